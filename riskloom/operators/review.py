"""Working with outside reviewers: batches of findings out, verdicts and fixes back in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions import text as X
from riskloom.functions.prose import advice
from riskloom.model import PROOF_FLAGS
from riskloom.operators.findings import found_order
from riskloom.plans.ranking import numbered

VERDICTS = (
    "id string, verdict string, confidence double, "
    f"proof struct<{','.join(f + ':boolean' for f in PROOF_FLAGS)}>, attack_scenario string, rationale string"
)
FIXES = "id string, status string, confidence double, patch string, recommendation string, explanation string"


def required_elements(category: Column) -> Column:
    return (
        F.when(
            category.isin("sql_injection", "command_injection", "log_injection"),
            F.array(F.lit("source_present"), F.lit("sink_present"), F.lit("path_present")),
        )
        .when(
            category.isin("hardcoded_secret", "weak_jwt", "slopsquatting", "committed_env_file"),
            F.array(F.lit("quoted_evidence")),
        )
        .otherwise(F.array(F.lit("quoted_evidence"), F.lit("source_line")))
    )


def verify_payload() -> Column:
    c = F.col
    return F.struct(
        "id", "category", "severity", "description", c("path").alias("file_path"), "line_number",
        F.round("confidence", 4).alias("confidence_hint"), "evidence_refs", "proof",
        required_elements(c("category")).alias("required_elements"),
    )


def fix_payload() -> Column:
    """Needs ``context``, the numbered lines around the finding."""
    c = F.col
    return F.struct(
        "id", "category", c("path").alias("file_path"), "line_number", "severity", "evidence_refs", "proof", "context",
        "description",
    )


def in_batches(findings: DataFrame, payload: Column, size: int) -> DataFrame:
    """(repo_id, batch, n, payload): findings in the order found, ``size`` to a batch.

    A batch is one request to a reviewer.
    """
    placed = numbered(findings.withColumn("payload", payload), ["repo_id"], found_order(), "place")
    batched = placed.withColumn("batch", F.floor(F.col("place") / size).cast("int"))
    return batched.groupBy("repo_id", "batch").agg(
        F.count("*").alias("n"),
        F.to_json(
            F.struct(F.transform(F.array_sort(F.collect_list(F.struct("place", "payload"))), lambda p: p.payload).alias("findings"))
        ).alias("payload"),
    )


def verify_batches(findings: DataFrame) -> DataFrame:
    return in_batches(findings.filter(F.col("status") != "rejected"), verify_payload(), K.VERIFY_BATCH)


def source_lines(findings: DataFrame, files: DataFrame, window: int = K.FIX_WINDOW) -> DataFrame:
    """(repo_id, path, line_number, context): the numbered lines around each place that has a finding.

    A file's text meets the distinct lines wanted of it, not its findings, and goes no further.
    """
    wanted = findings.where("path <> '' AND line_number > 0").groupBy("repo_id", "path").agg(F.collect_set("line_number").alias("wanted"))
    texts = files.select("repo_id", "path", X.split_lines(F.col("text")).alias("lines")).join(wanted, ["repo_id", "path"])
    each = texts.select("repo_id", "path", "lines", F.explode("wanted").alias("line_number"))
    at = F.col("line_number")
    framed = each.select("repo_id", "path", "line_number", X.line_frame(F.col("lines"), at, window, window).alias("frame"))
    first = F.greatest(at - window, F.lit(1))
    numbered_lines = F.transform("frame", lambda line, i: F.struct((first + i).cast("int").alias("line_number"), line.alias("code")))
    return framed.select("repo_id", "path", "line_number", numbered_lines.alias("context"))


def fix_batches(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Requests for fixes of confirmed findings, each with the source lines around it; empty where
    the file or the line is not there."""
    confirmed = findings.filter(F.col("status") == "confirmed")
    lines = source_lines(confirmed, files)
    context = F.coalesce("context", F.array().cast("array<struct<line_number:int,code:string>>"))
    return in_batches(confirmed.join(lines, ["repo_id", "path", "line_number"], "left").withColumn("context", context), fix_payload(), K.FIX_BATCH)


def parse_verdicts(answers: DataFrame) -> DataFrame:
    """Verdict rows from JSON answers (column ``answer``: object keyed by finding id)."""
    inner = "struct<verdict:string,confidence:double,proof:struct<" + ",".join(f"{f}:boolean" for f in PROOF_FLAGS) + ">,attack_scenario:string,rationale:string>"
    entries = answers.select(F.explode(F.from_json("answer", f"map<string,{inner}>")).alias("id", "v"))
    return entries.select("id", "v.*")


def merge_verdicts(findings: DataFrame, verdicts: DataFrame, validator: str = "verifier") -> DataFrame:
    """Take over the verdicts; a candidate without one goes to review.

    Call it only when the reviewer answered at all: with no verdict rows every
    candidate is demoted.  Rejected findings are not part of the exchange.
    """
    c = F.col
    v = verdicts.select(
        "id", c("verdict").alias("v_status"), c("confidence").alias("v_confidence"), c("proof").alias("v_proof"),
        c("attack_scenario").alias("v_scenario"),
    )
    open_ = c("status") != "rejected"
    known = open_ & c("v_status").isNotNull()
    rows = findings.join(v, "id", "left").withColumn("known", known)
    rows = rows.withColumns(
        {
            # a status outside the domain keeps the old one
            "status": F.when(
                c("known"), F.when(c("v_status").isin("confirmed", "rejected", "needs_review", "candidate"), c("v_status")).otherwise(c("status"))
            )
            .when(c("status") == "candidate", "needs_review")
            .otherwise(c("status")),
            "confidence": F.when(c("known"), F.coalesce("v_confidence", "confidence")).otherwise(c("confidence")),
            "proof": F.when(
                c("known"),
                F.struct(
                    *[F.coalesce(c("v_proof")[f], c("proof")[f]).alias(f) for f in PROOF_FLAGS], c("proof.notes").alias("notes")
                ),
            ).otherwise(c("proof")),
            "validator": F.when(c("known"), validator).otherwise(c("validator")),
        }
    )
    confirmed = c("known") & (c("status") == "confirmed")
    return rows.withColumns(
        {
            "confirmed_by": F.when(confirmed, F.array_union("confirmed_by", F.array(F.lit(validator)))).otherwise(c("confirmed_by")),
            "attack_chain": F.when(confirmed & c("proof.exploitability_proven"), F.coalesce("v_scenario", F.lit(""))).otherwise(c("attack_chain")),
        }
    ).drop("known", "v_status", "v_confidence", "v_proof", "v_scenario")


def models_used(findings: DataFrame) -> DataFrame:
    """Validators that took part, per repository."""
    return (
        findings.filter(F.col("validator").isNotNull())
        .groupBy("repo_id")
        .agg(F.sort_array(F.collect_set("validator")).alias("models_used"))
    )


def plausible_patch(patch: Column, path: Column) -> Column:
    """The patch names the file and holds a hunk."""
    return F.coalesce((X.strip(patch) != "") & F.contains(patch, path) & F.contains(patch, F.lit("@@")), F.lit(False))


def merge_fixes(findings: DataFrame, fixes: DataFrame, source: str = "reviewer") -> DataFrame:
    """Take over proposed fixes of confirmed findings.

    ``fixes`` holds the FIXES columns plus ``accepted`` and ``reasons`` of the patch
    check (null where no check ran).  The prose counts in any case, the patch only
    when it was accepted.
    """
    c = F.col
    x = fixes.select(
        "id", c("status").alias("x_status"), c("patch").alias("x_patch"), X.strip(F.coalesce("recommendation", F.lit(""))).alias("x_recommendation"),
        X.strip(F.coalesce("explanation", F.lit(""))).alias("x_explanation"), "accepted", "reasons",
    )
    rows = findings.join(x, "id", "left")
    known = (c("status") == "confirmed") & c("x_status").isNotNull()
    tried = known & (c("x_status") == "patch_ready") & plausible_patch(c("x_patch"), c("path"))
    rows = rows.withColumns({"known": known, "taken": tried & F.coalesce("accepted", F.lit(False)), "refused": tried & ~F.coalesce("accepted", F.lit(False))})
    return rows.withColumns(
        {
            "fix_code": F.when(c("taken"), c("x_patch")).otherwise(c("fix_code")),
            "recommendation": F.when(c("known") & (c("x_recommendation") != ""), c("x_recommendation")).otherwise(c("recommendation")),
            "fix": F.when(c("known") & (c("x_explanation") != ""), c("x_explanation")).otherwise(c("fix")),
            "fix_source": F.when(c("known") & (c("x_explanation") != ""), source).otherwise(c("fix_source")),
            "proof": F.when(
                c("refused") & c("reasons").isNotNull(),
                c("proof").withField(
                    "notes", F.concat(c("proof.notes"), F.transform("reasons", lambda r: F.concat(F.lit("Fix rejected: "), r)))
                ),
            ).otherwise(c("proof")),
        }
    ).drop("known", "taken", "refused", "x_status", "x_patch", "x_recommendation", "x_explanation", "accepted", "reasons")


def remediate(findings: DataFrame, source: str = "static_table") -> DataFrame:
    """Standard advice for findings that are not rejected and lack one of the two texts."""
    c = F.col
    short, long = advice(c("category"))
    gap = (c("status") != "rejected") & ~((c("recommendation") != "") & (c("fix") != "")) & short.isNotNull()
    # advice beside a reviewer's patch keeps the plain tag
    tag = F.when(F.coalesce(c("fix_code"), F.lit("")) == "", F.lit(source)).otherwise("static_table")
    return findings.withColumn("gap", gap).withColumns(
        {
            "recommendation": F.when(c("gap"), short).otherwise(c("recommendation")),
            "fix": F.when(c("gap"), long).otherwise(c("fix")),
            "fix_source": F.when(c("gap"), tag).otherwise(c("fix_source")),
        }
    ).drop("gap")
