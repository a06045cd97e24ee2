"""Reports: counts, summary, JSON and the view shown to a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions import text as X
from riskloom.model import FINDING_COLUMNS
from riskloom.operators.findings import found_order, report_order, severity_name, severity_rank
from riskloom.plans.ranking import numbered


def finding_counts(findings: DataFrame, key: str = "repo_id") -> DataFrame:
    """Counts per severity, total and highest severity of each ``key``."""
    counts = findings.groupBy(key).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in reversed(K.SEVERITIES)],
        F.count("*").alias("total"),
        F.max(severity_rank(F.col("severity"))).alias("top"),
    )
    return counts.withColumn("highest_severity", F.coalesce(severity_name(F.col("top")), F.lit("none"))).drop("top")


def summary(risk_score: Column) -> Column:
    """Two sentences for a reader; needs the columns of ``finding_counts``."""
    c = F.col
    parts = F.array_compact(
        F.array(*[F.when(c(s) > 0, F.concat(c(s).cast("string"), F.lit(f" {s}"))) for s in reversed(K.SEVERITIES)])
    )
    urgent = (c("critical") + c("high")) > 0
    return F.when(c("total") == 0, "No weaknesses were found. Scan again after every larger change.").otherwise(
        F.concat(
            F.lit("Found "), c("total").cast("string"),
            F.when(c("total") == 1, " weakness (").otherwise(" weaknesses ("),
            F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("low-severity"),
            F.lit("), risk score "), risk_score.cast("string"), F.lit("/100. "),
            F.when(urgent, "Repair the critical and high ones before the next release.").otherwise("Repair them to strengthen the code."),
        )
    )


def complete_scans(scans: DataFrame) -> DataFrame:
    return scans.filter(F.col("status") == "complete")


def scan_status(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Status of each scan with its number of findings; 0 until it is complete."""
    counted = findings.groupBy("scan_id").agg(F.count("*").alias("n"))
    number = F.when(F.col("status") == "complete", F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint")
    return scans.join(counted, "scan_id", "left").withColumn("findings_count", number).drop("n")


def ordered(findings: DataFrame, stored: bool = False) -> DataFrame:
    """Findings with their place in the report of their repository.

    ``stored`` orders by the severity text, as reading back from the store does.
    """
    order = [F.col("severity").desc(), *found_order()] if stored else report_order()
    return numbered(findings, ["repo_id"], order, "place").withColumn("place", F.col("place") + 1)


def by_severity(findings: DataFrame, severity: str = "ALL") -> DataFrame:
    return findings if severity == "ALL" else findings.filter(F.lower("severity") == severity.lower())


PAGE = 1000


def listed_fields(findings: DataFrame) -> Column:
    """A finding as a report lists it, with every field; those that the table lacks are null."""
    have = set(findings.columns)
    names = [(n, t) for n, t in FINDING_COLUMNS if n not in ("repo_id", "ord")]
    fields = [(F.col(n) if n in have else F.lit(None).cast(t)).alias("file_path" if n == "path" else n) for n, t in names if n != "confidence"]
    return F.struct(*fields, F.round("confidence", 4).alias("confidence"))


def report_json(
    scans: DataFrame, findings: DataFrame, page: int = PAGE, contexts: DataFrame | None = None, share_base: str | None = None
) -> DataFrame:
    """(scan_id, page, report): the JSON document of each complete scan.

    ``contexts`` has a row for each scan_id, all of which goes into ``repo_context``; the share
    address is made of ``share_base`` and the scan's id.

    A document lists at most ``page`` findings; a scan with more has several, each with
    the same head, so no row grows with the scan.  Findings come by severity, highest
    first; the counts come from a partial aggregation of their own.
    """
    c = F.col
    order = [severity_rank(c("severity")).desc(), c("ord"), c("path"), c("line_number"), c("id")]
    placed = numbered(findings, ["scan_id"], order, "place").withColumn("page", F.floor(c("place") / page).cast("int"))
    listed = placed.groupBy("scan_id", "page").agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "place",
                        listed_fields(findings).alias("f"),
                    )
                )
            ),
            lambda r: r.f,
        ).alias("findings")
    )
    counts = finding_counts(findings, "scan_id")
    rows = complete_scans(scans).join(counts, "scan_id", "left").join(listed, "scan_id", "left")
    if contexts is not None:
        about = F.struct(*[n for n in contexts.columns if n != "scan_id"])
        rows = rows.join(contexts.select("scan_id", about.alias("repo_context")), "scan_id", "left")
    rows = rows.fillna(0, [*K.SEVERITIES, "total", "page"]).fillna("none", ["highest_severity"])
    score = F.coalesce("risk_score", F.lit(0))
    document = F.struct(
        "scan_id", "repo_url", "scanned_at", score.alias("risk_score"),
        F.coalesce("verdict", F.lit("UNKNOWN")).alias("verdict"), summary(score).alias("summary"), "highest_severity",
        F.struct(*reversed(K.SEVERITIES), "total").alias("finding_counts"),
        F.coalesce("findings", F.array().cast(listed.schema["findings"].dataType)).alias("findings"),
        "frameworks", *(["repo_context"] if contexts is not None else []), "files_scanned", "scan_ms", "models_used",
        F.lit(None).cast("string").alias("share_url") if share_base is None else F.concat(F.lit(share_base.rstrip("/") + "/"), "scan_id").alias("share_url"),
        "page",
        F.greatest(F.ceil(c("total") / page), F.lit(1)).alias("pages"),
    )
    return rows.select("scan_id", "page", F.to_json(document).alias("report"))


def report_overview(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per complete scan as its page shows it: head, counts and duration."""
    rows = complete_scans(scans).join(finding_counts(findings, "scan_id"), "scan_id", "left")
    rows = rows.fillna(0, [*K.SEVERITIES, "total", "files_scanned"]).fillna("none", ["highest_severity"])
    score = F.coalesce("risk_score", F.lit(0))
    return rows.select(
        "scan_id", F.coalesce("repo_url", F.lit("")).alias("repo_url"), F.col("scanned_at").alias("created_at"), score.alias("risk_score"),
        F.coalesce("verdict", F.lit("UNKNOWN")).alias("verdict"), summary(score).alias("summary"), "highest_severity", *reversed(K.SEVERITIES),
        "files_scanned", duration_seconds(F.col("scan_ms")).alias("duration_seconds"),
    )


# ------------------------------------------------------------------ view
def category_label(category: Column) -> Column:
    return X.lookup(K.LABEL, category, category)


def owasp_short(owasp: Column) -> Column:
    code = F.regexp_extract(F.coalesce(owasp, F.lit("")), r"^(A\d+)", 1)
    return F.when(code != "", F.concat(F.lit("OWASP "), code)).otherwise("OWASP")


def fix_language(path: Column) -> Column:
    ending = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(F.coalesce(path, F.lit("")) == "", "code").otherwise(X.lookup(K.FIX_LANGUAGE, ending, "code"))


def reader_confidence(risk: Column) -> Column:
    return F.when(risk == "high", "low").when(risk == "medium", "medium").otherwise("high")


def consensus(confirmed_by: Column) -> Column:
    """Map of reviewer to agreement: three fixed seats, then anyone else who confirmed."""
    names = F.filter(F.array_union(F.array(*[F.lit(s) for s in K.CONSENSUS_SEATS]), confirmed_by), lambda n: n != "")
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_contains(confirmed_by, n)))


def report_view(findings: DataFrame) -> DataFrame:
    """One row per finding, shaped for display."""
    c = F.col

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.when(c(name) != "", c(name)), F.lit(default))

    name = F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1)
    label = category_label(c("category"))
    confirmed_by = F.coalesce("confirmed_by", F.array().cast("array<string>"))
    return findings.select(
        "repo_id", "id",
        F.upper(text("severity", "low")).alias("severity"),
        owasp_short(c("owasp_cat")).alias("owasp"),
        text("owasp_cat").alias("owasp_cat"),
        label.alias("category"),
        text("path").alias("file"),
        F.coalesce("line_number", F.lit(0)).alias("line"),
        F.when(name != "", F.concat(label, F.lit(" in "), name)).otherwise(label).alias("title"),
        text("description").alias("description"),
        text("evidence").alias("evidence"),
        F.coalesce(F.when(c("recommendation") != "", c("recommendation")), F.when(c("fix") != "", c("fix")), F.lit("")).alias("recommendation"),
        text("fix").alias("fix"),
        text("fix_code").alias("fix_code"),
        text("fix_source").alias("fix_source"),
        "cvss_score",
        text("cvss_vector").alias("cvss_vector"),
        text("status", "candidate").alias("status"),
        text("validator").alias("validator"),
        fix_language(c("path")).alias("fix_language"),
        text("attack_chain", "An attacker may use this weakness against the application.").alias("attacker_scenario"),
        reader_confidence(c("false_positive_risk")).alias("confidence"),
        consensus(confirmed_by).alias("consensus"),
        confirmed_by.alias("confirmed_by"),
    )


def duration_seconds(scan_ms: Column) -> Column:
    return F.round(F.coalesce(scan_ms, F.lit(0)) / 1000).cast("bigint")
