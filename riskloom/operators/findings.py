"""Findings as a table: merging duplicates, final severity, order and risk score."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions import text as X
from riskloom.functions.workers import by_value
from riskloom.model import PROOF_FLAGS, REF
from riskloom.plans.ranking import numbered


def severity_rank(col: Column) -> Column:
    return X.lookup({s: i for i, s in enumerate(K.SEVERITIES)}, col, -1)


def status_rank(col: Column) -> Column:
    return X.lookup({s: i for i, s in enumerate(K.STATUSES)}, col, -1)


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in K.SEVERITIES]), rank)


def status_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in K.STATUSES]), rank)


def report_order(tie: list[Column] | None = None) -> list[Column]:
    """Severity, status and rounded confidence, all descending; then the order found."""
    return [
        severity_rank(F.col("severity")).desc(),
        status_rank(F.col("status")).desc(),
        F.round("confidence", 4).desc(),
        *(found_order() if tie is None else tie),
    ]


def found_order() -> list[Column]:
    """Scanner, file, check, line: the order in which a scan meets its findings."""
    ord_ = F.col("ord")
    return [
        F.floor(ord_ / 100_000_000),
        F.lower("path"),
        F.col("path"),
        F.floor(ord_ / 10_000_000),
        F.col("line_number"),
        ord_,
        F.col("evidence"),
        F.col("id"),
    ]


# ------------------------------------------------------------------ duplicates
_FIRST_TEXT = ["description", "attack_chain", "fix_code", "recommendation", "fix", "fix_source", "validator", "owasp_cat", "cvss_vector"]
_FIRST_ROW = ["id", "rule_id", "evidence", "false_positive_risk"]
_KEY = ["repo_id", "category", "path", "line_number", "evidence_key"]


def _ordered_union(variants: Column, pick, kind: str) -> Column:
    """Union of the arrays of the variants in their order; the first keeps its repeats."""
    first = pick(F.get(variants, 0))
    rest = F.flatten(F.transform(F.slice(variants, F.lit(2), F.size(variants)), pick))
    added = F.array_except(F.array_distinct(rest), first)
    return F.concat(first, added).cast(kind)


def dedupe(findings: DataFrame) -> DataFrame:
    """One row per (repository, category, path, line, normalised evidence).

    Two aggregations.  The first also groups by the array values, so that any number
    of equal copies folds on the map side; the second merges the few variants left.
    Neither collects copies.
    """
    c = F.col

    def filled(name: str) -> Column:
        present = c(name).isNotNull() & (c(name) != "")
        return F.min(F.when(present, F.struct(c("ord").alias("ord"), c(name).alias("v")))).alias(name)

    arrays = F.struct(c("evidence_refs"), c("confirmed_by"), c("proof.notes").alias("notes"))
    keyed = findings.withColumns({"evidence_key": X.normalized(c("evidence")), "arrays": arrays})
    folded = keyed.groupBy(*_KEY, "arrays").agg(
        F.max(severity_rank(c("severity"))).alias("severity"),
        F.max(status_rank(c("status"))).alias("status"),
        F.max("confidence").alias("confidence"),
        *[F.bool_or(c("proof")[f]).alias(f) for f in PROOF_FLAGS],
        F.min(F.struct(c("ord").alias("ord"), *[c(n).alias(n) for n in _FIRST_ROW])).alias("head"),
        F.min(F.when(c("cvss_score").isNotNull(), F.struct(c("ord").alias("ord"), c("cvss_score").alias("v")))).alias("cvss_score"),
        *[filled(n) for n in _FIRST_TEXT],
    )
    merged = folded.groupBy(*_KEY).agg(
        F.max("severity").alias("severity"),
        F.max("status").alias("status"),
        F.max("confidence").alias("confidence"),
        *[F.bool_or(f).alias(f) for f in PROOF_FLAGS],
        F.min("head").alias("head"),
        F.min("cvss_score").alias("cvss_score"),
        *[F.min(n).alias(n) for n in _FIRST_TEXT],
        F.sort_array(F.collect_list(F.struct(c("head.ord").alias("ord"), c("head.id").alias("id"), c("arrays")))).alias("variants"),
    )
    notes = _ordered_union(c("variants"), lambda v: v.arrays.notes, "array<string>")
    blank = {n: F.lit("") for n in ("description", "attack_chain", "recommendation", "fix", "fix_source")}
    return merged.select(
        "repo_id",
        c("head.id").alias("id"),
        c("head.rule_id").alias("rule_id"),
        "category",
        status_name(c("status")).alias("status"),
        severity_name(c("severity")).alias("severity"),
        "confidence",
        "path",
        "line_number",
        c("head.evidence").alias("evidence"),
        _ordered_union(c("variants"), lambda v: v.arrays.evidence_refs, f"array<{REF}>").alias("evidence_refs"),
        F.struct(*PROOF_FLAGS, notes.alias("notes")).alias("proof"),
        *[F.coalesce(c(n)["v"], blank[n]).alias(n) if n in blank else c(n)["v"].alias(n) for n in _FIRST_TEXT],
        c("cvss_score")["v"].alias("cvss_score"),
        _ordered_union(c("variants"), lambda v: v.arrays.confirmed_by, "array<string>").alias("confirmed_by"),
        c("head.false_positive_risk").alias("false_positive_risk"),
        c("head.ord").alias("ord"),
    )


# ------------------------------------------------------------------ gates and final scoring
def contradiction_gate(findings: DataFrame) -> DataFrame:
    """Reject confirmed findings whose own evidence does not carry them."""
    c = F.col
    confirmed = c("status") == "confirmed"
    bare = confirmed & ((F.size("evidence_refs") == 0) | (c("line_number") <= 0))
    complete = c("proof.source_present") & c("proof.sink_present") & c("proof.path_present")
    open_path = confirmed & ~bare & c("category").isin("sql_injection", "command_injection") & ~complete
    note = F.when(bare, "Rejected by the contradiction gate: no evidence or source line.").when(
        open_path, "Rejected by the contradiction gate: the path is not fully proven."
    )
    return findings.withColumns({"bare": bare, "open_path": open_path, "gate_note": note}).withColumns(
        {
            "status": F.when(c("bare") | c("open_path"), "rejected").otherwise(c("status")),
            "confidence": F.when(c("bare"), 0.0)
            .when(c("open_path"), F.least(c("confidence"), F.lit(0.45)))
            .otherwise(c("confidence")),
            "proof": F.when(
                c("gate_note").isNotNull(),
                c("proof").withField("notes", F.concat(c("proof.notes"), F.array(c("gate_note")))),
            ).otherwise(c("proof")),
        }
    ).drop("bare", "open_path", "gate_note")


def final_scoring(findings: DataFrame) -> DataFrame:
    """Severity, score, vector and attack chain of confirmed findings; cleared for others."""
    c = F.col
    proven = c("proof.exploitability_proven")
    unsigned = F.contains(F.lower("evidence"), F.lit("none"))
    cat = c("category")
    secret = cat.isin("hardcoded_secret", "committed_env_file")
    cases = [
        ((cat == "sql_injection") & proven, ("sql_injection", "proven")),
        (cat == "sql_injection", ("sql_injection", "unproven")),
        (cat == "command_injection", ("command_injection", "any")),
        (cat == "log_injection", ("log_injection", "any")),
        (secret & (c("severity") == "critical"), ("secret", "critical")),
        (secret, ("secret", "other")),
        ((cat == "weak_jwt") & unsigned, ("weak_jwt", "none")),
        (cat == "weak_jwt", ("weak_jwt", "other")),
        (cat == "slopsquatting", ("slopsquatting", "any")),
    ]
    by_severity = {s: F.struct(c("severity").alias("severity"), F.lit(n).alias("score"), F.lit(v).alias("vector")) for s, (n, v) in K.CVSS_BY_SEVERITY.items()}
    outcome = F.when(c("status") != "confirmed", F.struct(c("severity").alias("severity"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("vector")))
    for condition, key in cases:
        severity, score, vector = K.CVSS_BY_CATEGORY[key]
        outcome = outcome.when(
            condition,
            F.struct((F.lit(severity) if severity else c("severity")).alias("severity"), F.lit(score).alias("score"), F.lit(vector).alias("vector")),
        )
    for name, value in by_severity.items():
        outcome = outcome.when(c("severity") == name, value)
    condition = (
        F.when(cat == "sql_injection", "attacker-controlled input reaches a SQL statement that binds no parameters")
        .when(cat == "command_injection", "attacker-controlled input reaches a shell command")
        .when((cat == "weak_jwt") & unsigned, "the signature of tokens is not checked")
    )
    chain = F.when((c("status") == "confirmed") & proven & condition.isNotNull(), F.concat(
        F.lit("Confirmed exploitability: "), condition, F.lit(". Evidence is quoted at "), c("path"), F.lit(":"), c("line_number").cast("string"), F.lit("."),
    ))
    other = cat.isin("log_injection") | (c("status") != "confirmed")
    kept = F.when(
        other | ((cat == "sql_injection") & proven) | ((cat == "weak_jwt") & unsigned), ""
    ).otherwise(c("attack_chain"))
    return (
        findings.withColumns({"outcome": outcome, "attack_chain": F.coalesce(chain, kept)})
        .withColumns(
            {
                "severity": c("outcome.severity"),
                "cvss_score": c("outcome.score"),
                "cvss_vector": c("outcome.vector"),
            }
        )
        .drop("outcome")
    )


def visible(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("status") != "rejected")


# ------------------------------------------------------------------ score
def _points() -> Column:
    """What a finding is worth before saturation."""
    damped = F.col("category").isin(*K.AI) & ~F.col("exploitability_proven")
    multiplier = X.lookup(K.STATUS_MULTIPLIER, F.col("status"), 0.25)
    multiplier = F.when(damped, multiplier * F.lit(K.UNPROVEN_AI_FACTOR)).otherwise(multiplier)
    return X.lookup(K.SEVERITY_WEIGHT, F.col("severity")) * multiplier


def saturation(index: Column) -> Column:
    return F.greatest(F.lit(K.SATURATION_FLOOR), F.lit(1.0) / (F.lit(1.0) + index * F.lit(K.SATURATION_STEP)))


# from this position on the floor applies whatever the order
SATURATED_AT = next(k for k in range(1000) if 1.0 / (1.0 + k * K.SATURATION_STEP) <= K.SATURATION_FLOOR)


def saturation_ranks(findings: DataFrame) -> DataFrame:
    """Position of each finding within its repository and category, with its factor."""
    placed = numbered(visible(findings), ["repo_id", "category"], report_order(), "position")
    return placed.withColumn("factor", saturation(F.col("position")))


# what decides the order of findings, ascending, with the points of each
_ORDER = [
    "level int", "sureness double", "scanner long", "low string", "path string", "chk long", "line_number int", "ord long", "evidence string", "id string",
    "points double",
]
_HEADS = ", ".join(["repo_id string", "category string", *_ORDER, "total double", "n_findings long"])


def _heads(top: int, most: int = 200_000):
    """Of each partition's findings the first ``top`` of every (repo_id, category), and the sum and
    number of all of them beside the first.  Batches are folded as they come; the state has ``top``
    rows for a group, and goes out early should there be more than ``most`` of them."""
    group, order = ["repo_id", "category"], [f.split()[0] for f in _ORDER]
    names = [*group, *order, "total", "n_findings"]

    def folded(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(n, "ascending") for n in (*group, *order)])
        labels = [rows.column(n).combine_chunks().dictionary_encode().indices.to_numpy() for n in group]
        new = np.ones(len(rows), bool)
        new[1:] = (labels[0][1:] != labels[0][:-1]) | (labels[1][1:] != labels[1][:-1])
        first = np.flatnonzero(new)
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        sums = [np.zeros(len(rows), rows.column(n).to_numpy().dtype) for n in ("total", "n_findings")]
        for out, n in zip(sums, ("total", "n_findings")):
            out[first] = np.add.reduceat(rows.column(n).to_numpy(), first)
        rows = pa.table([*(rows.column(n) for n in (*group, *order)), *map(pa.array, sums)], names=names)
        return rows.filter(pa.array(place < top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if len(batch):
                rows = pa.Table.from_arrays([batch.column(n) for n in names], names=names)  # without Spark's marks of columns that can't be null
                state = folded(rows if state is None else pa.concat_tables([state, rows]))
                if len(state) > most:
                    yield from state.combine_chunks().to_batches()
                    state = None
        if state is not None:
            yield from state.combine_chunks().to_batches()

    return run


def risk_scores(findings: DataFrame) -> DataFrame:
    """Risk score and verdict per repository.

    Only the first findings of a category stand above the floor factor.  The score is the floor
    share of all findings plus the surplus of those first ones.  Both come from one pass: each
    task folds its findings to the first few of every group, with the sums of all, before
    anything is shuffled; few rows for a group and task meet in two steps.  Outside the AI
    categories severity and status alone give the points, so there the order needs no more.
    """
    c = F.col
    rows = visible(findings).withColumn("exploitability_proven", c("proof.exploitability_proven"))
    ties = c("category").isin(*K.AI)
    rank = severity_rank(c("severity")) * len(K.STATUSES) + status_rank(c("status"))
    order = {
        "level": -rank, "sureness": F.when(ties, -F.round("confidence", 4)), "scanner": F.when(ties, F.floor(c("ord") / 100_000_000)),
        "low": F.when(ties, F.lower("path")), "path": F.when(ties, c("path")), "chk": F.when(ties, F.floor(c("ord") / 10_000_000)),
        "line_number": F.when(ties, c("line_number")), "ord": F.when(ties, c("ord")), "evidence": F.when(ties, c("evidence")),
        "id": F.when(ties, c("id")), "points": _points(), "total": _points(), "n_findings": F.lit(1),
    }
    kinds = dict(f.split() for f in _HEADS.split(", "))
    narrow = rows.select("repo_id", "category", *[x.cast(kinds[n]).alias(n) for n, x in order.items()])
    by_value(sys.modules[__name__], K)
    heads = narrow.mapInArrow(_heads(SATURATED_AT), _HEADS).withColumn("salt", F.spark_partition_id() % 64)
    names = [f.split()[0] for f in _ORDER]
    sums = [F.sum("total").alias("total"), F.sum("n_findings").alias("n_findings")]
    some = heads.groupBy("repo_id", "category", "salt").agg(*sums, F.slice(F.array_sort(F.collect_list(F.struct(*names))), 1, SATURATED_AT).alias("top"))
    per = some.groupBy("repo_id", "category").agg(*sums, F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, SATURATED_AT).alias("top"))
    surplus = F.aggregate(
        F.transform("top", lambda x, i: x["points"] * (saturation(i.cast("double")) - K.SATURATION_FLOOR)), F.lit(0.0), lambda a, x: a + x
    )
    total = per.withColumn("raw", c("total") * K.SATURATION_FLOOR + surplus).groupBy("repo_id").agg(
        F.sum("raw").alias("raw"), F.sum("n_findings").alias("n_findings")
    )
    # the sum is rounded before it is cut to a whole number, so that no engine's
    # last bits decide
    score = F.least(F.lit(100), F.floor(F.round("raw", 6))).cast("int")
    return total.select("repo_id", score.alias("risk_score"), "n_findings").withColumn("verdict", verdict(F.col("risk_score")))


def verdict(score: Column) -> Column:
    out = None
    for limit, name in K.VERDICT_BANDS:
        out = F.when(score <= limit, name) if out is None else out.when(score <= limit, name)
    return out.otherwise(K.VERDICT_TOP)
