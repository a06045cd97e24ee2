"""What goes into the store, see ``scanlog``, and tables keyed by a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources import scanlog
from riskloom.sources.scanlog import SCANS, STORED_FINDING, align, bucket  # noqa: F401


def scan_headers(scores: DataFrame, contexts: DataFrame, files_scanned: DataFrame, as_of: Column) -> DataFrame:
    """One complete scan per repository, from scores, contexts and file counts."""
    context = F.struct(
        "kind", "reasons", "local_network_hints", "public_api_signals", "external_exposure_proven", "sensitive_public_surface"
    )
    about = contexts.select("repo_id", "frameworks", context.alias("repo_context"))
    joined = about.join(scores.select("repo_id", "risk_score", "verdict"), "repo_id", "left").join(files_scanned, "repo_id", "left")
    return joined.select(
        F.sha2(F.concat_ws("\u0001", "repo_id", as_of.cast("string")), 256).alias("scan_id"),
        F.col("repo_id").alias("repo_url"),
        F.lit("complete").alias("status"),
        F.coalesce("risk_score", F.lit(0)).alias("risk_score"),
        F.coalesce("verdict", F.lit("CLEAN")).alias("verdict"),
        F.coalesce("files_scanned", F.lit(0)).cast("int").alias("files_scanned"),
        F.lit(None).cast("int").alias("scan_ms"),
        "frameworks",
        "repo_context",
        F.array().cast("array<string>").alias("models_used"),
        F.lit(None).cast("string").alias("error_message"),
        as_of.cast("timestamp").alias("created_at"),
        as_of.cast("timestamp").alias("updated_at"),
    )


def write_findings(findings: DataFrame, folder: str) -> None:
    """Add whole scans to a store; a scan that it holds already is replaced."""
    scanlog.commit(findings.sparkSession, folder, findings)


def read_findings(spark: SparkSession, folder: str) -> DataFrame | None:
    """The stored findings, or None before the first write."""
    return scanlog.findings(spark, folder) if scanlog._commits(spark, folder) else None


def cascade_delete(findings: DataFrame, deleted: DataFrame) -> DataFrame:
    """Findings of scans that still exist."""
    return findings.join(deleted.select("scan_id").distinct(), "scan_id", "left_anti")


def keyed_upsert(events: DataFrame, key: str, ts: str, on_insert: list[str], always: dict[str, str], existing: DataFrame | None = None) -> DataFrame:
    """One row per key: ``on_insert`` columns from its first event, ``always`` columns
    (new name -> source column) from its last.

    With ``existing`` (the same shape plus created_at and last_seen_at) the stored first
    values win.  Both sides are partial aggregates, so a busy key is folded early.
    """
    c = F.col
    first = F.min(F.struct(c(ts).alias("t"), *[c(n).alias(n) for n in on_insert]))
    last = F.max(F.struct(c(ts).alias("t"), *[c(s).alias(n) for n, s in always.items()]))
    new = events.groupBy(key).agg(first.alias("a"), last.alias("z"))
    out = new.select(
        key, c("a.t").alias("created_at"), *[c("a")[n].alias(n) for n in on_insert], c("z.t").alias("last_seen_at"),
        *[c("z")[n].alias(n) for n in always],
    )
    return out if existing is None else merge_keyed(existing.unionByName(out), key, on_insert, list(always))


def merge_keyed(rows: DataFrame, key: str, on_insert: list[str], always: list[str]) -> DataFrame:
    """One row per key of rows that ``keyed_upsert`` has made, from one or more parts of the events."""
    a = F.min(F.struct("created_at", *on_insert)).alias("a")
    z = F.max(F.struct("last_seen_at", *always)).alias("z")
    return rows.groupBy(key).agg(a, z).select(key, "a.*", "z.*")
