"""Streams: scan status, files that arrive over time and keyed tables; quota has a module of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from riskloom.operators import detect as D
from riskloom.sources.store import keyed_upsert, merge_keyed
from riskloom.streaming.runs import current, into_runs
from riskloom.streaming.state import STATE, settings


def latest_status(events: DataFrame) -> DataFrame:
    """Latest state of each scan from its status events (scan_id, status, error_message, ts)."""
    last = F.max(F.struct("ts", "seq", "status", "error_message"))
    return events.groupBy("scan_id").agg(last.alias("s")).select("scan_id", "s.status", "s.error_message", F.col("s.ts").alias("updated_at"), "s.seq")


def scan_stream(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Candidates of files as they arrive; stateless, so each file is scanned once.

    Repository-wide steps follow per micro-batch, see ``each_batch``.
    """
    wanted = [k for k in (D.DETECTOR_KEYS if keys is None else keys) if k != "DET-19"]
    return D.candidates(files, wanted)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Hand every micro-batch to ``handle``; finished input ends the query."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def upsert_batch(folder: str, key: str, ts: str, on_insert: list[str], always: dict[str, str], every: int = 8) -> Callable[[DataFrame, int], None]:
    """Handler that merges micro-batches into a keyed table of runs: a batch writes its own keys only."""
    return into_runs(
        folder, key, lambda batch: keyed_upsert(batch, key, ts, on_insert, always), lambda rows: merge_keyed(rows, key, on_insert, list(always)), every
    )


def upserted(spark: SparkSession, folder: str, schema, key: str, on_insert: list[str], always: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """The keyed table that ``upsert_batch`` keeps, or some keys of it."""
    return current(spark, folder, schema, lambda rows: merge_keyed(rows, key, on_insert, list(always)), key, keys)


def newest_status(rows: DataFrame) -> DataFrame:
    """Of the states of a scan the last one."""
    last = F.max(F.struct("updated_at", "seq", "status", "error_message"))
    return rows.groupBy("scan_id").agg(last.alias("s")).select("scan_id", "s.status", "s.error_message", "s.updated_at", "s.seq")


def keep_status(events: DataFrame, folder: str) -> None:
    """Take in the status events (scan_id, status, error_message, ts, seq) that the stream has now;
    the states they change go to a table of runs in ``folder``.

    The stream's state has a row for each scan, and a batch gives out the scans it changed.
    """
    handle = into_runs(f"{folder}/runs", "scan_id", lambda batch: batch, newest_status)
    with settings(events.sparkSession, STATE):
        changed = latest_status(events).writeStream.outputMode("update").foreachBatch(handle)
        changed.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


STATUS = "scan_id string, status string, error_message string, updated_at timestamp, seq bigint"


def status_now(spark: SparkSession, folder: str) -> DataFrame:
    """The table that ``keep_status`` keeps."""
    return current(spark, f"{folder}/runs", STATUS, newest_status)
