"""The sliding-log quota as a stream with keyed state.

Each (key, endpoint) keeps two things in the state store: the ticks that wait for the
watermark, with their attempts, and the log of admitted stamps that can still matter.  Ticks may
arrive out of order; once the watermark has passed some, a timer decides them in order, with the
same jump from one admitted tick to the next as in batches.  A second timer removes the state of
a key that was quiet for a window.  State lies in RocksDB and is saved with each batch, so a lost
executor's keys go on elsewhere.

Attempts that come after the watermark can't change what was decided.  They are not dropped: they
leave as rows with ``late`` set and no verdict, and ``into_tables`` writes them to a table of
their own.  Endpoints without a limit are admitted as they are decided, without a log.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.functions import fixed as K
from riskloom.functions.workers import by_value
from riskloom.operators import quota as Q
from riskloom.operators.quota import jump, verdicts
from riskloom.streaming.state import STATE, settings

DECIDED = "key string, endpoint string, tick bigint, attempts bigint, admitted bigint, remaining int, retry_after int, late boolean"
_COUNTED = "key string, endpoint string, tick bigint, limit int, attempts bigint"


class SlidingLog(StatefulProcessor):
    """State and timers of one (key, endpoint)."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "tick bigint, attempts bigint, limit int")
        self.log = handle.getValueState("log", "stamps array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        fresh = []
        for r in rows:
            if r.tick < mark:
                yield Row(key=key[0], endpoint=key[1], tick=r.tick, attempts=r.attempts, admitted=None, remaining=None, retry_after=None, late=True)
            else:
                fresh.append((r.tick, r.attempts, r.limit))
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(fresh)[0] + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda x: x[0]) if self.waiting.exists() else []
        log = list(self.log.get()[0]) if self.log.exists() else []
        due = [x for x in waiting if x[0] < mark]
        if due:
            ticks, place = np.unique(np.array([x[0] for x in due], np.int64), return_inverse=True)
            attempts = np.bincount(place, [x[1] for x in due]).astype(np.int64)
            yield from self._decided(key, ticks, attempts, due[0][2], log)
            rest = waiting[len(due) :]
            self.waiting.put(rest) if rest else self.waiting.clear()
            if due[0][2] is not None:
                log = jump(ticks, attempts, due[0][2], self.span, log)
        else:
            rest = waiting
        # Ticks to come are not below the watermark.
        kept = [s for s in log if s >= mark - self.span]
        if kept:
            self.log.update((kept,))
        elif self.log.exists():
            self.log.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] + 1)
        elif kept:
            self.handle.registerTimer(kept[-1] + self.span + 1)

    def _decided(self, key, ticks, attempts, limit, log) -> Iterator[Row]:
        same = {"key": key[0], "endpoint": key[1]}
        if limit is None:
            for tick, n in zip(ticks.tolist(), attempts.tolist()):
                yield Row(**same, tick=tick, attempts=n, admitted=n, remaining=None, retry_after=0, late=False)
            return
        admitted, free, wait = verdicts(ticks, attempts, limit, self.span, log)
        for tick, n, a, f, w in zip(*(x.tolist() for x in (ticks, attempts, admitted, free, wait))):
            yield Row(**same, tick=tick, attempts=n, admitted=a, remaining=f, retry_after=w, late=False)

    def close(self) -> None:
        pass


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Attempts per tick of each batch of events, so that a busy key sends little on."""
    for batch in batches:
        # Not left out by a filter of the frame, which Spark would move to before the watermark.
        table = pa.Table.from_batches([batch.filter(batch.column("endpoint").is_valid())]).group_by(["key", "endpoint", "tick", "limit"]).aggregate([([], "count_all")])
        yield from table.rename_columns(["key", "endpoint", "tick", "limit", "attempts"]).to_batches()


def decided(events: DataFrame, limit: Column | None = None, seconds: int = K.QUOTA_WINDOW_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Verdicts per (key, endpoint, tick) of a stream (key, endpoint, ts), and late attempts.

    A row with a null endpoint moves the watermark but is no attempt, so a source that ends or
    falls silent can close its last window with one.
    """
    quota = Q.limit_of(F.col("endpoint")) if limit is None else limit
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    # The time goes on as a number, without the mark by which Spark would drop late rows unseen.
    rows = marked.select("key", "endpoint", Q.ticks(F.col("ts")).alias("tick"), quota.cast("int").alias("limit"))
    by_value(sys.modules[__name__], Q, K)
    return (
        rows.mapInArrow(_fold, _COUNTED)
        .groupBy("key", "endpoint")
        .transformWithState(SlidingLog(seconds * 1000), DECIDED, "Append", "EventTime")
    )


def into_tables(folder: str) -> Callable[[DataFrame, int], None]:
    """Handler that writes a batch's verdicts to ``folder/admitted`` and its late attempts to
    ``folder/late``, in folders named by the batch, so a repeated batch replaces its own."""

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, rows in (("admitted", batch.where("NOT late").drop("late")), ("late", batch.where("late").select("key", "endpoint", "tick", "attempts"))):
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return handle


def run(events: DataFrame, folder: str, limit: Column | None = None, seconds: int = K.QUOTA_WINDOW_SECONDS, lateness: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """Take in what the stream has now, going on from the state in ``folder``; (admitted, late)
    of all runs so far."""
    spark = events.sparkSession
    with settings(spark, STATE):
        stream = decided(events, limit, seconds, lateness).writeStream.foreachBatch(into_tables(folder))
        stream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    shape = DECIDED.removesuffix(", late boolean")
    late = "key string, endpoint string, tick bigint, attempts bigint"
    read = lambda name, columns: spark.read.schema(f"{columns}, batch bigint").parquet(f"{folder}/{name}")
    return read("admitted", shape), read("late", late)
