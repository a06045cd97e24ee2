"""Sliding-log quota: an attempt is admitted while fewer than ``limit`` admitted ones
lie in the window before it.  Denied attempts leave no trace."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions.text import lookup
from riskloom.functions.workers import by_value

TICK_MICROS = 1000  # the log keeps milliseconds


def ticks(ts: Column) -> Column:
    """Milliseconds of a timestamp."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / TICK_MICROS).cast("bigint")


def limit_of(endpoint: Column) -> Column:
    """Allowed calls per window; null for endpoints without a quota."""
    return lookup(K.QUOTA, endpoint)


def attempts_in_window(events: DataFrame, seconds: int = K.QUOTA_WINDOW_SECONDS) -> DataFrame:
    """Number of attempts of a key in the window that ends with each event.

    Exact without sorting a key in one place: attempts are first counted per key and
    tick, ticks are cut into blocks of one window length, and each block is compared
    only with itself and the one before it.  A busy key spreads over its blocks.
    """
    c = F.col
    span = seconds * 1000
    counted = events.groupBy("key", "endpoint", ticks(c("ts")).alias("tick")).agg(F.count("*").alias("attempts"))
    blocked = counted.withColumn("block", F.floor(c("tick") / span))
    # every tick also serves the block after its own, as history only
    spread = blocked.withColumn("at", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("block", c("block") + c("at"))
    window = W.partitionBy("key", "endpoint", "block").orderBy("tick").rangeBetween(-span, 0)
    return (
        spread.withColumn("in_window", F.sum("attempts").over(window))
        .filter(c("at") == 0)
        .select("key", "endpoint", "tick", "attempts", "in_window")
    )


_ADMISSIONS = "key string, endpoint string, tick bigint, attempts bigint, admitted bigint, remaining int, retry_after int"
_ENTRIES = "key string, endpoint string, block bigint, log array<bigint>"
#: Ticks are packed in blocks of this many milliseconds, so a block holds at most as many.
BLOCK = 3_600_000


def jump(ticks, attempts, limit: int, span: int, log: list[int]) -> list[int]:
    """The log's stamps with those that ascending ticks add to it.

    With ``limit`` stamps in the log the next one can't be earlier than a window after the
    oldest of them, so the walk goes there by search: a step for each admitted tick, however
    many are denied in between.
    """
    log, at, n = list(log), 0, len(ticks)
    while at < n and limit > 0:
        if len(log) >= limit:
            free = log[-limit] + span + 1
            if ticks[at] < free:
                at = bisect_left(ticks, free, at)
                continue
        tick = int(ticks[at])
        held = sum(s >= tick - span for s in log[-limit:])
        log += [tick] * min(int(attempts[at]), limit - held)
        at += 1
    return log


def verdicts(ticks: np.ndarray, attempts: np.ndarray, limit: int, span: int, log: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(admitted, remaining, retry_after) of ascending ticks, for the log before them."""
    return _judged(ticks, attempts, np.int64(limit), span, np.array(jump(ticks, attempts, limit, span, log), np.int64))


def _judged(ticks, attempts, limit, span: int, stamps, shift=0):
    """``verdicts`` for all stamps that are ever admitted.  Ticks and stamps of several logs may
    follow each other if ``shift`` moves each log's far from the others'."""
    at, marks = ticks + shift, stamps
    first = np.searchsorted(marks, at - span)
    free = np.maximum(0, limit - (np.searchsorted(marks, at) - first))
    admitted = np.minimum(attempts, free)
    oldest = np.append(marks, 0)[np.minimum(first, len(marks))]
    wait = np.where(attempts > admitted, np.where(limit > 0, np.maximum(1, -((at - oldest - span) // 1000)), max(1, span // 1000)), 0)
    return admitted, free, wait


def _walk(span: int):
    """Pass the log through a key's blocks in order; what it was before each block goes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, log = None, []
        for batch in batches:
            logs = []
            keys = zip(batch.column("key").to_pylist(), batch.column("endpoint").to_pylist())
            for key, limit, ticks, attempts in zip(keys, batch.column("limit").to_pylist(), _lists(batch, "ticks"), _lists(batch, "attempts")):
                if key != current:
                    current, log = key, []
                log = [s for s in log if s >= ticks[0] - span]
                logs.append(log)
                log = jump(ticks.tolist(), attempts, limit, span, log)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("endpoint"), batch.column("block"), pa.array(logs, pa.list_(pa.int64()))], names=["key", "endpoint", "block", "log"]
            )

    return run


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    column = batch.column(name)
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(ends, ends[1:]))


def _decide(span: int):
    """A row for each tick of a block, from the log before the block.  The blocks of a batch are
    judged together: each is moved to a stretch of time of its own."""
    names = [f.split()[0] for f in _ADMISSIONS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits = batch.column("limit").to_numpy().astype(np.int64)
            ticks, attempts = (batch.column(n).flatten().to_numpy() for n in ("ticks", "attempts"))
            sizes = np.diff(batch.column("ticks").offsets.to_numpy())
            whose = np.repeat(np.arange(len(batch)), sizes)
            apart = np.arange(len(batch), dtype=np.int64) * 2 * (span + BLOCK)
            starts = np.array([0], np.int64) if not len(ticks) else ticks[np.cumsum(sizes) - sizes]
            shifts, stamps = apart - starts, []
            blocks = zip(_lists(batch, "ticks"), _lists(batch, "attempts"), limits.tolist(), batch.column("log").to_pylist(), shifts.tolist())
            for t, n, limit, log, shift in blocks:
                stamps += [x + shift for x in jump(t.tolist(), n, limit, span, log)]
            judged = _judged(ticks, attempts, limits[whose], span, np.array(stamps, np.int64), shifts[whose])
            same = [batch.column(c).take(pa.array(whose)) for c in ("key", "endpoint")]
            numbers = [pa.array(x, k) for x, k in zip((ticks, attempts, *judged), (pa.int64(),) * 3 + (pa.int32(),) * 2)]
            yield pa.RecordBatch.from_arrays([*same, *numbers], names=names)

    return run


def count_ticks(events: DataFrame, limit: Column | None = None) -> DataFrame:
    """(key, endpoint, tick, attempts, limit): attempts per key and millisecond."""
    quota = limit_of(F.col("endpoint")) if limit is None else limit
    counted = events.groupBy("key", "endpoint", ticks(F.col("ts")).alias("tick")).agg(F.count("*").alias("attempts"))
    return counted.withColumn("limit", quota.cast("int"))


def packed(counted: DataFrame) -> DataFrame:
    """(key, endpoint, block, limit, ticks, attempts): the ticks of a block as sorted lists."""
    pairs = F.array_sort(F.collect_list(F.struct("tick", "attempts")))
    rows = counted.groupBy("key", "endpoint", "limit", F.floor(F.col("tick") / BLOCK).alias("block")).agg(pairs.alias("pairs"))
    return rows.select("key", "endpoint", "block", "limit", F.col("pairs.tick").alias("ticks"), F.col("pairs.attempts").alias("attempts"))


def fold_ticks(counted: DataFrame, seconds: int = K.QUOTA_WINDOW_SECONDS) -> DataFrame:
    """Admissions of counted ticks."""
    c = F.col
    span = seconds * 1000
    free = counted.filter(c("limit").isNull()).select(
        "key", "endpoint", "tick", "attempts", c("attempts").alias("admitted"),
        F.lit(None).cast("int").alias("remaining"), F.lit(0).alias("retry_after"),
    )
    blocks = packed(counted.filter(c("limit").isNotNull()))
    walked = blocks.withColumn("attempts", F.transform("attempts", lambda n: F.least(n, c("limit").cast("long"))))
    by_value(sys.modules[__name__], K)
    entries = walked.repartition("key", "endpoint").sortWithinPartitions("key", "endpoint", "block").mapInArrow(_walk(span), _ENTRIES)
    # Null keys are keys too.
    left, right = blocks.alias("b"), entries.alias("e")
    same = [c(f"b.{k}").eqNullSafe(c(f"e.{k}")) for k in ("key", "endpoint", "block")]
    # Each block has its log; the outer join keeps Spark from taking the logs' partitions, one to a key, for all.
    known = left.join(right, same[0] & same[1] & same[2], "left").select("b.key", "b.endpoint", "b.limit", "e.log", "b.ticks", "b.attempts")
    return known.mapInArrow(_decide(span), _ADMISSIONS).unionByName(free)


def admissions(events: DataFrame, limit: Column | None = None, seconds: int = K.QUOTA_WINDOW_SECONDS) -> DataFrame:
    """(key, endpoint, tick, attempts, admitted, remaining, retry_after) per key and tick.

    Attempts of the same tick are counted before anything moves, so a busy key costs at
    most one row per millisecond, and ticks are packed in blocks.  Only the log has to pass
    through a key's blocks in order: one task reads a row per block and jumps from one admitted
    tick to the next.  All else, a verdict for each tick, is done block by block, so a key that
    is never quiet is spread over the cluster like many quiet ones.
    """
    return fold_ticks(count_ticks(events, limit), seconds)


def decisions(events: DataFrame, admitted: DataFrame) -> DataFrame:
    """Verdict per event: of the attempts in one tick the first ones are admitted."""
    order = W.partitionBy("key", "endpoint", "tick").orderBy("event_id")
    placed = events.withColumn("tick", ticks(F.col("ts"))).withColumn("place", F.row_number().over(order))
    known = admitted.select("key", "endpoint", "tick", "admitted")
    return placed.join(known, ["key", "endpoint", "tick"]).select(
        "event_id", "key", "endpoint", "ts", (F.col("place") <= F.col("admitted")).alias("allowed")
    )


def retained(events: DataFrame, as_of: Column, hours: int = K.QUOTA_RETENTION_HOURS) -> DataFrame:
    """Events not older than the retention time at ``as_of``."""
    return events.filter(F.col("ts") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
