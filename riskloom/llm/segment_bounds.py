"""Hard-negative mining with bounds from segment summaries.

A vector is cut into segments, and each segment's mean and deviation are stored beside it, for
several segment lengths.  In a segment of ``m`` components two vectors' product is ``m`` times
the product of their means, plus or minus at most ``m`` times the product of their deviations;
summed over the segments this bounds the score from both sides.  Long segments are tried first;
rows that may still count are looked at in shorter ones, and only what is left then is scored
exactly, in whole numbers.

An anchor's positives are the best rows of its own label; its negatives, for each positive, are
the best rows of other labels whose scores lie between ``low`` and ``high`` per cent of the
positive's.  Each pass holds the rows in blocks of at most about ``block_rows``, one at a time in
a task, and streams the anchors past them: blocks of one label for the positives, mixed ones for
the negatives.  A label with most of the rows just has more blocks.  Per anchor and block at most
``count`` rows leave a pass, and the final order is taken by Spark.  No bound depends on sampling;
results equal those of scoring every pair.

Rows with a null vec_id, label, vector or component take no part; nor do rows whose squared
length exceeds 2**62, whose scores a long can't hold.  Shorter vectors count as filled up with
zeros, an empty one scores 0 with all.  Rows equal in vec_id, label and vector count once; other
rows that share a vec_id are rows of their own.  Ties go to the smaller vec_id, then to a hash of
the row.  Negative or zero positives have no negatives in their range unless scores are equal to
it, as the inequalities say.  An empty table, and a label with a single row, give no rows.
Extra columns are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.workers import by_value
from riskloom.llm.common import partitions_for
from riskloom.plans.staging import stage

#: Lengths of segments, long ones first; each divides the one before it.
SEGMENTS = (16, 8, 4)
#: Bounds are taken in single precision; this much of the product of the lengths covers its errors.
SLACK = 1e-5
STORED = "vec_id long, label string, hash long, anchor boolean, norm double, whole binary, means binary, deviations binary"
POSITIVES = "anchor_id long, anchor_hash long, score long, vec_id long, hash long"
NEGATIVES = "anchor_id long, anchor_hash long, place int, score long, vec_id long, hash long"


def summaries(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the rows' segments, of all lengths side by side."""
    means, deviations = [], []
    for m in SEGMENTS:
        parts = whole.reshape(len(whole), -1, m).astype(np.float64)
        mean = parts.mean(axis=2)
        means.append(mean)
        deviations.append(np.sqrt(((parts - mean[:, :, None]) ** 2).mean(axis=2)))
    return np.hstack(means).astype("<f4"), np.hstack(deviations).astype("<f4")


def stored(vectors: DataFrame, anchor: Column) -> DataFrame:
    """Vectors (vec_id, label, vector of whole numbers) with their summaries, written once.
    ``anchor`` says which rows are anchors."""
    norm = F.aggregate("vector", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("vector").cast("array<long>").alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    rows = rows.where(norm <= float(1 << 62)).dropDuplicates(["vec_id", "label", "vector"])
    rows = rows.select("vec_id", "label", F.xxhash64("label", "vector").alias("hash"), "anchor", F.sqrt(norm).alias("norm"), "vector")
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // SEGMENTS[0])) * SEGMENTS[0]
    kept = ("vec_id", "label", "hash", "anchor", "norm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            whole = np.zeros((len(batch), width), np.int64)
            sizes = np.diff(column.offsets.to_numpy())
            whole[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
            sides = (whole.astype("<i8"), *summaries(whole))
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in sides]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *packed], names=[f.split()[0] for f in STORED.split(", ")])

    return stage(rows.mapInArrow(run, STORED), "vectors")


def _matrix(batch: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(len(batch), -1)


class Block:
    """Rows with their summaries, split by segment length."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids, self.hashes = batch.column("vec_id").to_numpy(), batch.column("hash").to_numpy()
        self.norm = batch.column("norm").to_numpy()
        self.labels = np.array(batch.column("label").to_pylist(), object)
        self.whole = _matrix(batch, "whole", "<i8")
        width = self.whole.shape[1]
        ends = np.cumsum([width // m for m in SEGMENTS])[:-1]
        self.means = np.split(_matrix(batch, "means", "<f4"), ends, axis=1)
        self.deviations = np.split(_matrix(batch, "deviations", "<f4"), ends, axis=1)

    def bounds(self, rows: np.ndarray, level: int, other: Block, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that the rows can have with row i of the other block."""
        m = np.float32(SEGMENTS[level])
        middle = self.means[level][rows] @ (other.means[level][i] * m)
        spread = self.deviations[level][rows] @ (other.deviations[level][i] * m) + SLACK * other.norm[i] * self.norm[rows] + SLACK
        return middle - spread, middle + spread

    def scores(self, rows: np.ndarray, other: Block, i: int) -> np.ndarray:
        """Exact scores.  No partial sum exceeds the product of the lengths; doubles are exact
        below 2**53, longs reach beyond."""
        if not len(rows):
            return np.zeros(0, np.int64)
        if self.norm[rows].max() * other.norm[i] < 2.0**52:
            return (self.whole[rows].astype(np.float64) @ other.whole[i].astype(np.float64)).astype(np.int64)
        return self.whole[rows] @ other.whole[i]

    def first(self, rows: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
        """Places of the best rows among the given ones."""
        return np.lexsort((self.hashes[rows], self.ids[rows], -scores))[:count]


def _greatest(values: np.ndarray, count: int) -> float:
    """The count-th greatest value, or minus infinity if there are fewer."""
    return np.partition(values, len(values) - count)[len(values) - count] if len(values) >= count else -np.inf


def best(block: Block, rows: np.ndarray, anchors: Block, i: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The count best of the rows for anchor i, and their scores."""
    for level in range(len(SEGMENTS)):
        if len(rows) <= count:
            break
        low, high = block.bounds(rows, level, anchors, i)
        rows = rows[high >= _greatest(low, count)]
    scores = block.scores(rows, anchors, i)
    got = block.first(rows, scores, count)
    return rows[got], scores[got]


def best_between(block: Block, rows: np.ndarray, anchors: Block, i: int, count: int, ranges: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each range (low, high) its place, the count best of the rows with scores in it, and
    their scores."""
    for level in range(len(SEGMENTS)):
        low, high = block.bounds(rows, level, anchors, i)
        open_ = np.zeros(len(rows), bool)
        for a, b in ranges:
            least = max(a, _greatest(low[(low >= a) & (high <= b)], count))  # as many surely lie in the range, at or above it
            open_ |= (high >= least) & (low <= b)
        rows = rows[open_]
    scores = block.scores(rows, anchors, i)
    for place, (a, b) in enumerate(ranges):
        inside = np.flatnonzero((scores >= a) & (scores <= b))
        got = inside[block.first(rows[inside], scores[inside], count)]
        yield place, rows[got], scores[got]


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Stretches of rows with one key, either of anchors or of others."""
    for batch in batches:
        marks = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "asks"))))
        first = 0
        for i in range(1, len(marks) + 1):
            if i == len(marks) or marks[i] != marks[first]:
                yield marks[first][:-1], marks[first][-1], batch.slice(first, i - first)
                first = i


def _met(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[Block, pa.RecordBatch]]:
    """(block, anchors) for rows sorted by key, with the anchors after the others."""
    key, parts, block = None, [], None
    for now, asks, batch in _runs(batches, keys):
        if now != key:
            key, parts, block = now, [], None
        if not asks:
            parts.append(batch)
        elif parts:
            if block is None:
                block = Block(pa.concat_batches(parts))
            yield block, batch


def _positives(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in _met(batches, ("label", "block")):
            anchors, out = Block(batch), []
            for i in range(len(batch)):
                others = np.flatnonzero((block.ids != anchors.ids[i]) | (block.hashes != anchors.hashes[i]))
                rows, scores = best(block, others, anchors, i, count)
                same = np.full((2, len(rows)), [[anchors.ids[i]], [anchors.hashes[i]]])
                out.append(np.vstack([same, scores[None], block.ids[rows][None], block.hashes[rows][None]]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.hstack(out)], names=[f.split()[0] for f in POSITIVES.split(", ")])

    return run


def _negatives(count: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in _met(batches, ("block",)):
            anchors, out = Block(batch), [np.zeros((6, 0), np.int64)]
            for i, positives in enumerate(batch.column("positives").to_pylist()):
                others = np.flatnonzero(block.labels != anchors.labels[i])
                ranges = [(-(-low * p // 100), high * p // 100) for p in positives]
                for place, rows, scores in best_between(block, others, anchors, i, count, ranges):
                    same = np.full((3, len(rows)), [[anchors.ids[i]], [anchors.hashes[i]], [place]])
                    out.append(np.vstack([same, scores[None], block.ids[rows][None], block.hashes[rows][None]]))
            columns = np.hstack(out)
            kinds = [pa.int32() if f.endswith(" int") else pa.int64() for f in NEGATIVES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=[f.split()[0] for f in NEGATIVES.split(", ")])

    return run


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_rows: int = 1 << 14
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors
    (vec_id, label, vector of whole numbers)."""
    table = stored(vectors, anchor)
    tasks = partitions_for(table)
    size = table.groupBy("label").count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
    rows = min(block_rows, -(-(size["all"] or 1) // tasks))
    data = ["vec_id", "label", "hash", "norm", "whole", "means", "deviations"]
    asking = table.where("anchor")
    in_order = (F.col("score").desc(), "vec_id", "hash")

    def against(asked: DataFrame, blocks: int) -> DataFrame:
        """All rows, dealt into blocks, and a copy of what is asked for each block."""
        held = table.select(*data, F.pmod("hash", F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"))
        copies = asked.select(*asked.columns, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"))
        return held.unionByName(copies, allowMissingColumns=True)

    by_label = against(asking.select(*data), -(-(size["most"] or 1) // rows)).repartition(tasks, "label", "block").sortWithinPartitions("label", "block", "asks")
    near = by_label.mapInArrow(_positives(positives), POSITIVES)
    turn = F.row_number().over(W.partitionBy("anchor_id", "anchor_hash").orderBy(*in_order))
    near = stage(near.withColumn("place", turn - 1).where(F.col("place") < positives), "positives")

    lists = near.groupBy("anchor_id", "anchor_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("positives"))
    asked = asking.join(lists, (F.col("vec_id") == F.col("anchor_id")) & (F.col("hash") == F.col("anchor_hash"))).select(*data, "positives")
    blocks = max(tasks, -(-(size["all"] or 1) // rows))
    mixed = against(asked, blocks).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks")
    far = mixed.mapInArrow(_negatives(negatives, low, high), NEGATIVES)
    rank = F.row_number().over(W.partitionBy("anchor_id", "anchor_hash", "place").orderBy(*in_order))
    far = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    of = near.select("anchor_id", "anchor_hash", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(of, ["anchor_id", "anchor_hash", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


by_value(sys.modules[__name__])
