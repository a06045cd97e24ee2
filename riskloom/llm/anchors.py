"""Finding what recurs across a corpus without sorting all of it.

An anchor is a stretch that a rule picks from its surroundings alone: of all short stretches in
a window the one with the smallest hash.  Equal windows pick equal anchors, so whatever recurs
has an anchor that recurs, and only a small part of all stretches are anchors.

1. Texts that are whole copies are known by two 64-bit hashes and their length; a copy has the
   key of its text, and each task takes a text's anchors once.
2. Anchors are counted over the corpus; those of one text only are gone.
3. Each document meets the recurring anchors of its text.  Documents without any, and copies
   after the first, are finished here; the others are written with their anchors.

An anchor with more than ``hot`` texts is marked, and the operators send its windows one by
one, so that no group of one anchor grows without bound.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.workers import by_value
from riskloom.llm.common import pieces, raw, whole_text
from riskloom.plans.staging import stage

#: Texts of a task whose keys are remembered, to take copies once.
SEEN_MOST = 1 << 20


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the key of the text."""
    text = whole_text()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"), F.xxhash64(text, F.lit(1)).alias("key2"),
    )


def squeezed(rows: DataFrame, *names: str) -> DataFrame:
    """The named columns, with ``text`` compressed: texts cross the network once in this form."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([small.compress(t) for t in raw(batch.column(0))], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *batch.columns[1:]], names=["text", *names])

    kinds = dict(rows.dtypes)
    return rows.select("text", *names).mapInArrow(squeeze, ", ".join(["text binary", *(f"{n} {kinds[n]}" for n in names)]))


def opened(column: pa.Array) -> list[bytes]:
    """The texts that ``squeezed`` made."""
    import zstandard

    large = zstandard.ZstdDecompressor()
    return [large.decompress(x) for x in column.to_pylist()]


def recurring(
    docs: DataFrame,
    find: Callable[[list[bytes]], list[np.ndarray]],
    finish: Callable[[list[bytes], list[tuple[bool, int]]], pa.RecordBatch],
    finished: str,
    hot: int,
) -> tuple[DataFrame, DataFrame]:
    """(documents that are done, documents still open).

    ``find`` gives the anchor hashes of each text.  ``finish`` gives a row of columns
    ``finished`` for each text that is a copy of one with another id, or shares no anchor; it is
    told whether it is a copy, and how many rows have the text.  Open
    documents have doc_id, the squeezed text, n_copies, first_id, and their recurring anchors: cold and
    hot ones.
    """
    rows = keyed(docs)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in pieces(whole, "text"):
                keys = batch.column(0).to_pylist()
                fresh = []
                for i, k in enumerate(keys):
                    if k not in seen:
                        fresh.append(i)
                        if len(seen) < SEEN_MOST:
                            seen.add(k)
                texts = raw(batch.column(1))
                found = find([texts[i] for i in fresh])
                hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
                owner = np.repeat(np.array([keys[i] for i in fresh], np.int64), [len(f) for f in found])
                yield pa.RecordBatch.from_pydict({"h": pa.array(hashes.view(np.int64)), "key": pa.array(owner)})

    occurrences = rows.select("key", "text").mapInArrow(spread, "h long, key long")
    counts = occurrences.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    hits = occurrences.join(counts, "h").groupBy("key").agg(
        F.collect_set(F.when(F.col("n") <= hot, F.col("h"))).alias("cold"), F.collect_set(F.when(F.col("n") > hot, F.col("h"))).alias("hot"),
    )
    copies = rows.groupBy("key", "key2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"))
    known = copies.join(hits, "key", "left")
    met = squeezed(rows, "doc_id", "key", "key2").join(known, ["key", "key2"]).select("doc_id", "text", "first_id", "n_copies", "cold", "hot")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 18):
                ids, first, n = (batch.column(i).to_pylist() for i in (0, 2, 3))
                lengths = [pa.compute.fill_null(pa.compute.list_value_length(batch.column(i)), 0).to_numpy(zero_copy_only=False) for i in (4, 5)]
                any_anchor = ((lengths[0] + lengths[1]) > 0).tolist()
                copy = [k > 1 and not (i is None and f is None) and i != f for i, f, k in zip(ids, first, n)]
                done = [not a or c for a, c in zip(any_anchor, copy)]
                texts = opened(batch.column(1))
                made = finish([texts[i] for i in range(len(done)) if done[i]], [(copy[i], n[i]) for i in range(len(done)) if done[i]])
                at = np.cumsum(done) - 1
                pick = pa.array([int(at[i]) if done[i] else None for i in range(len(done))], pa.int64())
                left = pa.array([None if d else t for t, d in zip(batch.column(1).to_pylist(), done)], pa.binary())
                columns = [batch.column(0), pa.array(done), left, *batch.columns[2:]]
                names = ["doc_id", "done", "text", "first_id", "n_copies", "cold", "hot"]
                yield pa.RecordBatch.from_arrays([*columns, *(c.take(pick) for c in made.columns)], names=[*names, *made.schema.names])

    schema = "doc_id long, done boolean, text binary, first_id long, n_copies long, cold array<long>, hot array<long>, " + finished
    table = stage(met.mapInArrow(part, schema), "anchored")
    names = [x.split()[0] for x in finished.split(", ")]
    return table.where("done").select("doc_id", *names), table.where("NOT done").select("doc_id", "text", "first_id", "n_copies", "cold", "hot")


def smallest_in(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbours the place of the smallest (the first of equals)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = hashes.copy(), np.arange(len(hashes)), 1
    while span < width:  # doubling: runs of 1, 2, 4, ... and then of the width itself
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        later = right < left
        best = np.where(later, right, left)
        at = np.where(later, at[step:], at[: len(at) - step])
        span += step
    return at[:n]


by_value(sys.modules[__name__])
