"""Token ids on disk: one compressed frame per document under a shared dictionary.

A store is a folder with two tables:

* ``dictionary``: one row with the zstandard dictionary, its hash and the bytes per id.  The
  dictionary is trained on the serialised ids of a bounded sample of short documents
  (``sample_docs``, ``sample_bytes``); it changes the size of the store, never its content.
* ``segments``: rows in ascending order of documents.  A segment is a run of frames of about
  ``segment_bytes``, with the offset index of its documents beside it: ids, where each frame
  ends, tokens per document, tokens before the segment in its shard, and the dictionary hash.

Each document is a frame by itself, so one short document is read by its index entry and a
slice of one segment, without decoding the others.

Order: doc_id ascending, null last; rows of one doc_id by a hash of the text.  A null text
counts as empty, an empty text has the end id only.  Repeated rows are kept, an empty table
gives an empty store, other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.workers import by_value
from riskloom.llm.common import pieces, whole_text
from riskloom.llm.tokens import encoder

SEGMENTS = (
    "shard int, segment long, first_id long, last_id long, dict_hash string, before long, n_segment_tokens long, "
    "doc_ids array<long>, ends array<long>, n_tokens array<long>, frames binary"
)
#: Bytes of text that are encoded at a time.
TEXTS_MOST = 2 << 20


def train_dictionary(docs: DataFrame, file: str, style: str, end_id: int, sample_docs: int, sample_bytes: int, dict_bytes: int) -> bytes:
    """A zstandard dictionary from at most ``sample_docs`` texts of 1 to ``sample_bytes``
    bytes, chosen by a hash of doc_id.  Empty if they are too few to train on."""
    text = whole_text()
    fits = F.octet_length(text).between(1, sample_bytes)
    chosen = docs.select("doc_id", text.alias("text")).where(fits).orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(sample_docs)

    def train(sample: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        enc = encoder(file, style)
        end = enc.pack([end_id])
        try:
            made = zstandard.train_dictionary(dict_bytes, [enc.ids(t) + end for t in sample["text"]]).as_bytes()
        except zstandard.ZstdError:
            made = b""
        return pd.DataFrame({"made": [made]})

    rows = chosen.groupBy(F.lit(0).alias("one")).applyInPandas(train, "made binary").collect()
    return bytes(rows[0]["made"]) if rows else b""


def dictionary_hash(made: bytes) -> str:
    return hashlib.sha256(made).hexdigest()


def write_store(
    docs: DataFrame,
    folder: str,
    file: str,
    style: str,
    end_id: int = 1,
    segment_bytes: int = 1 << 18,
    sample_docs: int = 500,
    sample_bytes: int = 1 << 14,
    dict_bytes: int = 1 << 16,
    level: int = 3,
) -> None:
    """Encode ``docs`` (doc_id, text) and write them as a store.

    Rows are cut by ranges of doc_id, so a partition is a shard in the order of the store;
    each is encoded, compressed and written by one task from batch to batch.
    """
    spark = docs.sparkSession
    made = train_dictionary(docs, file, style, end_id, sample_docs, sample_bytes, dict_bytes)
    name = dictionary_hash(made)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(file, style)
        end = enc.pack([end_id])
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(made) if made else None)
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        ids, ends, counts, frames, size = [], [], [], [], 0
        schema = pa.schema([
            ("shard", pa.int32()), ("segment", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("dict_hash", pa.string()),
            ("before", pa.int64()), ("n_segment_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
            ("n_tokens", pa.list_(pa.int64())), ("frames", pa.binary()),
        ])

        def flush() -> pa.RecordBatch:
            row = [shard, segment, ids[0], ids[-1], name, before, sum(counts), ids, ends, counts, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in (part for whole in batches for part in pieces(whole, "text", TEXTS_MOST)):
            for doc_id, packed in zip(batch.column(0).to_pylist(), enc.many(batch.column(1).to_pylist())):
                packed += end
                frames.append(squeeze.compress(packed))
                size += len(frames[-1])
                ids.append(doc_id)
                ends.append(size)
                counts.append(len(packed) // enc.width)
                if size >= segment_bytes:
                    yield flush()
                    segment, before = segment + 1, before + sum(counts)
                    ids, ends, counts, frames, size = [], [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select("doc_id", whole_text().alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut.mapInArrow(encode, SEGMENTS).write.option("compression", "none").parquet(f"{folder}/segments")
    width = encoder(file, style).width
    spark.createDataFrame([(name, bytearray(made), width)], "dict_hash string, dictionary binary, width int").coalesce(1).write.parquet(f"{folder}/dictionary")


def _opened(spark: SparkSession, folder: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(f"{folder}/dictionary").collect()[0]
    made = bytes(row["dictionary"])
    if dictionary_hash(made) != row["dict_hash"]:
        raise ValueError(f"the dictionary in {folder} does not have the hash it is filed under")
    return row["dict_hash"], made, row["width"]


def _decoder(name: str, made: bytes, width: int):
    """Function from frames to arrays of ids."""
    import zstandard

    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(made) if made else None)

    def decode(filed: str, frame: bytes) -> np.ndarray:
        if filed != name:
            raise ValueError(f"the segment was written with dictionary {filed}, not {name}")
        return np.frombuffer(expand.decompress(frame), f"<u{width}")

    return decode


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, decoded from its frame: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), shard."""
    name, made, width = _opened(spark, folder)
    segments = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments")
    totals = segments.groupBy("shard").agg(F.sum("n_segment_tokens").alias("n"))  # one row per shard
    base = totals.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(name, made, width)
        for batch in batches:
            for row in batch.to_pylist():
                crcs, first = [], 0
                for doc_id, stop, n in zip(row["doc_ids"], row["ends"], row["n_tokens"]):
                    ids = decode(row["dict_hash"], row["frames"][first:stop])
                    if len(ids) != n:
                        raise ValueError(f"document {doc_id}: {len(ids)} ids where the index has {n}")
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    first = stop
                counts = np.array(row["n_tokens"], np.int64)
                starts = row["before"] + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "within": pa.array(starts), "n_tokens": pa.array(counts),
                    "ids_crc32": pa.array(crcs, pa.int64()), "shard": pa.array([row["shard"]] * len(crcs), pa.int32()),
                })

    out = segments.select("shard", "dict_hash", "before", "doc_ids", "ends", "n_tokens", "frames").mapInArrow(
        read, "doc_id long, within long, n_tokens long, ids_crc32 long, shard int"
    )
    return out.join(base, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "shard")


def fetch(spark: SparkSession, folder: str, doc_id: int) -> DataFrame:
    """The ids of one document (one row for each copy of its doc_id): only segments whose
    index covers it are read, and only its own frames decoded."""
    name, made, width = _opened(spark, folder)
    near = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").where(F.col("first_id") <= doc_id).where(F.coalesce("last_id", F.lit(doc_id)) >= doc_id)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(name, made, width)
        for batch in batches:
            for row in batch.to_pylist():
                spans = zip([0, *row["ends"]], row["ends"], row["doc_ids"])
                found = [decode(row["dict_hash"], row["frames"][a:b]).astype(np.int64).tolist() for a, b, d in spans if d == doc_id]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id] * len(found), pa.int64()), "ids": pa.array(found, pa.list_(pa.int64()))})

    return near.select("dict_hash", "doc_ids", "ends", "frames").mapInArrow(pick, "doc_id long, ids array<long>")


by_value(sys.modules[__name__])
