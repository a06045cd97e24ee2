"""Exact dedup by a stream with keyed state.

Texts are equal if they are identical without white space.  Each document is described by a
digest of that form, its length, a stable row number and a content locator (the file it was
read from).  The descriptions run through Structured Streaming; per digest the state keeps
the row that stays (longest original, then smallest doc_id, then first row), its locator and
the group's size.  The state lies in RocksDB on the executors' disks, is saved with every
batch in the stream's checkpoint, and never expires; an executor that is lost restores it.

A hit says that digests agree.  The texts of all hits are then compared as a whole: the
smallest and the largest text of a digest must be the same, which Spark takes per task first,
so a group with a third of all rows is no hot spot.  Where they differ, the digest's rows are
grouped by their texts instead.

A null text counts as empty; all empty texts are one group.  A null doc_id comes after all
others.  Repeated rows are documents of one group, of which one stays.  An empty table gives
no rows.  Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import new_folder, whole_text

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores reserves files of megabytes
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bare(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def described(docs: DataFrame, digest_chars: int = 64, row: str | None = None) -> DataFrame:
    """row (numbered here, or a column that numbers the rows), doc_id, n_chars, locator, text_sha256, digest (its first ``digest_chars`` hex digits)."""
    text = whole_text()
    sha = F.sha2(bare(text).cast("binary"), 256)
    number = F.col(row) if row else F.monotonically_increasing_id()
    got = docs.select(
        number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n_chars"), F.input_file_name().alias("locator"),
        sha.alias("text_sha256"),
    )
    return got.withColumn("digest", F.substring("text_sha256", 1, digest_chars))


def better() -> Column:
    """Compares rows of a group: the largest stays."""
    return F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row"), F.col("doc_id"), F.col("row"), F.col("locator"))


def keyed_state(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream of descriptions to its present end; per digest the row that stays and the
    size of the group.

    Every batch writes the groups it changed to a folder of its own, which a repeated batch
    replaces; of a digest's versions the one with the largest size is the last.
    """
    spark = stream.sparkSession
    changes = stream.groupBy("digest").agg(F.max(better()).alias("best"), F.count("*").alias("group_size"))

    def save(batch: DataFrame, number: int) -> None:
        kept = batch.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("best.locator").alias("keep_locator"), "group_size")
        kept.write.mode("overwrite").parquet(f"{folder}/groups/batch={number}")

    with _settings(spark, STATE):
        query = (
            changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
            .foreachBatch(save).start()
        )
        query.awaitTermination()
    schema = "digest string, keep_id long, keep_row long, keep_locator string, group_size long, batch int"
    versions = spark.read.schema(schema).parquet(f"{folder}/groups") if query.lastProgress else spark.createDataFrame([], schema)
    last = F.max(F.struct("group_size", "keep_id", "keep_row", "keep_locator")).alias("v")
    return versions.groupBy("digest").agg(last).select("digest", "v.keep_id", "v.keep_row", "v.keep_locator", "v.group_size")


def _differing(docs: DataFrame, members: DataFrame, digest_chars: int) -> DataFrame:
    """Digests shared by texts that differ."""
    hits = members.where("group_size > 1").select(F.col("doc_id").alias("hit")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.join(hits, rows["doc_id"].eqNullSafe(hits["hit"]), "left_semi").select(bare(F.col("text")).alias("bare"))
    rows = rows.withColumn("digest", F.substring(F.sha2(F.col("bare").cast("binary"), 256), 1, digest_chars))
    return rows.groupBy("digest").agg(F.min("bare").alias("low"), F.max("bare").alias("high")).where("low != high").select("digest")


def duplicates(docs: DataFrame, digest_chars: int = 64, files_per_batch: int | None = None, row: str | None = None) -> DataFrame:
    """One row per document: row, doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    folder = new_folder(spark, "stream-dedup")
    rows = described(docs, digest_chars, row)
    rows.write.parquet(f"{folder}/described")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/described")
    source = spark.readStream.schema(rows.schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    groups = keyed_state(source.parquet(f"{folder}/described"), folder)
    members = rows.join(groups, "digest")
    out = ["row", "doc_id", "keep_id", "keep_row", "group_size", "text_sha256"]
    differing = _differing(docs, members, digest_chars)
    found = members.select(*out)
    if not differing.isEmpty():
        # Full bytes decide: two texts of one digest part by their whole SHA-256, of which the digest is a part.
        apart = rows.join(differing, "digest", "left_semi")
        best = apart.groupBy("text_sha256").agg(F.max(better()).alias("best"), F.count("*").alias("group_size"))
        regrouped = apart.join(best, "text_sha256").select(
            "row", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size", "text_sha256"
        )
        found = members.join(differing, "digest", "left_anti").select(*out).unionByName(regrouped)
    return found.select("row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns.  The rows are written once with a number,
    by which the verdicts find them again."""
    names = docs.columns
    spark = docs.sparkSession
    folder = new_folder(spark, "stream-dedup-rows")
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("doc")).withColumn("row", F.monotonically_increasing_id())
    packed.write.parquet(folder)
    packed = spark.read.schema(packed.schema).parquet(folder)
    verdict = duplicates(packed.select("doc.doc_id", "doc.text", "row"), row="row")
    return packed.join(verdict.where("kept").select("row"), "row", "left_semi").select("doc.*")
