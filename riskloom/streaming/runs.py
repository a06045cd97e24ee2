"""A table that a stream keeps up to date by writing only what a batch brings.

Each batch writes its rows as a run of its own, in folders by a hash of the key.  Readers merge the
runs, so nothing is rewritten for a batch.  Every ``every`` runs are merged into one, every
``every`` of those into a larger one, and so on: a row is written again as often as the number of
batches has digits, not once per batch.  Runs are named by the batches they cover, a repeated
batch replaces its own run, and of overlapping runs the longest counts.  Runs that a longer one
covered before a batch began are removed in that batch; a reader has that long to finish.

``merge`` takes rows of any number of runs to one row for each key, and must give the same in
whatever groups and order rows are merged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame], DataFrame]
Run = tuple[int, int]


def _names(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def runs(spark: SparkSession, folder: str) -> list[Run]:
    """(first batch, batch after the last) of each finished run."""
    path, fs = _names(spark, folder)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        first, _, end = status.getPath().getName().partition("-")
        if first.isdigit() and end.isdigit() and fs.exists(status.getPath().suffix("/_SUCCESS")):
            found.append((int(first), int(end)))
    return sorted(found)


def cover(found: list[Run]) -> list[Run]:
    """The longest runs that follow each other."""
    out, at = [], None
    for a, b in sorted(found, key=lambda r: (r[0], -r[1])):
        if at is None or a >= at:
            out.append((a, b))
            at = b
    return out


def _read(spark: SparkSession, folder: str, which: list[Run], schema=None, with_bucket: bool = False) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reduce(DataFrame.unionByName, [reader.parquet(f"{folder}/{a:09d}-{b:09d}") for a, b in which])
    return rows if with_bucket else rows.drop("bucket")


def _write(rows: DataFrame, folder: str, run: Run, key: str, buckets: int) -> None:
    where = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    rows.select("*", where).hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/{run[0]:09d}-{run[1]:09d}")


def before(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """The rows of all batches before one, of keys as often as their runs have them."""
    found = cover([r for r in runs(spark, folder) if r[1] <= number])
    return _read(spark, folder, found) if found else None


def add(rows: DataFrame, folder: str, number: int, key: str, merge: Merge, every: int = 8, buckets: int = 16) -> DataFrame:
    """Write the rows of a batch as its run, and merge runs where enough have come together; the
    batch's rows as they are stored."""
    spark = rows.sparkSession
    older = [r for r in runs(spark, folder) if r[1] <= number]
    path, fs = _names(spark, folder)
    for a, b in set(older) - set(cover(older)):
        fs.delete(path.suffix(f"/{a:09d}-{b:09d}"), True)
    _write(rows, folder, (number, number + 1), key, buckets)
    size = every
    while (number + 1) % size == 0:
        first = number + 1 - size
        shorter = [r for r in runs(spark, folder) if r[0] >= first and r[1] <= number + 1 and r != (first, number + 1)]
        _write(merge(_read(spark, folder, cover(shorter), rows.schema)), folder, (first, number + 1), key, buckets)
        size *= every
    return _read(spark, folder, [(number, number + 1)], rows.schema)


def into_runs(folder: str, key: str, fold: Merge, merge: Merge, every: int = 8, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """Handler of batches: ``fold`` makes a batch's rows, ``merge`` puts runs together."""

    def handle(batch: DataFrame, number: int) -> None:
        add(fold(batch), folder, number, key, merge, every, buckets)

    return handle


def current(spark: SparkSession, folder: str, schema, merge: Merge, key: str | None = None, keys: list[str] | None = None, buckets: int = 16) -> DataFrame:
    """The table now; with ``keys`` only these, read from their folders alone."""
    found = cover(runs(spark, folder))
    if not found:
        return spark.createDataFrame([], schema)
    if keys is None:
        return merge(_read(spark, folder, found, schema))
    columns = schema if isinstance(schema, str) else schema.toDDL()
    rows = _read(spark, folder, found, f"{columns}, bucket int", with_bucket=True)
    wanted = F.col("bucket").isin([F.pmod(F.xxhash64(F.lit(k)), F.lit(buckets)).cast("int") for k in keys])
    return merge(rows.where(wanted & F.col(key).isin(keys)).drop("bucket"))
