"""Numbering rows within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.plans.staging import stage


def slices_of(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def cut_by_range(rows: DataFrame, by: list[str], order: list[Column], slices: int) -> DataFrame:
    """_row, the group, slice, and ``at``, which counts up in the order of a slice."""
    sort = [*[F.col(b) for b in by], *order, F.col("_row")]
    return rows.repartitionByRange(slices, *sort).sortWithinPartitions(*sort).select(
        "_row", *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("at")
    )


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, slices: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in its group.

    A plain window would sort a group in one task, with all that its rows carry.  Here the rows
    are written once with a number of their own, and only that number, the group and what the
    order needs are cut by range into even slices, so that a large group spans many of them.  The
    places in the slices are written too, which fixes them; they are shifted by the rows that a
    group has in the slices before, of which one small row per group and slice meets in a window.
    The positions then go back to the rows by their numbers.
    """
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    cut = stage(cut_by_range(rows, by, order, slices or slices_of(df)), "slices")
    group = [f"_by{i}" for i in range(len(by))]
    counts = cut.groupBy("slice", *group).agg(F.count("*").alias("here"), F.min("at").alias("first"))
    ahead = W.partitionBy(*group).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(F.col("slice").alias("s"), *[F.col(g).alias(f"of{g}") for g in group], (F.coalesce(F.sum("here").over(ahead), F.lit(0)) - F.col("first")).alias("shift"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"of{g}")) for g in group], F.col("slice") == F.col("s"))
    positions = cut.join(shifts, same).select("_row", (F.col("at") + F.col("shift")).alias(name))
    return rows.join(positions, "_row").drop("_row")
