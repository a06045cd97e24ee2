"""A table as a stream of files that arrive in order, to run streams over stored data."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.plans.staging import stage


def arrivals(rows: DataFrame, order: Column, folder: str, parts: int = 4) -> Iterator[DataFrame]:
    """Write the rows to ``folder`` slice by slice along ``order`` (numbers or times) and give
    the stream over the folder after each slice.  Slices have even widths, not even counts.  The
    rows are made once and written with their places, as every slice reads them."""
    spark = rows.sparkSession
    placed = stage(rows.withColumn("_place", order.cast("double")), "arrivals")
    place = F.col("_place")
    low, high = placed.agg(F.min(place), F.max(place)).first()
    width = max((high - low) / parts, 1e-9) if low is not None else 1.0
    slices = placed.withColumn("_slice", F.coalesce(F.least(F.floor((place - F.lit(low or 0.0)) / width), F.lit(parts - 1)), F.lit(0)))
    for i in range(parts):
        slices.where(F.col("_slice") == i).drop("_slice", "_place").write.mode("append").parquet(folder)
        yield spark.readStream.schema(rows.schema).parquet(folder)
