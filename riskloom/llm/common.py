"""What the operators share: words, batches, folders."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.workers import by_value
from riskloom.plans.staging import shared_folder

#: White space between words, and words, as everywhere in these operators.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder on the storage that all executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def whole_text(col: str = "text") -> Column:
    """A text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a column of texts; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part have about ``most`` bytes; a longer text
    is a part by itself."""
    sizes = [0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield batch.slice(first)


def partitions_for(df: DataFrame) -> int:
    """The session's number of shuffle partitions, at least one for each core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


by_value(sys.modules[__name__])
