"""Cutting a plan: write a table to the cluster's shared folder and read it back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local: dict[str, str | None] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one is made up only where the
    setting is absent, as in local tests."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = _local.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="riskloom-")
        _local[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder on the storage that all executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Survives the loss of executors, and lets several consumers read only the columns
    they need.  Within ``staged`` the folder goes when the block ends.
    """
    spark = df.sparkSession
    target = new_folder(spark, label)
    for held in _open:
        held.append(target)
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


_open: list[list[str]] = []


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """Remove what is staged within the block at its end.  Results have to be written or collected
    before, as their plans read the staged tables."""
    held: list[str] = []
    _open.append(held)
    try:
        yield
    finally:
        _open.remove(held)
        for folder in held:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
