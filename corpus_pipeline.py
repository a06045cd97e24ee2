"""From raw documents to packed sequences: each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import curriculum, lsh_forest, retrieval_packing, rule_ledger, stream_dedup
from riskloom.llm.queries import tokenizer_file
from riskloom.plans.staging import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: SQL can't express retrieval packing; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the latest policy."""
    return rule_ledger.apply_policy(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the longest one."""
    return stream_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles, at a similarity of 0.8 or more."""
    return lsh_forest.one_of_each(docs, words=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them, in training order."""
    return curriculum.mixed(docs)


def stored_order(docs: DataFrame) -> Column:
    """The place of a row in the order in which its table was written: part, file of the
    part, row.  A frame that is not read from files has the order of its partitions."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema
    except AnalysisException:
        return F.array(F.monotonically_increasing_id())
    file = F.col("_metadata.file_name")
    return F.array(*[F.regexp_extract(file, p, 1).try_cast("long") for p in (r"^part-(\d+)", r"-c(\d+)\.")], F.col("_metadata.row_index"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, numbered in the training order of the mix."""
    return retrieval_packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), "bytes", order=stored_order(docs)).drop("ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
