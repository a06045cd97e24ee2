"""Reading repositories: folders, tables and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions import paths as P
from riskloom.functions import text as X


def read_tree(spark: SparkSession, root: str, depth: int = 0) -> DataFrame:
    """(repo_id, path, size, content) of the files below ``root``.

    With ``depth`` 0 the root is one repository; with 1 each folder directly below it is
    a repository of its own.  Sizes come from the listing; content is read only where
    it is selected.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # The listing names files by full URI; the root is spelled the same way, whatever store it is in.
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    inner = F.regexp_replace(F.substr("path", F.lit(len(whole) + 1)), "^/+", "")
    if depth:
        repo, rel = F.substring_index(inner, "/", 1), F.substr(inner, F.length(F.substring_index(inner, "/", 1)) + 2)
    else:
        repo, rel = F.lit(root.rstrip("/").split("/")[-1]), inner
    return raw.select(repo.alias("repo_id"), rel.alias("path"), F.col("length").alias("size"), "content")


def with_text(files: DataFrame) -> DataFrame:
    return files.withColumn("text", X.decode(F.col("content"))).drop("content")


def manifest(
    files: DataFrame,
    max_files: int | None = None,
    max_bytes: int = K.MAX_SOURCE_BYTES,
    strict: bool = False,
    max_file_bytes: int | None = None,
) -> DataFrame:
    """(repo_id, path, size, language, over_budget) of the files to scan.

    With ``max_files`` the first ones by lower-case path, with file_no and running_bytes;
    the row number is a limit, so each task keeps few rows per repository.  Without it
    all of them, and no window.  ``over_budget`` marks repositories whose files exceed
    ``max_bytes``, and drops nothing.  Files above ``max_file_bytes`` are left out if it is given.
    Only the listing is touched.
    """
    c = F.col
    listed = files.select("repo_id", "path", "size").filter(~P.is_ignored(c("path"), strict))
    if max_file_bytes is not None:
        listed = listed.filter(c("size") <= max_file_bytes)
    kept = listed
    if max_files is not None:
        order = W.partitionBy("repo_id").orderBy(F.lower("path"), "path")
        kept = listed.withColumn("file_no", F.row_number().over(order)).filter(c("file_no") <= max_files)
        running = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
        kept = kept.withColumn("running_bytes", running)
    # the running sum passes the budget exactly when the whole sum does
    over = kept.groupBy("repo_id").agg((F.sum("size") > max_bytes).alias("over_budget"))
    return kept.join(over, "repo_id").withColumn("language", P.language(c("path")))


def manifest_stats(files: DataFrame, max_files: int | None = None, strict: bool = False) -> DataFrame:
    """Bytes and files per repository: in total, scanned and ignored (by path or a limit)."""
    c = F.col
    total = files.groupBy("repo_id").agg(F.sum("size").alias("repo_size_bytes"))
    scanned = manifest(files, max_files, strict=strict).groupBy("repo_id").agg(
        F.sum("size").alias("scanned_source_bytes"), F.count("*").alias("scanned_file_count")
    )
    joined = total.join(scanned, "repo_id", "left").fillna(0, ["scanned_source_bytes", "scanned_file_count"])
    return joined.withColumn("ignored_size_bytes", c("repo_size_bytes") - c("scanned_source_bytes"))


def line_table(files: DataFrame) -> DataFrame:
    """(repo_id, path, line_no, line), 1-based."""
    return files.select("repo_id", "path", F.posexplode(X.split_lines(F.col("text"))).alias("pos", "line")).select(
        "repo_id", "path", (F.col("pos") + 1).alias("line_no"), "line"
    )
