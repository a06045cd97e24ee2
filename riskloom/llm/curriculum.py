"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule: its share of the training stream at time t in [0, 1]
is ``target * (1 + slope * (2t - 1))``, so that the schedule's integral over the whole run is
the target, early sources fade and late ones grow.  A source's documents lie one after
another in a fixed shuffled order, up to ``most`` times over.  A use of a document that begins
after ``d`` words of its source's stream belongs at the time when the integrated demand of the
source reaches ``d``: the inverse of the cumulative demand.  Rows are range-sorted by it.

Targets share all words by weight, but stop at ``most`` times the source's size; the excess
is shared again by weight until none is above, which is a level all uncapped sources reach
together and comes from running sums over the sources in order of size per weight.

Running sums over documents are taken in two steps, in buckets of about ``bucket_rows``
documents and over the buckets, so that a source with most of the rows spans many tasks.

A null text has size 0 and is never taken; the null source is a source, the last one.  Equal
doc_ids order by size; repeated rows are interchangeable.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.common import SPACE, WORD, whole_text
from riskloom.plans.staging import stage

#: Largest slope of a schedule; below 1, so that every source is present at every time.
SLOPE = 0.8


def sized(docs: DataFrame) -> DataFrame:
    """A row number, doc_id, source, size in words, and the shuffled order."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.size(F.regexp_extract_all(whole_text(), F.lit(WORD), F.lit(0))).cast("long").alias("size"),
    ).withColumn("ord", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(rows: DataFrame, weights: Column | None = None, most: int = 3) -> DataFrame:
    """Per source: size, documents, weight, target, slope.  One small row for each source."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("place", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", (weights if weights is not None else F.col("place") % 3 + 1).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * most).cast("double"))
    every = W.orderBy(F.col("cap") / F.col("weight"), "place")
    whole = W.partitionBy()
    per = per.select(
        "*",
        F.sum("source_size").over(whole).cast("double").alias("total"),
        F.sum("weight").over(whole).alias("all_weight"),
        F.count("*").over(whole).alias("n_sources"),
        F.row_number().over(every).alias("turn"),
        F.coalesce(F.sum("cap").over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("weight_before"),
    )
    # The level if exactly the sources before this one are capped; the right one belongs to the first source that it does not put above its cap.
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    first = F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct("turn", level.alias("level")))).over(whole)
    per = per.withColumn("level", F.coalesce(first["level"], F.lit(float("inf"))))
    span = F.greatest(F.col("n_sources") - 1, F.lit(1))
    return per.select(
        "source", "source_size", "n_docs", "weight",
        F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"),
        (F.lit(SLOPE) * (F.lit(2.0) * F.col("place") / span - 1)).alias("slope"),
    )


def placed(docs: DataFrame, weights: Column | None = None, most: int = 3, bucket_rows: int = 2_000) -> DataFrame:
    """Documents with their source's figures and ``ahead``, the words of the source before
    them in one pass over its documents.  Texts are read once: their sizes are written first."""
    rows = stage(sized(docs), "sizes")
    per = targets(rows, weights, most)
    # How many buckets a source gets follows its number of documents; a bucket is a range of the shuffled order.
    n = F.ceil(F.col("n_docs") / F.lit(bucket_rows))
    share = F.conv(F.substring("ord", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    same = rows["source"].eqNullSafe(per["source"])
    got = rows.join(per, same).drop(per["source"]).withColumn("bucket", F.floor(share * n).cast("long"))
    sums = got.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    over = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(over), F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "bucket").orderBy("ord", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    got = got.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    got = got.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return got.withColumn("ahead", F.col("base") + F.col("inside")).drop("s", "b", "base", "inside", "bucket")


def words_of_use(use: Column | int) -> Column:
    """Words taken in the use of a document numbered from 0."""
    use = F.lit(use) if isinstance(use, int) else use
    left = F.floor("target") - use * F.col("source_size") - F.col("ahead")
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))


def position(begin: Column) -> Column:
    """The time at which the demand of the source reaches so many words: the root in [0, 1] of
    slope * t^2 + (1 - slope) * t = begin / target."""
    part = F.least(F.lit(1.0), begin / F.col("target"))
    b = 1 - F.col("slope")
    root = F.sqrt(b * b + 4 * F.col("slope") * part)
    return F.when(F.col("target") > 0, 2 * part / (b + root))


def _uses(got: DataFrame, most: int) -> DataFrame:
    """A row for each use of the placed documents, range-sorted by training position."""
    got = got.withColumn("use", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    begin = (F.col("use") * F.col("source_size") + F.col("ahead")).cast("double")
    got = got.withColumn("words", words_of_use(F.col("use"))).where("words > 0")
    uses = got.select("row", "doc_id", "source", "use", "size", "words", position(begin).alias("position"))
    return uses.orderBy("position", "source", "doc_id", "use")


def schedule(docs: DataFrame, weights: Column | None = None, most: int = 3, bucket_rows: int = 2_000) -> DataFrame:
    """One row per use of a document, range-sorted by training position: doc_id, source, use,
    words (fewer than size where a source's demand ends inside the document), position."""
    return _uses(placed(docs, weights, most, bucket_rows), most).drop("row")


def totals(docs: DataFrame, weights: Column | None = None, most: int = 3, bucket_rows: int = 2_000) -> DataFrame:
    """Per document: size, its source's size and target, and from the schedule, which is written in
    its order first, the words taken over all uses and the position of the first one (null if it
    is not used)."""
    got = stage(placed(docs, weights, most, bucket_rows), "placed")
    uses = stage(_uses(got, most), "schedule")
    per = uses.groupBy("row").agg(F.sum("words").alias("words"), F.min("position").alias("position"))
    met = got.join(per, "row", "left")
    return met.select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "position")


def mixed(docs: DataFrame, weights: Column | None = None, most: int = 3) -> DataFrame:
    """The mix itself: documents with all their columns, one row per use, in training order.
    Where a source's demand ends inside a document its text ends there too.

    Rows are matched by a hash of all their columns.  Equal rows are one row with the uses of
    all of them, each with its own words and position.
    """
    names = docs.columns
    key = F.sha2(F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"}), 256)
    keyed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), key.alias("key"))
    lean = docs.select(key.alias("doc_id"), "source", "text")
    uses = schedule(lean, weights, most).select(F.col("doc_id").alias("key"), "use", "words", "size", "position")
    got = keyed.dropDuplicates(["key"]).join(uses, "key")
    units = F.regexp_extract_all("row.text", F.lit(SPACE + "*" + WORD), F.lit(0))
    head = F.array_join(F.slice(units, F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), head).otherwise(F.col("row.text"))
    changed = {"text": text, **({"n_chars": F.length(text).cast("long")} if "n_chars" in names else {})}
    return got.orderBy("position", "key", "use").select(*[changed.get(n, F.col(f"row.`{n}`")).alias(n) for n in names])
