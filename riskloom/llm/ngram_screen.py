"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over the documents.

Benchmark items are cut into windows of ``size`` words; an item with fewer words, but not none,
is one window.  The distinct windows are the set: hash, words, and the items they stand in.  A
document's words are hashed once, its windows are hashes of word hashes, and each is looked up
in the set; only a hit is verified, by its words.  Spans are words inside any verified window.

The set is broadcast while its measured size is under ``broadcast_bytes``.  A larger one is cut
by hash into parts under that size, and the documents are scanned once for each part.  Nothing
but one narrow row per document and its hits is shuffled; texts stay where they are read.

Words are runs of digits, letters a-z (A-Z lowered, nothing else) and characters beyond ASCII.
A null or empty text has no words: as a document it is clean, as an item it has no windows.  An
item without an id marks words but is neither counted nor listed; items with one id are one item.
Repeated documents each get their row; documents that share an id are told apart by their texts.
An empty benchmark leaves all documents clean.  Texts of any length are scanned whole.  Other
columns, whatever their names, are kept by ``clean`` and not looked at by ``screened``.
Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import whole_text

#: What lies between words, and words, in texts before lowering.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The normalised words of a text.  Splitting is many times faster than extracting matches."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def test_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """hash, length, gram, items: one row for each distinct window of the benchmark."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(whole_text()).alias("words")).where(F.size("words") > 0)
    words = words.withColumn("length", F.least(F.size("words"), F.lit(size)))
    cut = words.select("item", "length", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at"))
    grams = cut.select("item", F.slice("words", F.col("at"), F.col("length")).alias("words"))
    per = grams.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return per.select(
        F.xxhash64(_word_hashes(F.col("words"))).alias("hash"), F.size("words").alias("length"), F.array_join("words", " ").alias("gram"), "items",
    )


def _scan(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, digest, n_words, length, at, items: verified hits, and for each document a row of
    length 0 if that is among the lengths."""
    text = whole_text()
    read = docs.select("doc_id", F.md5(text).alias("digest"), words_of(text).alias("words"))
    hashed = read.select("*", F.size("words").alias("n_words"), _word_hashes(F.col("words")).alias("hashes"))
    each = hashed.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("length"))
    starts = F.sequence(F.lit(1), F.col("n_words") - F.col("length") + 1)
    own = F.when(F.col("length") == 0, F.array(F.xxhash64("digest"))).when(
        F.col("n_words") >= F.col("length"), F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i, F.col("length"))))
    )
    rows = each.select("doc_id", "digest", "words", "n_words", "length", own.alias("own"))
    # The outer form keeps Spark from testing the size of the windows first, which would cut them twice.
    rows = rows.select("doc_id", "digest", "words", "n_words", "length", F.posexplode_outer("own").alias("at", "own_hash"))
    met = rows.join(F.broadcast(windows.select("hash", "gram", "items")), F.col("own_hash") == F.col("hash"), "left")
    # Words are joined and compared after the join, for equal hashes only.
    verified = F.col("gram") == F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ")
    return met.where((F.col("length") == 0) | verified).select("doc_id", "digest", "n_words", "length", "at", "items")


def _by_text(docs: DataFrame, benchmark: DataFrame, size: int, broadcast_bytes: int) -> DataFrame:
    """doc_id, digest, n_words, copies, hits, items: a row for each distinct document."""
    windows = test_windows(benchmark, size)
    room = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16) + 64
    total = windows.agg(F.sum(room).alias("bytes"), F.array_sort(F.collect_set("length")).alias("lengths")).first()
    parts = max(1, -(-(total.bytes or 0) // broadcast_bytes))
    scans = [
        _scan(docs, windows.where(F.pmod("hash", F.lit(parts)) == p) if parts > 1 else windows, [*([0] if p == 0 else []), *total.lengths])
        for p in range(parts)
    ]
    hit = F.col("length") > 0
    span = F.struct(F.col("at").alias("first"), (F.col("at") + F.col("length")).alias("end"))
    return reduce(DataFrame.unionByName, scans).groupBy("doc_id", "digest").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(~hit).alias("copies"),
        F.array_sort(F.collect_set(F.when(hit, span))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items")))))).alias("items"),
    )


def _merged(hits: Column) -> Column:
    """Sorted spans with those joined that overlap or touch."""

    def extend(spans: Column, x: Column) -> Column:
        last = F.element_at(spans, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))
        apart = (F.size(spans) == 0) | (x["first"] > F.try_element_at(spans, F.lit(-1))["end"])
        return F.when(apart, F.concat(spans, F.array(x))).otherwise(F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(longer)))

    return F.aggregate(hits, F.array().cast("array<struct<first:int,end:int>>"), extend)


def screened(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_hit (words in spans), spans (merged; first word and the one after the
    last), items (the ids of the items met, sorted as strings): a row for each document."""
    per = _by_text(docs, benchmark, size, broadcast_bytes).withColumn("spans", _merged(F.col("hits")))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    rows = per.select("doc_id", "n_words", covered.alias("n_hit"), "spans", "items", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return rows.drop("copy")


def _without(text: Column, spans: Column) -> Column:
    """A text without its spans, each from its first word's start to its last word's end."""
    words = F.array_remove(F.split(text, BETWEEN), "")
    blanks = F.split(text, ANY_WORD)  # before the first word, between words, after the last one
    pairs = F.zip_with(blanks, words, lambda b, w: F.concat(b, F.coalesce(w, F.lit(""))))

    def kept(i: Column) -> Column:
        first = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
        end = F.coalesce(F.get(spans, i)["first"], F.size(pairs))
        return F.concat(F.array_join(F.slice(pairs, first + 1, end - first), ""), F.coalesce(F.get(blanks, end), F.lit("")))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), kept), "")


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", size: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The documents, with all their columns, without the spans that a benchmark window covers
    (``remove="spans"``) or without the documents that have any (``remove="documents"``).  Clean
    texts, nulls included, stay as they are."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove: spans or documents, not {remove!r}")
    per = _by_text(docs, benchmark, size, broadcast_bytes).where(F.size("hits") > 0)
    found = per.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), _merged(F.col("hits")).alias("_spans"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_doc")) & (F.md5(whole_text("_row.text")) == F.col("_digest"))
    if remove == "documents":
        return rows.join(found, same, "left_anti").select("_row.*")
    text = F.col("_row.text")
    cut = F.when(F.col("_spans").isNull(), text).otherwise(_without(text, F.col("_spans")))
    return rows.join(found, same, "left").select(*[cut.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
