"""Quality rules as a ledger: every rule is evaluated once per document, its failure is a bit
beside the measurements; policies are masks over the bits, chosen afterwards.

A policy with a new version needs no look at the texts, and what one rule alone rejects under
a policy comes from counts per bit pattern.

A null or empty text has no words and fails ``few_words``.  Rows are kept as they come, with
repeated rows and ids; an empty table gives an empty ledger.  The ledger carries doc_id
alone; ``apply_policy`` leaves other columns as they are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.workers import by_value
from riskloom.llm.common import SPACES, raw, whole_text

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

#: Each rule: when a document fails it, over the measurements.  The place is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "odd_word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "shouting": "10 * n_upper > 4 * word_chars",
}
BASE = ["few_words", "repeated_words"]
#: Policies by version: the rules that reject.
POLICIES: dict[int, list[str]] = {
    1: BASE,
    2: [*BASE, "many_symbols", "repeated_lines"],
    3: list(RULES),
}
LATEST = max(POLICIES)


def mask(rules: list[str]) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r in rules)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which the text has twice or more."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if len(number) == len(words):
        return 0
    n = len(words) - window + 1
    keys = np.zeros(n, np.uint64)
    for k in range(window):  # 64 bits mixed from the exact numbers of the words
        keys = (keys ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


UPPER = bytes(range(65, 91))


def measured(text: bytes) -> tuple[int, ...]:
    words = text.split()
    bare = text.translate(None, SPACES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words), len(bare.decode()), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(text) - len(text.translate(None, UPPER)),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: bit i is set if rule i fails."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measured(t) for t in raw(batch.column(1))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(len(MEASURES)))], names=["doc_id", *MEASURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(measure, LEDGER)
    bits = " | ".join(f"(CASE WHEN {when} THEN {1 << i}L ELSE 0L END)" for i, when in enumerate(RULES.values()))
    return rows.withColumn("failed", F.expr(bits))


def passes(failed: Column, version: int = LATEST) -> Column:
    """Whether a document passes the policy of a version, from its bits alone."""
    return failed.bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def patterns(book: DataFrame) -> DataFrame:
    """Documents and words per bit pattern: at most one row for each set of rules."""
    return book.groupBy("failed").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


def ablations(book: DataFrame, version: int = LATEST) -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents (and words) that only it
    rejects, so that come back without it.  Worked out on the counts per pattern."""
    whole = mask(POLICIES[version])
    names = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r in POLICIES[version]])
    hit = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("failed").bitwiseAND(F.lit(whole)) == F.col("r.bit")
    count = lambda when, what: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0))
    return patterns(book).withColumn("r", F.explode(names)).groupBy(F.col("r.rule").alias("rule")).agg(
        count(hit, "n_docs").alias("n_failed"), count(alone, "n_docs").alias("n_alone"), count(alone, "n_words").alias("words_alone"),
    )


def apply_policy(docs: DataFrame, version: int = LATEST) -> DataFrame:
    """The documents that pass, with all their columns.  The measurements are taken in the
    same pass over the texts, so nothing is joined."""
    names = docs.columns
    wrapped = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))

    @F.pandas_udf("array<long>")
    def measure(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: list(measured(t.encode())))

    got = wrapped.withColumn("m", measure(text))
    for i, m in enumerate(MEASURES):
        got = got.withColumn(m, F.col("m")[i])
    bits = " | ".join(f"(CASE WHEN {when} THEN {1 << i}L ELSE 0L END)" for i, when in enumerate(RULES.values()))
    return got.where(passes(F.expr(bits), version)).select("row.*")


by_value(sys.modules[__name__])
