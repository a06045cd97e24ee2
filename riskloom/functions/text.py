"""Column helpers for text and lines."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import fixed as K


def strip(col: Column) -> Column:
    """Python's str.strip()."""
    return F.trim(col, F.lit(K.WHITESPACE))


def split_lines(text: Column) -> Column:
    """Python's str.splitlines() as an array (1-based when indexed by Spark)."""
    body = F.regexp_replace(text, f"(?:{K.LINE_BREAK})\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, K.LINE_BREAK, -1))


def decode(content: Column) -> Column:
    """Bytes to text; bad bytes become U+FFFD and a missing body the empty string."""
    return F.coalesce(F.make_valid_utf8(content.cast("string")), F.lit(""))


def _one_of(words: Iterable[str]) -> str:
    """Pattern for any of the words, each taken literally."""
    return "(?:" + "|".join(f"\\Q{w}\\E" for w in words) + ")"


def contains_any(col: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def starts_with_any(col: Column, words: Iterable[str]) -> Column:
    return F.rlike(col, F.lit("^" + _one_of(words)))


def ends_with_any(col: Column, words: Iterable[str]) -> Column:
    return F.rlike(col, F.lit(_one_of(words) + "\\z"))


def matches(col: Column, pattern: str) -> Column:
    return F.rlike(col, F.lit(pattern))


def is_comment(line: Column) -> Column:
    return starts_with_any(strip(line), K.COMMENT_STARTS)


def is_safe_reference(line: Column) -> Column:
    return contains_any(line, K.SAFE_REFERENCES)


def evidence_text(line: Column) -> Column:
    return strip(line)


def line_frame(lines: Column, line_no: Column, before: int, after: int) -> Column:
    """The lines from ``line_no - before`` to ``line_no + after`` that exist."""
    first = F.greatest(line_no - before, F.lit(1))
    return F.slice(lines, first, line_no + after - first + 1)


def frame_text(lines: Column, line_no: Column, before: int, after: int) -> Column:
    return F.array_join(line_frame(lines, line_no, before, after), "\n")


def normalized(evidence: Column) -> Column:
    """Evidence with runs of white space folded, stripped and lower-cased."""
    return F.lower(F.trim(F.regexp_replace(evidence, r"(?U)\s+", " ")))


def literal_map(mapping: dict) -> Column:
    """A constant map; look up with ``F.try_element_at``."""
    pairs: list[Column] = []
    for key, value in mapping.items():
        pairs += [F.lit(key), F.lit(value)]
    return F.create_map(*pairs)


def lookup(mapping: dict, key: Column, default=None) -> Column:
    found = F.try_element_at(literal_map(mapping), key)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))
