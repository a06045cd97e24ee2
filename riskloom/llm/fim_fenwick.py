"""Fill-in-the-middle: texts cut in three, each cut found by descent in a Fenwick tree.

A text's UTF-8 bytes are cut into fixed blocks.  A Fenwick tree over the blocks keeps, in each
node, the units and the code points that begin in the blocks it covers.  A cut after ``u`` units
is found by binary lifting: from the largest power of two down, a node whose units still fit is
stepped over and subtracted; what is left of ``u`` is counted off inside the one block where the
descent ends.  Units are code points, or words: a word unit is the white space before a word and
the word, and what follows the last word is one more unit.  Units tile the text, so three parts
in a row always give the text again.

The cuts follow from a hash of the seed and doc_id alone, so reruns agree: ``h1`` to ``h4`` are
the first four groups of eight digits of the hex sha256 of ``seed:doc_id``.  The smaller and the
larger of ``h1`` and ``h2`` modulo units + 1 end prefix and middle; ``h3`` and ``h4`` choose the
form: plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle).

A null text counts as empty; an empty text, and one that holds a marker, stays plain, with null
cuts.  A null doc_id hashes as the empty string; documents with one id are cut at one draw each,
by their own lengths.  Repeated rows give equal rows.  Texts of any length are cut whole; a batch
is cut into parts of about a megabyte.  Other columns are kept under their names; the columns
added replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.workers import by_value
from riskloom.llm.common import pieces, raw

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = "n_units long, form string, prefix_chars long, middle_chars long, output string"
BLOCK = 256
_WORD_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


class Blocks:
    """A text's bytes in fixed blocks, under a Fenwick tree of (units, code points)."""

    def __init__(self, text: bytes, unit: str = "chars", block: int = BLOCK):
        self.block = block
        data = np.frombuffer(text, np.uint8)
        points = (data & 0xC0) != 0x80
        self.points, self.starts = points, points if unit == "chars" else _word_starts(text)
        edges = np.arange(0, len(data), block)
        counts = np.zeros((len(edges) + 1, 2), np.int64)
        if len(edges):
            counts[1:, 0] = np.add.reduceat(self.starts, edges, dtype=np.int64)
            counts[1:, 1] = np.add.reduceat(points, edges, dtype=np.int64)
        sums = counts.cumsum(axis=0)
        node = np.arange(len(sums))
        self.tree = (sums - sums[node & (node - 1)]).tolist()  # node i covers the blocks above i without its lowest bit
        self.n_units, self.n_points = sums[-1].tolist()

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code points before it) where the first ``units`` units end."""
        tree, at, points, left = self.tree, 0, 0, units
        step = 1 << (len(tree) - 1).bit_length()
        while step:
            if at + step < len(tree) and tree[at + step][0] <= left:
                at += step
                left -= tree[at][0]
                points += tree[at][1]
            step >>= 1
        # The cut lies before the unit that begins here after ``left`` others, or at the text's end.
        first = at * self.block
        begins = np.flatnonzero(self.starts[first : first + self.block])
        if left >= len(begins):
            return len(self.starts), self.n_points
        inside = int(begins[left])
        return first + inside, points + int(np.count_nonzero(self.points[first : first + inside]))


def _word_starts(text: bytes) -> np.ndarray:
    starts, end = np.zeros(len(text), bool), 0
    for m in _WORD_UNIT.finditer(text):
        starts[m.start()] = True
        end = m.end()
    if end < len(text):
        starts[end] = True
    return starts


def draws(seed: int, doc_id: int | None) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arrange(text: bytes, doc_id: int | None, seed: int, plain: int, spm: int, unit: str, block: int = BLOCK) -> tuple:
    """(units, form, code points of prefix and middle or None, output) of a text; ``plain`` and
    ``spm`` are percentages."""
    blocks = Blocks(text, unit, block)
    h1, h2, h3, h4 = draws(seed, doc_id)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or h3 % 100 >= 100 - plain or any(x in text for x in (p, s, m)):
        return blocks.n_units, "plain", None, None, text
    low, high = sorted((h1 % (blocks.n_units + 1), h2 % (blocks.n_units + 1)))
    (a, before), (b, until) = blocks.cut(low), blocks.cut(high)
    form = "spm" if h4 % 100 < spm else "psm"
    output = [s, text[b:], p, text[:a], m, text[a:b]] if form == "spm" else [p, text[:a], s, text[b:], m, text[a:b]]
    return blocks.n_units, form, before, until - before, b"".join(output)


def rearranged(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, unit: str = "chars") -> DataFrame:
    """The documents with n_units, form, prefix_chars, middle_chars (code points) and output."""
    if unit not in ("chars", "words"):
        raise ValueError(f"unit: chars or words, not {unit!r}")
    names = [f.split()[0] for f in ADDED.split(", ")]
    rows = docs.select(*[c for c in docs.columns if c not in names])
    kept = rows.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                made = [arrange(t, d, seed, plain, spm, unit) for t, d in zip(raw(batch.column("text")), batch.column("doc_id").to_pylist())]
                columns = [list(x) for x in zip(*made)] or [[] for _ in names]
                columns[-1] = [x.decode() for x in columns[-1]]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip(columns, kinds))], names=[*kept, *names])

    added = F.lit(None)  # the schema of what is added, as Spark parses it
    schema = rows.select("*", *[added.cast(f.split()[1]).alias(f.split()[0]) for f in ADDED.split(", ")]).schema
    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


by_value(sys.modules[__name__])
