"""Scoring texts by prediction by partial matching.

The model is a byte trie of contexts up to ``order`` bytes, counted over all training texts.  A
byte is coded in its longest known context; where that has not seen the byte, it escapes to
the context without its oldest byte, with the symbols of the longer one excluded.  A context
with n counted symbols of d kinds (both without the excluded ones) gives a symbol seen c times
(c - 1/2) / n and the escape d / 2n; a context whose symbols are all excluded escapes for
free; below the empty context the symbols never seen are equally likely.  Texts are lower-cased
words with one space between and a line end after, so the score covers words and end.

The trie is never in one place.  Texts lie in blocks; a block sends its distinct contexts with
symbols (and its distinct words), with their training counts, to the shards they belong to.  A
shard holds the part of the trie whose contexts agree in their last two bytes, sums the counts
of all blocks, and answers each block with log probabilities.  Only the counts of pairs of
bytes, 65,536 at most, are known to all tasks.

A null or empty text has the end alone.  A null doc_id is trained on.  Rows may repeat, each is
scored; a long text is cut into pieces that know the bytes before them, and its pieces are
added up.  Without training texts all bytes are equally likely.  An empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.workers import by_value
from riskloom.llm.common import partitions_for, raw, whole_text
from riskloom.llm.windows import Words, mixed
from riskloom.plans.staging import stage

BLOCKS = "block long, uids array<long>, doc_ids array<long>, held array<boolean>, ends array<boolean>, lengths array<long>, blob binary"
ASKED = "block long, shard long, grams binary, words binary"
ANSWER = "block long, shard long, logs binary, counts binary, n_kinds long"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


def _blocks(docs: DataFrame, order: int, block_bytes: int) -> DataFrame:
    """Texts packed into blocks, each piece after the ``order`` bytes before it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        base = TaskContext.get().partitionId() << 36
        number = row = 0
        parts: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            uids, ids, held, ends, texts = (list(x) for x in zip(*parts))
            columns = [[base + number], [uids], [ids], [held], [ends], [[len(t) for t in texts]], [squeeze.compress(b"".join(texts))]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()))],
                names=["block", "uids", "doc_ids", "held", "ends", "lengths", "blob"],
            )

        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2))):
                whole, at = bytes(order) + normal(text), order
                row += 1
                while at < len(whole):
                    stop = len(whole)
                    if stop - at > block_bytes:  # cut after the word that reaches the limit
                        stop = whole.find(b" ", at + block_bytes) + 1 or len(whole)
                    parts.append((base + row, doc_id, held, stop == len(whole), whole[at - order : stop]))
                    size += stop - at
                    at = stop
                    if size >= block_bytes:
                        yield flush()
                        number, parts, size = number + 1, [], 0
        if parts:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), whole_text().alias("text"))
    return stage(rows.mapInArrow(build, BLOCKS), "blocks")


class Block:
    """The pieces of a block: codes of all contexts with their symbols (the symbol in the lowest
    byte, older bytes above), and the hashes of all words."""

    def __init__(self, blob: bytes, lengths: list[int], order: int):
        import zstandard

        text = zstandard.ZstdDecompressor().decompress(blob)
        size = np.array(lengths, np.int64)
        first = np.cumsum(size) - size
        self.buffer = np.frombuffer(text, np.uint8)
        real = np.ones(len(text), bool)
        for k in range(order):
            real[first + k] = False
        codes = np.zeros(len(text) - order, np.int64)
        for j in range(order, -1, -1):  # the oldest byte first
            codes <<= 8
            codes |= self.buffer[order - j : len(text) - j]
        self.codes = codes[real[order:]]
        self.piece = np.repeat(np.arange(len(size), dtype=np.int32), size - order)
        words = Words([text[a + order : a + n] for a, n in zip(first.tolist(), size.tolist())])
        self.word_piece, hashes = words.text, words.windows(1)[1]
        self.words = hashes.view(np.int64)


def _dealt(values: np.ndarray, shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct values by shard and value, and where each shard begins."""
    order = np.lexsort((values, shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _distinct(block: Block, shards: int) -> Iterator[tuple]:
    """(occurrences' places among the distinct, distinct values by shard, shard limits) of grams and words."""
    for values, part in ((block.codes, lambda v: mixed(((v >> 8) & 0xFFFF).astype(np.uint64))), (block.words, lambda v: mixed(v.view(np.uint64)))):
        place, kinds = pd.factorize(values)
        kinds = np.asarray(kinds, np.int64)
        order, limits = _dealt(kinds, (part(kinds) % np.uint64(shards)).astype(np.int64), shards)
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        yield back[place], kinds[order], limits


def _folded(values: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending values as differences, with their counts, compressed."""
    import zstandard

    steps = np.diff(values.view(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unfolded(message: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(message), np.uint8)
    n = len(flat) // 12
    steps = np.ascontiguousarray(flat[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64).view(np.int64), np.ascontiguousarray(flat[8 * n :].reshape(4, n).T).view("<u4").ravel()


def _column(message: bytes, kind: str) -> np.ndarray:
    """Numbers whose bytes were laid out by place and compressed."""
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(message), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Trie:
    """The contexts of one shard, two bytes and longer, over the counts of byte pairs."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, pairs: np.ndarray, order: int):
        self.order, self.levels = order, {}
        for k in range(order, 1, -1):
            codes, at = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            self.levels[k] = [codes, np.bincount(at, weights=n, minlength=len(codes)) if len(codes) else np.zeros(0)]
        self.pairs = pairs.astype(float)  # by older byte and symbol
        self.single = self.pairs.sum(axis=0)
        self.contexts = {}
        for k in range(order, 1, -1):
            codes, count = self.levels[k]
            context = codes >> 8
            begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(codes) else np.zeros(0, np.int64)
            lower = self._count(k - 1, codes & ((1 << 8 * k) - 1))
            add = lambda x: np.add.reduceat(x, begin) if len(begin) else np.zeros(0)  # noqa: B023,E731
            self.contexts[k] = (context[begin], add(count), add(np.ones(len(codes))), add(lower))

    def _count(self, k: int, codes: np.ndarray) -> np.ndarray:
        if k == 1:
            return self.pairs[(codes >> 8) & 255, codes & 255]
        if k == 0:
            return self.single[codes & 255]
        known, count = self.levels[k]
        if not len(known):
            return np.zeros(len(codes))
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, count[at], 0.0)

    def _context(self, k: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, kinds, and symbols of the next lower context that are kinds here."""
        if k == 1:
            row = (codes >> 8) & 255
            return self.pairs.sum(axis=1)[row], (self.pairs > 0).sum(axis=1).astype(float)[row], ((self.pairs > 0) @ self.single)[row]
        if k == 0:
            whole = np.ones(len(codes))
            return self.single.sum() * whole, (self.single > 0).sum() * whole, 0 * whole
        known, n, d, lower = self.contexts[k]
        if not len(known):
            return (np.zeros(len(codes)),) * 3
        asked = (codes >> 8) & ((1 << 8 * k) - 1)
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        hit = known[at] == asked
        return tuple(np.where(hit, x[at], 0.0) for x in (n, d, lower))

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol in its context."""
        out, left = np.zeros(len(codes)), np.ones(len(codes), bool)
        gone_n, gone_d = np.zeros(len(codes)), np.zeros(len(codes))
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(self.order, -1, -1):
                n, d, lower = self._context(k, codes)
                free_n, free_d = n - gone_n, d - gone_d
                count = self._count(k, codes & ((1 << 8 * (k + 1)) - 1))
                codable = left & (free_d > 0)
                hit = codable & (count > 0)
                out[hit] += np.log10((count[hit] - 0.5) / free_n[hit])
                miss = codable & ~hit
                out[miss] += np.log10(0.5 * free_d[miss] / free_n[miss])
                left &= ~hit
                gone_n, gone_d = lower, d
        never = 256 - int((self.single > 0).sum())
        if never:
            out[left] -= np.log10(never)
        return out


def scores(docs: DataFrame, order: int = 5, block_bytes: int = 3 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The base is the sum over words and end of log10((c + 0.5) / (N + 0.5 (V + 1))), c a
    token's count, N all and V the distinct tokens in the training texts.
    """
    if not 2 <= order <= 6:
        raise ValueError("a context with its symbol must fit 64 bits and have two bytes or more")
    shards = partitions_for(docs)
    blocks = _blocks(docs, order, block_bytes)

    def basics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Training counts of byte pairs; at 65536 the words, at 65537 the texts."""
        total = np.zeros((1 << 16) + 2, np.int64)
        for batch in batches:
            for held, ends, lengths, blob in zip(*(c.to_pylist() for c in batch.columns)):
                block = Block(blob, lengths, order)
                train = ~np.array(held, bool)
                total[: 1 << 16] += np.bincount(block.codes[train[block.piece]] & 0xFFFF, minlength=1 << 16)
                total[1 << 16] += int(train[block.word_piece].sum())
                total[(1 << 16) + 1] += int((train & np.array(ends, bool)).sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(some), "n": pa.array(total[some])})

    counted = blocks.select("held", "ends", "lengths", "blob").mapInArrow(basics, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    known = np.zeros((1 << 16) + 2, np.int64)
    for code, n in counted.collect():  # 65,538 rows at most
        known[code] = n
    pairs, n_words, n_texts = known[: 1 << 16].reshape(256, 256), int(known[1 << 16]), int(known[-1])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, held, lengths, blob in zip(*(c.to_pylist() for c in batch.columns)):
                block = Block(blob, lengths, order)
                train = ~np.array(held, bool)
                sent = []
                for (place, kinds, limits), piece in zip(_distinct(block, shards), (block.piece, block.word_piece)):
                    n = np.bincount(place[train[piece]], minlength=len(kinds))
                    sent.append([(b > a, _folded(kinds[a:b], n[a:b])) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())])
                rows = [(number, s, g[1], w[1]) for s, (g, w) in enumerate(zip(*sent)) if g[0] or w[0]]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(columns[0], pa.int64()), "shard": pa.array(columns[1], pa.int64()),
                    "grams": pa.array(columns[2], pa.binary()), "words": pa.array(columns[3], pa.binary()),
                })

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        def summed(column: str) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
            each = [_unfolded(x) for x in rows[column]]
            at, kinds = pd.factorize(np.concatenate([values for values, _ in each]), sort=True)
            total = np.bincount(at, weights=np.concatenate([n for _, n in each]), minlength=len(kinds)).astype(np.int64)
            return [len(n) for _, n in each], at, np.asarray(kinds, np.int64), total

        squeeze = zstandard.ZstdCompressor(level=1)
        sizes, at, kinds, total = summed("grams")
        trained = total > 0
        logs = Trie(kinds[trained], total[trained], pairs, order).logs(kinds)[at].astype("<f4")
        word_sizes, word_at, words, word_total = summed("words")
        counts = word_total[word_at].astype("<i8")
        cut = lambda x, n: [squeeze.compress(y.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()) for y in np.split(x, np.cumsum(n)[:-1])]
        return pd.DataFrame({
            "block": rows["block"], "shard": rows["shard"], "logs": cut(logs, sizes), "counts": cut(counts, word_sizes),
            "n_kinds": [int((word_total > 0).sum())] + [0] * (len(rows) - 1),
        })

    asked = blocks.select("block", "held", "lengths", "blob").mapInArrow(ask, ASKED)
    answers = stage(asked.groupBy("shard").applyInPandas(answer, ANSWER), "answers")
    kinds = answers.agg(F.sum("n_kinds")).first()[0] or 0
    n_tokens, n_kinds = n_words + n_texts, kinds + (1 if n_texts else 0)
    floor = float(np.log10(n_tokens + 0.5 * (n_kinds + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["blob"], row["lengths"], order)
                got = {x["shard"]: x for x in row["got"]}
                (place, grams, limits), (word_place, words, word_limits) = _distinct(block, shards)
                logs, counts = np.zeros(len(grams)), np.zeros(len(words), np.int64)
                for s, x in got.items():
                    logs[limits[s] : limits[s + 1]] = _column(x["logs"], "<f4")
                    counts[word_limits[s] : word_limits[s + 1]] = _column(x["counts"], "<i8")
                n = len(row["uids"])
                ends = np.array(row["ends"], np.int64)
                c = counts[word_place]
                base = np.bincount(block.word_piece, weights=np.log10(c + 0.5), minlength=n) + ends * np.log10(n_texts + 0.5)
                tokens = np.bincount(block.word_piece, minlength=n) + ends
                known = np.bincount(block.word_piece, weights=c > 0, minlength=n).astype(np.int64) + ends * (n_texts > 0)
                yield pa.RecordBatch.from_pydict({
                    "uid": pa.array(row["uids"], pa.int64()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()),
                    "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
                    "base_score": pa.array(base - tokens * floor), "score": pa.array(np.bincount(block.piece, weights=logs[place], minlength=n)),
                })

    got = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "logs", "counts")).alias("got"))
    parts = blocks.join(got, "block").select("uids", "doc_ids", "held", "ends", "lengths", "blob", "got").mapInArrow(
        score, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    sums = [F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")]
    return parts.groupBy("uid", "doc_id", "held_out").agg(*sums).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


by_value(sys.modules[__name__])
