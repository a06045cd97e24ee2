"""Packing documents into training windows by lexical retrieval.

Whole windows of a long document stand by themselves, which leaves one rest per document,
shorter than a window.  BM25 weights come from figures of the whole corpus: number of rests,
their mean length, and the number of rests with each token id.  Rests are sorted by their
heaviest terms, common ones first (see ``route``), and cut into consecutive shards of about
``shard_docs``: documents with the same heavy terms stand together, and a term of any
frequency only spans more shards.  Each shard builds an inverted index over the token ids of
its rests.  A seed asks it with its ``query_terms`` heaviest terms; unused neighbours, best
first, fill the seed's window as far as they fit whole.  The best neighbour that does not fit
is cut to fill the window to the last token, and what is left of it is the next seed.  Where
nothing shares a term with the seed the longest unused rest is taken.  So only the last
window of a shard has padding.  A neighbour in another shard is not reached; the README
gives the share that is.

With an ``order`` the training order decides instead: shards are consecutive slices of it, the
seed is the first unused rest, sequences are numbered by the place of their seeds, and uses
of one doc_id do not share a window while anything else is left.

A null text counts as empty: its piece is the end id alone.  Rows may repeat, each is a
document by itself; ties of scores go by doc_id and length.  An empty table gives no pieces.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.workers import by_value
from riskloom.llm.common import pieces, whole_text
from riskloom.llm.tokens import encoder
from riskloom.plans.staging import stage

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
PIECE_NAMES = [p.split()[0] for p in PIECES.split(", ")]
ENCODED = "doc_id long, place array<long>, doc_tokens long, window_crcs array<long>, windows binary, rest binary"
#: Most partitions that the sorted rests are cut into; a partition holds as many shards as it needs.
PARTITIONS_MOST = 10_000
#: Bytes of texts that are encoded, and rests that are counted or get their keys together.
TEXTS_MOST, RESTS_MOST = 4 << 20, 512


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Corpus(NamedTuple):
    """Figures of all rests: how many, their mean length, how many have each token id."""

    n: int
    mean: float
    df: np.ndarray


def corpus(encoded: DataFrame, code: str) -> Corpus:
    """One count for each token id in use comes to the driver, however many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, tokens = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            rests = batch.column(0).to_pylist()
            for first in range(0, len(rests), RESTS_MOST):
                some = rests[first : first + RESTS_MOST]
                ids = np.frombuffer(b"".join(some), code)
                owner = np.repeat(np.arange(len(some)), [len(r) // ids.itemsize for r in some])
                seen = np.bincount(np.unique((owner << 32) | ids) & 0xFFFFFFFF, minlength=len(df))
                seen[: len(df)] += df
                df = seen
                n += len(some)
                tokens += ids.nbytes
        some = np.flatnonzero(df)
        term = np.concatenate([[-2, -1], some])
        yield pa.RecordBatch.from_pydict({"term": pa.array(term, pa.int64()), "n": pa.array(np.concatenate([[n, tokens], df[some]]), pa.int64())})

    sums = encoded.select("rest").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in sums.collect()}
    n, size = found.pop(-2, 0), found.pop(-1, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Corpus(n, max(size / np.dtype(code).itemsize / max(n, 1), 1.0), df)


def idf_of(n: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def routes(rests: list[np.ndarray], whole: Corpus, k1: float, b: float, shard_docs: int, terms: int = 6) -> list[bytes]:
    """The sort key of each rest: its heaviest terms of those that recur, first the one that
    about fills a shard (nearest to ``shard_docs`` among the heaviest), then by weight.  The
    rests of a batch are sorted together."""
    lengths = np.array([len(r) for r in rests], np.int64)
    owner = np.repeat(np.arange(len(rests), dtype=np.int64), lengths)
    ids = np.concatenate(rests).astype(np.int64) if len(rests) else np.zeros(0, np.int64)
    pairs, tf = np.unique((owner << 32) | ids, return_counts=True)
    owner, term = pairs >> 32, pairs & 0xFFFFFFFF
    df = whole.df[term]
    shared = df > 1
    owner, term, tf, df = owner[shared], term[shared], tf[shared], df[shared]
    weight = idf_of(whole.n, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[owner] / whole.mean))
    begins = np.searchsorted(owner, np.arange(len(rests) + 1)).tolist()
    common = np.where(df >= shard_docs // 4, weight, -1.0)
    packed, out = term.astype(">u4"), []
    for first, last in zip(begins, begins[1:]):  # terms ascend, so of equal weights the first is the smaller term
        w, some = weight[first:last], np.arange(last - first)
        if len(w) > terms:
            some = np.flatnonzero(w >= np.partition(w, len(w) - terms)[len(w) - terms])
        some = some[np.argsort(-w[some], kind="stable")[:terms]]
        lead = int(np.argmax(common[first:last])) if len(w) else 0
        if len(w) and common[first + lead] >= 0:
            some = np.concatenate([[lead], some])
        out.append(packed[first + some].tobytes())
    return out


class Index:
    """BM25 over lists of term numbers, with the figures of these lists or of a whole corpus."""

    def __init__(self, docs: list[np.ndarray], k1: float, b: float, whole: Corpus | None = None):
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(self.n, dtype=np.int64), lengths)
        terms = np.concatenate(docs).astype(np.int64) if self.n else np.zeros(0, np.int64)
        pairs, tf = np.unique(terms * self.n + owner, return_counts=True) if len(terms) else (terms, terms)
        term, self.doc = pairs // max(self.n, 1), pairs % max(self.n, 1)
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        self.first, self.last = first, first + df
        idf = np.repeat(idf_of(self.n, df) if whole is None else idf_of(whole.n, whole.df[self.terms]), df)
        mean = whole.mean if whole else max(lengths.mean() if self.n else 1.0, 1.0)
        norm = k1 * (1 - b + b * lengths / mean)
        self.weight = idf * tf * (k1 + 1) / (tf + norm[self.doc])
        # The same entries by document, for what each document asks with: terms that others have.
        useful = np.flatnonzero(np.repeat(df > 1, df))
        by_doc = self.doc[useful]
        order = useful[np.argsort(by_doc.astype(np.uint16) if self.n <= 1 << 16 else by_doc, kind="stable")]
        self.own_term, self.own_weight = np.repeat(np.arange(len(self.terms)), df)[order], self.weight[order]
        self.own_at = np.searchsorted(self.doc[order], np.arange(self.n + 1))

    def asked(self, seed: int, query_terms: int) -> np.ndarray:
        """The heaviest terms of a document, of equal weights the first."""
        own = slice(self.own_at[seed], self.own_at[seed + 1])
        weight, term = self.own_weight[own], self.own_term[own]
        if len(weight) > query_terms > 0:
            some = np.flatnonzero(weight >= np.partition(weight, len(weight) - query_terms)[len(weight) - query_terms])
            weight, term = weight[some], term[some]
        return term[np.argsort(-weight, kind="stable")[:query_terms]]

    def scores(self, seed: int, query_terms: int) -> np.ndarray:
        asked = self.asked(seed, query_terms)
        if not len(asked):
            return np.zeros(self.n)
        spans = [slice(self.first[t], self.last[t]) for t in asked]
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)


def fill(
    rests: list[np.ndarray], window: int, k1: float, b: float, query_terms: int, whole: Corpus | None = None,
    same: np.ndarray | None = None,
) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (rest, first token, tokens).  With ``same``, rests are in training
    order and those with equal numbers are kept apart."""
    index = Index(rests, k1, b, whole)
    left = np.array([len(r) for r in rests], np.int64)
    begun = np.zeros(len(rests), np.int64)
    unused = left > 0
    longest = np.argsort(-left, kind="stable") if same is None else np.arange(len(rests))
    nxt = 0

    def take(i: int, room: int) -> tuple[int, int, int]:
        n = min(int(left[i]), room)
        piece = (int(i), int(begun[i]), n)
        begun[i] += n
        left[i] -= n
        unused[i] = False
        return piece

    def spare(made: list[tuple[int, int, int]] = ()) -> int | None:
        nonlocal nxt
        while nxt < len(longest) and not unused[longest[nxt]]:
            nxt += 1
        if same is not None and made:
            free = longest[nxt:][unused[longest[nxt:]]]
            free = free[~np.isin(same[free], same[[i for i, _, _ in made]])]
            if len(free):
                return int(free[0])
        return int(longest[nxt]) if nxt < len(longest) else None

    seed = spare()
    while seed is not None:
        made = [take(seed, window)]
        room = window - made[0][2]
        scores = index.scores(seed, query_terms)
        near = np.flatnonzero(unused & (scores > 0))
        near = near[np.argsort(-scores[near], kind="stable")]
        if same is not None:
            near = near[same[near] != same[seed]]
            near = near[np.sort(np.unique(same[near], return_index=True)[1])]
        seed = None
        while room:
            fits = near[left[near] <= room]
            if len(fits):
                # As many of the best as fit together, then look again at what still fits.
                n = max(1, int(np.searchsorted(np.cumsum(left[fits]), room, side="right")))
                for i in fits[:n]:
                    room -= int(left[i])
                    made.append(take(i, window))
                near = near[unused[near]]
                continue
            cut = int(near[0]) if len(near) else spare(made)
            if cut is None:
                break
            made.append(take(cut, room))
            room -= made[-1][2]
            near = near[unused[near]]
            if left[cut]:
                seed = cut
        yield made
        if seed is None:
            seed = spare()


def pack(
    docs: DataFrame,
    file: str,
    style: str,
    end_id: int = 1,
    window: int = 2048,
    shard_docs: int = 2048,
    query_terms: int = 24,
    k1: float = 1.2,
    b: float = 0.75,
    with_ids: bool = False,
    order: Column | None = None,
) -> DataFrame:
    """One row per piece; ``ids`` are its ids as little-endian 32-bit integers if asked for.
    ``order`` is the place of a row in training, an array of longs."""
    shards = max(1, math.ceil(docs.count() / shard_docs))
    ordered = order is not None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file, style)
        end = enc.pack([end_id])
        code = f"<u{enc.width}"
        for batch in (part for whole in batches for part in pieces(whole, "text", TEXTS_MOST)):
            counts, crcs, windows, rests = [], [], [], []
            for packed in enc.many(batch.column(2).to_pylist()):
                packed += end
                ids = np.frombuffer(packed, code)
                whole = len(ids) // window * window
                counts.append(len(ids))
                crcs.append([crc(ids[i : i + window]) for i in range(0, whole, window)])
                windows.append(packed[: whole * enc.width] if with_ids else b"")
                rests.append(packed[whole * enc.width :])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "place": batch.column(1), "doc_tokens": pa.array(counts, pa.int64()),
                "window_crcs": pa.array(crcs, pa.list_(pa.int64())), "windows": pa.array(windows, pa.binary()), "rest": pa.array(rests, pa.binary()),
            })

    text = whole_text()
    place = F.lit(None) if order is None else order
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.cast("array<long>").alias("place"), text.alias("text"))
    encoded = stage(rows.mapInArrow(encode, ENCODED), "encoded")
    code = f"<u{encoder(file, style).width}"
    whole = corpus(encoded, code)

    def pack_shard(rows: pd.DataFrame, number: int) -> tuple[pd.DataFrame, int]:
        if not ordered:
            rows = rows.sort_values(["doc_id", "doc_tokens"], kind="stable", na_position="last").reset_index(drop=True)
        out, windows = [], []

        def add(row: int, start: int, length: int, total: int, offset: int, ids: np.ndarray | None, check: int | None = None) -> None:
            check = crc(ids) if check is None else check
            out.append((doc_ids[row], start, length, check, total, number, offset, ids.astype("<u4").tobytes() if with_ids else None))

        doc_ids, totals = rows["doc_id"].to_list(), rows["doc_tokens"].to_list()
        rests = [np.frombuffer(x, code) for x in rows["rest"]]
        before = [t - len(r) for t, r in zip(totals, rests)]
        same = None
        if ordered:  # a row without an id is a document by itself
            same = pd.factorize(rows["doc_id"])[0]
            same = np.where(same < 0, len(rows) + np.arange(len(rows)), same)
        for i, crcs in enumerate(rows["window_crcs"]):
            windows += [(i, k * window, int(check)) for k, check in enumerate(crcs)]
        windows += [(made[0][0], made, None) for made in fill(rests, window, k1, b, query_terms, whole, same)]
        if ordered:
            windows.sort(key=lambda w: w[0])
        for i, made, check in windows:
            if check is not None:
                ids = np.frombuffer(rows["windows"][i], code)[made : made + window] if with_ids else None
                add(i, made, window, totals[i], 0, ids, check)
            else:
                offset = 0
                for j, first, n in made:
                    add(j, before[j] + first, n, totals[j], offset, rests[j][first : first + n])
                    offset += n
            number += 1
        return pd.DataFrame(out, columns=PIECE_NAMES).astype({"doc_id": "Int64"}), number

    def pack_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive shards of a sorted partition; the last has up to twice ``shard_docs``."""
        held, have, number = [], 0, None
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in PIECE_NAMES])

        def made(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            pieces, number = pack_shard(rows.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), number)
            return pa.RecordBatch.from_pandas(pieces, schema, preserve_index=False)

        for batch in batches:
            if not batch.num_rows:
                continue
            if number is None:
                number = batch.column("part")[0].as_py() << 40
            held.append(batch)
            have += batch.num_rows
            while have >= 2 * shard_docs:
                every = pa.Table.from_batches(held)
                yield made(every.slice(0, shard_docs))
                held, have = every.slice(shard_docs).to_batches(), have - shard_docs
        if have:
            yield made(pa.Table.from_batches(held))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rests = [np.frombuffer(r, code) for r in batch.column("rest").to_pylist()]
            keys = [k for i in range(0, len(rests), RESTS_MOST) for k in routes(rests[i : i + RESTS_MOST], whole, k1, b, shard_docs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "route"])

    if not ordered:
        keys = ["route", "doc_id", "doc_tokens", "salt"]
        # written, as Spark reads the rows twice to cut them by range
        rows = stage(encoded.mapInArrow(routed, f"{ENCODED}, route binary"), "routed").withColumn("salt", F.xxhash64("rest"))
    else:
        keys, rows = ["place"], encoded
    rows = rows.repartitionByRange(min(shards, PARTITIONS_MOST), *keys).sortWithinPartitions(*keys)
    return rows.drop("route", "salt", "place").withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(pack_sorted, PIECES)


by_value(sys.modules[__name__])
