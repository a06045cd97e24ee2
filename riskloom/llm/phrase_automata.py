"""Removing passages that an earlier document has, by automata over recurring phrases.

A window is ``size`` consecutive words.  A word goes if a window over it starts in a document
with a smaller doc_id too.

Documents that share an anchor (``anchors``, here stretches of ``grain`` words) send the words
around it, as far as windows with that anchor reach, to the anchor's shard.  A shard confirms
the windows that two documents have, compiles them into Aho-Corasick automata of at most
``patterns`` each, and streams all stretches of the shard through them, which finds every
occurrence.  Equal stretches of a task travel once, and all stretches travel packed by shard.
Each document then gets the occurrences in its own stretches and drops the words of those that
an earlier document has.  An anchor with more than ``hot`` texts would make a shard large: its
windows go one by one as hashes, and the smallest id of each is a grouped minimum.

A null text has no words.  A null doc_id counts as larger than all others.  Copies and rows of
one doc_id: only smaller ids count, so equal rows of the first id are all kept.  An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.workers import by_value
from riskloom.llm.anchors import opened, recurring, smallest_in
from riskloom.llm.common import partitions_for, pieces
from riskloom.llm.windows import Words, mixed, stretch_hashes
from riskloom.plans.staging import stage

RESULT = "n_words long, n_removed long, kept_sha256 string, kept_text string"
LAST_ID = (1 << 63) - 1
#: Stretches that a task holds before it packs them by shard.
PACKED = 100_000


def _anchors(words: Words, size: int, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its first word, and the place and hash of its anchor."""
    at, hashes = words.windows(grain)
    if not len(at):
        return at, at, hashes, at
    full = np.full(len(words.starts), np.iinfo(np.uint64).max, np.uint64)
    full[at] = hashes
    place = smallest_in(full, size - grain + 1)
    first = np.flatnonzero(words.text[: max(0, len(words.starts) - size + 1)] == words.text[size - 1 :])
    place = place[first]
    return first, place, full[place], words.text[first]


def _removed(n: int, gone: int, kept: bytes, text: bool) -> tuple[int, int, str, str | None]:
    return n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if text else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    n, gone, sha, text = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_pydict({
        "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(text, pa.string()),
    })


class Stretches:
    """The stretches of the recurring anchors of some texts: route, key, first word and end, number
    of the text, and whether it is a single window of a hot anchor.  Words are counted through all
    texts.  An anchor recurs or is hot in the whole corpus, so the texts' anchors go together."""

    def __init__(self, texts: list[bytes], cold: np.ndarray, hot: np.ndarray, size: int, grain: int):
        self.words = Words(texts)
        first, place, hashes, owner = _anchors(self.words, size, grain)
        signed = hashes.view(np.int64)
        is_hot = np.isin(signed, hot)
        use = np.isin(signed, cold) | is_hot
        first, place, hashes, owner, is_hot = first[use], place[use], hashes[use], owner[use], is_hot[use]
        # Windows of one anchor are neighbours; a hot anchor's windows go one by one.
        new = np.ones(len(first), bool)
        new[1:] = (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1) | is_hot[1:]
        self.at = np.flatnonzero(new)
        self.begin, self.owner = first[self.at], owner[self.at]
        stop = np.append(self.at[1:], len(first))
        self.n_windows = stop - self.at
        self.end = self.begin + self.n_windows + size - 1
        w = self.words
        content = stretch_hashes(w.buffer, w.starts[self.begin], w.ends[self.end - 1]) if len(self.begin) else np.zeros(0, np.uint64)
        self.key = mixed(content ^ (hashes[self.at] * np.uint64(3)))
        self.hot, self.route = is_hot[self.at], hashes[self.at]


def _hits(s: Stretches, found: pa.ListArray, own: np.ndarray, size: int) -> np.ndarray:
    """Which words of the texts lie in a window that a document with an id below ``own`` has;
    ``found`` has the keys, window places and smallest ids that each text's stretches met."""
    row = np.repeat(np.arange(len(found)), pa.compute.fill_null(pa.compute.list_value_length(found), 0).to_numpy(zero_copy_only=False))
    key, places, lows = found.flatten().flatten()
    count = pa.compute.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
    places, lows = (x.flatten().to_numpy(zero_copy_only=False) for x in (places, lows))
    first = np.cumsum(count) - count
    # Of a text and a key one number each, the same for stretches and for what was found.
    distinct, number = np.unique(np.concatenate([key.to_numpy(zero_copy_only=False), s.key.view(np.int64)]), return_inverse=True)
    number += np.concatenate([row, s.owner]) * len(distinct)
    met, asked = number[: len(row)], number[len(row) :]
    order = np.argsort(met, kind="stable")
    at = np.minimum(np.searchsorted(met[order], asked), max(len(met) - 1, 0))
    mine = np.flatnonzero(met[order][at] == asked) if len(met) else np.zeros(0, np.int64)
    entry = order[at[mine]] if len(met) else mine
    n = count[entry]
    each = np.repeat(first[entry] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    begin = np.repeat(s.begin[mine], n) + places[each]
    begin = begin[lows[each] < np.repeat(own[s.owner[mine]], n)]
    total = len(s.words.starts)
    return np.cumsum(np.bincount(begin, minlength=total + 1) - np.bincount(begin + size, minlength=total + 1))[:total] > 0


def _kept(s: Stretches, gone: np.ndarray, text: bool) -> list[tuple]:
    """A row for each text without its words that are ``gone``."""
    w, rows = s.words, []
    flat, starts, ends = w.buffer.tobytes(), w.starts, w.ends
    for first, last in zip(w.first.tolist(), w.last.tolist()):
        mine = gone[first:last]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], mine, [True]]).view(np.int8))) + first
        runs = zip(starts[edges[::2]].tolist(), ends[edges[1::2] - 1].tolist())
        rows.append(_removed(last - first, int(mine.sum()), b" ".join([flat[a:b] for a, b in runs]), text))
    return rows


def _locate(group: list[tuple[int, bytes, int, int]], size: int, patterns: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(key, window places, smallest doc_id that has the window) of the stretches (key, words,
    smallest and largest doc_id) of one shard's part."""
    import ahocorasick

    # Each word of the part becomes two characters, so a match must begin at a multiple of two.
    number: dict[bytes, str] = {}
    for _, words, _, _ in group:
        for w in words.split(b" "):
            if w not in number:
                n = len(number)
                number[w] = chr(33 + (n >> 8)) + chr(33 + (n & 255))
    coded = [("".join(map(number.__getitem__, words.split(b" "))), key, low, high) for key, words, low, high in group]
    span = 2 * size
    least: dict[str, int] = {}
    most: dict[str, int] = {}
    for text, _, low, high in coded:
        for i in range(0, len(text) - span + 1, 2):
            w = text[i : i + span]
            known = least.get(w)
            if known is None:
                least[w], most[w] = low, high
            else:
                if low < known:
                    least[w] = low
                if high > most[w]:
                    most[w] = high
    confirmed = [w for w, low in least.items() if low < most[w]]
    found: dict[int, list[tuple[int, int]]] = {}
    for a in range(0, len(confirmed), patterns):
        automaton = ahocorasick.Automaton()
        for w in confirmed[a : a + patterns]:
            automaton.add_word(w, least[w])
        automaton.make_automaton()
        for i, (text, _, _, _) in enumerate(coded):
            for end, low in automaton.iter(text):
                if end % 2 == 1:
                    found.setdefault(i, []).append(((end + 1 - span) // 2, low))
    for i, hits in found.items():
        yield coded[i][1], [p for p, _ in hits], [low for _, low in hits]


def _packs(held: list[dict[int, list]]) -> pa.RecordBatch:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    shard, packs = [], []
    for number, mine in enumerate(held):
        if mine:
            route, low, high, words = zip(*mine.values())
            numbers = np.array([list(mine), route, low, high], "<i8")
            packs.append(squeeze.compress(len(mine).to_bytes(8, "little") + numbers.tobytes() + b"\n".join(words)))
            shard.append(number)
    return pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int64()), "pack": pa.array(packs, pa.binary())})


def _settled(packs: list[bytes], size: int, patterns: int) -> Iterator[pa.RecordBatch]:
    """What the automata of one shard find, anchor by anchor, some thousand stretches at a time."""
    import zstandard

    large = zstandard.ZstdDecompressor()
    numbers, words = [], []
    for pack in packs:
        flat = large.decompress(pack)
        n = int.from_bytes(flat[:8], "little")
        numbers.append(np.frombuffer(flat[8 : 8 + 32 * n], "<i8").reshape(4, n))
        words += flat[8 + 32 * n :].split(b"\n")
    key, route, low, high = np.concatenate(numbers, axis=1)
    order = np.lexsort((key, route))
    new = np.flatnonzero(np.concatenate([[True], (route[order][1:] != route[order][:-1]) | (key[order][1:] != key[order][:-1])]))
    low[order[new]], high[order[new]] = np.minimum.reduceat(low[order], new), np.maximum.reduceat(high[order], new)
    order = order[new]  # equal stretches of several tasks are one
    starts = np.flatnonzero(np.concatenate([[True], route[order][1:] != route[order][:-1]]))
    stops = np.append(starts[1:], len(order))
    first = 0
    for last in range(len(starts)):
        if stops[last] - starts[first] >= patterns // 4 or last == len(starts) - 1:
            some = order[starts[first] : stops[last]]
            group = [*zip(key[some].tolist(), [words[i] for i in some.tolist()], low[some].tolist(), high[some].tolist())]
            keys, places, lows = [], [], []
            for k, place, least in _locate(group, size, patterns):
                keys.append(k)
                places.append(place)
                lows.append(least)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "places": pa.array(places, pa.list_(pa.int32())), "lows": pa.array(lows, pa.list_(pa.int64()))})
            first = last + 1


def without_repeats(docs: DataFrame, size: int = 13, grain: int = 6, hot: int = 10_000, patterns: int = 20_000, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the kept words if asked for."""

    def find(texts: list[bytes]) -> list[np.ndarray]:
        _, place, hashes, owner = _anchors(Words(texts), size, grain)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]

    def finish(texts: list[bytes], copies: list[tuple[bool, int]]) -> pa.RecordBatch:
        rows = []
        for t, (copy, _) in zip(texts, copies):
            words = t.split()
            gone = copy and len(words) >= size
            rows.append(_removed(len(words), len(words) if gone else 0, b"" if gone else b" ".join(words), with_text))
        return _batch(rows)

    done, open_docs = recurring(docs, find, finish, RESULT, hot)

    sent = open_docs.select("doc_id", "text", "first_id", "cold", "hot")
    shards = partitions_for(docs)

    def stretches(batch: pa.RecordBatch) -> Stretches:
        anchors = [batch.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("cold", "hot")]
        return Stretches(opened(batch.column("text")), *anchors, size, grain)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Stretches, np.ndarray]]:
        """Some documents at a time, their stretches, and the id that each document counts with."""
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 18):
                yield batch, stretches(batch), pa.compute.fill_null(batch.column("first_id"), LAST_ID).to_numpy(zero_copy_only=False)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cold stretches, packed by shard; equal ones of a pack once, with their smallest and largest id."""
        held: list[dict[int, list]] = [{} for _ in range(shards)]
        total = 0
        for _, s, lows in each(batches):
            flat, cold = s.words.buffer.tobytes(), ~s.hot
            route, begin, end = s.route.view(np.int64)[cold], s.begin[cold], s.end[cold]
            columns = (route % shards, s.key.view(np.int64)[cold], route, lows[s.owner[cold]], s.words.starts[begin], s.words.ends[end - 1])
            for shard, key, to, low, a, b in zip(*(c.tolist() for c in columns)):
                mine = held[shard]
                known = mine.get(key)
                if known is None:
                    mine[key] = [to, low, low, flat[a:b]]
                    total += 1
                elif low < known[1]:
                    known[1] = low
                elif low > known[2]:
                    known[2] = low
            if total >= PACKED:
                yield _packs(held)
                held, total = [{} for _ in range(shards)], 0
        if total:
            yield _packs(held)

    # Copies of the first document were finished before; their ids count through it, as all are larger.
    packs = sent.mapInArrow(ship, "shard long, pack binary").repartition(shards, "shard").sortWithinPartitions("shard")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, []
        for batch in batches:
            for shard, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != last and mine:
                    yield from _settled(mine, size, patterns)
                    mine = []
                last = shard
                mine.append(pack)
        if mine:
            yield from _settled(mine, size, patterns)

    found = "key long, places array<int>, lows array<long>"

    def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s, lows in each(batches):
            key = s.key.view(np.int64)
            order = np.lexsort((key, s.owner))
            key, owner = key[order], s.owner[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, owner = key[new], owner[new]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(owner)), "key": pa.array(key), "low": pa.array(lows[owner])})

    listed = "doc_id long, key long, low long"
    keys = sent.mapInArrow(list_keys, listed)
    # A hot anchor's windows are whole stretches: which document has one first is a minimum per window.
    only_hot = sent.where(F.size("hot") > 0).withColumn("cold", F.array().cast("array<bigint>"))
    single = only_hot.mapInArrow(list_keys, listed).groupBy("key").agg(F.min("low").alias("low"), F.max("low").alias("high")).where("low < high")
    single = single.select("key", F.array(F.lit(0)).alias("places"), F.array("low").alias("lows"))
    located = stage(packs.mapInArrow(locate, found).unionByName(single), "located")
    mine = keys.select("doc_id", "key").join(located, "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "places", "lows")).alias("found"))
    whole = open_docs.join(mine, open_docs["doc_id"].eqNullSafe(mine["doc_id"]), "left").select(open_docs["doc_id"], "text", "cold", "hot", "found")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in pieces(whole_batch, "text", 1 << 18):
                s = stretches(batch)
                own = pa.compute.fill_null(batch.column("doc_id"), LAST_ID).to_numpy(zero_copy_only=False)
                made = _batch(_kept(s, _hits(s, batch.column("found"), own, size), with_text))
                yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=["doc_id", *made.schema.names])

    return done.unionByName(whole.mapInArrow(remove, "doc_id long, " + RESULT))


by_value(sys.modules[__name__])
