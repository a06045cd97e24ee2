"""Small documents with every odd case, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, shard string, block string, n string, words string, kept string"


def texts(seed: int = 1) -> list[str | None]:
    pick = random.Random(seed)
    vocabulary = ["the", "of", "And", "été", "straße", "x", "naïve", "漢字", "don't", "re|al", "$$$", "über", "a\xa0b"] + [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(pick.choices(vocabulary, k=n))
    passage, line = say(60), say(7)
    out: list[str | None] = [None, "", "   \n\t", "one", "two words", "THE of and", "the OF And"]
    for i in range(24):
        body = say(pick.randint(5, 120))
        out.append(body + ("\n" + passage if i % 4 == 0 else "") + ("\n" + line) * (i % 3) + "\n" + say(pick.randint(0, 30)))
    base = say(150).split()
    for i in range(8):  # a group of near copies
        copy = base[:]
        for _ in range(i):
            copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
        out.append(" ".join(copy))
    out += [out[9], out[9], (out[10] or "").replace(" ", "  \n"), (out[10] or "") + " ", "ab" * 600, "spam " * 300, "\n".join([line] * 30), say(3000), "SHOUT LOUD " * 8]
    return out


def rows(seed: int = 1) -> list[tuple]:
    """Documents with ids out of order, some null sources, and columns with clashing names."""
    got = texts(seed)
    ids = list(range(100, 100 + len(got)))
    random.Random(seed).shuffle(ids)
    odd = ("k", "r", "s", "b", "n", "w", "yes")
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", len(t or ""), *odd) for i, t in zip(ids, got)]


def documents(spark, data=None, slices=3):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(slices)


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def without_words(docs: list[tuple], size: int) -> dict:
    """Operator 2: (words, removed, hash of the rest) by doc_id."""
    words = {d: (t or "").encode().split() for d, t in docs}
    first: dict[tuple, int] = {}
    for d, w in words.items():
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(d, first.get(k, d))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def without_bytes(docs: list[tuple], size: int) -> dict:
    """Operator 9: (bytes, removed, runs, hash of the rest) by doc_id, for distinct ids."""
    data = {d: (t or "").encode() for d, t in docs}
    seen = Counter(t[i : i + size] for t in data.values() for i in range(len(t) - size + 1))
    out = {}
    for d, t in data.items():
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(t), sum(gone), runs, sha(bytes(b for b, g in zip(t, gone) if not g)))
    return out


def near_groups(docs: list[tuple], words: int, percent: int) -> dict:
    """Operator 8: (set size, component) by doc_id."""
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def bare(t: str | None) -> str:
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def exact_groups(docs: list[tuple]) -> dict:
    """Operator 4: (keeper, group size, kept) by doc_id."""
    groups = defaultdict(list)
    for d, t in docs:
        groups[bare(t)].append((-len(t or ""), d))
    out = {}
    for members in groups.values():
        keep = min(members)[1]
        out.update({d: (keep, len(members), d == keep) for _, d in members})
    return out


def mix(docs: list[tuple], most: int = 3) -> dict:
    """Operator 6: targets by source, by sharing again and again."""
    size: dict = defaultdict(int)
    for _, t, s in docs:
        size[s] += len((t or "").encode().split())
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        rest = total - sum(most * size[s] for s in full)
        shared = sum(weight[s] for s in order if s not in full)
        target = {s: most * size[s] if s in full else rest * weight[s] / shared for s in order}
        over = {s for s in order if target[s] > most * size[s]} - full
        if not over:
            return {s: (size[s], target[s]) for s in order}
        full |= over
