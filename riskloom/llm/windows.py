"""Hashes of word windows and of byte windows, for many texts at a time.

A buffer's prefix sums of ``table[byte] * M**i`` (modulo 2**64) give the hash of any stretch
of bytes in two look-ups, so windows of any length cost the same.  Stretches of equal bytes
have equal hashes wherever they lie.
"""

from __future__ import annotations

import sys

import numpy as np

from riskloom.functions.workers import by_value

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
CHUNK = 1 << 20
#: White space as in ``bytes.split``, all as a space.
ONE_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _table() -> np.ndarray:
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(0x94D049BB133111EB)
    return mixed(x)


def mixed(x: np.ndarray) -> np.ndarray:
    """The values spread evenly over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_kept: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _kept or len(_kept["up"]) < n:
        size = max(n, 1 << 16)
        _kept["up"], _kept["down"] = _powers(MULTIPLIER, size), _powers(INVERSE, size)
        _kept["table"] = _table()
    return _kept["up"][:n], _kept["down"][:n]


def stretch_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of buffer[s:e] for each (s, e); starts ascend.  Long buffers go by chunks of
    stretches, so that the memory stays near the longest stretch."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(starts, base + CHUNK)))
        part = buffer[base : int(ends[first:last].max())]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_kept["table"][part] * up[:-1], out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mixed((sums[e] - sums[s]) * down[s] + (ends[first:last] - starts[first:last]).astype(np.uint64))
        first = last
    return out


class Words:
    """The words of several texts, each text's words joined by single spaces."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        plain = [(t.lower() if lower else t).translate(ONE_BLANK) for t in texts]  # ASCII case and white space only, as bytes have it
        flat = np.frombuffer(b" ".join(plain), np.uint8)
        visible = np.concatenate([[False], flat != 32, [False]])
        edges = np.flatnonzero(visible[1:] != visible[:-1])
        begins, stops = edges[::2], edges[1::2]
        offsets = np.cumsum([len(t) + 1 for t in plain]) if plain else np.zeros(0, np.int64)
        self.last = np.searchsorted(begins, offsets)
        self.counts = np.diff(self.last, prepend=0)
        self.first = self.last - self.counts
        used = visible[1:-1]
        used[stops[:-1]] = True  # one blank after each word but the last
        self.buffer = flat if used.all() else flat[used]
        sizes = stops - begins
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of k words within one text."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        return at, stretch_hashes(self.buffer, self.starts[at], self.ends[at + k - 1])

    def shingle_sets(self, k: int) -> list[np.ndarray]:
        """Per text the sorted distinct hashes of its windows; a shorter text is one window."""
        at, hashes = self.windows(k)
        owner = self.text[at]
        bounds = np.searchsorted(owner, np.arange(len(self.counts) + 1))
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        whole = dict(zip(short.tolist(), stretch_hashes(self.buffer, self.starts[self.first[short]], self.ends[self.last[short] - 1])))
        return [
            np.array([whole[i]], np.uint64) if i in whole else np.unique(hashes[bounds[i] : bounds[i + 1]])
            for i in range(len(self.counts))
        ]


by_value(sys.modules[__name__])
