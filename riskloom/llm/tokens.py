"""Encoding whole texts with a public tokenizer, fast for repeated pieces.

The tokenizers library spends most of its time outside the merging of bytes.  A text is
therefore cut here at the limits where its pre-tokenizer cuts as well, each distinct piece
is merged once by the library's model, and the packed ids of a text are the joined ids of
its pieces.  ``many`` does so for a batch of texts: limits by comparing neighbouring
characters, equal pieces by Arrow's dictionary, so that a piece is looked up once a batch.
Texts with characters above U+00FF, or with white space other than the six ASCII ones, are
cut at safe white space only and go through the library as they are.
Added tokens such as ``<|endoftext|>`` get their own ids in a text, as in the library.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa

from riskloom.functions.workers import by_value

#: Letters, digits and white space up to U+00FF, as the tokenizers' patterns class them.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
BLANK = " \t\n\x0b\x0c\r"
OTHER_BLANK = "\x1c\x1d\x1e\x1f\x85\xa0"
ENDING = "'s|'t|'re|'ve|'m|'ll|'d"

PATTERNS = {
    "words": f"{ENDING}|[{LETTER}]+|[{NUMBER}]|[^{BLANK}{LETTER}{NUMBER}]+",
    "bytes": f"{ENDING}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+",
}
#: Where other texts may be cut: word by word, or at a blank between two visible ASCII characters.
SAFE_CUTS = {"words": f"[{BLANK}]+", "bytes": "(?<=[!-~])(?= [!-~])"}
SEEN_MOST = 800_000
PIECE_MOST = 64


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _kinds() -> np.ndarray:
    """The class of each character up to U+00FF: 1 white space, 2 letter, 3 number, 0 any other."""
    every = "".join(map(chr, range(256)))
    kinds = np.zeros(256, np.uint8)
    for kind, chars in enumerate((BLANK, LETTER, NUMBER), 1):
        kinds[[ord(c) for c in re.findall(f"[{chars}]", every)]] = kind
    return kinds


def piece_starts(text: np.ndarray, kinds: np.ndarray, ends: np.ndarray, style: str) -> np.ndarray:
    """Which characters begin a piece of the pattern for a style, in texts of Latin-1 joined to
    one buffer; ``ends`` has the end of each text.  White space that belongs to no piece
    (``words``) is cut off like one."""
    n = len(text)
    begins = np.concatenate([[0], ends[:-1]])
    begins = begins[begins < n]
    start = np.ones(n, bool)
    start[1:] = kinds[1:] != kinds[:-1]
    if style == "bytes":
        # The last of some blanks before a visible character begins a piece, which goes on if it is a space.
        joins = np.zeros(n, bool)
        joins[1:] = start[1:] & (kinds[:-1] == 1)
        joins[begins] = False
        after = np.flatnonzero(joins)
        start[after - 1] = True
        start[after] = text[after - 1] != 32
    else:
        start |= kinds == 3  # each digit is a piece
    start[begins] = True
    # Endings like 's where a piece begins with the apostrophe; what follows them begins another.
    marks = np.flatnonzero(text == 39)
    marks = marks[start[marks]]
    if len(marks):
        room = ends[np.searchsorted(ends, marks, side="right")] - marks
        first, second = (np.where(room > k, text[np.minimum(marks + k, n - 1)], 0) for k in (1, 2))
        one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        two = ((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        start[marks[one | two] + 1] = False
        follows = np.concatenate([marks[one] + 2, marks[two] + 3])
        start[follows[follows < n]] = True
    return start


def _latin(text: str, table: bytes | None) -> bytes | None:
    """The text in Latin-1, its characters changed by a table; none if it has other characters
    or other white space."""
    try:
        coded = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    made = coded.translate(table, OTHER_BLANK.encode("latin-1"))
    return made if len(made) == len(coded) else None


class Encoder:
    """Packed ids (little-endian, ``width`` bytes each) of texts.

    ``style`` says how the file's pre-tokenizer cuts: ``words`` (lower case, white space
    dropped, word ends marked) or ``bytes`` (white space kept).  About ``SEEN_MOST`` pieces
    are remembered, in two halves: when one is full, those of the older half that were not
    met again are forgotten.
    """

    def __init__(self, file: str, style: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        # A text that holds one of the file's added tokens goes through the library whole.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        self.style, self.lower = style, style == "words"
        self.kinds = _kinds()
        self.small = bytes(ord(chr(i).lower()) for i in range(256)) if self.lower else None
        self.pattern = re.compile(PATTERNS[style])
        self.cut = re.compile(SAFE_CUTS[style])
        self.odd = re.compile(f"[{OTHER_BLANK}]|[^\\x00-\\xff]")
        self.table = {i: "".join(_byte_letters()[b] for b in chr(i).encode()) for i in range(256)}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = {2: "H", 4: "I"}[self.width]
        self.seen: dict[str | bytes, bytes] = {}
        self.before: dict[str | bytes, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        made = array(self.code, ids)
        if sys.byteorder != "little":
            made.byteswap()
        return made.tobytes()

    def _merge(self, piece: str) -> bytes:
        return self.pack([t.id for t in self.model.tokenize(piece.translate(self.table))])

    def _library(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _each(self, parts: list, make) -> list[bytes]:
        if len(self.seen) > SEEN_MOST // 2:
            self.before, self.seen = self.seen, {}
        made = [*map(self.seen.get, parts)]
        fresh = {part: self.before.get(part) or make(part) for part in {p for p, m in zip(parts, made) if m is None}}
        self.seen.update((p, m) for p, m in fresh.items() if len(p) <= PIECE_MOST)
        return [fresh[p] if m is None else m for p, m in zip(parts, made)] if fresh else made

    def _known(self, parts: list[str], make) -> bytes:
        try:
            return b"".join(map(self.seen.__getitem__, parts))
        except KeyError:
            return b"".join(self._each(parts, make))

    def ids(self, text: str) -> bytes:
        if self.added.search(text):
            return self._library(text)
        if self.odd.search(text):
            return b"".join([self._odd(unit) for unit in self.cut.split(text) if unit])
        return self._known(self.pattern.findall(text.lower() if self.lower else text), self._merge)

    def many(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text, for a batch at a time."""
        latin = [None if self.added.search(t) else _latin(t, self.small) for t in texts]
        joined = [t for t in latin if t is not None]
        if not any(joined):
            return [self.ids(t) for t in texts]
        buffer = b"".join(joined)
        ends = np.cumsum([len(t) for t in joined])
        chars = np.frombuffer(buffer, np.uint8)
        kinds = self.kinds[chars]
        start = piece_starts(chars, kinds, ends, self.style)
        if self.lower:  # white space only parts the pieces
            start = start[kinds != 1]
            joined = [t.translate(None, BLANK.encode()) for t in joined]
            buffer = b"".join(joined)
            ends = np.cumsum([len(t) for t in joined])
        starts = np.flatnonzero(start)
        offsets = pa.py_buffer(np.append(starts, len(buffer)).astype(np.int64))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(buffer)]).dictionary_encode()
        piece = found.indices.to_numpy()
        made = self._each(found.dictionary.to_numpy(zero_copy_only=False).tolist(), lambda piece: self._merge(piece.decode("latin-1")))
        ids = np.frombuffer(b"".join(made), f"<u{self.width}")
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // self.width
        firsts = np.cumsum(sizes) - sizes
        n = sizes[piece]
        stops = np.cumsum(n)
        every = ids[np.repeat(firsts[piece] - (stops - n), n) + np.arange(int(n.sum()))].tobytes()
        stops = np.concatenate([[0], stops])[np.searchsorted(starts, ends)] * self.width
        made, begin = [], 0
        for stop in stops.tolist():
            made.append(every[begin:stop])
            begin = stop
        known = iter(made)
        return [self.ids(t) if x is None else next(known) for t, x in zip(texts, latin)]

    def _odd(self, unit: str) -> bytes:
        if self.odd.search(unit):
            return self._known(["\0" + unit], lambda keyed: self._library(keyed[1:]))
        return self._known(self.pattern.findall(unit.lower() if self.lower else unit), self._merge)


def encoder(file: str, style: str) -> Encoder:
    """The encoder for a file, kept on the library's module so that the next task of the
    same worker finds it, with the pieces it has seen."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_riskloom_encoders", {})
    if (file, style) not in kept:
        kept[file, style] = Encoder(file, style)
    return kept[file, style]


by_value(sys.modules[__name__])
