"""Two plug-ins, as a user would write them."""

from __future__ import annotations

import sys

from riskloom.functions.workers import by_value
from riskloom.operators.detect import outcome
from riskloom.operators.plugins import Plugin

CAPITALS = outcome("injection", 8, "capitals", "low", "candidate", "high", "capitals")
LONG_WORD = outcome("injection", 8, "long_word", "low", "candidate", "high", "long word")


def capital_lines(path: str, lines: list[str]):
    """Lines with over a third of a file's capital letters.  Fails on files that have none."""
    capitals = [sum("A" <= x <= "Z" for x in line) for line in lines]
    for i, (n, line) in enumerate(zip(capitals, lines), 1):
        if 300 * n // sum(capitals) > 100:
            yield i, line, CAPITALS


def long_words(path: str, lines: list[str]):
    for i, line in enumerate(lines, 1):
        if any(len(word) > 14 for word in line.split(" ")):
            yield i, line, LONG_WORD


EXAMPLES = [Plugin("CAPITALS", capital_lines), Plugin("LONG-WORDS", long_words, (".yaml",))]
by_value(sys.modules[__name__])
