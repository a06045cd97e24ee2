"""Rules of one's own in Python, each kept from the failures of the others.

A plug-in looks at one file at a time.  What it raises on a file becomes a row that names the
rule, the file and the error; the rule reports nothing for that file and goes on with the next,
and all other rules are untouched.  Files stream through in Arrow batches; rules that do not ask
for a file's suffix do not see it.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions.workers import by_value
from riskloom.model import CANDIDATE_FIELDS, FLOW
from riskloom.operators import detect as D

ROWS = "repo_id string, path string, rule string, error string, line_number int, evidence string, number int, seq int, ctx string"
ERRORS = "rule string, repo_id string, path string, error string"


@dataclass(frozen=True)
class Plugin:
    """``find(path, lines)`` gives (line number from 1, evidence, number of an outcome) for each
    finding; ``suffixes`` are the file endings it reads, all if there are none."""

    key: str
    find: Callable[[str, list[str]], Iterable[tuple[int, str, int]]]
    suffixes: tuple[str, ...] = ()


def _looked_at(plugins: list[Plugin], window: int):
    names = [f.split()[0] for f in ROWS.split(", ")]
    kinds = [pa.int32() if f.endswith(" int") else pa.string() for f in ROWS.split(", ")]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for repo, path, text in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "path", "text"))):
                lines = (text or "").splitlines()
                for p in plugins:
                    if p.suffixes and not (path or "").endswith(p.suffixes):
                        continue
                    try:
                        found = []
                        for seq, (line, evidence, number) in enumerate(p.find(path, list(lines))):
                            first = max(line - window, 1)
                            near = "\n".join(lines[first - 1 : line + window])
                            found.append((repo, path, p.key, None, int(line), str(evidence), int(number), seq, near))
                        out += found
                    except Exception as e:
                        out.append((repo, path, p.key, f"{type(e).__name__}: {e}", None, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    return run


def plugin_rows(files: DataFrame, plugins: list[Plugin]) -> DataFrame:
    """A row for each finding and each error of the plug-ins."""
    by_value(sys.modules[__name__], K, *{sys.modules[p.find.__module__] for p in plugins})
    return D.read_files(files).select("repo_id", "path", "text").mapInArrow(_looked_at(plugins, K.EVIDENCE_WINDOW), ROWS)


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NOT NULL").select("rule", "repo_id", "path", "error")


def found(rows: DataFrame) -> DataFrame:
    """Candidates, as the built-in rules give them, with the lines around them and no flows."""
    o = F.expr(f"element_at({D._outcome_table()}, number + 1)")
    values = {"seq": F.col("o.seq") + F.col("seq"), "line_number": F.col("line_number"), "evidence": F.col("evidence"), "false_positive_risk": F.col("o.risk")}
    hits = rows.where("error IS NULL").withColumn("o", o)
    columns = [values.get(n, F.col(f"o.{n}")).cast(t).alias(n) for n, t in CANDIDATE_FIELDS]
    return hits.select("repo_id", "path", *columns, "ctx", F.expr(f"CAST(array() AS array<{FLOW}>)").alias("flows"))
