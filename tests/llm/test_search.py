"""Operators 11 and 12 against plain versions, and their odd cases."""

import math
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ngram_screen, segment_bounds
from riskloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, lang string, digest string"


def lowered(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]


def items(spark, data):
    return spark.createDataFrame([(i, t, "en", "x") for i, t in data], ITEMS).repartition(2)


def benchmark():
    long = brute.texts()[12].split()
    return [
        (1, " ".join(long[3:30])), (1, " ".join(long[3:30])), (2, " ".join(long[20:34])), (10, "TWO-words"), (11, None), (12, " .,- "), (13, "w5, w6! straße?"),
        (None, " ".join(brute.texts()[20].split()[:11])), (14, "Éa éa"), (15, "漢字 " * 12), (16, " ".join(long[25:45])),
    ]


def screen(docs, tests, size):
    """(words, hit places, items) by document number."""
    windows = {}
    for i, t in tests:
        w = lowered(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    lengths = {len(x) for x in windows}
    out = []
    for t in docs:
        w, hit, met = lowered(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    met |= found
        out.append((len(w), hit, sorted(str(x) for x in met if x is not None)))
    return out


def cut(text, hit):
    """The text without hit words and what stands between two of them."""
    out, end, before = [], 0, False
    for i, m in enumerate(WORD.finditer(text)):
        if not (before and i in hit):
            out.append(text[end : m.start()])
        if i not in hit:
            out.append(m[0])
        end, before = m.end(), i in hit
    return "".join(out) + text[end:]


DOCS = [*brute.rows(), *[(500 + i, t, "en", None, 0, *"abcdefg") for i, t in enumerate(["W5 w6 STRASSE", "w5 W6 straße", "two words", "TWO  words", "\x00two\x7fwords!", "漢字 " * 15, "ÉA éa Éa éa"])], (500, "another text", "en", None, 0, *"abcdefg")]
DOCS += DOCS[5:9] + [(None, "two words", "en", None, 0, *"abcdefg"), (None, "x", "en", None, 0, *"abcdefg"), (None, None, "en", None, 0, *"abcdefg")]


@pytest.mark.parametrize("room", [1 << 20, 500])
def test_screen(spark, room):
    got = ngram_screen.screened(brute.documents(spark, DOCS), items(spark, benchmark()), size=10, broadcast_bytes=room).collect()
    want = [(d, n, len(hit), tuple(met)) for (d, *_), (n, hit, met) in zip(DOCS, screen([r[1] for r in DOCS], benchmark(), 10))]
    key = lambda r: (r[0] is None, r)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got], key=str) == sorted(want, key=str)
    assert sum(r[2] > 0 for r in want) > 8 and all(sum(b - a for a, b in r.spans) == r.n_hit for r in got)
    assert all(x[1] < y[0] for r in got for x, y in zip(r.spans, r.spans[1:])), key


def test_clean(spark):
    docs = brute.documents(spark, DOCS)
    results = screen([r[1] for r in DOCS], benchmark(), 4)
    spans = ngram_screen.clean(docs, items(spark, benchmark()), "spans", size=4)
    assert spans.columns == docs.columns
    want = [(r[0], r[1] if not hit else cut(r[1], hit), *r[2:]) for r, (_, hit, _) in zip(DOCS, results)]
    assert sorted(map(str, map(tuple, spans.collect()))) == sorted(map(str, want))
    kept = ngram_screen.clean(docs, items(spark, benchmark()), "documents", size=4)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r, (_, hit, _) in zip(DOCS, results) if not hit)
    with pytest.raises(ValueError):
        ngram_screen.clean(docs, docs, "words")


def test_screen_of_empty_tables_and_long_texts(spark):
    docs, none = brute.documents(spark, DOCS[:20]), items(spark, [])
    assert ngram_screen.screened(docs.limit(0), items(spark, benchmark())).count() == 0
    assert {(r.n_hit, tuple(r["items"])) for r in ngram_screen.screened(docs, none).collect()} == {(0, ())}
    assert ngram_screen.clean(docs, none).exceptAll(docs).count() == 0
    words = [f"v{i}" for i in range(200_000)]
    long = brute.documents(spark, [(1, " ".join(words), "", "", 0, *"abcdefg"), (2, "q " * 100_000, "", "", 0, *"abcdefg")], slices=2)
    tests = items(spark, [(7, " ".join(words[199_985:])), (8, "q " * 30)])
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in ngram_screen.screened(long, tests).collect()) == [
        (1, 200_000, 15, ["7"]), (2, 100_000, 100_000, ["8"])
    ]


def test_screen_is_native(spark):
    plan = ngram_screen.screened(brute.documents(spark), items(spark, benchmark()))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


VECTORS = "vec_id long, label int, vector array<long>, hash string, block string, asks string"


def vectors(spark, data, slices=3):
    return spark.createDataFrame([(i, n, v, "h", "b", "a") for i, n, v in data], VECTORS).repartition(slices)


def mined(data, every=10, positives=5, negatives=5, low=80, high=100):
    """Rows as results, by scoring all pairs."""
    rows = {(i, n, tuple(v)) for i, n, v in data if None not in (i, n, v) and None not in v and sum(x * x for x in v) <= 1 << 62}
    out = []
    for a in rows:
        if a[0] % every:
            continue
        score = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in rows if r != a)
        for s, p, _ in [x for x in score if x[2] == a[1]][:positives]:
            inside = [x for x in score if x[2] != a[1] and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a[0], p, k, n, -s, -t) for k, (t, n, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def random_vectors(seed, n=220, width=20, spread=40):
    pick = random.Random(seed)
    centres = [[pick.randint(-spread, spread) for _ in range(width)] for _ in range(6)]
    label = lambda: 0 if pick.random() < 0.4 else pick.randint(1, 5)
    return [(i, label(), [c + pick.randint(-spread // 4, spread // 4) for c in pick.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("block_rows, data", [
    (1 << 14, random_vectors(1)), (7, random_vectors(2)), (30, random_vectors(3, width=64)), (16, random_vectors(4, spread=4, width=5)),
    (30, random_vectors(5, spread=1 << 27)), (40, random_vectors(6, width=1, spread=3)),
])
def test_hard_negatives(spark, data, block_rows):
    want = mined(data)
    got = segment_bounds.hard_negatives(vectors(spark, data), F.col("vec_id") % 10 == 0, block_rows=block_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_hard_negatives_of_odd_rows(spark):
    data = random_vectors(7, n=120, width=9)
    odd = [(None, 1, [1] * 9), (200, None, [1] * 9), (201, 1, None), (202, 1, [1, None]), (203, 2, []), (204, 3, [50]), (205, 9, [40] * 9), (210, 8, [30] * 30),
           (220, 2, [1 << 40] * 9), (230, 0, [0] * 9), (231, 0, []), (240, 4, [1 << 27] * 4), (241, 4, [1 << 27] * 3), (242, 5, [1 << 27] * 4)]
    data += odd + data[:30]  # repeated rows count once
    got = segment_bounds.hard_negatives(vectors(spark, data), F.col("vec_id") % 10 == 0, block_rows=11)
    assert sorted(map(tuple, got.collect())) == mined(data)


def test_hard_negatives_need_rows(spark):
    one = vectors(spark, [(0, 1, [5, 5]), (3, 2, [4, 5])])
    for df in (one, one.limit(0)):
        assert segment_bounds.hard_negatives(df, F.col("vec_id") % 10 == 0).count() == 0


def test_embeddings_with_odd_components(spark, tmp_path):
    rows = [(100, 1, [0.5, 0.25]), (101, 1, [0.5, 0.5]), (7, 2, [0.45, 0.45]), (8, 3, [float("nan"), 1.0]), (9, 3, [float("inf"), 1.0]), (10, 3, [None, 1.0]), (11, 2, [0.5, 0.2])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, (n + 1) % 10 if i % 7 == 0 else n, [math.floor(256 * float(np.float32(x))) for x in v]) for i, n, v in rows if all(x is not None and math.isfinite(x) for x in v)]
    got = QUERIES["op12_segment_bounds"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == mined(whole, every=100) and got


def test_bounds_hold():
    import pyarrow as pa

    pick = np.random.default_rng(5)
    for spread in (3, 300, 1 << 25):
        whole = pick.integers(-spread, spread, (60, 64))
        means, deviations = segment_bounds.summaries(whole)
        block = segment_bounds.Block(pa.RecordBatch.from_pydict({
            "vec_id": list(range(60)), "hash": [0] * 60, "label": ["a"] * 60, "norm": np.sqrt((whole.astype(float) ** 2).sum(axis=1)),
            "whole": [r.astype("<i8").tobytes() for r in whole], "means": [r.tobytes() for r in means], "deviations": [r.tobytes() for r in deviations],
        }))
        rows, width = np.arange(60), np.inf
        for level in range(len(segment_bounds.SEGMENTS)):
            low, high = block.bounds(rows, level, block, 3)
            exact = whole @ whole[3]
            assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < width
            width = (high - low).mean()
