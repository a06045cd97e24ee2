"""Operators 2, 4, 8 and 9 against plain versions, and their odd cases."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import links, lsh_forest, phrase_automata, stream_dedup, suffix_sort

DATA = brute.rows()
PAIRS = [(r[0], r[1]) for r in DATA]


@pytest.mark.parametrize("hot", [10_000, 1])
def test_phrases(spark, hot):
    got = phrase_automata.without_repeats(brute.documents(spark), hot=hot, patterns=7)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()}
    assert found == brute.without_words(PAIRS, 13)


def test_stretches_of_a_batch_are_those_of_each_text():
    rng, size, grain = random.Random(8), 5, 2
    texts = [" ".join(rng.choices("abcd", k=n)).encode() for n in (0, 3, 5, 40, 6, 25)]
    every = np.unique(phrase_automata._anchors(phrase_automata.Words(texts), size, grain)[2]).view(np.int64)
    cold, hot = every[::3], every[1::3]
    batch = phrase_automata.Stretches(texts, cold, hot, size, grain)
    assert len(batch.key) and batch.hot.any() and not batch.hot.all()
    for i, t in enumerate(texts):
        alone, mine = phrase_automata.Stretches([t], cold, hot, size, grain), batch.owner == i
        for name in ("key", "route", "hot", "n_windows"):
            assert getattr(alone, name).tolist() == getattr(batch, name)[mine].tolist()
        assert alone.begin.tolist() == (batch.begin[mine] - batch.words.first[i]).tolist()


def test_words_of_a_batch():
    rng = random.Random(9)
    for _ in range(300):
        texts = ["".join(rng.choices("aB \n\t\v\f\r\x1cé\0", k=rng.randrange(9))).encode() for _ in range(rng.randrange(5))]
        words = phrase_automata.Words(texts, lower=True)
        want = [t.lower().split() for t in texts]
        assert [words.buffer[a:b].tobytes() for a, b in zip(words.starts, words.ends)] == [w for ws in want for w in ws]
        assert words.buffer.tobytes() == b" ".join(w for ws in want for w in ws)
        assert words.counts.tolist() == [len(ws) for ws in want] and words.text.tolist() == [i for i, ws in enumerate(want) for _ in ws]


def test_phrases_keep_null_ids_and_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    data = [(i, text, None, None, 0, *"abcdefg") for i in (5, 5, 9, None)]
    got = phrase_automata.without_repeats(brute.documents(spark, data)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 20), (5, 0), (5, 0), (9, 20)]


@pytest.mark.parametrize("hot", [10_000, 1])
@pytest.mark.parametrize("size, grain", [(400, 64), (37, 8)])
def test_bytes(spark, size, grain, hot):
    got = suffix_sort.without_repeats(brute.documents(spark), size=size, grain=grain, hot=hot)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()}
    assert found == brute.without_bytes(PAIRS, size)
    assert all(len(r.starts) == r.n_spans and sum(r.ends) - sum(r.starts) == r.n_removed for r in got.collect())


def test_suffixes_sort_as_bytes():
    import numpy as np

    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order = suffix_sort.multikey_order(rows)
    assert [tuple(r) for r in rows[order]] == sorted(tuple(r) for r in rows)


def test_large_groups_are_compared_in_slices(monkeypatch):
    rng = np.random.default_rng(5)
    size, grain = 40, 8
    pool = [bytes(rng.integers(97, 99, size - grain).tolist()) for _ in range(30)]
    around = sorted({pool[a][int(cut):] + b"sameword" + pool[b][: int(end)] for a, b, cut, end in zip(*rng.integers(0, 30, (4, 400)))})
    left = np.array([x.index(b"sameword") for x in around])
    asked = []
    hashes = suffix_sort.stretch_hashes
    monkeypatch.setattr(suffix_sort, "stretch_hashes", lambda text, begin, end: asked.append(len(begin)) or hashes(text, begin, end))
    found = []
    for most in (10**9, 1000):
        monkeypatch.setattr(suffix_sort, "POSITIONS", most)
        asked.clear()
        found.append(suffix_sort.reaches(around, left, np.ones(len(around), np.int64), size, grain))
        assert sum(asked) > 2000
    assert max(asked) <= 1000 and found[0][1].any()
    assert all((a == b).all() for a, b in zip(*found))


@pytest.mark.parametrize("digest_chars, files", [(64, None), (1, None), (64, 1)])
def test_exact(spark, digest_chars, files):
    """A digest of one hex digit makes different texts meet; their whole texts part them."""
    got = stream_dedup.duplicates(brute.documents(spark), digest_chars, files).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == brute.exact_groups(PAIRS)
    assert {r.doc_id: r.text_sha256 for r in got} == {d: brute.sha(brute.bare(t).encode()) for d, t in PAIRS}


def test_exact_keeps_one_of_equal_rows(spark):
    data = [(i, t, "en", "s", 0, *"abcdefg") for i, t in [(3, "a b"), (3, "a b"), (None, "ab"), (1, "ab"), (None, "c"), (7, None), (8, "")]]
    got = stream_dedup.deduplicated(brute.documents(spark, data))
    assert got.columns == brute.documents(spark, data).columns
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == [(-1, "c"), (3, "a b"), (7, None)]


@pytest.mark.parametrize("words, percent, most", [(3, 85, 4096), (5, 80, 4096), (3, 85, 2)])
def test_near(spark, words, percent, most):
    got = lsh_forest.near_duplicates(brute.documents(spark), words, percent, region_most=most).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_groups(PAIRS, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def near_pairs(groups, words=100):
    """Groups of two close copies each of two texts that are similar near the threshold, so
    that a copy is nearer than what the groups must be linked by."""
    pick = random.Random(5)
    out = []
    for g in range(groups):
        one = [f"g{g}w{i}" for i in range(words)]
        two = one[:]
        for k in range(1, 1 + g % 4):
            two[25 * k] = f"g{g}v{k}"
        out += [" ".join(one), " ".join([*one, f"g{g}a"]), " ".join(two), " ".join([*two, f"g{g}b"])]
    ids = list(range(len(out)))
    pick.shuffle(ids)
    return [(i, t) for i, t in zip(ids, out)]


@pytest.mark.parametrize("words, percent, most", [(3, 85, 3), (5, 80, 2)])
def test_near_pairs_at_the_threshold(spark, words, percent, most):
    """Regions above the limit are settled as those below it."""
    pairs = near_pairs(100)
    docs = brute.documents(spark, [(i, t, "en", "s", 0, *"abcdefg") for i, t in pairs])
    got = lsh_forest.near_duplicates(docs, words, percent, region_most=most).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_groups(pairs, words, percent)


def test_large_regions_of_equal_minima(spark):
    """Classes that all 60 minima leave in one region are still looked at pair by pair."""
    labelled = spark.createDataFrame([(1, 0, n, n // 4) for n in range(50)], "region long, tree int, node long, component long")
    met = set()
    tasks = lsh_forest._sliced(labelled, 10).collect()
    for a in (r for r in tasks if r.asks):
        met |= {frozenset((a.node, b.node)) for b in tasks if b.answers and (a.ask_slice, a.slice) == (b.ask_slice, b.slice)}
    assert met >= {frozenset((a, b)) for a in range(50) for b in range(a) if a // 4 != b // 4}


def test_near_keeps_clean_and_null_ids(spark):
    data = [(i, t, "en", "s", 0, *"abcdefg") for i, t in [(None, "quite alone here"), (2, None), (3, ""), (4, "x y z v"), (4, "x y z v"), (None, "x y z v")]]
    got = lsh_forest.one_of_each(brute.documents(spark, data), words=3, percent=85)
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect() if r.doc_id) == [(2, ""), (3, ""), (4, "x y z v"), (4, "x y z v")]
    assert got.columns == brute.documents(spark, data).columns


def test_an_id_with_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    data = [(i, t, "en", "s", 0, *"abcdefg") for i, t in [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (7, a + " more"), (None, b), (None, "x y z"), (None, "x y z"), (None, None)]]
    got = lsh_forest.near_duplicates(brute.documents(spark, data), words=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (2, 1), (3, 1), (7, 1)]
    assert sorted((r.n_shingles, r.component_id or -1, r.kept) for r in got if not r.doc_id) == [(0, -1, True), (1, -1, True), (1, -1, True), (58, 1, False)]
    kept = lsh_forest.one_of_each(brute.documents(spark, data), words=3, percent=85)
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, ""), (-1, "x y z"), (1, a), (1, b)]
    joined = [(1, a), (1, b), (2, b + " more"), (3, a + " more " + b)]  # a longer text links nothing by the id alone
    data = [(i, t, "en", "s", 0, *"abcdefg") for i, t in joined]
    kept = lsh_forest.one_of_each(brute.documents(spark, data), words=3, percent=85)
    assert sorted((r.doc_id, len(r.text)) for r in kept.collect()) == sorted((i, len(t)) for i, t in joined if i != 2)


@pytest.mark.parametrize("most", [1, 40, 300, 10**6])
def test_runs_cut_no_group(most):
    pick = random.Random(most)
    leading = sorted(pick.choice([b"a", b"ab", b"b", b"c", b"d", b"e"]) for _ in range(60))
    batches = []
    while leading:
        n = pick.randint(1, 9)
        some, leading = leading[:n], leading[n:]
        batches.append(pa.RecordBatch.from_pydict({"leading": pa.array(some, pa.binary()), "around": pa.array([b"x" * pick.randint(0, 30) for _ in some], pa.binary())}))
    got = [t.column("leading").to_pylist() for t in suffix_sort.whole_groups(iter(batches), most)]
    assert sum(got, []) == [x for b in batches for x in b.column(0).to_pylist()]
    assert all(x[-1] != y[0] for x, y in zip(got, got[1:])) and (most > 300 or len(got) > 1)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95)]
    got = links.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(61)} | {(90, 90), (95, 90), (100, 90)}


@pytest.mark.parametrize(
    "operator",
    [phrase_automata.without_repeats, suffix_sort.without_repeats, stream_dedup.duplicates, lsh_forest.near_duplicates, lsh_forest.one_of_each, stream_dedup.deduplicated],
)
def test_empty_table(spark, operator):
    none = brute.documents(spark).where(F.lit(False))
    assert operator(none).count() == 0
