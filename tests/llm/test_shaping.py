"""Operators 1, 3, 6, 7 and 10 against plain versions, and their odd cases."""

import math
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import curriculum, ppm, retrieval_packing, rule_ledger, token_store, tokens
from riskloom.llm.tokens import Encoder

DATA = brute.rows()
STYLES = [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")]


def library(name):
    made = Tokenizer.from_file(public_tokenizers.path(name))
    made.encode_special_tokens = True
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name, style", STYLES)
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab's'tAÉß 1²0 \n\t  .,!#’é\xa0\x85漢İΣς́\x1c\r\x0blve<|>"), st.characters(codec="utf-8")), max_size=40))
def test_pieces_have_the_library_ids(name, style, text):
    if style not in test_pieces_have_the_library_ids.__dict__:
        setattr(test_pieces_have_the_library_ids, style, (Encoder(public_tokenizers.path(name), style), library(name)))
    enc, ids = getattr(test_pieces_have_the_library_ids, style)
    assert np.frombuffer(enc.ids(text), "<u2").tolist() == ids(text)


@pytest.mark.parametrize("name, style", STYLES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="ab''stmdrevlL1²é \n\t.,\xa0", max_size=20), st.text(max_size=10), st.sampled_from(["", "<|endoftext|> a", "it's", "'", " ", "\x1fa b"])), max_size=6))
def test_batches_have_the_library_ids(name, style, texts):
    if style not in test_batches_have_the_library_ids.__dict__:
        setattr(test_batches_have_the_library_ids, style, (Encoder(public_tokenizers.path(name), style), Tokenizer.from_file(public_tokenizers.path(name))))
    enc, plain = getattr(test_batches_have_the_library_ids, style)
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.many(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name, style", STYLES)
def test_batches_are_not_cut_text_by_text(monkeypatch, name, style):
    texts = ["It'S we'LL ''s 'tis", "", "ÀÉ Þß×÷ÿµ 1²34 x'", "s a", " \t\n", "don't 're've5's!!'d", "'", "re", "a" * 100 + " \x00\x0b.\r"]
    enc, ids = Encoder(public_tokenizers.path(name), style), library(name)
    looked = []
    each = enc._each
    monkeypatch.setattr(enc, "ids", None)
    monkeypatch.setattr(enc, "_each", lambda parts, make: looked.append(parts) or each(parts, make))
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.many(texts * 3)] == [ids(t) for t in texts] * 3
    assert len(looked) == 1 and len(looked[0]) == len(set(looked[0]))


def test_pieces_met_again_are_merged_once(monkeypatch):
    monkeypatch.setattr(tokens, "SEEN_MOST", 20)
    enc, merged = Encoder(public_tokenizers.path("byte_bpe_50k.json"), "bytes"), []
    merge = enc._merge
    monkeypatch.setattr(enc, "_merge", lambda piece: merged.append(piece) or merge(piece))
    for i in range(20):
        enc.many([f" often also{' again' * i} w{'x' * i}"])
    assert merged.count(" often") == merged.count(" also") == 1
    assert len(enc.seen) + len(enc.before) <= 30


@pytest.mark.parametrize("name, style", STYLES)
def test_added_tokens_have_the_library_ids(name, style):
    plain, enc = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name), style)
    end, start = "<|endoftext|>", "<|startoftext|>"
    for text in (f"a {end} b", f"{start}A b{end}{end} c", f"été {end}\n漢字 x{start}y", f"{end} a\xa0b", end.upper(), "<|endof text|>", "<|endoftext", f" {end} "):
        assert np.frombuffer(enc.ids(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_store_round_trip(spark, tmp_path):
    ids = library("word_bpe_49k.json")
    folder = f"{tmp_path}/store"
    token_store.write_store(brute.documents(spark), folder, public_tokenizers.path("word_bpe_49k.json"), "words", segment_bytes=300)
    got = sorted(token_store.read_store(spark, folder).collect())
    start, expected = 0, []
    for d, t, *_ in sorted(DATA, key=lambda r: r[0]):
        own = [*ids(t), 1]
        expected.append((d, start, len(own), brute.crc(own)))
        start += len(own)
    assert [tuple(r)[:4] for r in got] == expected
    some = DATA[12]
    assert [r.ids for r in token_store.fetch(spark, folder, some[0]).collect()] == [[*ids(some[1]), 1]]
    index = spark.read.parquet(f"{folder}/segments")
    assert index.select("dict_hash").distinct().count() == 1 and index.count() > 3
    row = spark.read.parquet(f"{folder}/dictionary").first()
    assert token_store.dictionary_hash(bytes(row.dictionary)) == row.dict_hash


def test_store_orders_null_and_repeated_ids(spark, tmp_path):
    data = [(i, t, "", "", 0, *"abcdefg") for i, t in [(None, "z"), (4, "b"), (4, "b"), (1, None)]]
    folder = f"{tmp_path}/store"
    token_store.write_store(brute.documents(spark, data), folder, public_tokenizers.path("word_bpe_49k.json"), "words")
    got = sorted(token_store.read_store(spark, folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(1, 0, 1), (4, 1, 2), (4, 3, 2), (None, 5, 2)]


def measures(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    twice = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return (
        len(words), len(b"".join(words).decode()), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice), len(lines),
        sum("A" <= c <= "Z" for c in text or ""),
    )


def test_ledger(spark):
    book = rule_ledger.ledger(brute.documents(spark)).collect()
    expected = {r[0]: measures(r[1]) for r in DATA}
    assert {r.doc_id: tuple(r[m] for m in rule_ledger.MEASURES) for r in book} == expected
    for r in book:
        n, chars, symbols, dup, repeat, lines, upper = expected[r.doc_id]
        fails = [n < 10, 100 * repeat > 20 * n, 10 * symbols > n, chars < 2 * n or chars > 20 * n, 2 * dup > lines, 10 * upper > 4 * chars]
        assert r.failed == sum(1 << i for i, f in enumerate(fails) if f)


def test_policies_and_ablations(spark):
    docs = brute.documents(spark)
    book = rule_ledger.ledger(docs)
    for version, rules in rule_ledger.POLICIES.items():
        bits = [r.failed for r in book.collect()]
        whole = rule_ledger.mask(rules)
        got = {r.rule: (r.n_failed, r.n_alone) for r in rule_ledger.ablations(book, version).collect()}
        assert got == {r: (sum(bool(b & rule_ledger.mask([r])) for b in bits), sum(b & whole == rule_ledger.mask([r]) for b in bits)) for r in rules}
        kept = rule_ledger.apply_policy(docs, version)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in book.collect() if r.failed & whole == 0)


def test_mix(spark):
    got = curriculum.totals(brute.documents(spark), bucket_rows=3).collect()
    expected = brute.mix([(r[0], r[1], r[3]) for r in DATA])
    taken = Counter()
    for r in got:
        size, target = expected[r.source]
        assert (r.source_size, r.size) == (size, len((dict((x[0], x[1]) for x in DATA)[r.doc_id] or "").encode().split()))
        assert r.target == pytest.approx(target) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(t + 1e-9) for s, (_, t) in expected.items())


def test_mix_caps_small_sources(spark):
    data = [(i, "w " * n, "", s, 0, *"abcdefg") for i, (s, n) in enumerate([("a", 1), ("b", 2), ("c", 4), ("d", 500), ("d", 300), (None, 0)])]
    got = {r.source: r.target for r in curriculum.targets(curriculum.sized(brute.documents(spark, data))).collect()}
    assert got == pytest.approx({s: t for s, (_, t) in brute.mix([(r[0], r[1], r[3]) for r in data]).items()})


def test_schedule_follows_the_demand(spark):
    docs = brute.documents(spark)
    uses = curriculum.schedule(docs, bucket_rows=3)
    rows = uses.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and all(0 <= r.position <= 1 for r in rows)
    total = {r.doc_id: r.taken for r in curriculum.totals(docs).collect()}
    words = Counter()
    for r in rows:
        words[r.doc_id] += r.words
    assert {d: n for d, n in total.items() if n} == dict(words)
    slope = {r.source: (r.slope, r.target) for r in curriculum.targets(curriculum.sized(docs)).collect()}
    for source, (a, target) in slope.items():  # the demand at a use's position is what its source has given before
        given = 0
        for r in sorted((r for r in rows if r.source == source), key=lambda r: (r.position, r.doc_id)):
            assert target * ((1 - a) * r.position + a * r.position**2) == pytest.approx(given, abs=1e-6)
            given += r.words


def test_totals_come_from_the_written_schedule(spark, monkeypatch):
    written = {}
    keep = curriculum.stage
    monkeypatch.setattr(curriculum, "stage", lambda df, label: written.setdefault(label, keep(df, label)))
    rows = [*DATA, (DATA[0][0], *DATA[0][1:]), (None, "a b", *DATA[0][2:])]
    got = curriculum.totals(brute.documents(spark, rows), bucket_rows=3).collect()
    assert len(got) == len(rows)
    uses = written["schedule"].collect()
    assert sum(r.taken for r in got) == sum(u.words for u in uses)
    assert sorted(r.position for r in got if r.position is not None) == sorted(u.position for u in uses if u.use == 0)
    assert all(0 <= r.taken <= 3 * r.size for r in got)


def test_mixed_rows(spark):
    docs = brute.documents(spark)
    got = curriculum.mixed(docs)
    assert got.columns == docs.columns
    words = Counter()
    for r in got.collect():
        words[r.source] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert dict(words) == {s: math.floor(t + 1e-9) for s, (_, t) in brute.mix([(r[0], r[1], r[3]) for r in DATA]).items() if t >= 1}


def test_mixed_equal_rows_and_null_ids(spark):
    rows = [(1, "a b c d", "en", "s", 7, *"abcdefg")] * 2 + [(2, "e f", "en", "t", 3, *"abcdefg")] + [(None, f"w{i} x y", "en", "u", 5, *"abcdefg") for i in range(5)] + [(None, "w0 x y", "en", "u", 5, *"abcdefg")]
    want = {s: math.floor(t + 1e-9) for s, (_, t) in brute.mix([(r[0], r[1], r[3]) for r in rows]).items()}
    for slices in (1, 5):
        got = curriculum.mixed(brute.documents(spark, rows, slices=slices)).collect()
        words = Counter()
        for r in got:
            words[r.source] += len(r.text.split())
        assert dict(words) == want and want["s"] < 16


def test_routes_are_the_heaviest_terms():
    pick = np.random.default_rng(3)
    rests = [np.minimum(pick.zipf(1.3, n), 900).astype("<u2") for n in (0, 1, 5, 40, 300, 300, 0, 77)]
    df = pick.integers(0, 60, 901)
    whole = retrieval_packing.Corpus(500, 60.0, df)
    for shard_docs in (16, 100, 400):
        want = []
        for r in rests:
            weights = {}
            for t, tf in Counter(r.tolist()).items():
                if df[t] > 1:
                    weights[t] = math.log1p((500 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(r) / 60.0))
            heavy = sorted(weights, key=lambda t: (-weights[t], t))
            common = [t for t in heavy if df[t] >= shard_docs // 4][:1]
            want.append(np.array(common + heavy[:6], ">u4").tobytes())
        assert retrieval_packing.routes(rests, whole, 1.2, 0.75, shard_docs) == want


def test_packing(spark):
    ids = library("byte_bpe_50k.json")
    docs = brute.documents(spark)
    got = retrieval_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "bytes", window=256, shard_docs=20, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, t, *_ in DATA:
        own, at = [*ids(t), 1], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            part = own[at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(own), brute.crc(part))
            assert np.frombuffer(r.ids, "<u4").tolist() == part
            at += r.length
        assert at == len(own)
    short = 0
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 256
        short += at < 256
    assert short <= -(-len(DATA) // 20)  # the last sequence of each shard


def test_neighbours_share_a_window():
    """A seed gets the document that shares its rare words before others."""
    rng = np.random.default_rng(5)
    topics = [rng.integers(1000 * k, 1000 * k + 40, 60) for k in range(1, 9)]
    rests = [t.astype(np.uint16) for pair in zip(topics, topics) for t in pair]
    for made in retrieval_packing.fill(rests, 120, 1.2, 0.75, 24):
        assert len({i // 2 for i, _, _ in made}) == 1


def topics(groups, of_each):
    """Documents of a topic have its rare words in common, and every one the usual words."""
    rng = np.random.default_rng(8)
    made = []
    for g in range(groups):
        own = [f"{''.join(rng.choice(list('bcdfgklmnprstvz'), 7))}" for _ in range(12)]
        made += [(g, " ".join([*rng.choice(own, 20), *rng.choice(["the", "of", "and", "to", "in"], 20)])) for _ in range(of_each)]
    order = rng.permutation(len(made))
    return [(int(i), *made[i]) for i in order]


def test_packing_neighbours_meet_across_shards(spark):
    """A document's window holds its topic, though there are many more shards than one."""
    made = topics(60, 10)
    data = [(i, t, "", "s", 0, *"abcdefg") for i, _, t in made]
    got = retrieval_packing.pack(brute.documents(spark, data), public_tokenizers.path("byte_bpe_50k.json"), "bytes", window=512, shard_docs=40).collect()
    topic, of_window = {i: g for i, g, _ in made}, defaultdict(list)
    for r in got:
        of_window[r.sequence_id].append(topic[r.doc_id])
    same = sum(max(Counter(m).values()) for m in of_window.values())
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())
    assert same > 0.5 * len(got), (same, len(got))


def test_figures_are_of_the_whole_corpus(spark):
    ids = library("byte_bpe_50k.json")
    rests = [np.array([*ids(t), 1]) for _, t, *_ in DATA]
    encoded = spark.createDataFrame([(r.astype("<u2").tobytes(),) for r in rests], "rest binary").repartition(5)
    found = retrieval_packing.corpus(encoded, "<u2")
    df = Counter(t for r in rests for t in set(r.tolist()))
    assert found.n == len(rests) and found.mean == pytest.approx(sum(map(len, rests)) / len(rests))
    assert {t: int(found.df[t]) for t in np.flatnonzero(found.df)} == dict(df)


def plain_ppm(data, order):
    held = lambda d: brute.zlib.crc32(str(d).encode()) % 5 == 1 if d is not None else False
    normal = {d: b" ".join((t or "").encode().lower().split()) + b"\n" for d, t in data}
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    tokens = Counter()
    for d, t in normal.items():
        if not held(d):
            tokens.update([*t.split(), b"\n"])
            b = bytes(order) + t
            for i in range(order, len(b)):
                for k in range(order + 1):
                    seen[k][b[i - k : i]][b[i]] += 1

    def log(context, symbol):
        gone, out = set(), 0.0
        for k in range(order, -1, -1):
            counts = seen[k].get(context[order - k :])
            if counts:
                free = {s: n for s, n in counts.items() if s not in gone}
                if symbol in free:
                    return out + math.log10((free[symbol] - 0.5) / sum(free.values()))
                if free:
                    out += math.log10(len(free) / 2 / sum(free.values()))
                gone |= set(counts)
        return out - math.log10(256 - len(gone))

    total, kinds = sum(tokens.values()), len(tokens)
    out = {}
    for d, t in normal.items():
        b, words = bytes(order) + t, [*t.split(), b"\n"]
        base = sum(math.log10((tokens[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        score = sum(log(b[i - order : i], b[i]) for i in range(order, len(b)))
        out[d] = (held(d), len(words), sum(tokens[w] > 0 for w in words), total, base, score)
    return out, log


@pytest.mark.parametrize("block", [6 << 20, 500])
def test_ppm(spark, block):
    got = ppm.scores(brute.documents(spark), block_bytes=block).collect()
    expected, _ = plain_ppm([(r[0], r[1]) for r in DATA], 5)
    assert len(got) == len(expected)
    for r in got:
        held, n, known, total, base, score = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-5, abs=1e-4)


def test_ppm_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.zeros(3, np.int64), rng.integers(97, 103, 400)])
    grams = sum(text[3 - j : len(text) - j] << (8 * j) for j in range(4))
    kinds, n = np.unique(grams, return_counts=True)
    trie = ppm.Trie(kinds, n, np.bincount(grams & 0xFFFF, minlength=1 << 16).reshape(256, 256), 3)
    for context in (0, 0x616263, 0x7A7A61, 0x616200, 0x7A7A7A):
        assert (10 ** trie.logs((context << 8) + np.arange(256))).sum() == pytest.approx(1)


def test_repeated_rows_and_null_ids(spark):
    data = [(i, "the same words here", "", None, 0, *"abcdefg") for i in (4, 4, None)]
    docs = brute.documents(spark, data)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in ppm.scores(docs).collect()) == [(-1, 5), (4, 5), (4, 5)]
    assert rule_ledger.ledger(docs).count() == 3
    assert curriculum.totals(docs).agg(F.sum("taken")).first()[0] == 12
    packed = retrieval_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "bytes").collect()
    assert sum(r.length for r in packed) == 3 * packed[0].doc_tokens


def test_empty_tables(spark, tmp_path):
    none = brute.documents(spark).where(F.lit(False))
    file = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_store(none, f"{tmp_path}/none", file, "bytes")
    assert token_store.read_store(spark, f"{tmp_path}/none").count() == 0
    assert retrieval_packing.pack(none, file, "bytes").count() == 0
    assert rule_ledger.ledger(none).count() == 0 and rule_ledger.apply_policy(none).count() == 0
    assert curriculum.totals(none).count() == 0 and curriculum.mixed(none).count() == 0
    assert ppm.scores(none).count() == 0
