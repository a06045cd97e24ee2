"""Each stage of the pipeline against a plain version, and the entry points."""

import math
from collections import Counter, defaultdict

import brute
import corpus_pipeline
from test_shaping import measures

import __spark_entry__ as entry
from riskloom.llm import oracles, queries, retrieval_packing
from riskloom.plans.staging import stage

NAMES = ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "packing"]


def test_stages(spark):
    docs = brute.documents(spark)
    columns = docs.columns
    kept = [(r[0], r[1], r[3]) for r in brute.rows()]
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    got = {}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, "unused"), name)
        got[name] = docs
        if name != "packing":
            assert docs.columns == columns

    def passes(t):
        n, chars, symbols, dup, repeat, lines, upper = measures(t)
        return not (n < 10 or 100 * repeat > 20 * n or 10 * symbols > n or chars < 2 * n or chars > 20 * n or 2 * dup > lines or 10 * upper > 4 * chars)

    ids = lambda name: sorted(r.doc_id for r in got[name].collect())
    kept = [r for r in kept if passes(r[1])]
    assert ids("quality_rules") == sorted(r[0] for r in kept)
    groups = brute.exact_groups([r[:2] for r in kept])
    kept = [r for r in kept if groups[r[0]][2]]
    assert ids("exact_dedup") == sorted(r[0] for r in kept)
    near = brute.near_groups([r[:2] for r in kept], 5, 80)
    kept = [r for r in kept if near[r[0]][1] == r[0]]
    assert ids("near_dedup") == sorted(r[0] for r in kept)
    words = Counter()
    for r in got["source_mix"].collect():
        words[r.source] += len(r.text.encode().split())
    targets = {s: math.floor(t + 1e-9) for s, (_, t) in brute.mix(kept).items()}
    assert dict(words) == {s: t for s, t in targets.items() if t}
    texts = Counter((r.doc_id, r.text) for r in got["source_mix"].collect())
    rows = got["packing"].collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    from test_shaping import library

    ids_of = library("byte_bpe_50k.json")
    expected = Counter()
    for (d, t), n in texts.items():
        expected[d] += n * (len(ids_of(t)) + 1)
    assert total == expected


def test_packing_keeps_the_training_order(spark):
    """Sequences follow the stored order, and the uses of a document are apart."""
    say = lambda i: " ".join(f"{w}{i}" for w in ("alpha", "beta", "gamma", "delta") * 100)
    data = [(i % 30, say(i % 30), "", "s", 0, *"abcdefg") for i in range(90)]
    mixed = stage(spark.createDataFrame(data[:45], brute.SCHEMA).coalesce(1).union(spark.createDataFrame(data[45:], brute.SCHEMA).coalesce(1)), "mixed")
    rows = corpus_pipeline.packing(spark, mixed, "unused").collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    heads = [min(sequences[s], key=lambda r: r.offset).doc_id for s in sorted(sequences)]
    assert all(len({r.doc_id for r in m}) == len(m) for m in sequences.values())
    assert heads[0] == 0 and sum(r.length for r in rows) == 3 * sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_shards_are_slices_of_the_order(spark):
    data = [(i * 7 % 200, f"word {i * 7 % 200} said", "", "s", 0, *"abcdefg") for i in range(200)]
    docs = stage(spark.createDataFrame(data, brute.SCHEMA).coalesce(1), "ordered")
    order, file = corpus_pipeline.stored_order(docs), queries.tokenizer_file("byte_bpe_50k.json")
    rows = retrieval_packing.pack(docs, file, "bytes", window=32, shard_docs=20, order=order).collect()
    at = {r[0]: i for i, r in enumerate(data)}
    ranked = [at[r.doc_id] for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert all(abs(place - i * 200 / len(ranked)) < 60 for i, place in enumerate(ranked))


def test_entry_points():
    every = entry.queries()
    numbers = [int(k[2:].split("_")[0]) for k in queries.QUERIES]
    assert numbers == list(range(1, 14)) and "pipeline" in every and set(queries.QUERIES) <= set(every)
    assert set(oracles.ORACLES) <= set(every)
