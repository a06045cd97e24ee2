"""Operators on hand-made rows: merging, scores, quota, patches, store, sources, streams."""

import io
import random
import zipfile
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from riskloom.functions import fixed as K
from riskloom.operators import detect as D
from riskloom.operators import findings as R
from riskloom.operators import patches as PT
from riskloom.operators import quota as QU
from riskloom.operators import review as V
from riskloom.plans import corpus, queries
from riskloom.plans import scan as S
from riskloom.plans.ranking import numbered
from riskloom.sources import archives as A
from riskloom.sources import files as SF
from riskloom.sources import scanlog as SL
from riskloom.sources import store as ST
from riskloom.streaming import jobs as J
from riskloom.streaming import quota as SQ
from riskloom.streaming import runs as RN
from riskloom.streaming import scans as SS


def finding(spark, rows):
    """Findings from dicts; the rest is filled with blanks."""
    base = queries.stand_in(spark, SMALL).limit(0)
    blank = {
        "repo_id": "r", "rule_id": "x", "category": "missing_auth", "status": "candidate", "severity": "medium", "confidence": 0.5, "path": "a.py",
        "line_number": 1, "evidence": "E", "evidence_refs": [], "description": "", "attack_chain": "", "fix_code": None, "recommendation": "", "fix": "",
        "fix_source": "", "cvss_score": None, "cvss_vector": None, "confirmed_by": [], "validator": None, "owasp_cat": None, "false_positive_risk": "low",
        "proof": (False, False, False, False, False, False, []),
    }
    data = []
    for i, row in enumerate(rows):
        full = {**blank, "ord": i, "id": f"f{i}", **row}
        data.append(tuple(full[c] for c in base.columns))
    return spark.createDataFrame(data, base.schema)


def test_three_copies_merge(spark):
    rows = finding(
        spark,
        [
            {"severity": "medium", "status": "candidate", "confidence": 0.41, "confirmed_by": ["rule-a"], "evidence": "Call( x )"},
            {"severity": "critical", "status": "needs_review", "confidence": 0.73, "confirmed_by": ["rule-b"], "evidence": "call(  x )", "fix": "Protect"},
            {"severity": "high", "status": "confirmed", "confidence": 0.62, "confirmed_by": ["rule-a"], "evidence": "CALL( X ) ", "fix": "Other", "fix_code": "patch"},
        ],
    )
    got = R.dedupe(rows).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.id, r.severity, r.status, r.confidence, r.confirmed_by, r.fix, r.fix_code) == ("f0", "critical", "confirmed", 0.73, ["rule-a", "rule-b"], "Protect", "patch")


def test_merging_twice_changes_nothing(spark):
    once = R.dedupe(queries.stand_in(spark, SMALL))
    cols = [c for c in once.columns]
    assert sorted(map(str, R.dedupe(once).select(*cols).collect())) == sorted(map(str, once.collect()))


def test_a_crowd_of_copies_folds(spark):
    one = finding(spark, [{"proof": (True, False, False, False, False, False, ["n"])}])
    crowd = one.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(19999)).cast("array<bigint>")))
    rows = R.dedupe(crowd).collect()
    assert len(rows) == 1 and rows[0].proof.notes == ["n"] and rows[0].ord == 0


def test_scores_match_the_plain_definition(spark):
    random.seed(3)
    rows = [
        {
            "category": random.choice(["sql_injection", "prompt_injection", "weak_jwt"]), "severity": random.choice(K.SEVERITIES),
            "status": random.choice(K.STATUSES), "confidence": random.choice([0.2, 0.5, 0.9]), "repo_id": f"r{random.randrange(25)}", "line_number": i,
            "proof": (True, True, True, False, True, random.random() < 0.5, []),
        }
        for i in range(300)
    ]
    got = {r.repo_id: r.risk_score for r in R.risk_scores(finding(spark, rows)).collect()}
    want = defaultdict(float)
    seen = defaultdict(int)
    order = sorted(
        range(len(rows)),
        key=lambda i: (-K.SEVERITIES.index(rows[i]["severity"]), -K.STATUSES.index(rows[i]["status"]), -rows[i]["confidence"], rows[i]["line_number"]),
    )
    for i in order:
        r = rows[i]
        if r["status"] == "rejected":
            continue
        k = seen[r["repo_id"], r["category"]]
        seen[r["repo_id"], r["category"]] += 1
        m = K.STATUS_MULTIPLIER[r["status"]]
        if r["category"] in K.AI and not r["proof"][5]:
            m *= 0.35
        want[r["repo_id"]] += K.SEVERITY_WEIGHT[r["severity"]] * m * max(0.2, 1 / (1 + 0.55 * k))
    assert got == {repo: min(100, int(round(v, 6))) for repo, v in want.items()}


def test_repeats_saturate(spark):
    rows = [{"category": "missing_rate_limit", "status": "needs_review", "line_number": i} for i in range(8)]
    assert 0 < R.risk_scores(finding(spark, rows)).collect()[0].risk_score < 32


@pytest.mark.parametrize("seed", [1, 2])
def test_admissions_match_a_walk_through_the_log(spark, seed):
    random.seed(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        # one busy caller, quiet spells, and repeated instants
        key = "busy" if random.random() < 0.4 else f"k{random.randrange(6)}"
        at = start + timedelta(minutes=random.choice([random.randrange(0, 3000), random.randrange(9000, 9600)]), milliseconds=random.choice([0, 0, 500]))
        rows.append((i, key, random.choice(["scan/github", "waitlist", "other"]), at))
    events = spark.createDataFrame(rows, "event_id long, key string, endpoint string, ts timestamp")
    got = {(r.event_id): r.allowed for r in QU.decisions(events, QU.admissions(events)).collect()}
    log, want = defaultdict(list), {}
    for i, key, endpoint, at in sorted(rows, key=lambda r: (r[3], r[0])):
        recent = [t for t in log[key, endpoint] if t >= at - timedelta(hours=1)]
        want[i] = endpoint not in K.QUOTA or len(recent) < K.QUOTA[endpoint]
        if want[i]:
            log[key, endpoint].append(at)
    assert got == want


TEXT = "a\nb\nc\nd\n"


@pytest.mark.parametrize(
    ("patch", "ok", "text"),
    [
        ("--- a/f.py\n+++ b/f.py\n@@ -2,2 +2,2 @@\n-b\n+B\n c\n", True, "a\nB\nc\nd\n"),
        ("--- a/f.py\n+++ b/f.py\n@@ -1 +1 @@\n-c\n+C\n", True, "a\nb\nC\nd\n"),
        ("--- a/f.py\n+++ b/f.py\n@@ -1 +1,2 @@\n+z\n a\n@@ -4 +5 @@\n-d\n\\ No newline at end of file\n", True, "z\na\nb\nc\n"),
        ("--- a/f.py\n+++ b/f.py\n@@ -1 +1 @@\n-q\n+r\n", False, None),
        ("--- a/f.py\n+++ b/f.py\n@@ one @@\n-a\n", False, None),
        ("--- a/g.py\n+++ b/g.py\n@@ -1 +1 @@\n-a\n+b\n", False, None),
        ("--- a/f.py\n+++ b/../x.py\n@@ -1 +1 @@\n-a\n+b\n", False, None),
        ("--- a/f.py\n+++ /dev/null\n@@ -1 +0 @@\n-a\n", False, None),
        ("just words", False, None),
    ],
)
def test_patches(spark, files, patch, ok, text):
    fixes = spark.createDataFrame([("x", "repo", patch)], "id string, repo_id string, patch string")
    rows = PT.apply_patches(fixes, files({"f.py": TEXT})).collect()
    assert [(r.ok, r.text) for r in rows] == [(ok, text)]
    assert ok or rows[0].error


def test_fixes_are_judged(spark, files):
    tree = files({"f.py": 'def f(uid):\n    db.execute(f"SELECT {uid}")\n', "g.py": "x = 1\n"})
    head = "--- a/f.py\n+++ b/f.py\n@@ -2 +2 @@\n-    db.execute(f\"SELECT {uid}\")\n"
    fixes = spark.createDataFrame(
        [
            ("good", "repo", "sql_injection", "f.py", head + "+    db.find(uid)\n"),
            ("same", "repo", "sql_injection", "f.py", head + '+    db.execute(f"SELECT {uid}")  # ok\n'),
            ("broken", "repo", "sql_injection", "f.py", head + "+    db.find(\n"),
            ("aside", "repo", "sql_injection", "f.py", "--- a/g.py\n+++ b/g.py\n@@ -1 +1 @@\n-x = 1\n+x = 2\n"),
            ("empty", "repo", "sql_injection", "f.py", " "),
            ("other", "repo", "missing_auth", "f.py", head + '+    db.execute(f"SELECT {uid}")  # ok\n'),
        ],
        "id string, repo_id string, category string, path string, patch string",
    )
    got = {r.id: r.accepted for r in PT.verify_fixes(fixes, tree).collect()}
    assert got == {"good": True, "same": False, "broken": False, "aside": False, "empty": False, "other": True}


def test_verdicts_from_json(spark):
    answers = spark.createDataFrame(
        [('{"f1": {"verdict": "confirmed", "confidence": 0.9, "proof": {"source_present": true}, "attack_scenario": "s"}, "f2": {"verdict": "rejected"}}',)], "answer string"
    )
    got = {r.id: (r.verdict, r.confidence) for r in V.parse_verdicts(answers).collect()}
    assert got == {"f1": ("confirmed", 0.9), "f2": ("rejected", None)}


def test_batches(spark):
    rows = finding(spark, [{"path": f"p{i}", "line_number": i} for i in range(40)])
    assert sorted(r.n for r in V.verify_batches(rows).collect()) == [4, 6, 6, 6, 6, 6, 6]


@pytest.mark.parametrize("slices", [1, 7])
def test_numbers_of_a_large_group(spark, slices):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "big").otherwise((F.col("id") % 40).cast("string")).alias("g"), (F.col("id") * 7919 % 5003).alias("v"))
    got = numbered(rows, ["g"], [F.col("v").desc()], "place", slices).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.g].append((r.place, r.v))
    for pairs in groups.values():
        assert [p for p, _ in sorted(pairs)] == list(range(len(pairs)))
        assert [v for _, v in sorted(pairs)] == sorted((v for _, v in pairs), reverse=True)
    assert len(got) == 5000


# ------------------------------------------------------------------ sources and store
def test_folders_are_read(spark, tmp_path):
    for repo, path, body in [("one", "src/a.py", b"x = 1\n"), ("one", "b.js", b"\xff ok"), ("two", "c/d.sql", b"SELECT 1;")]:
        target = tmp_path / repo / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    for root in (f"file:{tmp_path}", f"file://{tmp_path}/", f"{tmp_path}/"):  # however the root is spelled
        assert sorted((r.repo_id, r.path) for r in SF.read_tree(spark, root, depth=1).select("repo_id", "path").collect()) == [
            ("one", "b.js"), ("one", "src/a.py"), ("two", "c/d.sql")
        ]
    raw = SF.read_tree(spark, str(tmp_path), depth=1)
    listed = raw.select("repo_id", "path", "size")
    assert sorted(map(tuple, listed.collect())) == [("one", "b.js", 4), ("one", "src/a.py", 6), ("two", "c/d.sql", 9)]
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    texts = {r.path: r.text for r in SF.with_text(raw).collect()}
    assert texts["b.js"] == "\ufffd ok"


def test_budget_of_a_repository(spark):
    rows = [("r", f"p{i}.py", 400) for i in range(5)] + [("s", "a.py", 10), ("s", "big.py", 2 << 20)]
    listed = spark.createDataFrame(rows, "repo_id string, path string, size long")
    got = SF.manifest(listed, max_files=3, max_bytes=1000, max_file_bytes=1 << 20).collect()
    assert {(r.repo_id, r.over_budget) for r in got} == {("r", True), ("s", False)}
    assert sorted(r.path for r in got) == ["a.py", "p0.py", "p1.py", "p2.py"]
    assert SF.manifest(listed).count() == 7  # without limits nothing is dropped


def _zip(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return bytearray(buffer.getvalue())


def test_archives_are_expanded(spark):
    rows = [
        ("one", _zip({"top/a.py": "x", "top/s/b.py": "y"})),
        ("two", _zip({"a.py": "x", "s/b.py": "y", "t/c.py": "z"})),
        ("evil", _zip({"../up.py": "x"})),
        ("root", _zip({"/abs.py": "x"})),
        ("text", bytearray(b"hello")),
        ("cut", bytearray(b"PK\x03\x04nothing")),
    ]
    files, rejected = A.expand_archives(spark.createDataFrame(rows, "repo_id string, content binary"))
    assert sorted((r.repo_id, r.path) for r in files.collect()) == [("one", "a.py"), ("one", "s/b.py"), ("two", "a.py"), ("two", "s/b.py"), ("two", "t/c.py")]
    assert sorted(r.repo_id for r in rejected.collect()) == ["cut", "evil", "root", "text"]


def test_a_broken_archive_gives_no_files(spark):
    good = _zip({"a.py": "x" * 500, "b.py": "y" * 500})
    broken = bytearray(good)
    at = bytes(good).index(b"b.py") + 4
    broken[at : at + 3] = b"\xff\xff\xff"  # the second member can't be read
    none = spark.createDataFrame([("one", good), ("two", broken), ("three", None)], "repo_id string, content binary")
    files, rejected = A.expand_archives(none)
    assert sorted((r.repo_id, r.path) for r in files.collect()) == [("one", "a.py"), ("one", "b.py")]
    assert {r.repo_id: r.error.partition(":")[0] for r in rejected.collect()} == {"two": "unreadable archive", "three": "not a zip archive"}


def test_line_breaks(spark, files):
    text = "a\r\nb\rc\nd\x0be\x0cf\x1cg\x1dh\x1ei\x85j\u2028k\u2029l\n\n"
    rows = SF.line_table(files({"x": text})).orderBy("line_no").collect()
    assert [r.line for r in rows] == text.splitlines()
    assert SF.line_table(files({"x": ""})).count() == 0
    assert [r.line for r in SF.line_table(files({"x": "\n"})).collect()] == [""]


def test_store_replaces_whole_scans(spark, tmp_path):
    folder = str(tmp_path / "findings")
    one = finding(spark, [{"id": "a"}, {"id": "b"}]).withColumn("scan_id", F.lit("s1"))
    two = finding(spark, [{"id": "c"}]).withColumn("scan_id", F.lit("s2"))
    ST.write_findings(one, folder)
    ST.write_findings(two, folder)
    ST.write_findings(finding(spark, [{"id": "d"}]).withColumn("scan_id", F.lit("s1")), folder)
    got = ST.read_findings(spark, folder)
    assert sorted((r.scan_id, r.id) for r in got.collect()) == [("s1", "d"), ("s2", "c")]
    kept = ST.cascade_delete(got, spark.createDataFrame([("s1",)], "scan_id string"))
    assert [r.id for r in kept.collect()] == ["c"]


def test_upsert_keeps_the_first_and_the_last(spark):
    def rows(*data):
        return spark.createDataFrame(data, "email string, ts long, source string, ip string")

    first = ST.keyed_upsert(rows(("a", 2, "x", "i"), ("a", 1, "y", "j"), ("b", 5, "z", "k")), "email", "ts", ["source", "ip"], {"last_source": "source"})
    both = ST.keyed_upsert(rows(("a", 9, "w", "l")), "email", "ts", ["source", "ip"], {"last_source": "source"}, first)
    got = {r.email: tuple(r)[1:] for r in both.collect()}
    assert got == {"a": (1, "y", "j", 9, "w"), "b": (5, "z", "k", 5, "z")}


# ------------------------------------------------------------------ streams
def test_files_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "files")
    corpus.code_files(spark, SMALL).repartition(3).write.parquet(source)
    batch = spark.read.parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = J.scan_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    keys = [k for k in D.DETECTOR_KEYS if k != "DET-19"]
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, D.candidates(batch, keys).collect()))


def test_quota_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "events")
    events = queries._quota_events(spark, SMALL)
    for low, high in [(1, 8), (8, 15), (15, 22), (22, 32)]:  # files arrive in time order
        part = events.filter((F.dayofmonth("ts") >= low) & (F.dayofmonth("ts") < high))
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    admitted, late = SQ.run(stream, str(tmp_path / "out"))
    key = ["key", "endpoint", "tick", "attempts", "admitted"]
    got = {tuple(r) for r in admitted.filter("remaining IS NOT NULL").select(*key).collect()}
    assert late.count() == 0
    want = {tuple(r) for r in QU.admissions(events).filter("remaining IS NOT NULL").select(*key).collect()}
    end = max(t[2] for t in want)
    settled = {t for t in want if t[2] < end - 10 * 60 * 1000}
    assert settled <= got <= want and len(settled) > 100


def test_status_stream_and_upsert_stream(spark, tmp_path):
    source = str(tmp_path / "events")
    events = queries._sign_ups(spark, SMALL)
    events.repartition(3).write.parquet(source)
    folder = str(tmp_path / "table")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    handle = J.upsert_batch(folder, "email", "ts", ["source", "ip"], {"last_source": "source"})
    J.each_batch(stream, handle, str(tmp_path / "state")).start().awaitTermination()
    want = ST.keyed_upsert(events, "email", "ts", ["source", "ip"], {"last_source": "source"})
    now = lambda **options: J.upserted(spark, folder, want.schema, "email", ["source", "ip"], {"last_source": "source"}, **options)
    assert sorted(map(str, now().collect())) == sorted(map(str, want.collect()))
    some = sorted(r.email for r in want.limit(2).collect())
    assert sorted(map(str, now(keys=some).collect())) == sorted(map(str, want.where(F.col("email").isin(some)).collect()))


def test_runs_are_merged_like_digits(spark, tmp_path):
    folder, merge = str(tmp_path / "runs"), lambda rows: rows.groupBy("k").agg(F.max("n").alias("n"))
    handle = RN.into_runs(folder, "k", merge, merge, every=2, buckets=2)
    rows = lambda *data: spark.createDataFrame(list(data), "k string, n long")
    written = []
    for i in range(7):
        handle(rows(("a", i), (f"k{i}", i), ("a", -i)), i)
        written.append(RN.cover(RN.runs(spark, folder)))
    assert written == [[(0, 1)], [(0, 2)], [(0, 2), (2, 3)], [(0, 4)], [(0, 4), (4, 5)], [(0, 4), (4, 6)], [(0, 4), (4, 6), (6, 7)]]
    assert len(RN.runs(spark, folder)) == 3  # what longer runs covered is gone
    handle(rows(("a", 9), ("k6", 8)), 6)  # a repeated batch replaces its run
    want = [("a", 9), ("k0", 0), ("k1", 1), ("k2", 2), ("k3", 3), ("k4", 4), ("k5", 5), ("k6", 8)]
    assert sorted(map(tuple, RN.current(spark, folder, "k string, n long", merge).collect())) == want
    own = spark.read.parquet(f"{folder}/{6:09d}-{7:09d}")  # a batch writes its own keys only
    assert sorted(r.k for r in own.collect()) == ["a", "k6"]
    some = RN.current(spark, folder, "k string, n long", merge, "k", ["k3", "k9"], buckets=2)
    assert [tuple(r) for r in some.collect()] == [("k3", 3)]
    assert RN.current(spark, f"{folder}-none", "k string, n long", merge).count() == 0


def test_status_stream_keeps_the_latest(spark, tmp_path):
    rows = [("s", "queued", None, 1), ("s", "running", None, 2), ("t", "queued", None, 1), ("s", "failed", "boom", 3)]
    source = str(tmp_path / "status")
    base = spark.createDataFrame(rows, "scan_id string, status string, error_message string, n long")
    base.select("scan_id", "status", "error_message", F.timestamp_seconds("n").alias("ts"), F.col("n").alias("seq")).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    query = J.latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.scan_id, r.status, r.error_message) for r in spark.table("latest").collect()} == {("s", "failed", "boom"), ("t", "queued", None)}


def test_paths_outside_a_scan_are_read_nowhere(spark, files):
    leak = 'api_key = "sk-proj-abcdefghijklmnopqrstuvwxyz0123456789ABCD"\n'
    tree = files({"src/a.py": leak, "node_modules/x/a.py": leak, "dist/a.js": leak, "src/a.min.js": leak})
    assert {r.path for r in D.candidates(tree).collect()} == {r.path for r in S.scan(tree).collect()} == {"src/a.py"}


def test_a_busy_key_is_spread_over_tasks(spark):
    from pyspark.sql.types import LongType

    events = spark.range(60_000, numPartitions=4).select(
        F.col("id").cast(LongType()).alias("event_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.lit("scan/github").alias("endpoint"), F.timestamp_millis(F.col("id") * 3_000).alias("ts"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        decided = QU.admissions(events)
        tasks = sorted(r["count"] for r in decided.groupBy(F.spark_partition_id().alias("task")).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and tasks[-1] <= 2 * tasks[1]
    admitted = [r.tick for r in decided.filter("key = 'hot' AND admitted > 0").orderBy("tick").collect()]
    log, want = [], []
    for tick in range(0, 60_000 * 3_000, 6_000):
        if len(log) < 5 or log[-5] < tick - 3_600_000:
            log.append(tick)
            want.append(tick)
    assert admitted == want and len(want) > 200


@pytest.mark.parametrize("seed", range(4))
def test_jumps_equal_a_walk(seed):
    pick = random.Random(seed)
    for _ in range(60):
        ticks = sorted(pick.sample(range(400), pick.randint(1, 120)))
        attempts, limit, span = [pick.randint(1, 4) for _ in ticks], pick.randint(0, 6), pick.choice([3, 40, 200])
        before = sorted(pick.choices(range(-span, 0), k=pick.randint(0, limit)))
        log, want = list(before), []
        for t, n in zip(ticks, attempts):
            held = sum(s >= t - span for s in log)
            took = min(n, max(0, limit - held))
            log += [t] * took
            recent = [s for s in log if s >= t - span]
            want.append((took, max(0, limit - held), max(1, -((t - (recent[0] if recent else t) - span) // 1000)) if n > took else 0))
        got = QU.verdicts(np.array(ticks), np.array(attempts), limit, span, before)
        assert list(zip(*(x.tolist() for x in got))) == want


def test_quota_stream_keeps_state_and_late_attempts(spark, tmp_path):
    start = datetime(2024, 1, 1)
    say = lambda *rows: spark.createDataFrame(
        [(k, e, start + timedelta(minutes=m)) for k, e, m in rows], "key string, endpoint string, ts timestamp"
    ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    say(*[("a", "waitlist", m) for m in (0, 9, 3, 6)], ("b", "free", 9))
    stream = spark.readStream.schema("key string, endpoint string, ts timestamp").parquet(f"{tmp_path}/in")
    SQ.run(stream, f"{tmp_path}/out")
    say(("a", "waitlist", 61), ("a", "waitlist", 61), (None, None, 130))  # another run goes on from the state of the first
    SQ.run(stream, f"{tmp_path}/out")
    say(("a", "waitlist", 4), ("a", "waitlist", 4), ("b", "free", 1), ("c", "contact", 125), (None, None, 400))
    admitted, late = SQ.run(stream, f"{tmp_path}/out")
    minute = lambda r: (r.tick - int(start.replace(tzinfo=timezone.utc).timestamp() * 1000)) // 60_000
    assert sorted((r.key, minute(r), r.attempts, r.admitted, r.remaining) for r in admitted.collect()) == [
        ("a", 0, 1, 1, 3), ("a", 3, 1, 1, 2), ("a", 6, 1, 1, 1), ("a", 9, 1, 0, 0), ("a", 61, 2, 1, 1), ("b", 9, 1, 1, None), ("c", 125, 1, 1, 3)
    ]
    assert sorted((r.key, minute(r), r.attempts) for r in late.collect()) == [("a", 4, 2), ("b", 1, 1)]


def _in_store(spark, folder, **options):
    return sorted((r.scan_id, r.id) for r in SL.findings(spark, folder, **options).collect())


def _of(spark, scan, *ids):
    return finding(spark, [{"id": i} for i in ids]).withColumn("scan_id", F.lit(scan))


def test_store_versions_deletions_and_compaction(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    head = lambda *rows: spark.createDataFrame(list(rows), "scan_id string, status string, risk_score int")
    SL.commit(spark, folder, _of(spark, "s1", "a", "b").unionByName(_of(spark, "s2", "c")), head(("s1", "running", None), ("s2", "complete", 7), ("s3", "queued", None)))
    SL.commit(spark, folder, scans=head(("s3", "running", None)))  # a head alone leaves findings as they are
    SL.commit(spark, folder, _of(spark, "s1", "d"), head(("s1", "complete", 9)))
    assert _in_store(spark, folder) == [("s1", "d"), ("s2", "c")]
    assert sorted((r.scan_id, r.status, r.risk_score) for r in SL.scans(spark, folder).collect()) == [("s1", "complete", 9), ("s2", "complete", 7), ("s3", "running", None)]
    number = SL.commit(spark, folder, deleted=head(("s1", "", 0), ("s3", "", 0)).select("scan_id"))
    assert _in_store(spark, folder) == [("s2", "c")] and [r.scan_id for r in SL.scans(spark, folder).collect()] == ["s2"]
    assert _in_store(spark, folder, at=number - 1) == [("s1", "d"), ("s2", "c")]
    SL.commit(spark, folder, _of(spark, "s1", "e"))  # it comes back without its old findings
    before = _in_store(spark, folder)
    assert before == [("s1", "e"), ("s2", "c")]
    SL.commit(spark, folder, scans=head(("s2", "complete", 1)), findings=_of(spark, "s9"))  # a whole scan without findings
    assert _in_store(spark, folder) == [("s1", "e")]
    base = SL.compact(spark, folder)
    assert _in_store(spark, folder) == [("s1", "e")] and SL.findings(spark, folder)._jdf.queryExecution().toString().count("LeftSemi") == 0
    assert _in_store(spark, folder, at=base - 2) == before
    assert SL.vacuum(spark, folder) == base and _in_store(spark, folder) == [("s1", "e")]
    assert {r.scan_id for r in SL.heads(spark, folder).collect()} == {"s1", "s2"}
    SL.commit(spark, folder, _of(spark, "s4", "f"))
    assert _in_store(spark, folder) == [("s1", "e"), ("s4", "f")]


def test_a_failed_write_leaves_the_old_state(spark, tmp_path):
    folder = str(tmp_path / "store")
    SL.commit(spark, folder, _of(spark, "s1", "a"))
    broken = _of(spark, "s2", "b").withColumn("evidence", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        SL.commit(spark, folder, broken)
    assert _in_store(spark, folder) == [("s1", "a")] and len(SL._commits(spark, folder)) == 1
    late = SL._commits(spark, folder)[-1]["number"]
    SL.commit(spark, folder, _of(spark, "s3", "c"))
    with pytest.raises(SL.Conflict):  # made from a state that is no longer the last one
        SL.commit(spark, folder, _of(spark, "s1", "a"), base=True, after=late)
    assert _in_store(spark, folder) == [("s1", "a"), ("s3", "c")]


def test_some_scans_are_read_from_their_buckets(spark, tmp_path):
    folder = str(tmp_path / "store")
    SL.commit(spark, folder, finding(spark, [{"id": f"f{i}"} for i in range(40)]).withColumn("scan_id", F.concat(F.lit("s"), F.col("id"))))
    some = SL.findings(spark, folder, scan_ids=["sf3", "sf4"])
    assert sorted(r.id for r in some.collect()) == ["f3", "f4"]
    assert some.select(F.input_file_name().alias("f")).distinct().count() <= 2 < SL.findings(spark, folder).select(F.input_file_name().alias("f")).distinct().count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_arriving_files_change_what_was_decided(spark, files, tmp_path):
    sql = "CREATE TABLE public.accounts (id int);\nCREATE TABLE public.notes (id int);\n"
    route = "from fastapi import FastAPI\napp = FastAPI()\n\n@app.get('/api/admin/users')\ndef users(q):\n    return q\n"
    leak = 'api_key = "sk-proj-abcdefghijklmnopqrstuvwxyz0123456789ABCD"\n'
    steps = [
        {"one": {"db/schema.sql": sql, "a.py": route}, "two": {"k.py": leak}, "three": {"x.sql": sql}},
        {"one": {"src/supabase/client.ts": "import { createClient } from '@supabase/supabase-js'\n", "b.py": leak}, "two": {"notes.py": "x = 1\n"}},
        {"two": {"m.py": leak}, "four": {"n.py": leak}},
        {"one": {"app/auth/middleware.py": "from fastapi import Depends\n\ndef get_current_user():\n    return Depends(login_required)\n"}},
    ]
    columns = "repo_id string, path string, text string"
    seen, counts = {}, []
    for number, tree in enumerate(steps):
        files(tree).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for repo, paths in tree.items():
            seen.setdefault(repo, {}).update(paths)
        got = SS.run(spark.readStream.schema(columns).parquet(f"{tmp_path}/in"), str(tmp_path / "out"))
        want = S.scan(files(seen))
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        counts.append(want.where("category = 'rls_disabled'").count())
        decided = {(r.repo_id, r.path): r.batch for r in SS._last(RN.before(spark, f"{tmp_path}/out/decided", 99)).collect()}
        assert all(decided["two", p] == next(i for i, t in enumerate(steps) if p in t.get("two", {})) for r, p in decided if r == "two")
    assert counts[0] == 0 < counts[1]  # the tables count once the project is known
    assert decided["one", "db/schema.sql"] >= 1 and decided["three", "x.sql"] == 0
    SS.scan_batch(str(tmp_path / "out"))(files(steps[3]), 3)  # a repeated batch changes nothing
    again = SS.findings(spark, str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, want.collect()))


def test_scores_of_many_batches(spark):
    """Batches and partitions change nothing: the score is the sum over positions."""
    pick = random.Random(3)
    rows = [
        {"id": f"i{i}", "repo_id": f"r{pick.randrange(20)}", "category": pick.choice(["sql_injection", "prompt_injection"]), "severity": pick.choice(K.SEVERITIES[:2]),
         "status": pick.choice(K.STATUSES), "confidence": pick.choice([0.5, 0.50001, 0.7]), "path": pick.choice(["a", "B", "b"]),
         "line_number": pick.randrange(5), "ord": pick.randrange(3) * 10**8, "proof": (True, True, True, False, True, pick.random() < 0.5, [])}
        for i in range(400)
    ]
    df = finding(spark, rows)
    placed = R.saturation_ranks(df).withColumn("exploitability_proven", F.col("proof.exploitability_proven")).withColumn("points", R._points())
    raw = placed.groupBy("repo_id").agg(F.sum(F.col("points") * F.col("factor")).alias("raw"))
    want = {r.repo_id: min(100, int(round(r.raw, 6))) for r in raw.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.repo_id: r.risk_score for r in R.risk_scores(df.repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(set(got.values())) > 5
