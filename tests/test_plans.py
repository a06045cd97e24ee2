"""The shape of plans that matters at size."""

import os

from conftest import SMALL
from pyspark.sql import functions as F

from riskloom.operators import context as C
from riskloom.operators import detect as D
from riskloom.operators import findings as R
from riskloom.operators import flows as T
from riskloom.plans import queries
from riskloom.plans import scan as S
from riskloom.plans.ranking import cut_by_range
from riskloom.plans.staging import new_folder, stage, staged
from riskloom.sources import files as SF
from riskloom.streaming.arrivals import arrivals


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_score_cuts_groups_before_the_shuffle(spark):
    findings = stage(queries.stand_in(spark, SMALL), "plan")
    text = plan(R.risk_scores(findings))
    assert text.count("Scan parquet") == 1  # both parts of the score come from one reading
    exchanges = text[: text.index("MapInArrow")].count("Exchange")
    assert exchanges == text.count("Exchange") and "partial_sum" in text and "Window" not in text


def test_sample_cuts_repositories_before_the_shuffle(spark):
    contexts = stage(C.file_context(S.mark_ignored(queries._files(spark, SMALL))), "plan")
    assert "Partial" in plan(C.first_files(contexts, 40))


def test_no_cross_join_and_no_forced_broadcast(spark):
    for name in ("scan_risk", "package_audit", "verdict_merge", "report_json", "retention", "taint_join", "quota_decisions"):
        text = plan(queries.QUERIES[name](spark, SMALL))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_needed_columns_are_read(spark):
    text = plan(queries.quota_attempts(spark, SMALL))
    assert "value" not in text.split("ReadSchema")[1] and "props" not in text.split("ReadSchema")[1]


def test_listing_filters_reach_the_reader(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    listed = SF.read_tree(spark, str(tmp_path)).filter(F.col("size") <= 10).select("path", "size")
    assert "LessThanOrEqual(length,10)" in plan(listed).replace(" ", "")


def test_a_staged_scan_reads_no_text_again(spark):
    files = queries._files(spark, SMALL)
    facts = stage(S.file_facts(S.mark_ignored(files)), "plan")
    text = plan(S.evidenced(facts, S.repository_facts(facts)))
    assert "events.parquet" not in text and "ArrowEvalPython" not in text


def test_numbering_moves_no_text(spark):
    rows = stage(queries.stand_in(spark, SMALL).withColumn("_row", F.monotonically_increasing_id()), "plan")
    text = plan(cut_by_range(rows, ["repo_id"], R.report_order(), 4))
    read = text.split("ReadSchema")[1]
    assert "Exchange rangepartitioning" in text
    assert not any(wide in read for wide in ("description", "attack_chain", "recommendation", "evidence_refs", "proof", "fix"))


def test_detectors_read_the_files_once(spark):
    tree = str(new_folder(spark, "plan"))
    spark.createDataFrame([("r", "a.sql", "CREATE TABLE public.a (id int);")], "repo_id string, path string, text string").write.parquet(tree)
    text = plan(D.candidates(spark.read.parquet(tree)))
    assert tree.rpartition("/")[2] not in text and text.count("file-items") >= 1


def test_staged_folders_go_with_their_block(spark):
    with staged(spark):
        kept = stage(spark.range(3), "scope")
        folder = kept.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
        assert kept.count() == 3 and os.path.isdir(folder)
    assert not os.path.isdir(folder)


def test_flows_are_parsed_once_and_joined_by_sorting(spark, files):
    table = files({"m.py": "import os\nos.system(request.args)\n"})
    flows = T.taint_flows(table)
    assert plan(flows).count("ArrowEvalPython") == 1 and plan(T.python_routes(table)).count("ArrowEvalPython") == 1
    found = D.candidates(table, ["DET-05"])
    text = plan(T.join_flows(found, flows))
    assert "Broadcast" not in text and "SortMergeJoin" in text


def test_findings_of_a_repository_are_spread(spark, files):
    table = files({f"m{i}.py": 'import os\nos.popen(f"cat {request.args}")\n' for i in range(40)})
    facts = S.file_facts(S.mark_ignored(table))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = S.raw_findings(facts, S.repository_facts(facts)).select("repo_id", "path", "kind", F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r.at for r in rows}) > 1 and len({(r.repo_id, r.kind) for r in rows}) == 1
    assert {r.path for r in rows} == {f"m{i}.py" for i in range(40)}


def test_arriving_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(30, numPartitions=3).mapInArrow(count, "id long")
    sizes = [spark.read.schema("id long").parquet(str(tmp_path / "in")).count() for _ in arrivals(rows, F.col("id"), str(tmp_path / "in"), parts=3)]
    assert made.value == 30 and sizes == [10, 20, 30]


def test_headers_make_the_files_once(spark, monkeypatch):
    made = []
    keep = queries._files
    monkeypatch.setattr(queries, "_files", lambda *a: made.append(a) or keep(*a))
    assert queries.scan_headers(spark, SMALL).count() == queries.repo_context(spark, SMALL).count()
    assert len(made) == 2  # one for each query
