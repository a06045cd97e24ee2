"""Scans of files that arrive over time, with all that a scan knows about whole repositories.

A batch's texts are read once, into the facts of its files.  What a repository's files say of it
as a whole are masks, signals and routes; those of a batch are merged with those of the batches
before.  Where the merged view of a repository is what it was, only the batch's files are decided.
Where it has changed (a new kind, exposure, authentication, a Supabase project), the repository's
earlier files are decided again from their stored facts; no text is read twice, and other
repositories are not touched.

Facts, masks and findings are tables of runs (see ``runs``) in one folder, and every batch can be
repeated.  A file counts as decided by the last batch that did; its findings from before then no
longer count.  Files of a repository arrive once, or again as they were; a changed repository is
scanned under a new repo_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import context as C
from riskloom.operators import detect as D
from riskloom.plans import scan as S
from riskloom.plans.staging import stage
from riskloom.streaming import runs as RN

#: What decides findings beside a file's own facts.
VIEW = ["kind", "external_exposure_proven", "sensitive_public_surface", "project_auth", "supabase_project"]


def _kept(rows: DataFrame) -> DataFrame:
    return rows


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repo_id", "path").agg(F.max("batch").alias("batch"))


def _masks(rows: DataFrame) -> DataFrame:
    return C.merged_masks(rows, D.REPO_SIGNALS)


def _views(masks: DataFrame) -> DataFrame:
    signals = masks.select("repo_id", F.col("f_auth_project").alias("project_auth"), F.col("f_supabase").alias("supabase_project"))
    return C.masked_contexts(masks).join(signals, "repo_id").select("repo_id", *VIEW)


def scan_batch(folder: str, keys: list[str] | None = None, strict: bool = False, every: int = 8) -> Callable[[DataFrame, int], None]:
    """Handler of batches of files (repo_id, path, text)."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = {n: f"{folder}/{n}" for n in ("facts", "masks", "decided", "found")}
        facts = RN.add(S.file_facts(S.mark_ignored(batch, strict), keys), place["facts"], number, "repo_id", _kept, every)
        fresh = C.context_masks(facts, D.REPO_SIGNALS)
        fresh = RN.add(fresh, place["masks"], number, "repo_id", _masks, every)
        known, earlier = RN.before(spark, place["masks"], number), RN.before(spark, place["facts"], number)
        todo = facts
        views = fresh
        if known is not None:
            touched = known.join(fresh.select("repo_id"), "repo_id", "left_semi")
            was = _views(_masks(touched))
            views = _masks(touched.unionByName(fresh))
            now = _views(views)
            same = [F.col(f"was.{v}").eqNullSafe(F.col(f"now.{v}")) for v in VIEW]
            changed = was.alias("was").join(now.alias("now"), F.col("was.repo_id") == F.col("now.repo_id"))
            turned = changed.where(~F.forall(F.array(*same), lambda x: x)).select("now.repo_id")
            again = earlier.join(turned, "repo_id", "left_semi").dropDuplicates(["repo_id", "path"])
            todo = stage(todo.unionByName(again), "to-decide")
        found = S.finish(S.evidenced(todo, stage(_views(views), "views"), keys))
        mark = F.lit(number).cast("long").alias("batch")
        RN.add(found.select("*", mark), place["found"], number, "repo_id", _kept, every)
        RN.add(todo.select("repo_id", "path", mark), place["decided"], number, "repo_id", _last, every)

    return handle


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of all files that have arrived."""
    last = _last(RN.before(spark, f"{folder}/decided", 1 << 62))
    found = RN.before(spark, f"{folder}/found", 1 << 62)
    return found.join(last, ["repo_id", "path", "batch"], "left_semi").drop("batch")


def run(files: DataFrame, folder: str, keys: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Take in the files that the stream has now, going on from what ``folder`` holds; the findings
    of all runs so far."""
    stream = files.writeStream.foreachBatch(scan_batch(folder, keys, strict)).option("checkpointLocation", f"{folder}/state")
    stream.trigger(availableNow=True).start().awaitTermination()
    return findings(files.sparkSession, folder)
