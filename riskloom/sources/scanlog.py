"""Stored scans: commits that add, replace or delete scans, merged when they are read.

A folder holds ``heads`` (a row for each scan that a commit touches), ``findings`` (in folders by
a hash of the scan) and ``_commits``, a small numbered file for each commit.  Data are written
first, under a name of their own; the numbered file then makes the commit, all of it at once, and
can't replace one that exists, so two writers get two numbers.  What a failed writer leaves
behind is in no commit and never read.  Nothing stored is changed in place.

Of a scan counts what the latest commit that has it says, for its head and for its findings; a
deletion takes both away until a later commit brings the scan again.  Deletions of a commit come
before its rows.  ``compact`` writes the live rows as a commit that readers start from, and
``vacuum`` removes the data of the commits before it.

Findings of older generations may lack columns; these read as the defaults of ``STORED_FINDING``.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.model import PROOF, REF

SCANS = (
    "scan_id string, repo_url string, status string, risk_score int, verdict string, files_scanned int, scan_ms int, "
    "frameworks array<string>, repo_context struct<kind:string,reasons:array<string>,local_network_hints:array<string>,"
    "public_api_signals:array<string>,external_exposure_proven:boolean,sensitive_public_surface:boolean>, "
    "models_used array<string>, error_message string, created_at timestamp, updated_at timestamp"
)
# column -> (type, default of a missing value as SQL)
STORED_FINDING = {
    "scan_id": ("string", "NULL"),
    "id": ("string", "NULL"),
    "category": ("string", "''"),
    "severity": ("string", "'low'"),
    "status": ("string", "'candidate'"),
    "confidence": ("double", "0"),
    "path": ("string", "''"),
    "line_number": ("int", "0"),
    "evidence": ("string", "''"),
    "evidence_refs": (f"array<{REF}>", "array()"),
    "proof": (PROOF, "NULL"),
    "description": ("string", "''"),
    "attack_chain": ("string", "''"),
    "fix_code": ("string", "NULL"),
    "recommendation": ("string", "''"),
    "fix": ("string", "''"),
    "fix_source": ("string", "''"),
    "cvss_score": ("double", "NULL"),
    "cvss_vector": ("string", "NULL"),
    "confirmed_by": ("array<string>", "array()"),
    "validator": ("string", "NULL"),
    "owasp_cat": ("string", "NULL"),
    "false_positive_risk": ("string", "'low'"),
    "ord": ("bigint", "0"),
}
BUCKETS = 256


class Conflict(Exception):
    """Another commit came first, and this one was made from the state before it."""


def align(df: DataFrame, target: dict[str, tuple[str, str]]) -> DataFrame:
    """Bring an older table to the columns of ``target``: missing columns and null values
    take the default."""
    columns = []
    for name, (kind, default) in target.items():
        value = F.expr(f"CAST({default} AS {kind})")
        present = F.coalesce(F.col(name).cast(kind), value) if name in df.columns else value
        columns.append(present.alias(name))
    return df.select(*columns)


def bucket(scan_id: Column) -> Column:
    return F.pmod(F.xxhash64(scan_id), F.lit(BUCKETS)).cast("int")


# ------------------------------------------------------------------ the list of commits
def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, folder: str) -> list[dict]:
    """All commits in order: number, data (the name its data have), base, findings."""
    path, fs = _file_system(spark, f"{folder}/_commits")
    if not fs.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    found = []
    for name in names:
        if name.isdigit():
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(path.suffix(f"/{name}")), "UTF-8")
            found.append({"number": int(name), **json.loads(text)})
    return found


def _seen(spark: SparkSession, folder: str, at: int | None = None) -> list[dict]:
    """The commits that a reader has to merge: the last base up to ``at`` and what follows it."""
    commits = [x for x in _commits(spark, folder) if at is None or x["number"] <= at]
    bases = [i for i, x in enumerate(commits) if x["base"]]
    return commits[bases[-1] if bases else 0 :]


def _record(spark: SparkSession, folder: str, entry: dict, after: int | None) -> int:
    """Make a commit: the next number, or the one after ``after`` and no other."""
    jvm = spark._jvm
    path, fs = _file_system(spark, f"{folder}/_commits")
    fs.mkdirs(path)
    draft = path.suffix(f"/draft-{entry['data']}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(entry), "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    while True:
        last = max((x["number"] for x in _commits(spark, folder)), default=-1)
        if after is not None and last != after:
            fs.delete(draft, False)
            raise Conflict(f"{folder}: commit {last} came after {after}")
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(path.suffix(f"/{last + 1:012d}")), options)
            return last + 1
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise


# ------------------------------------------------------------------ writing
def commit(
    spark: SparkSession, folder: str, findings: DataFrame | None = None, scans: DataFrame | None = None, deleted: DataFrame | None = None,
    base: bool = False, after: int | None = None,
) -> int:
    """Write scans (heads), the findings of whole scans and deletions (scan_id) as one commit;
    its number.  A scan without findings that replaces one with findings needs a head."""
    data = uuid.uuid4().hex
    shape = StructType.fromDDL(SCANS)
    heads = []
    if scans is not None:
        columns = [F.col(f.name).cast(f.dataType) if f.name in scans.columns else F.lit(None).cast(f.dataType) for f in shape]
        whole = F.lit(findings is not None)
        heads.append(scans.select(*[x.alias(f.name) for x, f in zip(columns, shape)], F.lit(True).alias("has_head"), whole.alias("has_findings"), F.lit(False).alias("gone")))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in shape.fields[1:]]
    if findings is not None:
        ids = findings.select("scan_id").distinct()
        heads.append(ids.select("scan_id", *empty, F.lit(False).alias("has_head"), F.lit(True).alias("has_findings"), F.lit(False).alias("gone")))
    if deleted is not None:
        heads.append(deleted.select("scan_id").distinct().select("scan_id", *empty, F.lit(False).alias("has_head"), F.lit(False).alias("has_findings"), F.lit(True).alias("gone")))
    reduce(DataFrame.unionByName, heads).write.parquet(f"{folder}/heads/commit={data}")
    if findings is not None:
        rows = findings.select(*[c for c in STORED_FINDING if c in findings.columns], bucket(F.col("scan_id")).alias("bucket"))
        # splits large buckets over several writers and keeps small ones whole
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/findings/commit={data}")
    return _record(spark, folder, {"data": data, "base": base, "findings": findings is not None}, after)


def compact(spark: SparkSession, folder: str) -> int:
    """Write what is live as one commit that readers start from."""
    now = max(x["number"] for x in _commits(spark, folder))
    live = heads(spark, folder, now)
    return commit(spark, folder, _merged(spark, folder, live, now), live.where("has_head").select(*StructType.fromDDL(SCANS).names), base=True, after=now)


def vacuum(spark: SparkSession, folder: str) -> int:
    """Remove the data of commits before the last base; how many were removed.  Readers that
    began before the base must have ended."""
    kept = {x["data"] for x in _seen(spark, folder)}
    gone = [x for x in _commits(spark, folder) if x["data"] not in kept]
    for x in gone:
        for part in ("heads", "findings"):
            path, fs = _file_system(spark, f"{folder}/{part}/commit={x['data']}")
            fs.delete(path, True)
        path, fs = _file_system(spark, f"{folder}/_commits/{x['number']:012d}")
        fs.delete(path, False)
    return len(gone)


# ------------------------------------------------------------------ reading
def _read(spark: SparkSession, folder: str, part: str, columns: str, commits: list[dict]) -> DataFrame:
    """Rows of some commits, with the number of each row's commit."""
    if not commits:
        return spark.createDataFrame([], f"{columns}, commit string, number bigint")
    paths = [f"{folder}/{part}/commit={x['data']}" for x in commits]
    raw = spark.read.schema(f"{columns}, commit string").option("basePath", f"{folder}/{part}").parquet(*paths)
    numbers = F.create_map(*[F.lit(v) for x in commits for v in (x["data"], x["number"])])
    return raw.withColumn("number", F.element_at(numbers, F.col("commit")).cast("long"))


def heads(spark: SparkSession, folder: str, at: int | None = None) -> DataFrame:
    """A row for each live scan: its columns, ``has_head``, and ``found``, the number of the commit
    that holds its findings (null if there are none).  ``at`` reads as of a commit."""
    names = StructType.fromDDL(SCANS).names
    rows = _read(spark, folder, "heads", f"{SCANS}, has_head boolean, has_findings boolean, gone boolean", _seen(spark, folder, at))
    c = F.col
    last = rows.groupBy("scan_id").agg(
        F.max(F.when(c("gone"), c("number"))).alias("gone_at"),
        F.max(F.when(c("has_findings"), c("number"))).alias("found_at"),
        F.max(F.when(c("has_head"), F.struct("number", "updated_at", *[n for n in names if n not in ("scan_id", "updated_at")]))).alias("head"),
    )
    live = lambda number: c("gone_at").isNull() | (number >= c("gone_at"))
    head = F.when(live(c("head.number")), c("head"))
    shown = last.select("scan_id", head.alias("head"), F.when(live(c("found_at")), c("found_at")).alias("found"))
    return shown.where("head IS NOT NULL OR found IS NOT NULL").select(
        *["scan_id" if n == "scan_id" else c(f"head.{n}").alias(n) for n in names], c("head").isNotNull().alias("has_head"), "found"
    )


def scans(spark: SparkSession, folder: str, at: int | None = None) -> DataFrame:
    """The live scans."""
    return heads(spark, folder, at).where("has_head").drop("has_head", "found")


def _merged(spark: SparkSession, folder: str, live: DataFrame, at: int | None, scan_ids: list[str] | None = None) -> DataFrame:
    columns = ", ".join(f"{n} {kind}" for n, (kind, _) in STORED_FINDING.items())
    commits = _seen(spark, folder, at)
    rows = _read(spark, folder, "findings", f"{columns}, bucket int", [x for x in commits if x["findings"]])
    if scan_ids is not None:
        rows = rows.where(F.col("bucket").isin([bucket(F.lit(i)) for i in scan_ids]) & F.col("scan_id").isin(scan_ids))
    if len(commits) > 1:  # the first commit, or a base, holds live rows only
        held = live.where("found IS NOT NULL").select(F.col("scan_id").alias("live_id"), "found")
        rows = rows.join(held, (F.col("scan_id") == F.col("live_id")) & (F.col("number") == F.col("found")), "left_semi")
    return align(rows, STORED_FINDING).withColumn("bucket", bucket(F.col("scan_id")))


def findings(spark: SparkSession, folder: str, scan_ids: list[str] | None = None, at: int | None = None) -> DataFrame:
    """The findings of the live scans, or of some; these are read from their buckets alone."""
    return _merged(spark, folder, heads(spark, folder, at), at, scan_ids)
