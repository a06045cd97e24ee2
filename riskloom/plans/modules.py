"""Python modules that parse, derived from the event table, and patches for them.

Every event becomes one small function; twelve consecutive events make a module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.corpus import spread

PARTS_PER_MODULE = 12

# six lines each; {u} is the user and {e} the event
PARTS: list[str] = [
    '@app.get("/api/admin/users{u}")\ndef list_{e}(name):\n    cursor.execute(f"SELECT * FROM t WHERE n = {name}")\n    return []\n\n',
    '@app.post("/public/{u}")\ndef add_{e}(item):\n    cursor.execute("INSERT INTO t VALUES (?)", (item,))\n    return {}\n\n',
    'def run_{e}():\n    import subprocess\n    subprocess.run(request.args["cmd"], shell=True)\n\n\n',
    'def safe_{e}():\n    import os, shlex\n    os.system(shlex.quote(request.form["x"]) + flag)\n\n\n',
    '@router.get("/info/{u}")\nasync def info_{e}(q):\n    logger.info(f"asked {request.query_params}")\n    return q\n\n',
    'def plain_{e}(a, b):\n    total = a + b + {u}\n    print(f"total {total}")\n    return total\n\n',
    '@app.delete("/internal/{u}")\n@login_check\ndef drop_{e}(uid):\n    db.execute("DELETE FROM t WHERE id = " + uid)\n    return None\n',
    'class Box{e}:\n    @bp.route("/account/{u}")\n    def show(self, request):\n        return eval(request.body)\n\n',
]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return events.withColumns(
        {
            "module_no": F.floor(F.col("event_id") / PARTS_PER_MODULE).cast("bigint"),
            "position": (F.col("event_id") % PARTS_PER_MODULE).cast("int"),
            "part_no": ((F.col("event_id") * 5 + F.col("user_id")) % len(PARTS)).cast("int"),
        }
    )


def _path():
    return F.concat(F.lit("svc/m"), F.col("module_no").cast("string"), F.lit(".py"))


def _repo():
    number = F.col("module_no")
    return F.when(number % 3 == 0, "mod-big").otherwise(F.concat(F.lit("mod-"), F.floor(number / 50).cast("string")))


def python_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, path, text); a module has at most twelve parts."""
    c = F.col
    part = F.element_at(F.array(*[F.lit(p) for p in PARTS]), c("part_no") + 1)
    part = F.replace(F.replace(part, F.lit("{u}"), c("user_id").cast("string")), F.lit("{e}"), c("event_id").cast("string"))
    rows = _events(spark, sf_dir).select("module_no", "position", part.alias("part"))
    grouped = rows.repartition(spread(spark), "module_no").groupBy("module_no").agg(F.array_sort(F.collect_list(F.struct("position", "part"))).alias("parts"))
    return grouped.select(
        _repo().alias("repo_id"), _path().alias("path"),
        F.array_join(F.transform("parts", lambda p: p.part), "\n").alias("text"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, repo_id, category, path, patch): a proposed fix per first part of a kind in a module.

    By the event number a patch repairs the statement, leaves it open, breaks the
    syntax, misses the text, or names no file.
    """
    c = F.col
    first = _events(spark, sf_dir).filter(c("part_no") == 0)
    line = c("position") * 6 + 3
    old = '    cursor.execute(f"SELECT * FROM t WHERE n = {name}")'
    new = (
        F.when(c("event_id") % 5 == 0, "    cursor.find(name)")
        .when(c("event_id") % 5 == 1, old + "  # checked")
        .when(c("event_id") % 5 == 2, "    cursor.execute(")
        .otherwise("    cursor.find(name)")
    )
    gone = F.when(c("event_id") % 5 == 3, "    not in the file").otherwise(old)
    head = F.concat(F.lit("--- a/"), _path(), F.lit("\n+++ b/"), _path(), F.lit("\n"))
    hunk = F.concat(F.lit("@@ -"), line.cast("string"), F.lit(" +"), line.cast("string"), F.lit(" @@\n-"), gone, F.lit("\n+"), new, F.lit("\n"))
    patch = F.when(c("event_id") % 15 == 4, hunk).otherwise(F.concat(head, hunk))
    return first.select(
        F.concat(F.lit("fix-"), c("event_id").cast("string")).alias("id"), _repo().alias("repo_id"), F.lit("sql_injection").alias("category"),
        _path().alias("path"), patch.alias("patch"),
    )
