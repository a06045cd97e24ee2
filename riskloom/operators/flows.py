"""Data flows of Python files as a table, and their join with findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import paths as P
from riskloom.functions import sqltext as Q
from riskloom.operators.detect import _FLOW_WORDS, with_file_columns
from riskloom.operators.pyfacts import python_facts, python_syntax


def code_index(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, flows): only files that name a sink are parsed."""
    wanted = F.expr(Q.all_of("endswith(lower(path), '.py')", Q.has("text", _FLOW_WORDS)))
    facts = python_facts(F.col("text"), F.col("path"), wanted, routes=False)
    return files.select("repo_id", "path", P.language(F.col("path")).alias("language"), facts.getField("flows").alias("flows"))


def taint_flows(files: DataFrame) -> DataFrame:
    """One row per flow: (repo_id, path, category, line, confidence, sanitized, refs)."""
    # the outer form: for the plain one Spark adds a filter on the size of the array, for which each file would be parsed a second time
    return code_index(files).select("repo_id", "path", F.explode_outer("flows").alias("f")).where("f IS NOT NULL").select("repo_id", "path", "f.*")


def best_flows(flows: DataFrame) -> DataFrame:
    """The flow with the highest confidence per file, line and category; of equal ones
    the one whose references come first."""
    best = F.max_by(F.struct("confidence", "sanitized", "refs"), F.struct("confidence", F.to_json(F.struct("refs"))))
    return flows.groupBy("repo_id", "path", "line", "category").agg(best.alias("flow")).select("repo_id", "path", "line", "category", "flow.*")


def join_flows(findings: DataFrame, flows: DataFrame) -> DataFrame:
    """Findings with the best flow that ends on their line, if any.

    Both sides grow with the files.  Spark takes the size of flows from that of the table they are made
    of, far below their own, and would send all of them through the driver; so the join is by sorting.
    """
    best = best_flows(flows).withColumnRenamed("line", "line_number").withColumnsRenamed(
        {"confidence": "flow_confidence", "sanitized": "flow_sanitized", "refs": "flow_refs"}
    )
    return findings.join(best.hint("merge"), ["repo_id", "path", "line_number", "category"], "left")


def python_routes(files: DataFrame) -> DataFrame:
    """Routes that decorators declare: (repo_id, path, route, method, line, guarded, seq)."""
    df = with_file_columns(files, ["f_python_routes"])
    facts = df.select("repo_id", "path", python_facts(F.col("text"), F.col("path"), F.col("f_python_routes"), flows=False).alias("py"))
    return facts.select("repo_id", "path", F.explode_outer("py.routes").alias("r")).where("r IS NOT NULL").select("repo_id", "path", "r.*")


def syntax_check(files: DataFrame) -> DataFrame:
    """(repo_id, path, ok, message) of the Python files."""
    text = F.when(P.suffix(F.col("path")) == ".py", F.col("text"))
    return files.select("repo_id", "path", python_syntax(text).alias("s")).filter("s IS NOT NULL").select("repo_id", "path", "s.*")
