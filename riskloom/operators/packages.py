"""Dependencies declared in a repository, and findings about suspicious ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions import paths as P
from riskloom.functions import sqltext as Q
from riskloom.functions import text as X
from riskloom.functions.prose import TEXTS
from riskloom.model import PROOF_FLAGS, REF, SCANNERS
from riskloom.plans.ranking import numbered

_RECORD = "struct<package:string,line_number:int,quote:string>"


def npm_records(text: Column, lines: Column) -> Column:
    """Names of the three dependency sections, each with the first line that quotes it."""
    sections = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>")
    names = F.flatten(
        F.array_compact(F.array(*[F.map_keys(sections[s]) for s in K.PACKAGE_SECTIONS]))
    )

    def record(name: Column) -> Column:
        quoted = F.concat(F.lit('"'), name, F.lit('"'))
        at = F.array_position(F.transform(lines, lambda l: F.contains(l, quoted)), True).cast("int")
        return F.struct(
            name.alias("package"),
            F.greatest(at, F.lit(1)).alias("line_number"),
            F.when(at > 0, F.left(X.strip(F.get(lines, at - 1)), F.lit(K.QUOTE_CHARS))).otherwise(quoted).alias("quote"),
        )

    return F.transform(names, record)


def requirement_records(lines: Column) -> Column:
    sql = f"""
        filter(transform({{lines}}, (l, i) -> named_struct(
            'package', {Q.strip(f"get(split({Q.strip('l')}, {Q.lit(K.REQUIREMENT_SPLIT)}), 0)")},
            'line_number', i + 1,
            'quote', left({Q.strip('l')}, {K.QUOTE_CHARS}))),
          r -> r.quote != '' AND NOT startswith(r.quote, '#') AND r.package != '')"""
    return F.expr(sql.format(lines=lines))


def pyproject_records(lines: Column) -> Column:
    sql = f"""
        filter(transform({{lines}}, (l, i) -> named_struct(
            'package', regexp_extract(l, {Q.lit(K.PYPROJECT_LINE)}, 1),
            'line_number', i + 1,
            'quote', left({Q.strip('l')}, {K.QUOTE_CHARS}))),
          r -> r.package != '')"""
    return F.expr(sql.format(lines=lines))


def extract_packages(files: DataFrame) -> DataFrame:
    """(repo_id, path, registry, package, line_number, quote, pos) of every manifest.

    Of a package that a manifest names twice the last record counts, at the first
    one's position.
    """
    c = F.col
    name = P.file_name(c("path"))
    wanted = files.filter(name.isin(*K.DEPENDENCY_FILES)).select(
        "repo_id", "path", name.alias("name"), "text", X.split_lines(c("text")).alias("lines")
    )
    records = (
        F.when(c("name") == "package.json", npm_records(c("text"), c("lines")).cast(f"array<{_RECORD}>"))
        .when(c("name") == "pyproject.toml", pyproject_records("lines").cast(f"array<{_RECORD}>"))
        .otherwise(requirement_records("lines").cast(f"array<{_RECORD}>"))
    )
    rows = wanted.select(
        "repo_id", "path",
        F.when(c("name") == "package.json", "npm").otherwise("pypi").alias("registry"),
        F.posexplode(records).alias("pos", "r"),
    )
    return (
        rows.groupBy("repo_id", "registry", "path", c("r.package").alias("package"))
        .agg(F.max(F.struct("pos", "r.line_number", "r.quote")).alias("last"), F.min("pos").alias("pos"))
        .select("repo_id", "path", "registry", "package", "last.line_number", "last.quote", "pos")
    )


def audit_batch(packages: DataFrame, limit: int | None = None) -> DataFrame:
    """The records of a repository in the order of an audit, npm first and then by file; the
    first ``limit`` of them if a limit is given."""
    order = [F.col("registry"), F.lower("path"), F.col("path"), F.col("pos")]
    if limit is None:
        return numbered(packages, ["repo_id"], order, "place").withColumn("place", F.col("place") + 1)
    return packages.withColumn("place", F.row_number().over(W.partitionBy("repo_id").orderBy(*order))).filter(F.col("place") <= limit)


def audit_findings(packages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings for packages whose registry verdict is bad.

    ``verdicts`` holds (registry, package, verdict, confidence, reason).  Of several
    manifests of a repository that name the package, the last one is quoted.
    """
    c = F.col
    bad = verdicts.filter(c("verdict").isin("suspicious", "not_found"))
    hit = packages.join(bad, ["registry", "package"])
    best = hit.groupBy("repo_id", "registry", "package", "verdict", "confidence", "reason").agg(
        F.max(F.struct(F.lower("path").alias("lowered"), "path", "line_number", "quote")).alias("at")
    )
    confirmed = c("confidence") >= K.PACKAGE_CONFIRM_AT
    line = c("at.line_number")
    ref = F.struct(
        F.lit("manifest").alias("kind"), c("at.path").alias("file_path"), line.alias("line_start"), line.alias("line_end"),
        c("at.quote").alias("quote"),
    )
    ids = F.sha2(F.concat_ws("\u0001", "repo_id", F.lit("slopsquatting"), "registry", "package", "at.path"), 256)
    no_text, null_text = F.lit(""), F.lit(None).cast("string")
    nobody = F.array().cast("array<string>")
    return best.select(
        "repo_id",
        ids.alias("id"),
        F.lit("slopsquatting").alias("rule_id"),
        F.lit("slopsquatting").alias("category"),
        F.when(confirmed, "confirmed").otherwise("needs_review").alias("status"),
        F.when(c("verdict") == "not_found", "critical").otherwise("high").alias("severity"),
        c("confidence").cast("double").alias("confidence"),
        c("at.path").alias("path"),
        line.alias("line_number"),
        c("at.quote").alias("evidence"),
        F.array(ref).cast(f"array<{REF}>").alias("evidence_refs"),
        F.struct(*[F.lit(False).alias(f) for f in PROOF_FLAGS], nobody.alias("notes")).alias("proof"),
        F.concat(F.lit(TEXTS["slopsquatting"][0] + " ["), c("package"), F.lit(": "), c("verdict"), F.lit(", "), F.coalesce("reason", F.lit("no reason given")), F.lit("]")).alias("description"),
        no_text.alias("attack_chain"),
        null_text.alias("fix_code"),
        no_text.alias("recommendation"),
        no_text.alias("fix"),
        no_text.alias("fix_source"),
        F.lit(None).cast("double").alias("cvss_score"),
        null_text.alias("cvss_vector"),
        F.when(confirmed, F.array(F.lit("package-audit"))).otherwise(nobody).alias("confirmed_by"),
        F.lit("package-audit").alias("validator"),
        F.lit(K.OWASP["slopsquatting"]).alias("owasp_cat"),
        F.when(c("verdict") == "not_found", "low").otherwise("medium").alias("false_positive_risk"),
        F.lit(SCANNERS.index("packages") * 100_000_000).cast("bigint").alias("ord"),
    )
