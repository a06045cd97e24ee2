"""Unified patches: applying them to files and checking that they repair a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions import paths as P
from riskloom.functions import sqltext as Q
from riskloom.functions import text as X
from riskloom.operators import detect as D
from riskloom.operators.evidence import build_evidence
from riskloom.operators.pyfacts import python_syntax
from riskloom.plans.ranking import slices_of
from riskloom.plans.staging import stage

def targets(patch: Column) -> Column:
    """Paths a patch changes, without the a/ and b/ prefixes and time stamps."""
    new = F.regexp_extract_all(patch, F.lit(r"(?m)^--- [^\n]*\n\+\+\+ ([^\t\n]*)"), F.lit(1))
    old = F.regexp_extract_all(patch, F.lit(r"(?m)^--- ([^\t\n]*)[^\n]*\n\+\+\+ "), F.lit(1))
    # a removed file has only its old name
    names = F.zip_with(new, old, lambda n, o: F.when(X.strip(n) == "", X.strip(o)).otherwise(X.strip(n)))
    return F.transform(names, lambda n: F.when(n == "/dev/null", "").otherwise(F.regexp_replace(n, "^[ab]/", "")))


# A file's part of a patch: what follows its two name lines, up to the next pair of them.
_PART = r"(?sm)^--- ([^\t\n]*)[^\n]*\n\+\+\+ ([^\t\n]*)[^\n]*(?:\n|\z)(.*?)(?=^--- [^\n]*\n\+\+\+ |\z)"
# A hunk: the line it starts at, and its body; a header without a line number gives a hunk that fits nowhere.
_HUNK = r"(?sm)^@@(?: -(\d+)(?:,\d+)? \+\d+(?:,\d+)? @@)?[^\n]*(?:\n|\z)(.*?)(?=^@@|\z)"


def _side(lines: str, other: str) -> str:
    """SQL for one side of a hunk as text: its lines without their marks, each ended by a line feed."""
    own = f"filter({lines}, l -> NOT startswith(l, '{other}') AND NOT startswith(l, '\\\\'))"
    return f"array_join(transform({own}, l -> concat(substring(l, 2), '\\n')), '')"


def _hunks(part: str) -> str:
    """SQL for the hunks of a file's part: (line, old, new, sound)."""
    body = "split(regexp_replace(b, '\\n\\\\z', ''), '\\n')"
    body = f"IF(b = '', CAST(array() AS array<string>), {body})"
    zipped = f"zip_with(regexp_extract_all({part}, {Q.lit(_HUNK)}, 1), regexp_extract_all({part}, {Q.lit(_HUNK)}, 2), (n, b) -> named_struct('n', n, 'lines', {body}))"
    sound = "h.n <> '' AND forall(h.lines, l -> l = '' OR substring(l, 1, 1) IN (' ', '-', '+', '\\\\'))"
    return (
        f"transform({zipped}, h -> named_struct('at', CAST(IF(h.n = '', '0', h.n) AS int), 'old', {_side('h.lines', '+')}, "
        f"'new', {_side('h.lines', '-')}, 'sound', {sound}))"
    )


def _changed() -> str:
    """SQL for (text, moved, fits): the hunks' old sides replaced by their new ones, in order.

    The text stands between line feeds, so a block of whole lines is a piece of text.  Each
    block is looked for from the line its hunk names, moved by what earlier hunks added.
    """
    count = lambda x: f"(length({x}) - length(replace({x}, '\\n', '')))"
    start = "least(length(substring_index(s.text, '\\n', greatest(h.at - 1 + s.moved, 0) + 1)) + 1, length(s.text))"
    found = f"IF(h.old = '', {start}, locate(concat('\\n', h.old), s.text, {start}))"
    step = (
        f"IF(NOT s.fits OR NOT h.sound OR {found} = 0, named_struct('text', s.text, 'moved', s.moved, 'fits', false), "
        f"named_struct('text', concat(left(s.text, {found}), h.new, substring(s.text, {found} + 1 + length(h.old))), "
        f"'moved', s.moved + {count('h.new')} - {count('h.old')}, 'fits', true))"
    )
    begin = f"concat('\\n', regexp_replace(regexp_replace(text, {Q.lit(K.LINE_BREAK)}, '\\n'), '\\n\\\\z', ''), IF(text = '', '', '\\n'))"
    return f"aggregate(hunks, named_struct('text', {begin}, 'moved', 0, 'fits', true), (s, h) -> {step})"


def apply_patches(fixes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, repo_id, path, ok, text, error): every file a fix changes, after the change.

    ``fixes`` holds (id, repo_id, patch).  A patch is cut into its files' parts, these meet the
    files in one equi join, and each text is changed by SQL functions alone.
    """
    c = F.col
    parts = F.regexp_extract_all("patch", F.lit(_PART), F.lit(3))
    wanted = fixes.select("id", "repo_id", F.arrays_zip(targets(c("patch")).alias("path"), parts.alias("part")).alias("changes"))
    bare = wanted.filter(F.size("changes") == 0).select(
        "id", "repo_id", F.lit(None).cast("string").alias("path"), F.lit(False).alias("ok"), F.lit(None).cast("string").alias("text"),
        F.lit("The patch names no file.").alias("error"),
    )
    each = wanted.select("id", "repo_id", F.posexplode("changes").alias("place", "change")).select("id", "repo_id", "place", "change.path", "change.part")
    # several parts for one file are one after another
    each = each.groupBy("id", "repo_id", "path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x.part), "").alias("part")
    )
    met = each.join(files.select("repo_id", "path", "text"), ["repo_id", "path"], "left")
    done = met.withColumn("hunks", F.expr(_hunks("part"))).withColumn("r", F.when(c("text").isNotNull(), F.expr(_changed())))
    error = (
        F.when(c("path") == "", "The patch leaves no file to change.")
        .when(F.startswith("path", F.lit("/")) | F.array_contains(F.split("path", "/"), ".."), "The patch points outside the repository.")
        .when(c("text").isNull(), F.concat(F.lit("There is no file "), "path", F.lit(" to change.")))
        .when(~c("r.fits"), F.concat(F.lit("The patch does not fit "), "path", F.lit(".")))
    )
    done = done.withColumn("error", error)
    good = c("error").isNull()
    return done.select(
        "id", "repo_id", "path", good.alias("ok"), F.when(good, F.substring("r.text", F.lit(2), F.length("r.text"))).alias("text"), "error"
    ).unionByName(bare)


def verify_fixes(fixes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, accepted, reasons): does the patch apply, parse and remove the finding?

    ``fixes`` holds (id, repo_id, category, path, patch).  Accepted when all changed
    files apply, changed Python files parse, and a fresh scan of the changed files shows
    no surviving finding of the same category in the finding's file.
    """
    c = F.col
    changed = stage(apply_patches(fixes, files), "patched-files")
    syntax = python_syntax(F.when(c("ok") & (P.suffix(c("path")) == ".py"), c("text")))
    checked = changed.withColumn("syntax", syntax)
    problem = (
        F.when(~c("ok"), c("error"))
        .when(~c("syntax.ok"), F.concat(F.lit("After the patch "), c("path"), F.lit(" does not parse: "), c("syntax.message"), F.lit(".")))
    )
    problems = checked.groupBy("id").agg(F.min(F.when(problem.isNotNull(), F.struct("path", problem.alias("what")))).alias("first_problem"))
    rescanned = fixes.filter(c("category").isin("sql_injection", "command_injection", "log_injection"))
    survivors = _survivors(rescanned, changed.filter("ok"), files)
    empty = X.strip(F.coalesce("patch", F.lit(""))) == ""
    rows = fixes.join(problems, "id", "left").join(survivors.withColumn("survives", F.lit(True)), "id", "left")
    reasons = (
        F.when(empty, F.array(F.lit("There is no patch.")))
        .when(c("first_problem").isNotNull(), F.array("first_problem.what"))
        .when(c("survives"), F.array(F.lit("The weakness is still there after the patch.")))
        .otherwise(F.array(F.lit("The patch fits, the code parses and the weakness is gone.")))
    )
    accepted = ~empty & c("first_problem").isNull() & c("survives").isNull()
    return rows.select("id", accepted.alias("accepted"), reasons.alias("reasons"))


def _survivors(fixes: DataFrame, changed: DataFrame, files: DataFrame) -> DataFrame:
    """Ids of fixes whose finding is still there after the change.

    A fix that leaves the finding's file alone is judged by that file as it was.
    """
    c = F.col
    own = fixes.select("id", "category", "path", "repo_id")
    after = changed.select("id", "path", c("text").alias("new_text"))
    view = (
        own.join(after, ["id", "path"], "left")
        .join(files.select("repo_id", "path", "text"), ["repo_id", "path"], "left")
        .select(c("id").alias("repo_id"), "path", F.coalesce("new_text", "text", F.lit("")).alias("text"))
    )
    # scanning is heavy for its bytes, so the rows are spread rather than merged
    view = view.repartition(slices_of(view), "repo_id")
    keys = ["DET-01", "DET-02", "DET-03", "DET-04", "DET-05", "DET-06"]
    items = D.file_items(view, keys, context=True, flows=True, keep=["f_web_hint"])
    found = D.candidates_from_items(items, keys, carry=["ctx", "flows", "f_web_hint"])
    found = found.withColumns({"kind": F.lit(None).cast("string"), "external_exposure_proven": F.lit(None).cast("boolean")})
    built = build_evidence(found).filter(c("status") != "rejected")
    survived = built.select(c("repo_id").alias("id"), "category", "path").distinct()
    return own.join(survived, ["id", "category", "path"], "left_semi").select("id").distinct()
