"""The whole scan as one plan: files in, findings and scores per repository out.

One pass reads the texts and leaves a narrow row per file: signals, context words and
the few lines worth a look with what surrounds them.  Everything after it works on
that table; no text is read twice, joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import paths as P
from riskloom.operators import context as C
from riskloom.operators import detect as D
from riskloom.operators import findings as R
from riskloom.operators import packages as PK
from riskloom.operators import patches as PT
from riskloom.operators import plugins as PL
from riskloom.operators import review as V
from riskloom.operators.evidence import build_evidence
from riskloom.plans.staging import stage

EVIDENCE_SIGNALS = ["f_web_hint"]


def mark_ignored(files: DataFrame, strict: bool = False, max_file_bytes: int | None = None) -> DataFrame:
    """Add ``ignored``: paths outside the scan and, where a limit is given, files above it
    (``left_out`` counts them)."""
    ignored = P.is_ignored(F.col("path"), strict)
    if max_file_bytes is not None:
        size = F.col("size") if "size" in files.columns else F.octet_length("text")
        ignored = ignored | (size > max_file_bytes)
    return files.withColumn("ignored", ignored)


def left_out(marked: DataFrame) -> DataFrame:
    """Per repository the files that a scan does not read, and their bytes."""
    size = F.col("size") if "size" in marked.columns else F.octet_length("text")
    return marked.filter("ignored").groupBy("repo_id").agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"))


def file_facts(files: DataFrame, keys=None, *, flows: bool = True) -> DataFrame:
    """The one pass over the texts.  ``files`` holds (repo_id, path, text, ignored)."""
    signals = [*D.REPO_SIGNALS, *EVIDENCE_SIGNALS]
    scanned = F.when(~F.col("ignored"), F.col("text")).otherwise("")
    context = C.with_sample(files).select("repo_id", "path", "ignored", scanned.alias("text"), *C.file_context_columns())
    return D.file_items(
        context, keys, context=True, flows=flows, keep=signals, carry=["ignored", *C.CONTEXT_COLUMNS]
    )


def repository_facts(facts: DataFrame) -> DataFrame:
    """One row per repository: project-wide signals and context."""
    flags = D.collect_repo_flags(facts.filter(~F.col("ignored")).select("repo_id", *D.REPO_SIGNALS))
    return C.repo_contexts(facts).join(flags, "repo_id", "left")


#: Slices in which the findings of a repository meet what is known of it.
SLICES = 32
FOR_EVIDENCE = ["ctx", "flows", "f_web_hint"]


def raw_findings(facts: DataFrame, repos: DataFrame, keys=None, found: DataFrame | None = None) -> DataFrame:
    """Candidates with what the evidence step needs, in the light of their repository."""
    if found is None:
        found = D.candidates_from_items(facts, keys, carry=FOR_EVIDENCE)
    about = repos.select(
        "repo_id", "project_auth", "supabase_project", "kind", "external_exposure_proven", "sensitive_public_surface"
    )
    # The repository side grows with the corpus, so Spark picks the join by size.  Its narrow rows come once for
    # each slice of a repository's files, so that the findings of a large repository do not meet in one task.
    slices = about.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    sliced = found.withColumn("slice", F.pmod(F.xxhash64("path"), F.lit(SLICES)).cast("int"))
    return project_view(sliced.join(slices, ["repo_id", "slice"], "left").drop("slice"))


def project_view(joined: DataFrame) -> DataFrame:
    """Project-wide signals at work: tables without row security matter only in Supabase
    projects, and known auth middleware leaves a missing check uncertain."""
    c = F.col
    uncertain = (c("category") == "missing_auth") & F.coalesce(c("project_auth"), F.lit(False))
    return joined.filter((c("category") != "rls_disabled") | F.coalesce(c("supabase_project"), F.lit(False))).withColumns(
        {
            "status": F.when(uncertain, "needs_review").otherwise(c("status")),
            "false_positive_risk": F.when(uncertain, "high").otherwise(c("false_positive_risk")),
        }
    )


ABOUT_REPOSITORY = ["kind", "external_exposure_proven", "sensitive_public_surface"]


def evidenced(facts: DataFrame, repos: DataFrame, keys=None, found: DataFrame | None = None) -> DataFrame:
    """Findings with evidence; what is known about the repository stays with them."""
    return build_evidence(raw_findings(facts, repos, keys, found), carry=ABOUT_REPOSITORY)


def finish(findings: DataFrame) -> DataFrame:
    """Context downgrade, merging of duplicates, removal of rejected, final scoring.

    ``findings`` carries the columns of ABOUT_REPOSITORY.
    """
    adjusted = C.apply_context(findings).drop(*ABOUT_REPOSITORY)
    return R.final_scoring(R.visible(R.dedupe(adjusted)))


def scan(files: DataFrame, keys=None, *, flows: bool = True, strict: bool = False, staged: bool = False) -> DataFrame:
    """Findings of all repositories in ``files`` (repo_id, path, text[, size]).

    With ``staged`` the facts table is written to the shared folder first, which is the
    way to run it over a large corpus: its readers then touch a fraction of the input.
    """
    facts = file_facts(mark_ignored(files, strict), keys, flows=flows)
    if staged:
        facts = stage(facts, "file-facts")
    return scan_facts(facts, keys)


def scan_facts(facts: DataFrame, keys=None) -> DataFrame:
    """Findings from the facts of all files, for callers that read more from these."""
    return finish(evidenced(facts, repository_facts(facts), keys))


def scan_with_rules(files: DataFrame, rules: list, keys=None, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of a scan with rules of one's own: line and file rules in SQL, and plug-ins
    in Python.

    No rule can stop a scan.  A plug-in that fails on a file says nothing of that file.  An SQL
    rule runs in the pass over all files; should the pass fail, each is tried alone, and the ones
    that fail are left out.  ``errors`` has (rule, repo_id, path, error); a rule left out has no path.
    """
    spark = files.sparkSession
    marked = mark_ignored(files, strict)
    plugins = [r for r in rules if isinstance(r, PL.Plugin)]
    own = [r for r in rules if not isinstance(r, PL.Plugin)]
    built_in = list(D.DETECTOR_KEYS if keys is None else keys)

    def passed(chosen: list) -> tuple[DataFrame, DataFrame]:
        facts = stage(file_facts(marked, chosen), "file-facts")
        return facts, stage(D.candidates_from_items(facts, chosen, carry=FOR_EVIDENCE), "candidates")

    left_out = []
    try:
        facts, found = passed([*built_in, *own])
    except Exception:
        if not own:
            raise
        good = []
        for rule in own:
            try:
                stage(D.candidates_from_items(D.file_items(marked.where("NOT ignored"), [rule]), [rule]), "candidates")
                good.append(rule)
            except Exception as e:
                left_out.append((rule.key, None, None, str(e).strip().partition("\n")[0]))
        facts, found = passed([*built_in, *good])
    errors = spark.createDataFrame(left_out, PL.ERRORS)
    if plugins:
        rows = stage(PL.plugin_rows(marked.where("NOT ignored"), plugins), "plug-ins")
        hints = facts.select("repo_id", "path", "f_web_hint")
        found = found.unionByName(PL.found(rows).join(hints, ["repo_id", "path"]))
        errors = errors.unionByName(PL.errors(rows))
    repos = repository_facts(facts)
    return finish(evidenced(facts, repos, found=found)), errors


def reviewed_scan(
    files: DataFrame,
    verdicts: DataFrame | None = None,
    package_verdicts: DataFrame | None = None,
    fixes: DataFrame | None = None,
    keys=None,
    *,
    strict: bool = False,
    staged: bool = False,
) -> DataFrame:
    """A scan that takes outside reviews into account, in the order of the full pipeline:
    evidence, verdicts, contradiction gate, package findings, fixes, standard advice,
    repository context, merging, final scoring.

    ``verdicts`` and ``fixes`` refer to finding ids (see ``operators.review``);
    ``fixes`` lacking the columns accepted and reasons are checked here.
    """
    marked = mark_ignored(files, strict)
    facts = file_facts(marked, keys)
    if staged:
        facts = stage(facts, "file-facts")
    repos = repository_facts(facts)
    found = evidenced(facts, repos, keys)
    if verdicts is not None:
        found = V.merge_verdicts(found, verdicts)
    found = R.contradiction_gate(found)
    scanned = marked.filter(~F.col("ignored"))
    if package_verdicts is not None:
        audited = PK.audit_findings(PK.extract_packages(scanned), package_verdicts)
        found = found.unionByName(audited, allowMissingColumns=True)
    if fixes is not None:
        if "accepted" not in fixes.columns:
            about = found.filter("status = 'confirmed'").select("id", "repo_id", "category", "path")
            ready = fixes.filter("status = 'patch_ready'").select("id", "patch").join(about, "id")
            fixes = fixes.join(PT.verify_fixes(ready, scanned), "id", "left")
        found = V.merge_fixes(found, fixes)
    return finish(V.remediate(found))


def repository_scores(findings: DataFrame) -> DataFrame:
    """Risk score, verdict and number of findings per repository."""
    return R.risk_scores(findings)
