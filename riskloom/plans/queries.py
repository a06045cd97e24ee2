"""Named queries over the given tables, one or more per operator.

Each function takes a session and a table folder and returns a flat DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions import paths as P
from riskloom.functions import sqltext as Q
from riskloom.functions import text as X
from riskloom.model import CANDIDATE_FIELDS, PROOF_FLAGS
from riskloom.operators import context as C
from riskloom.operators import detect as D
from riskloom.operators import evidence as E
from riskloom.operators import findings as R
from riskloom.operators import flows as T
from riskloom.operators import packages as PK
from riskloom.operators import patches as PT
from riskloom.operators import plugins as PL
from riskloom.operators import quota as QU
from riskloom.operators import report as RP
from riskloom.operators import review as V
from riskloom.plans import corpus, modules, rules, zips
from riskloom.plans import scan as S
from riskloom.plans.staging import new_folder, stage
from riskloom.sources import archives as AR
from riskloom.sources import files as SF
from riskloom.sources import scanlog as SL
from riskloom.sources import store as ST
from riskloom.streaming import jobs as J
from riskloom.streaming import quota as SQ
from riskloom.streaming import scans as SS
from riskloom.streaming.arrivals import arrivals

Query = Callable[[SparkSession, str], DataFrame]
c = F.col


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.code_files(spark, sf)


def _joined(col: Column | str) -> Column:
    return F.array_join(col, "|")


def _flat(findings: DataFrame) -> DataFrame:
    return findings.select(
        "repo_id", "id", "rule_id", "category", "status", "severity", F.round("confidence", 4).alias("confidence"), "path", "line_number",
        "evidence", F.size("evidence_refs").alias("n_refs"), *[c(f"proof.{f}").alias(f) for f in PROOF_FLAGS],
        _joined("proof.notes").alias("notes"), "description", "attack_chain", "cvss_score", "cvss_vector", "owasp_cat", "false_positive_risk",
        "ord",
    )


def _evidenced(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    facts = stage(S.file_facts(S.mark_ignored(_files(spark, sf))), "file-facts")
    repos = S.repository_facts(facts)
    return S.evidenced(facts, repos), repos


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return S.scan(_files(spark, sf), staged=True)


# ------------------------------------------------------------------ sources
def repo_risk(spark, sf):
    """The score as one plan from files to verdict, nothing written in between."""
    return S.repository_scores(S.scan(_files(spark, sf)))


def scan_risk(spark, sf):
    # the findings are stored before they are scored, as the score reads them twice
    return S.repository_scores(stage(_findings(spark, sf), "findings"))


def archive_expand(spark, sf):
    """All documents packed in archives and taken out of them again, with the archives that are turned away."""
    files, rejected = AR.expand_archives(stage(zips.document_archives(table(spark, sf, "documents")), "archives"))
    kept = files.select("repo_id", "path", "size", F.md5("content").alias("digest"), F.lit(None).cast("string").alias("error"))
    gone = rejected.select("repo_id", c("member").alias("path"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("digest"), "error")
    return kept.unionByName(gone)


def _sized(spark, sf) -> DataFrame:
    """The corpus with some files in folders that are skipped, and their sizes."""
    files = _files(spark, sf)
    n = F.octet_length("text")
    folder = F.when(n % 7 == 0, "node_modules/").when(n % 11 == 0, "Build/").otherwise("")
    ending = F.when(n % 13 == 0, ".min.js").when(n % 17 == 0, ".md").otherwise("")
    return files.select("repo_id", F.concat(folder, "path", ending).alias("path"), (n * 37).cast("bigint").alias("size"))


def ingest_files(spark, sf):
    """All files to scan, and which repositories are over a budget."""
    return SF.manifest(_sized(spark, sf), max_bytes=2_000_000).select("repo_id", "path", "size", "language", "over_budget")


def ingest_head(spark, sf):
    """The first files of each repository, for a scan of so many files at most."""
    return SF.manifest(_sized(spark, sf), max_files=30, max_bytes=2_000_000).select(
        "repo_id", "path", "size", "language", "file_no", "running_bytes", "over_budget"
    )


def ingest_stats(spark, sf):
    return SF.manifest_stats(_sized(spark, sf))


def page_text(spark, sf):
    """Pages as bytes, decoded, with their path below the host."""
    pages = table(spark, sf, "pages")
    return pages.select(
        "page_id",
        F.length(X.decode(F.encode("html", "UTF-8"))).alias("n_chars"),
        P.relative_to(F.regexp_replace("url", "^https?:/", ""), "/m").alias("rel"),
        P.suffix(F.regexp_extract("url", r"^[^?#]*", 0)).alias("suffix"),
    )


def line_table(spark, sf):
    documents = table(spark, sf, "documents").select(
        c("source").alias("repo_id"), F.concat(F.lit("doc/"), "doc_id", F.lit(".txt")).alias("path"), "text"
    )
    lines = SF.line_table(documents.unionByName(_files(spark, sf)))
    return lines.groupBy("repo_id", "path").agg(
        F.count("*").alias("n_lines"),
        F.count_if(X.is_comment(c("line"))).alias("n_comments"),
        F.count_if(X.is_safe_reference(c("line"))).alias("n_safe"),
        F.sum(F.length(X.evidence_text(c("line")))).alias("n_chars"),
    )


def _packages(spark, sf) -> DataFrame:
    return PK.extract_packages(_files(spark, sf))


def deps_npm(spark, sf):
    return _packages(spark, sf).filter("registry = 'npm'")


def deps_pypi(spark, sf):
    return _packages(spark, sf).filter("registry = 'pypi'")


def deps_all(spark, sf):
    return PK.audit_batch(_packages(spark, sf))


# ------------------------------------------------------------------ detectors
def _candidate_columns(df: DataFrame) -> DataFrame:
    return df.select("repo_id", "path", *[n for n, _ in CANDIDATE_FIELDS])


def detector(key: str) -> Query:
    def run(spark, sf):
        return _candidate_columns(D.candidates(_files(spark, sf), [key]))

    return run


def documents_as_files(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        c("source").alias("repo_id"), F.concat(F.lit("corpus/"), "doc_id", F.lit(".py")).alias("path"), "text"
    )


def det_31_documents(spark, sf):
    return _candidate_columns(D.candidates(documents_as_files(spark, sf), ["DET-31"]))


def detectors_all(spark, sf):
    found = D.candidates(_files(spark, sf))
    return found.groupBy("repo_id", "category", "severity", "status").agg(
        F.count("*").alias("n"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line")
    )


def scan_texts(spark, sf):
    """All detectors over all given texts: documents under six file types, pages as scripts, turns as code."""
    kinds = F.array(*[F.lit(k) for k in (".py", ".js", ".ts", ".json", ".yaml", ".sql")])
    text = F.coalesce("text", F.lit("")).alias("text")
    docs = table(spark, sf, "documents").select(
        c("source").alias("repo_id"), F.concat(F.lit("corpus/"), "doc_id", F.get(kinds, (c("doc_id") % 6).cast("int"))).alias("path"), text
    )
    pages = table(spark, sf, "pages").select(
        F.lit("pages").alias("repo_id"), F.concat(F.lit("web/"), "page_id", F.lit(".js")).alias("path"), F.coalesce("html", F.lit("")).alias("text")
    )
    turns = table(spark, sf, "conversations").select(F.lit("turns").alias("repo_id"), F.concat(F.lit("chat/"), "conv_id", F.lit("-"), "turn", F.lit(".py")).alias("path"), text)
    return _candidate_columns(D.candidates(docs.unionByName(pages).unionByName(turns)))


def route_risk(spark, sf):
    """Route tests on the paths of web pages and of file-based handlers."""
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("page:"), "page_id").alias("source"), F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1).alias("route")
    )
    events = table(spark, sf, "events")
    words = ["admin", "login", "verify", "user/verify", "pay", "health", "token", "public", "account/reset", "internal/x"]
    picked = F.element_at(F.array(*[F.lit(w) for w in words]), (c("event_id") % len(words) + 1).cast("int"))
    made = events.select(
        F.concat(F.lit("event:"), "event_id").alias("source"),
        P.handler_route(F.concat(F.lit("app/api/"), picked, F.lit("/"), c("user_id").cast("string"), F.lit("/route.ts"))).alias("route"),
    )
    method = F.when(F.length("route") % 2 == 0, "POST").otherwise("GET")
    rows = pages.unionByName(made)
    return rows.select(
        "source", "route",
        P.is_high_risk_route(c("route")).alias("high_risk"),
        P.sensitive_class(c("route")).alias("sensitive"),
        P.is_login_target(c("route")).alias("login_target"),
        P.needs_rate_limit(c("route")).alias("needs_limit"),
        P.sensitive_action(c("route"), method, F.lit("missing_rate_limit")).alias("action_limit"),
        P.sensitive_action(c("route"), method, F.lit("missing_auth")).alias("action_auth"),
    )


def coverage_flags(spark, sf):
    return D.repo_flags(_files(spark, sf))


def anti_rls(spark, sf):
    """Created tables without a matching ALTER in the same file, as a relational anti join."""
    files = _files(spark, sf).filter(P.suffix(c("path")) == ".sql")
    made = files.select("repo_id", "path", F.explode(F.expr(Q.match_lines("text", K.CREATE_TABLE))).alias("m")).select(
        "repo_id", "path", F.lower(F.regexp_extract("m.match", K.CREATE_TABLE, 1)).alias("table_name"), "m.line"
    )
    on = files.select(
        "repo_id", "path", F.explode(F.regexp_extract_all("text", F.lit(K.RLS_ALTER), F.lit(1))).alias("t")
    ).select("repo_id", "path", F.lower("t").alias("table_name"))
    bare = made.filter(~c("table_name").isin(*K.SYSTEM_TABLES)).join(on, ["repo_id", "path", "table_name"], "left_anti")
    return bare.groupBy("repo_id", "path", "table_name").agg(F.max("line").alias("line_number"))


# ------------------------------------------------------------------ evidence
def evidence_context(spark, sf):
    """Surroundings of every SQL-injection candidate, by a join on the file row and a slice."""
    files = _files(spark, sf)
    found = D.candidates(files, ["DET-01", "DET-02"]).select("repo_id", "path", "line_number")
    lines = files.select("repo_id", "path", X.split_lines(c("text")).alias("lines"))
    met = found.join(lines, ["repo_id", "path"])
    return met.select(
        "repo_id", "path", "line_number",
        X.frame_text(c("lines"), c("line_number"), K.EVIDENCE_WINDOW, K.EVIDENCE_WINDOW).alias("near"),
        F.size(X.line_frame(c("lines"), c("line_number"), K.FIX_WINDOW, K.FIX_WINDOW)).alias("n_fix_lines"),
        F.left(X.frame_text(c("lines"), c("line_number"), 0, 25), F.lit(K.QUOTE_CHARS)).alias("handler_part"),
    )


def evidence_prefilter(spark, sf):
    files = _files(spark, sf)
    items = D.file_items(files, context=True)
    found = D.candidates_from_items(items, carry=["ctx"])
    notes = E.prefilter_notes()
    return found.select("repo_id", "path", "line_number", "category", "seq", "evidence", _joined(notes).alias("notes"))


def attacker_assignment(spark, sf):
    items = D.file_items(_files(spark, sf), [f"DET-0{i}" for i in range(1, 9)], context=True)
    found = D.candidates_from_items(items, [f"DET-0{i}" for i in range(1, 9)], carry=["ctx"])
    return found.select(
        "repo_id", "path", "line_number", "category",
        F.array_join(F.array_sort(E.interpolated_variables()), "|").alias("variables"),
        E.attacker_assignment().alias("assigned"),
        E.has_interpolation().alias("interpolated"),
        E.has_sanitizer().alias("sanitized"),
    )


def evidence_proof(spark, sf):
    found, _ = _evidenced(spark, sf)
    return found.select("repo_id", "id", "category", "path", "line_number", *[c(f"proof.{f}").alias(f) for f in PROOF_FLAGS], _joined("proof.notes").alias("notes"))


def evidence_status(spark, sf):
    return _flat(_evidenced(spark, sf)[0])


# ------------------------------------------------------------------ repository context
def _contexts(spark, sf) -> DataFrame:
    return C.repo_contexts(C.file_context(S.mark_ignored(_files(spark, sf))))


def repo_frameworks(spark, sf):
    found = C.repo_frameworks(C.file_context(S.mark_ignored(_files(spark, sf))))
    return found.select("repo_id", _joined("frameworks").alias("frameworks"))


def repo_context(spark, sf):
    return _contexts(spark, sf).select(
        "repo_id", "kind", _joined("reasons").alias("reasons"), _joined("local_network_hints").alias("local_network_hints"),
        _joined("public_api_signals").alias("public_api_signals"), "external_exposure_proven", "sensitive_public_surface",
        "app_score", "framework_score", "library_score", "ml_score",
    )


# kinds of the stand-in repositories; the choice is part of the query
_KINDS = ["internal_service", "ml_platform", "library", "framework", "application", "unknown"]
_CATEGORIES = sorted(K.OWASP)


def stand_in(spark, sf) -> DataFrame:
    """Order lines seen as findings: many repositories, all categories, many repeats."""
    lines = table(spark, sf, "lineitem")
    no_text = F.lit("")

    def pick(values: list[str], index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    category = pick(_CATEGORIES, (c("l_partkey") + c("l_suppkey")) % len(_CATEGORIES))
    status = pick(["confirmed", "needs_review", "candidate", "rejected", "needs_review"], (c("l_orderkey") + c("l_linenumber")) % 5)
    severity = pick(K.SEVERITIES, (c("l_partkey") + c("l_linenumber")) % 4)
    path = F.concat(F.lit("Src/p"), (c("l_partkey") % 3).cast("string"), F.lit(".py"))
    line = (c("l_linenumber") % 3).cast("int")
    evidence = F.concat(F.lit("Row   "), "l_returnflag", F.lit(" \t"), "l_linestatus")
    ord_ = (c("l_orderkey") * 10 + c("l_linenumber")).cast("bigint")
    proven = c("l_linestatus") == "O"
    note = F.concat(F.lit("flag "), "l_returnflag")
    ref = F.struct(
        F.lit("literal").alias("kind"), path.alias("file_path"), line.alias("line_start"), line.alias("line_end"),
        F.concat(F.lit("q"), (c("l_suppkey") % 3).cast("string")).alias("quote"),
    )
    text = F.when(c("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("text "), (c("l_partkey") % 7).cast("string")))
    return lines.select(
        F.concat(F.lit("repo-"), (c("l_suppkey") % 40).cast("string")).alias("repo_id"),
        F.concat("l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey").alias("id"),
        category.alias("rule_id"),
        category.alias("category"),
        status.alias("status"),
        severity.alias("severity"),
        F.round(c("l_discount") * 9, 4).alias("confidence"),
        path.alias("path"),
        line.alias("line_number"),
        evidence.alias("evidence"),
        F.array(ref).alias("evidence_refs"),
        F.struct(
            F.lit(True).alias("source_present"), F.lit(True).alias("sink_present"), (c("l_returnflag") != "A").alias("path_present"),
            F.lit(False).alias("sanitizer_present"), proven.alias("attacker_controlled"), proven.alias("exploitability_proven"),
            F.array(note).alias("notes"),
        ).alias("proof"),
        text.alias("description"),
        no_text.alias("attack_chain"),
        F.lit(None).cast("string").alias("fix_code"),
        text.alias("recommendation"),
        F.when(c("l_suppkey") % 2 == 0, text).otherwise("").alias("fix"),
        no_text.alias("fix_source"),
        F.lit(None).cast("double").alias("cvss_score"),
        F.lit(None).cast("string").alias("cvss_vector"),
        F.when(c("l_returnflag") == "R", F.array(F.lit("gemini"), F.lit("reviewer"))).otherwise(F.array().cast("array<string>")).alias("confirmed_by"),
        F.when(c("l_returnflag") == "R", "reviewer").alias("validator"),
        F.lit(None).cast("string").alias("owasp_cat"),
        F.when(c("l_partkey") % 2 == 0, "low").otherwise("medium").alias("false_positive_risk"),
        ord_.alias("ord"),
    )


def context_downgrade(spark, sf):
    number = F.regexp_extract("repo_id", r"(\d+)$", 1).cast("int")
    found = stand_in(spark, sf).withColumns(
        {
            "kind": F.element_at(F.array(*[F.lit(k) for k in _KINDS]), number % len(_KINDS) + 1),
            "external_exposure_proven": number % 4 == 0,
            "sensitive_public_surface": number % 8 == 0,
        }
    )
    out = C.apply_context(found).select(
        "repo_id", "category", "status", "severity", "false_positive_risk", F.round("confidence", 4).alias("confidence"),
        _joined("proof.notes").alias("notes"),
    )
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ findings
def _merged(spark, sf) -> DataFrame:
    """Merged stand-in findings, stored as findings are before reports read them."""
    return stage(R.dedupe(stand_in(spark, sf)), "findings")


def _flat_merged(df: DataFrame) -> DataFrame:
    refs = F.transform("evidence_refs", lambda r: r.quote)
    return df.select(
        "repo_id", "id", "category", "status", "severity", F.round("confidence", 4).alias("confidence"), "path", "line_number", "evidence",
        _joined(refs).alias("quotes"), _joined("proof.notes").alias("notes"), _joined("confirmed_by").alias("confirmed_by"),
        *[c(f"proof.{f}").alias(f) for f in PROOF_FLAGS], "description", "recommendation", "fix", "validator", "false_positive_risk", "ord",
    )


def dedupe_findings(spark, sf):
    return _flat_merged(R.dedupe(stand_in(spark, sf)))


def final_scoring(spark, sf):
    out = R.final_scoring(R.visible(stand_in(spark, sf)))
    return out.select("repo_id", "id", "category", "status", "severity", "cvss_score", "cvss_vector", "attack_chain")


def contradiction_gate(spark, sf):
    out = R.contradiction_gate(stand_in(spark, sf))
    return out.select("repo_id", "id", "category", "status", F.round("confidence", 4).alias("confidence"), _joined("proof.notes").alias("notes"))


def risk_score(spark, sf):
    return R.risk_scores(stand_in(spark, sf))


def saturation_ranks(spark, sf):
    ranked = R.saturation_ranks(_merged(spark, sf))
    return ranked.select("repo_id", "category", "id", c("position").cast("int").alias("position"), F.round("factor", 6).alias("factor"))


def scan_findings(spark, sf):
    return _flat(_findings(spark, sf))


def own_rules(spark, sf):
    """Two plug-ins over whole documents: the findings of both, and the documents on which one fails."""
    files = table(spark, sf, "documents").select(
        F.coalesce("source", F.lit("none")).alias("repo_id"), F.concat(F.lit("d"), "doc_id", F.lit(".yaml")).alias("path"), "text"
    )
    rows = PL.plugin_rows(files, rules.EXAMPLES)
    return rows.groupBy("rule", "path", "error").agg(
        F.count("line_number").alias("n"), F.sum("line_number").cast("bigint").alias("lines"), F.sum(F.length("evidence")).cast("bigint").alias("chars")
    )


# ------------------------------------------------------------------ review
def verify_batches(spark, sf):
    """Conversation turns as findings, six to a request."""
    turns = table(spark, sf, "conversations")
    found = turns.select(
        F.concat(F.lit("conv-"), (c("conv_id") % 20).cast("string")).alias("repo_id"),
        F.concat("conv_id", F.lit(":"), "turn").alias("id"),
        F.when(c("role") == "user", "prompt_injection").when(c("role") == "assistant", "sql_injection").otherwise("weak_jwt").alias("category"),
        F.lit("candidate").alias("status"), F.lit("medium").alias("severity"), F.lit(0.5).alias("confidence"),
        F.concat(F.lit("c/"), "conv_id").alias("path"), c("turn").cast("int").alias("line_number"),
        X.evidence_text(c("text")).alias("evidence"), c("turn").cast("bigint").alias("ord"),
        F.array().cast("array<string>").alias("evidence_refs"), F.lit(None).cast("string").alias("proof"), F.lit("").alias("description"),
    )
    batches = V.verify_batches(found)
    parsed = F.from_json("payload", "findings array<struct<id:string,category:string,required_elements:array<string>>>")
    return batches.select(
        "repo_id", "batch", "n",
        _joined(F.transform(parsed.findings, lambda f: f.id)).alias("ids"),
        _joined(F.transform(parsed.findings, lambda f: F.array_join(f.required_elements, "+"))).alias("required"),
    )


def fix_payloads(spark, sf):
    """The confirmed findings of a scan as they go out for fixes, with the lines around them."""
    batches = V.fix_batches(stage(_findings(spark, sf), "findings"), _files(spark, sf))
    parsed = F.from_json("payload", "findings array<struct<id:string,file_path:string,line_number:int,context:array<struct<line_number:int,code:string>>>>")
    return batches.select("repo_id", "batch", F.explode(parsed.findings).alias("f")).select(
        "repo_id", "batch", "f.id", c("f.file_path").alias("path"), c("f.line_number").alias("line_number"),
        F.size("f.context").cast("bigint").alias("n_lines"), F.get(c("f.context"), 0)["line_number"].alias("first_line"),
        F.array_join(F.transform("f.context", lambda x: x.code), "\n").alias("code"),
    )


def fix_batches(spark, sf):
    no_files = spark.createDataFrame([], "repo_id string, path string, text string")
    batches = V.fix_batches(_merged(spark, sf), no_files)
    parsed = F.from_json("payload", "findings array<struct<id:string>>")
    return batches.select("repo_id", "batch", "n", _joined(F.transform(parsed.findings, lambda f: f.id)).alias("ids"))


def _labelled(spark, sf) -> DataFrame:
    """Documents as findings."""
    docs = table(spark, sf, "documents")
    n = c("doc_id")
    flags = [(n % k == 0).alias(f) for f, k in zip(PROOF_FLAGS, (2, 3, 5, 7, 2, 3), strict=True)]
    return docs.select(
        c("source").alias("repo_id"), F.concat(F.lit("f"), "doc_id").alias("id"),
        F.when(n % 3 == 0, "sql_injection").otherwise("weak_jwt").alias("category"),
        F.when(n % 4 == 0, "rejected").when(n % 4 == 1, "confirmed").when(n % 4 == 2, "candidate").otherwise("needs_review").alias("status"),
        F.lit("high").alias("severity"), F.round((n % 100) / 100, 4).alias("confidence"), F.concat("lang", F.lit("/a.py")).alias("path"),
        F.lit(1).alias("line_number"), c("text").alias("evidence"),
        F.struct(*flags, F.array().cast("array<string>").alias("notes")).alias("proof"),
        F.array(F.lit("x")).alias("evidence_refs"), F.lit("").alias("attack_chain"), F.lit(None).cast("string").alias("fix_code"),
        F.lit("").alias("recommendation"), F.lit("").alias("fix"), F.lit("").alias("fix_source"),
        F.array().cast("array<string>").alias("confirmed_by"), F.lit(None).cast("string").alias("validator"),
    )


def _verdicts(spark, sf) -> DataFrame:
    labels = table(spark, sf, "labels")
    proof = F.struct(
        *[
            (F.lit(True) if f == "source_present" else (c("toxic") == 0) if f == "exploitability_proven" else F.lit(None).cast("boolean")).alias(f)
            for f in PROOF_FLAGS
        ]
    )
    verdict = F.when(c("quality") == 1, "confirmed").when(c("toxic") == 1, "odd").otherwise("rejected")
    return labels.select(
        F.concat(F.lit("f"), "doc_id").alias("id"), verdict.alias("verdict"), ((c("quality") * 3 + c("toxic")) / 4).alias("confidence"),
        proof.alias("proof"), F.concat(F.lit("scenario "), "doc_id").alias("attack_scenario"), F.lit("").alias("rationale"),
    )


def verdict_merge(spark, sf):
    merged = R.contradiction_gate(V.merge_verdicts(_labelled(spark, sf), _verdicts(spark, sf)))
    return merged.select(
        "repo_id", "id", "status", F.round("confidence", 4).alias("confidence"), *[c(f"proof.{f}").alias(f) for f in PROOF_FLAGS],
        "validator", _joined("confirmed_by").alias("confirmed_by"), "attack_chain",
    )


def models_used(spark, sf):
    merged = V.merge_verdicts(_labelled(spark, sf), _verdicts(spark, sf))
    return V.models_used(merged).select("repo_id", _joined("models_used").alias("models_used"))


def package_verdicts(spark, sf) -> DataFrame:
    """Registry facts for the packages that occur, decided by their names."""
    names = _packages(spark, sf).select("registry", "package").distinct()
    size = F.length("package")
    return names.select(
        "registry", "package", F.when(size % 3 == 0, "not_found").when(size % 3 == 1, "suspicious").otherwise("ok").alias("verdict"),
        F.round((size % 10) / 10 + 0.05, 4).alias("confidence"), F.concat(F.lit("length "), size).alias("reason"),
    )


def _audit(spark, sf) -> DataFrame:
    return PK.audit_findings(_packages(spark, sf), package_verdicts(spark, sf))


def package_audit(spark, sf):
    return _audit(spark, sf).select(
        "repo_id", "category", "status", "severity", "confidence", "path", "line_number", "evidence", _joined("confirmed_by").alias("confirmed_by"),
        "validator", "false_positive_risk", "description",
    )


def det_33(spark, sf):
    """Package findings join the others after the evidence step; final scoring included."""
    out = R.final_scoring(R.visible(R.dedupe(_audit(spark, sf))))
    return out.select("repo_id", "path", "line_number", "category", "status", "severity", "cvss_score", "evidence")


def _fixes(spark, sf) -> DataFrame:
    n = c("doc_id")
    docs = table(spark, sf, "documents")
    return docs.select(
        F.concat(F.lit("f"), "doc_id").alias("id"), F.when(n % 3 == 0, "cannot_fix").otherwise("patch_ready").alias("status"), F.lit(0.5).alias("confidence"),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("--- a/"), "lang", F.lit("/a.py\n+++ b/"), "lang", F.lit("/a.py\n@@ -1 +1 @@\n"))).alias("patch"),
        F.when(n % 7 == 0, " ").otherwise(" do it ").alias("recommendation"), F.when(n % 11 == 0, "").otherwise("because").alias("explanation"),
        F.when(n % 13 != 0, n % 9 != 0).alias("accepted"), F.when(n % 9 == 0, F.array(F.lit("no"), F.lit("never"))).alias("reasons"),
    )


def fix_merge(spark, sf):
    merged = V.merge_fixes(_labelled(spark, sf), _fixes(spark, sf))
    return merged.select("repo_id", "id", "status", "fix_code", "recommendation", "fix", "fix_source", _joined("proof.notes").alias("notes"))


def remediation(spark, sf):
    out = V.remediate(stand_in(spark, sf))
    cols = ["category", "status", "recommendation", "fix", "fix_source"]
    return out.groupBy(*cols).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ report
def report_counts(spark, sf):
    counts = RP.finding_counts(stand_in(spark, sf))
    return counts.join(risk_score(spark, sf).select("repo_id", "risk_score"), "repo_id").withColumn("summary", RP.summary(c("risk_score")))


def report_order(spark, sf):
    return RP.ordered(R.visible(_merged(spark, sf))).select("repo_id", "id", "severity", "status", c("place").cast("int").alias("place"))


def report_order_stored(spark, sf):
    return RP.ordered(RP.by_severity(_merged(spark, sf), "HIGH"), stored=True).select("repo_id", "id", "severity", c("place").cast("int").alias("place"))


def _scans(spark, sf) -> DataFrame:
    """Suppliers as scans."""
    n = c("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("repo-"), n.cast("string")).alias("scan_id"), c("s_name").alias("repo_url"),
        F.when(n % 5 == 0, "running").otherwise("complete").alias("status"), (n % 101).cast("int").alias("risk_score"),
        F.when(n % 3 == 0, F.lit(None)).otherwise("HIGH").alias("verdict"), F.lit("2024-01-31T00:00:00Z").alias("scanned_at"),
        F.array().cast("array<string>").alias("frameworks"), n.cast("int").alias("files_scanned"), (n * 100).cast("int").alias("scan_ms"),
        F.array().cast("array<string>").alias("models_used"),
    )


def _stored(spark, sf) -> DataFrame:
    return _merged(spark, sf).withColumn("scan_id", c("repo_id"))


def report_json(spark, sf):
    scans = _scans(spark, sf)
    contexts = scans.select("scan_id", F.when(c("files_scanned") % 2 == 0, "library").otherwise("application").alias("kind"))
    reports = RP.report_json(scans, _stored(spark, sf), page=100, contexts=contexts, share_base="https://reports.example/r/")
    shape = (
        "scan_id string, risk_score int, verdict string, summary string, highest_severity string, "
        "finding_counts struct<critical:bigint,high:bigint,medium:bigint,low:bigint,total:bigint>, findings array<struct<id:string,confidence:double,rule_id:string,file_path:string,fix_source:string,cvss_vector:string>>, "
        "repo_context struct<kind:string>, share_url string"
    )
    r = reports.select("page", F.from_json("report", shape).alias("r")).select("page", "r.*")
    return r.select(
        "scan_id", "page", "risk_score", "verdict", "summary", "highest_severity", "finding_counts.critical", "finding_counts.total",
        F.get(c("findings"), 0)["id"].alias("first_id"), F.size("findings").cast("bigint").alias("n_findings"),
        F.get(c("findings"), 0)["file_path"].alias("first_path"), c("repo_context.kind").alias("kind"), "share_url",
    )


def report_overview(spark, sf):
    return RP.report_overview(_scans(spark, sf), _stored(spark, sf))


def scan_status(spark, sf):
    return RP.scan_status(_scans(spark, sf), _stored(spark, sf)).select("scan_id", "status", "risk_score", "verdict", "files_scanned", "findings_count")


def report_view(spark, sf):
    view = RP.report_view(R.final_scoring(R.visible(R.dedupe(stand_in(spark, sf)))))
    seats = F.array_join(
        F.transform(F.array_sort(F.map_entries("consensus")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), "|"
    )
    return view.withColumns({"consensus": seats, "confirmed_by": _joined("confirmed_by")})


# ------------------------------------------------------------------ store
def scan_store(spark, sf):
    """Findings of an older generation (fewer columns) go into a store, some scans are deleted with their
    findings, and some others are stored again."""
    folder = new_folder(spark, "scan-store")
    old = _stored(spark, sf).drop("proof", "recommendation", "fix", "fix_source", "evidence_refs")
    scans = _scans(spark, sf).drop("scanned_at")
    SL.commit(spark, folder, old, scans)
    running = scans.filter("status = 'running'")
    SL.commit(spark, folder, deleted=running)
    again = scans.filter(c("files_scanned") % 7 == 0)
    SL.commit(spark, folder, SL.findings(spark, folder).join(again, "scan_id", "left_semi"))
    SL.compact(spark, folder)
    kept = SL.findings(spark, folder)
    return kept.groupBy("scan_id", "severity", "status", "fix_source", "false_positive_risk").agg(
        F.count("*").alias("n"), F.sum(F.size("evidence_refs")).alias("refs"), F.count("proof").alias("proofs")
    )


def scan_headers(spark, sf):
    """Whole scans of all repositories, stored with their findings and read back."""
    # files are made once, and their texts are read once for findings and contexts
    files = stage(_files(spark, sf).withColumn("size", F.octet_length("text").cast("bigint")), "files")
    folder = new_folder(spark, "scan-headers")
    counted = SF.manifest(files, None).groupBy("repo_id").agg(F.count("*").alias("files_scanned"))
    facts = stage(S.file_facts(S.mark_ignored(files.drop("size"))), "file-facts")
    found = stage(S.scan_facts(facts), "findings")
    heads = ST.scan_headers(S.repository_scores(found), C.repo_contexts(facts), counted, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    heads = stage(heads, "heads")
    SL.commit(spark, folder, found.join(heads.select("scan_id", c("repo_url").alias("repo_id")), "repo_id"), heads)
    n = SL.findings(spark, folder).groupBy("scan_id").agg(F.count("*").alias("n_stored"))
    return SL.scans(spark, folder).join(n, "scan_id", "left").select(
        "repo_url", "status", "risk_score", "verdict", "files_scanned", _joined("frameworks").alias("frameworks"), "repo_context.kind",
        F.coalesce("n_stored", F.lit(0)).alias("n_stored"),
    )


def _sign_ups(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id", F.lit("@example.org")).alias("email"), c("ts").cast("timestamp").alias("ts"),
        c("event_type").alias("source"), F.concat(F.lit("10.0.0."), c("event_id") % 250).alias("ip"),
    )


def keyed_upsert(spark, sf):
    out = ST.keyed_upsert(_sign_ups(spark, sf), "email", "ts", ["source", "ip"], {"last_source": "source"})
    return out.withColumns({"created_at": F.unix_micros("created_at"), "last_seen_at": F.unix_micros("last_seen_at")})


def retention(spark, sf):
    events = _quota_events(spark, sf)
    last = events.agg(F.max("ts")).scalar()
    return QU.retained(events, last).select("event_id", "key", "endpoint")


# ------------------------------------------------------------------ quota
def _quota_events(spark, sf) -> DataFrame:
    endpoint = F.when(c("event_type") == "signup", "waitlist").when(c("event_type") == "error", "contact").when(c("event_type") == "view", "free").otherwise("scan/github")
    # ten callers, so that the limits matter
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("10.0.0."), c("user_id") % 10).alias("key"), endpoint.alias("endpoint"), c("ts").cast("timestamp").alias("ts")
    )


def quota_attempts(spark, sf):
    return QU.attempts_in_window(_quota_events(spark, sf))


def quota_admissions(spark, sf):
    return QU.admissions(_quota_events(spark, sf))


def quota_decisions(spark, sf):
    events = _quota_events(spark, sf)
    return QU.decisions(events, QU.admissions(events)).select("event_id", "key", "endpoint", "allowed")


def stream_quota(spark, sf):
    """The same verdicts from a stream: events arrive in four slices, each taken in by a run that goes
    on from the state of the one before, and a row without endpoint closes the last window."""
    events, folder = _quota_events(spark, sf), new_folder(spark, "stream-quota")
    for stream in arrivals(events, c("ts"), f"{folder}/events"):
        SQ.run(stream, folder)
    end = events.agg(F.max("ts").alias("ts")).select(
        *[F.lit(None).cast(events.schema[n].dataType).alias(n) for n in ("event_id", "key", "endpoint")], (c("ts") + F.expr("INTERVAL 2 HOURS")).alias("ts")
    )
    end.write.mode("append").parquet(f"{folder}/events")
    return SQ.run(stream, folder)[0].drop("batch")


def _status_events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("scan-"), "user_id").alias("scan_id"),
        F.when(c("event_type") == "error", "failed").when(c("event_type") == "purchase", "complete").when(c("event_type") == "click", "running").otherwise("queued").alias("status"),
        F.when(c("event_type") == "error", F.concat(F.lit("code "), "event_id")).alias("error_message"),
        c("ts").cast("timestamp").alias("ts"), c("event_id").alias("seq"),
    )


def stream_status(spark, sf):
    """Status events arrive in four slices; the table holds the last state of each scan."""
    folder = new_folder(spark, "stream-status")
    for stream in arrivals(_status_events(spark, sf), c("ts"), f"{folder}/events"):
        J.keep_status(stream, folder)
    return J.status_now(spark, folder).drop("seq").withColumn("updated_at", F.unix_micros("updated_at"))


def _arriving_files(spark, sf, parts: int) -> DataFrame:
    """The corpus arrives in slices that cut through every repository."""
    folder = new_folder(spark, "stream-scan")
    files = _files(spark, sf)
    place = F.pmod(F.xxhash64("repo_id", "path"), F.lit(1000))
    for stream in arrivals(files, place, f"{folder}/files", parts):
        found = SS.run(stream, folder)
    return found


def stream_scan(spark, sf):
    return _flat(_arriving_files(spark, sf, 3))


def stream_risk(spark, sf):
    return S.repository_scores(_arriving_files(spark, sf, 2))


def stream_upsert(spark, sf):
    """Sign-ups arrive in ten slices, each one batch of a keyed table."""
    folder, how = new_folder(spark, "stream-upsert"), ("email", "ts", ["source", "ip"], {"last_source": "source"})
    events = _sign_ups(spark, sf)
    for stream in arrivals(events, c("ts"), f"{folder}/events", parts=10):
        J.each_batch(stream, J.upsert_batch(f"{folder}/table", *how, every=4), f"{folder}/state").start().awaitTermination()
    schema = ST.keyed_upsert(events, *how).schema
    out = J.upserted(spark, f"{folder}/table", schema, how[0], *how[2:])
    return out.withColumns({"created_at": F.unix_micros("created_at"), "last_seen_at": F.unix_micros("last_seen_at")})


# ------------------------------------------------------------------ Python modules
def taint_flows(spark, sf):
    flows = T.taint_flows(modules.python_modules(spark, sf))
    kinds = F.array_join(F.transform("refs", lambda r: r.kind), "|")
    return flows.select("repo_id", "path", "category", "line", "confidence", "sanitized", kinds.alias("kinds"))


def taint_join(spark, sf):
    files = modules.python_modules(spark, sf)
    found = D.candidates(files, ["DET-01", "DET-03", "DET-05"]).select("repo_id", "path", "line_number", "category", "severity")
    joined = T.join_flows(found, T.taint_flows(files))
    return joined.select("repo_id", "path", "line_number", "category", "flow_confidence", "flow_sanitized")


def code_index(spark, sf):
    index = T.code_index(modules.python_modules(spark, sf).unionByName(_files(spark, sf)))
    return index.select("repo_id", "path", "language", F.coalesce(F.size("flows"), F.lit(0)).alias("n_flows"))


def py_routes(spark, sf):
    return T.python_routes(modules.python_modules(spark, sf)).select("repo_id", "path", "route", "method", "line", "guarded")


def det_09(spark, sf):
    return _candidate_columns(D.candidates(modules.python_modules(spark, sf), ["DET-09"]))


def syntax_check(spark, sf):
    files = modules.python_modules(spark, sf).unionByName(_files(spark, sf))
    return T.syntax_check(files).select("repo_id", "path", "ok")


def module_scan(spark, sf):
    """Findings of files that parse: data flows decide."""
    return S.scan(modules.python_modules(spark, sf), staged=True).select(
        "repo_id", "path", "line_number", "category", "status", "severity", F.round("confidence", 4).alias("confidence"), F.size("evidence_refs").alias("n_refs")
    )


def patch_apply(spark, sf):
    files, fixes = modules.python_modules(spark, sf), modules.patches(spark, sf)
    done = PT.apply_patches(fixes, files)
    return done.select("id", "repo_id", "path", "ok", F.length("text").alias("n_chars"), "error")


def fix_verify(spark, sf):
    files, fixes = modules.python_modules(spark, sf), modules.patches(spark, sf)
    return PT.verify_fixes(fixes, files).select("id", "accepted", _joined("reasons").alias("reasons"))


# ------------------------------------------------------------------ requests
def validate_requests(spark, sf):
    """Addresses, repository URLs and patch texts as users send them."""
    pages = table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), c("url").alias("value"))
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.when(c("doc_id") % 4 == 0, F.concat(F.lit("https://github.com/"), "source", F.lit("/"), "lang", F.lit(".git/tree")))
        .when(c("doc_id") % 4 == 1, F.concat(F.lit(" github.com/"), "source", F.lit("/r.x/ ")))
        .when(c("doc_id") % 4 == 2, F.concat("source", F.lit("@"), "lang", F.lit(".org")))
        .otherwise(F.regexp_extract("text", r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", 0)).alias("value"),
    )
    v = c("value")
    owner = P.owner_and_repo(v)
    return pages.unionByName(docs).select(
        "id", owner.owner.alias("owner"), owner.repo.alias("repo"), P.normalise_repo(v).alias("canonical"),
        X.matches(v, K.EMAIL).alias("is_email"), V.plausible_patch(F.when(F.length(v) % 2 == 0, F.concat(v, F.lit("\n@@ -1 +1 @@"))).otherwise(v), F.regexp_extract(v, r"[^/]+$", 0)).alias("patch_like"),
        (F.hex(F.substring(v.cast("binary"), 1, 4)) == K.ZIP_MAGIC_HEX).alias("is_zip"),
    )


QUERIES: dict[str, Query] = {
    "repo_risk": repo_risk,
    "scan_risk": scan_risk,
    "ingest_files": ingest_files,
    "ingest_head": ingest_head,
    "ingest_stats": ingest_stats,
    "page_text": page_text,
    "line_table": line_table,
    "deps_npm": deps_npm,
    "deps_pypi": deps_pypi,
    "deps_all": deps_all,
    **{f"det_{k[-2:]}": detector(k) for k in D.DETECTOR_KEYS if k != "DET-09"},
    "det_09": det_09,
    "det_31_documents": det_31_documents,
    "det_33": det_33,
    "detectors_all": detectors_all,
    "route_risk": route_risk,
    "coverage_flags": coverage_flags,
    "anti_rls": anti_rls,
    "evidence_context": evidence_context,
    "evidence_prefilter": evidence_prefilter,
    "attacker_assignment": attacker_assignment,
    "evidence_proof": evidence_proof,
    "evidence_status": evidence_status,
    "repo_frameworks": repo_frameworks,
    "repo_context": repo_context,
    "context_downgrade": context_downgrade,
    "dedupe_findings": dedupe_findings,
    "contradiction_gate": contradiction_gate,
    "final_scoring": final_scoring,
    "risk_score": risk_score,
    "saturation_ranks": saturation_ranks,
    "scan_findings": scan_findings,
    "own_rules": own_rules,
    "archive_expand": archive_expand,
    "scan_texts": scan_texts,
    "verify_batches": verify_batches,
    "fix_batches": fix_batches,
    "fix_payloads": fix_payloads,
    "verdict_merge": verdict_merge,
    "models_used": models_used,
    "package_audit": package_audit,
    "fix_merge": fix_merge,
    "remediation": remediation,
    "report_counts": report_counts,
    "report_order": report_order,
    "report_order_stored": report_order_stored,
    "report_json": report_json,
    "report_overview": report_overview,
    "report_view": report_view,
    "scan_status": scan_status,
    "scan_store": scan_store,
    "scan_headers": scan_headers,
    "keyed_upsert": keyed_upsert,
    "retention": retention,
    "quota_attempts": quota_attempts,
    "quota_admissions": quota_admissions,
    "quota_decisions": quota_decisions,
    "stream_quota": stream_quota,
    "stream_status": stream_status,
    "stream_scan": stream_scan,
    "stream_risk": stream_risk,
    "stream_upsert": stream_upsert,
    "taint_flows": taint_flows,
    "taint_join": taint_join,
    "code_index": code_index,
    "py_routes": py_routes,
    "syntax_check": syntax_check,
    "module_scan": module_scan,
    "patch_apply": patch_apply,
    "fix_verify": fix_verify,
    "validate_requests": validate_requests,
}
