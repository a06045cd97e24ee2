"""Checking SQL per query key, for DuckDB over the same tables."""

from __future__ import annotations

from oracle import base as B
from oracle.base import NL, has, pick, q, rx, words
from riskloom.functions import fixed as K
from riskloom.functions.prose import TEXTS
from riskloom.plans.queries import _CATEGORIES, _KINDS


def _with(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


FILES = [*B.corpus_ctes(), *B.file_ctes()]
NORM = "lower(trim(regexp_replace(evidence, '\\s+', ' ', 'g')))"
PROOF = ", ".join(B.PROOF)


def _detector(key: str) -> str:
    return _with([*FILES, *B.candidate_ctes([key])], f"SELECT {B.COLUMNS} FROM cand")


def _evidenced(keys=None) -> list[str]:
    return [*FILES, *B.candidate_ctes(keys), *B.context_ctes(), *B.evidence_ctes()]


def _scan(keys=None) -> list[str]:
    return [
        *_evidenced(keys),
        *B.downgrade("evidenced", "adjusted"),
        f"""merged AS (SELECT *, '' AS attack_chain FROM adjusted
            QUALIFY row_number() OVER (PARTITION BY repo_id, category, path, line_number, {NORM} ORDER BY ord) = 1)""",
        *B.final("(SELECT * FROM merged WHERE status <> 'rejected')", "scanned"),
    ]


def _scan_score(keys=None) -> str:
    return _with([*_scan(keys), *B.scored("scanned")], f"SELECT repo_id, risk_score, n_findings, {B.VERDICT} AS verdict FROM scored")


FLAT = f"repo_id, id, rule_id, category, status, severity, round(confidence, 4) AS confidence, path, line_number, evidence, n_refs, {PROOF}, array_to_string(note_list, '|') AS notes, description"

# ------------------------------------------------------------------ sources
SIZED = [
    *B.corpus_ctes(),
    """sized AS (SELECT repo_id, CASE WHEN n % 7 = 0 THEN 'node_modules/' WHEN n % 11 = 0 THEN 'Build/' ELSE '' END || path
        || CASE WHEN n % 13 = 0 THEN '.min.js' WHEN n % 17 = 0 THEN '.md' ELSE '' END AS path, n * 37 AS size
        FROM (SELECT *, octet_length(encode(text)) AS n FROM code))""",
    f"""listed AS (SELECT repo_id, path, size, row_number() OVER (PARTITION BY repo_id ORDER BY lower(path), path) AS file_no FROM sized
        WHERE NOT {B.ignored('path', 'size')})""",
    """kept AS (SELECT *, CAST(sum(size) OVER (PARTITION BY repo_id ORDER BY file_no) AS BIGINT) AS running_bytes FROM listed WHERE file_no <= 30)""",
]


def _packages() -> list[str]:
    stripped = B.strip("line")
    section = " UNION ALL ".join(
        f"""SELECT repo_id, path, 'npm' AS registry, {i} AS sec, unnest(json_keys(text, '$.{s}')) AS package,
            generate_subscripts(json_keys(text, '$.{s}'), 1) AS k, lines FROM named WHERE name = 'package.json'"""
        for i, s in enumerate(K.PACKAGE_SECTIONS)
    )
    at = "list_position(list_transform(lines, lambda l: contains(l, '\"' || package || '\"')), true)"
    return [
        *B.corpus_ctes(),
        B.file_ctes()[0],
        f"npm_keys AS ({section})",
        f"""npm AS (SELECT repo_id, path, registry, package, row_number() OVER (PARTITION BY repo_id, path ORDER BY sec, k) - 1 AS pos,
            greatest(coalesce({at}, 0), 1) AS line_number,
            CASE WHEN {at} > 0 THEN left({B.strip(f'list_extract(lines, {at})')}, {K.QUOTE_CHARS}) ELSE '"' || package || '"' END AS quote FROM npm_keys)""",
        "raw_line AS (SELECT repo_id, path, name, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_number FROM named)",
        f"""pip AS (SELECT repo_id, path, 'pypi' AS registry, {B.strip(f'list_extract(string_split_regex({stripped}, {q(K.REQUIREMENT_SPLIT)}), 1)')} AS package,
            line_number AS pos, line_number, left({stripped}, {K.QUOTE_CHARS}) AS quote FROM raw_line
            WHERE name IN ('requirements.txt', 'requirements-dev.txt') AND {stripped} <> '' AND NOT starts_with({stripped}, '#'))""",
        f"""toml AS (SELECT repo_id, path, 'pypi' AS registry, regexp_extract(line, {q(K.PYPROJECT_LINE)}, 1) AS package, line_number AS pos, line_number,
            left({stripped}, {K.QUOTE_CHARS}) AS quote FROM raw_line WHERE name = 'pyproject.toml' AND {rx('line', K.PYPROJECT_LINE)})""",
        """record AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY pos) - 1 AS nth FROM
            (SELECT * FROM npm UNION ALL SELECT * FROM pip WHERE package <> '' UNION ALL SELECT * FROM toml))""",
        """package AS (SELECT repo_id, path, registry, package, CAST(max_by(line_number, nth) AS INTEGER) AS line_number, max_by(quote, nth) AS quote,
            CAST(min(nth) AS INTEGER) AS pos FROM record GROUP BY repo_id, path, registry, package)""",
    ]


AUDIT = [
    *_packages(),
    """facts AS (SELECT DISTINCT registry, package, CASE WHEN length(package) % 3 = 0 THEN 'not_found' WHEN length(package) % 3 = 1 THEN 'suspicious' ELSE 'ok' END AS verdict,
        round((length(package) % 10) / 10 + 0.05, 4) AS confidence, 'length ' || length(package) AS reason FROM package)""",
    f"""audit AS (SELECT repo_id, 'slopsquatting' AS category, CASE WHEN confidence >= {K.PACKAGE_CONFIRM_AT} THEN 'confirmed' ELSE 'needs_review' END AS status,
        CASE WHEN verdict = 'not_found' THEN 'critical' ELSE 'high' END AS severity, confidence, path, line_number, quote AS evidence,
        CASE WHEN confidence >= {K.PACKAGE_CONFIRM_AT} THEN 'package-audit' ELSE '' END AS confirmed_by, 'package-audit' AS validator,
        CASE WHEN verdict = 'not_found' THEN 'low' ELSE 'medium' END AS false_positive_risk,
        {q(TEXTS['slopsquatting'][0])} || ' [' || package || ': ' || verdict || ', ' || reason || ']' AS description, '' AS attack_chain, false AS exploitability_proven
        FROM package JOIN facts USING (registry, package) WHERE verdict <> 'ok'
        QUALIFY row_number() OVER (PARTITION BY repo_id, registry, package ORDER BY lower(path) DESC, path DESC, line_number DESC) = 1)""",
]

# ------------------------------------------------------------------ stand-in findings
_CAT = pick(_CATEGORIES, f"(l_partkey + l_suppkey) % {len(_CATEGORIES)}")
STAND_IN = [
    f"""stand AS (SELECT 'repo-' || (l_suppkey % 40) AS repo_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, {_CAT} AS category,
        {pick(['confirmed', 'needs_review', 'candidate', 'rejected', 'needs_review'], '(l_orderkey + l_linenumber) % 5')} AS status,
        {pick(K.SEVERITIES, '(l_partkey + l_linenumber) % 4')} AS severity, round(l_discount * 9, 4) AS confidence, 'Src/p' || (l_partkey % 3) || '.py' AS path,
        CAST(l_linenumber % 3 AS INTEGER) AS line_number, 'Row   ' || l_returnflag || ' ' || chr(9) || l_linestatus AS evidence, 'q' || (l_suppkey % 3) AS quote,
        l_returnflag <> 'A' AS path_present, l_linestatus = 'O' AS exploitability_proven, ['flag ' || l_returnflag] AS note_list,
        CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'text ' || (l_partkey % 7) END AS description,
        CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 3 <> 0 THEN 'text ' || (l_partkey % 7) ELSE '' END AS fix,
        CASE WHEN l_returnflag = 'R' THEN ['gemini', 'reviewer'] ELSE CAST([] AS VARCHAR[]) END AS confirmed_list,
        CASE WHEN l_returnflag = 'R' THEN 'reviewer' END AS validator, CASE WHEN l_partkey % 2 = 0 THEN 'low' ELSE 'medium' END AS false_positive_risk,
        CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord, '' AS attack_chain FROM lineitem)""",
]
_KEY = f"repo_id, category, path, line_number, {NORM}"



def _ordered(name: str, expr: str) -> list[str]:
    """CTE ``name`` (key, vals): distinct values per key by the first row that has them.

    Rows are put in the order (ord, id) and values of one row in their own order.
    """
    return [
        f"""{name}_x AS (SELECT kid, ord, id, unnest({expr}) AS v, generate_subscripts({expr}, 1) AS p FROM keyed)""",
        f"""{name}_f AS (SELECT kid, v, min((ord, id, p)) AS first FROM {name}_x GROUP BY kid, v)""",
        f"""{name} AS (SELECT kid, array_to_string(list(v ORDER BY first), '|') AS {name} FROM {name}_f GROUP BY kid)""",
    ]


MERGED = [
    *STAND_IN,
    f"keyed AS (SELECT *, md5(concat_ws(chr(1), repo_id, category, path, line_number, {NORM})) AS kid FROM stand)",
    *_ordered("quotes", "[quote]"),
    *_ordered("notes", "note_list"),
    *_ordered("confirmed_by", "confirmed_list"),
    f"""heads AS (SELECT kid, repo_id, category, path, line_number, id, evidence, false_positive_risk, ord FROM keyed
        QUALIFY row_number() OVER (PARTITION BY kid ORDER BY ord, id) = 1)""",
    f"""sums AS (SELECT kid, max({B.SEV}) AS sev, max({B.STA}) AS sta, max(confidence) AS confidence, bool_or(path_present) AS path_present,
        bool_or(exploitability_proven) AS exploitability_proven,
        coalesce(first(description ORDER BY ord, description) FILTER (description <> ''), '') AS description,
        coalesce(first(fix ORDER BY ord, fix) FILTER (fix <> ''), '') AS fix, first(validator ORDER BY ord, validator) FILTER (validator <> '') AS validator
        FROM keyed GROUP BY kid)""",
    f"""deduped AS (SELECT h.*, {pick(K.STATUSES, 'sta')} AS status, {pick(K.SEVERITIES, 'sev')} AS severity, confidence, quotes, notes, coalesce(confirmed_by, '') AS confirmed_by,
        true AS source_present, true AS sink_present, path_present, false AS sanitizer_present, exploitability_proven AS attacker_controlled, exploitability_proven,
        description, description AS recommendation, fix, validator, '' AS attack_chain
        FROM heads h JOIN sums USING (kid) JOIN quotes USING (kid) JOIN notes USING (kid) LEFT JOIN confirmed_by USING (kid))""",
]
SCANS = """scans AS (SELECT 'repo-' || s_suppkey AS scan_id, CASE WHEN s_suppkey % 5 = 0 THEN 'running' ELSE 'complete' END AS status, CAST(s_suppkey % 101 AS INTEGER) AS risk_score,
    CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'HIGH' END AS verdict, CAST(s_suppkey AS INTEGER) AS files_scanned FROM supplier)"""


def _counts(source: str, key: str) -> str:
    per = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in reversed(K.SEVERITIES))
    return f"SELECT {key}, {per}, count(*) AS total, {pick(K.SEVERITIES, f'max({B.SEV})')} AS highest_severity FROM {source} GROUP BY {key}"


SUMMARY = (
    "CASE WHEN total = 0 THEN 'No weaknesses were found. Scan again after every larger change.' ELSE 'Found ' || total || "
    "CASE WHEN total = 1 THEN ' weakness (' ELSE ' weaknesses (' END || CASE WHEN critical + high + medium + low > 0 THEN "
    "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {s} > 0 THEN {s} || ' {s}' END" for s in reversed(K.SEVERITIES)) + "], lambda x: x IS NOT NULL), ', ') "
    "ELSE 'low-severity' END || '), risk score ' || risk_score || '/100. ' || CASE WHEN critical + high > 0 THEN "
    "'Repair the critical and high ones before the next release.' ELSE 'Repair them to strengthen the code.' END END"
)

# ------------------------------------------------------------------ documents as findings
_N = "doc_id"
LABELLED = [
    """lab AS (SELECT source AS repo_id, 'f' || doc_id AS id, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'sql_injection' ELSE 'weak_jwt' END AS category,
        CASE doc_id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'candidate' ELSE 'needs_review' END AS status,
        round((doc_id % 100) / 100, 4) AS confidence, lang || '/a.py' AS path, doc_id % 2 = 0 AS source_present, doc_id % 3 = 0 AS sink_present, doc_id % 5 = 0 AS path_present,
        doc_id % 7 = 0 AS sanitizer_present, doc_id % 2 = 0 AS attacker_controlled, doc_id % 3 = 0 AS exploitability_proven FROM documents)""",
    """ver AS (SELECT 'f' || doc_id AS id, CASE WHEN quality = 1 THEN 'confirmed' WHEN toxic = 1 THEN 'odd' ELSE 'rejected' END AS verdict,
        (quality * 3 + toxic) / 4 AS v_confidence, toxic = 0 AS v_proven, 'scenario ' || doc_id AS scenario FROM labels)""",
    """met AS (SELECT lab.*, ver.* EXCLUDE (id), ver.id IS NOT NULL AND status <> 'rejected' AS known FROM lab LEFT JOIN ver USING (id))""",
    """taken AS (SELECT * REPLACE (
        CASE WHEN known THEN CASE WHEN verdict = 'odd' THEN status ELSE verdict END WHEN status = 'candidate' THEN 'needs_review' ELSE status END AS status,
        CASE WHEN known THEN v_confidence ELSE confidence END AS confidence, source_present OR known AS source_present,
        CASE WHEN known THEN v_proven ELSE exploitability_proven END AS exploitability_proven), CASE WHEN known THEN 'verifier' END AS validator FROM met)""",
]
FIX_ROWS = """fx AS (SELECT 'f' || doc_id AS id, doc_id AS n, doc_id % 3 = 0 AS cannot, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '--- a/' || lang || '/a.py' || chr(10) || '+++ b/' || lang
    || '/a.py' || chr(10) || '@@ -1 +1 @@' || chr(10) END AS patch FROM documents)"""

# ------------------------------------------------------------------ quota
EVENTS = """qe AS (SELECT event_id, '10.0.0.' || (user_id % 10) AS key, CASE event_type WHEN 'signup' THEN 'waitlist' WHEN 'error' THEN 'contact' WHEN 'view' THEN 'free'
    ELSE 'scan/github' END AS endpoint, ts, epoch_us(ts) // 1000 AS tick FROM events)"""
_LIMIT = "CASE endpoint WHEN 'scan/github' THEN 5 WHEN 'waitlist' THEN 3 WHEN 'contact' THEN 3 END"
# exact admissions, one event of a key at a time; the log is the list of admitted ticks
ADMIT = [
    EVENTS,
    f"seq AS (SELECT *, {_LIMIT} AS lim, row_number() OVER (PARTITION BY key, endpoint ORDER BY tick, event_id) AS nth FROM qe)",
    f"""walk AS (
        SELECT event_id, key, endpoint, tick, nth, lim, true AS allowed, 0 AS before_n, [tick] AS log, tick AS oldest FROM seq WHERE nth = 1 AND lim IS NOT NULL
        UNION ALL
        SELECT s.event_id, s.key, s.endpoint, s.tick, s.nth, s.lim, len(list_filter(w.log, lambda t: t >= s.tick - 3600000)) < s.lim,
            len(list_filter(w.log, lambda t: t >= s.tick - 3600000)),
            CASE WHEN len(list_filter(w.log, lambda t: t >= s.tick - 3600000)) < s.lim THEN list_append(list_filter(w.log, lambda t: t >= s.tick - 3600000), s.tick)
                ELSE list_filter(w.log, lambda t: t >= s.tick - 3600000) END,
            coalesce(list_min(list_filter(w.log, lambda t: t >= s.tick - 3600000)), s.tick)
        FROM walk w JOIN seq s ON s.key = w.key AND s.endpoint = w.endpoint AND s.nth = w.nth + 1)""",
]


def _recursive(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


# ------------------------------------------------------------------ modules
# what each part holds, read off its text: (part, line of the sink, category, confidence, sanitized, reference kinds)
FLOW_ROWS = [
    (0, 3, "sql_injection", 0.92, "false", "source|path|sink"),
    (1, 3, "sql_injection", 0.55, "true", "source|path|sink|sanitizer"),
    (2, 3, "command_injection", 0.92, "false", "source|path|sink"),
    (3, 3, "command_injection", 0.55, "true", "source|path|sink|sanitizer"),
    (4, 3, "log_injection", 0.92, "false", "source|path|sink"),
    (6, 4, "sql_injection", 0.92, "false", "source|path|sink"),
    (7, 4, "command_injection", 0.92, "false", "source|path|sink"),
]
# (part, line of the function, method, route before the user, guarded)
ROUTE_ROWS = [(0, 2, "GET", "/api/admin/users"), (1, 2, "POST", "/public/"), (4, 2, "GET", "/info/"), (6, 3, "DELETE", "/internal/"), (7, 3, "ROUTE", "/account/")]
# lines that the line rules report: (part, line, category)
HIT_ROWS = [(0, 3, "sql_injection"), (4, 3, "log_injection"), (6, 4, "sql_injection")]


# what a scan finds in each part: (part, line, category, status, severity, confidence, references); every
# repository of modules is an application whose routes face outward
SCAN_ROWS = [
    (0, 3, "sql_injection", "confirmed", "critical", 0.946, 4),
    (4, 3, "log_injection", "candidate", "high", 0.74, 4),
    (6, 4, "sql_injection", "confirmed", "critical", 0.946, 4),
    (0, 2, "missing_auth", "candidate", "critical", 0.866, 1),
    (1, 2, "missing_auth", "needs_review", "medium", 0.69, 1),
    (6, 3, "missing_auth", "needs_review", "critical", 0.69, 1),
    (7, 3, "missing_auth", "candidate", "critical", 0.866, 1),
]


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(v) if isinstance(v, str) and v not in ("true", "false") else str(v) for v in r) + ")" for r in rows) + ")"


MODULE = [
    *B.module_ctes(),
    f"flow AS (SELECT repo_id, path, category, CAST(before + at_line AS INTEGER) AS line, CAST(confidence AS DOUBLE) AS confidence, sanitized, kinds, part_no FROM part JOIN {_values(FLOW_ROWS)} f(part_no, at_line, category, confidence, sanitized, kinds) USING (part_no))",
    f"route AS (SELECT repo_id, path, prefix || user_id AS route, method, CAST(before + at_line AS INTEGER) AS line, part_no FROM part JOIN {_values(ROUTE_ROWS)} r(part_no, at_line, method, prefix) USING (part_no))",
]
PATCH = """fx AS (SELECT 'fix-' || event_id AS id, p.*, p.event_id % 15 = 4 AS nofile, p.event_id % 5 AS kind FROM part p WHERE part_no = 0)"""
_OLD = '    cursor.execute(f"SELECT * FROM t WHERE n = {name}")'
_NEW_LEN = f"CASE kind WHEN 1 THEN {len(_OLD) + 11} WHEN 2 THEN {len('    cursor.execute(')} ELSE {len('    cursor.find(name)')} END"

ORACLES: dict[str, str] = {
    "repo_risk": _scan_score(),
    "scan_risk": _scan_score(),
    "scan_findings": _with(_scan(), f"SELECT {FLAT}, attack_chain, cvss_score, cvss_vector, owasp_cat, false_positive_risk, ord FROM scanned"),
    "ingest_files": _with(
        SIZED,
        f"""SELECT repo_id, path, size, CASE WHEN {B.suffix_of('path')} IN ({words(K.PY)}) THEN 'python' WHEN {B.suffix_of('path')} IN ({words(K.JS)}) THEN 'javascript' ELSE 'text' END AS language,
            sum(size) OVER (PARTITION BY repo_id) > 2000000 AS over_budget FROM listed""",
    ),
    "ingest_head": _with(
        SIZED,
        f"""SELECT repo_id, path, size, CASE WHEN {B.suffix_of('path')} IN ({words(K.PY)}) THEN 'python' WHEN {B.suffix_of('path')} IN ({words(K.JS)}) THEN 'javascript' ELSE 'text' END AS language,
            file_no, running_bytes, bool_or(running_bytes > 2000000) OVER (PARTITION BY repo_id) AS over_budget FROM kept""",
    ),
    "ingest_stats": _with(
        SIZED,
        """SELECT repo_id, repo_size_bytes, coalesce(s, 0) AS scanned_source_bytes, coalesce(n, 0) AS scanned_file_count, repo_size_bytes - coalesce(s, 0) AS ignored_size_bytes
            FROM (SELECT repo_id, CAST(sum(size) AS BIGINT) AS repo_size_bytes FROM sized GROUP BY repo_id)
            LEFT JOIN (SELECT repo_id, CAST(sum(size) AS BIGINT) AS s, count(*) AS n FROM listed GROUP BY repo_id) USING (repo_id)""",
    ),
    "page_text": f"""SELECT page_id, length(html) AS n_chars, CASE WHEN starts_with(u, '/m/') THEN substr(u, 4) ELSE u END AS rel, {B.suffix_of("regexp_extract(url, '^[^?#]*')")} AS suffix
        FROM (SELECT *, regexp_replace(url, '^https?:/', '') AS u FROM pages)""",
    "line_table": _with(
        [
            *B.corpus_ctes(),
            "every AS (SELECT source AS repo_id, 'doc/' || doc_id || '.txt' AS path, text FROM documents UNION ALL SELECT * FROM code)",
            f"l AS (SELECT repo_id, path, unnest({B.lines_of('text')}) AS line FROM every)",
        ],
        f"""SELECT repo_id, path, count(*) AS n_lines, count(*) FILTER (regexp_matches({B.strip('line')}, '^(?:#|//|[*])')) AS n_comments,
            count(*) FILTER ({has('line', K.SAFE_REFERENCES)}) AS n_safe, CAST(sum(length({B.strip('line')})) AS BIGINT) AS n_chars FROM l GROUP BY repo_id, path""",
    ),
    "deps_npm": _with(_packages(), "SELECT * FROM package WHERE registry = 'npm'"),
    "deps_pypi": _with(_packages(), "SELECT * FROM package WHERE registry = 'pypi'"),
    "deps_all": _with(
        _packages(),
        f"SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY registry, lower(path), path, pos) AS INTEGER) AS place FROM package",
    ),
    **{f"det_{k[-2:]}": _detector(k) for k in B.detector_ctes()[1]},
    "det_31_documents": _with(
        [*B.file_ctes("(SELECT source AS repo_id, 'corpus/' || doc_id || '.py' AS path, text FROM documents)"), *B.candidate_ctes(["DET-31"])], f"SELECT {B.COLUMNS} FROM cand"
    ),
    "det_33": _with(
        [*AUDIT, *B.final("audit", "done")], "SELECT repo_id, path, line_number, category, status, severity, cvss_score, evidence FROM done"
    ),
    "detectors_all": _with(
        [*FILES, *B.candidate_ctes()],
        "SELECT repo_id, category, severity, status, count(*) AS n, min(line_number) AS first_line, max(line_number) AS last_line FROM cand GROUP BY ALL",
    ),
    "route_risk": _with(
        [
            f"""src AS (SELECT 'page:' || page_id AS source, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS route FROM pages
                UNION ALL SELECT 'event:' || event_id, '/api/' || {pick(['admin', 'login', 'verify', 'user/verify', 'pay', 'health', 'token', 'public', 'account/reset', 'internal/x'], 'event_id % 10')} || '/' || user_id FROM events)""",
            "m AS (SELECT *, CASE WHEN length(route) % 2 = 0 THEN 'POST' ELSE 'GET' END AS method FROM src)",
        ],
        f"""SELECT source, route, {B.high_risk('route')} AS high_risk, CASE WHEN {has('lower(route)', K.AUTH_FRAGMENTS)} THEN 'auth' WHEN {has('lower(route)', K.PAYMENT_FRAGMENTS)} THEN 'payment' END AS sensitive,
            ({has('lower(route)', K.STRONG_LOGIN_WORDS)} OR ({has('lower(route)', K.WEAK_LOGIN_WORDS)} AND {has('lower(route)', K.LOGIN_CONTEXT_WORDS)})) AS login_target,
            {B.needs_limit('route')} AS needs_limit, {B.action('route', 'method', "'missing_rate_limit'")} AS action_limit, {B.action('route', 'method', "'missing_auth'")} AS action_auth FROM m""",
    ),
    "coverage_flags": _with(FILES, "SELECT * FROM flags"),
    "anti_rls": _with(
        [*FILES, *B.detector_ctes()[0]],
        "SELECT repo_id, path, t AS table_name, CAST(line_no AS INTEGER) AS line_number FROM made ANTI JOIN enabled USING (repo_id, path, t)",
    ),
    "evidence_context": _with(
        [*FILES, *B.candidate_ctes(["DET-01", "DET-02"])],
        f"""SELECT c.repo_id, c.path, line_number, array_to_string({B.frame('lines', 'line_number', 6, 6)}, {NL}) AS near, CAST(len({B.frame('lines', 'line_number', 8, 8)}) AS INTEGER) AS n_fix_lines,
            left(array_to_string({B.frame('lines', 'line_number', 0, 25)}, {NL}), {K.QUOTE_CHARS}) AS handler_part FROM cand c JOIN file f ON f.repo_id = c.repo_id AND f.path = c.path""",
    ),
    "evidence_prefilter": _with(
        [*FILES, *B.candidate_ctes([k for k in B.detector_ctes()[1] if k != "DET-19"]),
         f"bare_rls AS (SELECT repo_id, path, line_no AS line_number, 'rls_disabled' AS category, 0 AS seq, 'CREATE TABLE ' || name_of || ' — ENABLE ROW LEVEL SECURITY not found' AS evidence FROM bare)",
         "every AS (SELECT repo_id, path, line_number, category, seq, evidence FROM cand UNION ALL SELECT * FROM bare_rls)"],
        f"""SELECT c.repo_id, c.path, CAST(c.line_number AS INTEGER) AS line_number, category, CAST(seq AS INTEGER) AS seq, evidence, array_to_string({B.prefilter(ctx='l.ctx', path='c.path')}, '|') AS notes
            FROM every c JOIN line l ON l.repo_id = c.repo_id AND l.path = c.path AND l.line_no = c.line_number""",
    ),
    "attacker_assignment": _with(
        [*FILES, *B.candidate_ctes([f"DET-0{i}" for i in range(1, 9)])],
        f"""SELECT c.repo_id, c.path, line_number, category, array_to_string(list_sort({B.variables('evidence')}), '|') AS variables, {B.assigned('evidence', 'l.ctx')} AS assigned,
            {has('evidence', K.INTERPOLATION_MARKS)} AS interpolated, {B.sanitized('evidence', 'l.ctx', 'category')} AS sanitized
            FROM cand c JOIN line l ON l.repo_id = c.repo_id AND l.path = c.path AND l.line_no = c.line_number""",
    ),
    "evidence_proof": _with(_evidenced(), f"SELECT repo_id, id, category, path, line_number, {PROOF}, array_to_string(note_list, '|') AS notes FROM evidenced"),
    "evidence_status": _with(
        _evidenced(), f"SELECT {FLAT}, '' AS attack_chain, CAST(NULL AS DOUBLE) AS cvss_score, CAST(NULL AS VARCHAR) AS cvss_vector, owasp_cat, false_positive_risk, ord FROM evidenced"
    ),
    "repo_frameworks": _with([*FILES, *B.context_ctes()], "SELECT repo_id, array_to_string(frameworks, '|') AS frameworks FROM ctx_all"),
    "repo_context": _with(
        [*FILES, *B.context_ctes()],
        """SELECT repo_id, kind, array_to_string(reasons, '|') AS reasons, array_to_string(local_network_hints, '|') AS local_network_hints, array_to_string(routes, '|') AS public_api_signals,
            external_exposure_proven, sensitive_public_surface, app_score, framework_score, library_score, ml_score FROM ctx""",
    ),
    "context_downgrade": _with(
        [
            *STAND_IN,
            f"""sited AS (SELECT *, {pick(_KINDS, f"CAST(regexp_extract(repo_id, '(\\d+)$', 1) AS INTEGER) % {len(_KINDS)}")} AS kind,
                CAST(regexp_extract(repo_id, '(\\d+)$', 1) AS INTEGER) % 4 = 0 AS external_exposure_proven, CAST(regexp_extract(repo_id, '(\\d+)$', 1) AS INTEGER) % 8 = 0 AS sensitive_public_surface FROM stand)""",
            *B.downgrade("sited", "moved"),
        ],
        """SELECT repo_id, category, status, severity, false_positive_risk, round(confidence, 4) AS confidence, array_to_string(note_list, '|') AS notes, count(*) AS n FROM moved GROUP BY ALL""",
    ),
    "dedupe_findings": _with(
        MERGED,
        f"SELECT repo_id, id, category, status, severity, round(confidence, 4) AS confidence, path, line_number, evidence, quotes, notes, confirmed_by, {PROOF}, description, recommendation, fix, validator, false_positive_risk, ord FROM deduped",
    ),
    "contradiction_gate": _with(
        STAND_IN,
        """SELECT repo_id, id, category, CASE WHEN bare OR opened THEN 'rejected' ELSE status END AS status,
            round(CASE WHEN bare THEN 0 WHEN opened THEN least(confidence, 0.45) ELSE confidence END, 4) AS confidence,
            array_to_string(note_list, '|') || CASE WHEN bare THEN '|Rejected by the contradiction gate: no evidence or source line.' WHEN opened THEN '|Rejected by the contradiction gate: the path is not fully proven.' ELSE '' END AS notes
            FROM (SELECT *, status = 'confirmed' AND line_number <= 0 AS bare, status = 'confirmed' AND line_number > 0 AND category IN ('sql_injection', 'command_injection') AND NOT path_present AS opened FROM stand)""",
    ),
    "final_scoring": _with(
        [*STAND_IN, *B.final("(SELECT * FROM stand WHERE status <> 'rejected')", "done")], "SELECT repo_id, id, category, status, severity, cvss_score, cvss_vector, attack_chain FROM done"
    ),
    "risk_score": _with([*STAND_IN, *B.scored("stand")], f"SELECT repo_id, risk_score, n_findings, {B.VERDICT} AS verdict FROM scored"),
    "saturation_ranks": _with(
        MERGED,
        f"""SELECT repo_id, category, id, CAST(position AS INTEGER) AS position, round(greatest({K.SATURATION_FLOOR}, 1.0 / (1.0 + position * {K.SATURATION_STEP})), 6) AS factor
            FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, category ORDER BY {B.REPORT_ORDER}) - 1 AS position FROM deduped WHERE status <> 'rejected')""",
    ),
    "verify_batches": _with(
        [
            """t AS (SELECT 'conv-' || (conv_id % 20) AS repo_id, conv_id || ':' || turn AS id, CASE role WHEN 'user' THEN 'source_line' WHEN 'assistant' THEN 'sql' ELSE 'literal' END AS kind,
                row_number() OVER (PARTITION BY conv_id % 20 ORDER BY lower('c/' || conv_id), 'c/' || conv_id, turn) - 1 AS place FROM conversations)""",
        ],
        """SELECT repo_id, CAST(place // 6 AS INTEGER) AS batch, count(*) AS n, array_to_string(list(id ORDER BY place), '|') AS ids,
            array_to_string(list(CASE kind WHEN 'sql' THEN 'source_present+sink_present+path_present' WHEN 'literal' THEN 'quoted_evidence' ELSE 'quoted_evidence+source_line' END ORDER BY place), '|') AS required
            FROM t GROUP BY repo_id, place // 6""",
    ),
    "fix_batches": _with(
        [*MERGED, f"t AS (SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY {B.FOUND_ORDER}) - 1 AS place FROM deduped WHERE status = 'confirmed')"],
        "SELECT repo_id, CAST(place // 4 AS INTEGER) AS batch, count(*) AS n, array_to_string(list(id ORDER BY place), '|') AS ids FROM t GROUP BY repo_id, place // 4",
    ),
    "verdict_merge": _with(
        LABELLED,
        f"""SELECT repo_id, id, CASE WHEN opened THEN 'rejected' ELSE status END AS status, round(CASE WHEN opened THEN least(confidence, 0.45) ELSE confidence END, 4) AS confidence, {PROOF}, validator,
            CASE WHEN known AND status = 'confirmed' THEN 'verifier' ELSE '' END AS confirmed_by, CASE WHEN known AND status = 'confirmed' AND exploitability_proven THEN scenario ELSE '' END AS attack_chain
            FROM (SELECT *, status = 'confirmed' AND category = 'sql_injection' AND NOT (source_present AND sink_present AND path_present) AS opened FROM taken)""",
    ),
    "models_used": _with(LABELLED, "SELECT repo_id, 'verifier' AS models_used FROM taken WHERE validator IS NOT NULL GROUP BY repo_id"),
    "package_audit": _with(
        AUDIT, "SELECT repo_id, category, status, severity, confidence, path, line_number, evidence, confirmed_by, validator, false_positive_risk, description FROM audit"
    ),
    "fix_merge": _with(
        [LABELLED[0], FIX_ROWS,
         """m AS (SELECT lab.*, n, patch, status = 'confirmed' AND n IS NOT NULL AS known, status = 'confirmed' AND n IS NOT NULL AND NOT cannot AND patch <> '' AS tried,
            coalesce(n % 13 <> 0 AND n % 9 <> 0, false) AS accepted FROM lab LEFT JOIN fx USING (id))"""],
        """SELECT repo_id, id, status, CASE WHEN tried AND accepted THEN patch END AS fix_code, CASE WHEN known AND n % 7 <> 0 THEN 'do it' ELSE '' END AS recommendation,
            CASE WHEN known AND n % 11 <> 0 THEN 'because' ELSE '' END AS fix, CASE WHEN known AND n % 11 <> 0 THEN 'reviewer' ELSE '' END AS fix_source,
            CASE WHEN tried AND NOT accepted AND n % 9 = 0 THEN 'Fix rejected: no|Fix rejected: never' ELSE '' END AS notes FROM m""",
    ),
    "remediation": _with(
        STAND_IN,
        f"""SELECT category, status, CASE WHEN gap THEN {B.case_map('category', {k: v[1] for k, v in TEXTS.items()})} ELSE description END AS recommendation,
            CASE WHEN gap THEN {B.case_map('category', {k: v[2] for k, v in TEXTS.items()})} ELSE fix END AS fix, CASE WHEN gap THEN 'static_table' ELSE '' END AS fix_source, count(*) AS n
            FROM (SELECT *, status <> 'rejected' AND NOT (description <> '' AND fix <> '') AS gap FROM stand) GROUP BY ALL""",
    ),
    "report_counts": _with(
        [*STAND_IN, *B.scored("stand"), f"counts AS ({_counts('stand', 'repo_id')})"],
        f"SELECT repo_id, critical, high, medium, low, total, highest_severity, risk_score, {SUMMARY} AS summary FROM counts JOIN scored USING (repo_id)",
    ),
    "report_order": _with(
        MERGED,
        f"SELECT repo_id, id, severity, status, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY {B.REPORT_ORDER}) AS INTEGER) AS place FROM deduped WHERE status <> 'rejected'",
    ),
    "report_order_stored": _with(
        MERGED,
        f"SELECT repo_id, id, severity, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY severity DESC, {B.FOUND_ORDER}) AS INTEGER) AS place FROM deduped WHERE severity = 'high'",
    ),
    "report_json": _with(
        [*MERGED, SCANS, f"counts AS ({_counts('deduped', 'repo_id')})",
         f"""pages AS (SELECT repo_id, CAST(place // 100 AS INTEGER) AS page, first(id ORDER BY place) AS first_id, first(path ORDER BY place) AS first_path, count(*) AS n_findings FROM (SELECT repo_id, id, path,
            row_number() OVER (PARTITION BY repo_id ORDER BY {B.SEV} DESC, ord, path, line_number, id) - 1 AS place FROM deduped) GROUP BY repo_id, place // 100)"""],
        f"""SELECT scan_id, coalesce(page, 0) AS page, risk_score, coalesce(verdict, 'UNKNOWN') AS verdict, {SUMMARY} AS summary, highest_severity, critical, total, first_id, coalesce(n_findings, 0) AS n_findings,
                first_path, CASE WHEN files_scanned % 2 = 0 THEN 'library' ELSE 'application' END AS kind, 'https://reports.example/r/' || scan_id AS share_url
            FROM (SELECT s.files_scanned, f.first_path, s.scan_id, s.risk_score, s.verdict, s.status, coalesce(c.critical, 0) AS critical, coalesce(c.high, 0) AS high, coalesce(c.medium, 0) AS medium, coalesce(c.low, 0) AS low,
                coalesce(c.total, 0) AS total, coalesce(c.highest_severity, 'none') AS highest_severity, page, first_id, f.n_findings
                FROM scans s LEFT JOIN counts c ON c.repo_id = s.scan_id LEFT JOIN pages f ON f.repo_id = s.scan_id WHERE s.status = 'complete')""",
    ),
    "report_overview": _with(
        [*MERGED, SCANS, f"counts AS ({_counts('deduped', 'repo_id')})"],
        f"""SELECT scan_id, (SELECT s_name FROM supplier WHERE 'repo-' || s_suppkey = scan_id) AS repo_url, '2024-01-31T00:00:00Z' AS created_at, risk_score, coalesce(verdict, 'UNKNOWN') AS verdict,
                {SUMMARY} AS summary, highest_severity, critical, high, medium, low, files_scanned, CAST(round(files_scanned * 100 / 1000.0) AS BIGINT) AS duration_seconds
            FROM (SELECT s.*, coalesce(c.critical, 0) AS critical, coalesce(c.high, 0) AS high, coalesce(c.medium, 0) AS medium, coalesce(c.low, 0) AS low,
                coalesce(c.total, 0) AS total, coalesce(c.highest_severity, 'none') AS highest_severity FROM scans s LEFT JOIN counts c ON c.repo_id = s.scan_id WHERE s.status = 'complete')""",
    ),
    "report_view": _with(
        [*MERGED, *B.final("(SELECT * FROM deduped WHERE status <> 'rejected')", "done"),
         f"lab AS (SELECT *, {B.case_map('category', K.LABEL, 'category')} AS label, list_extract(string_split(path, '/'), -1) AS fname FROM done)"],
        """SELECT repo_id, id, upper(severity) AS severity, 'OWASP' AS owasp, '' AS owasp_cat, label AS category, path AS file, line_number AS line, label || ' in ' || fname AS title, description, evidence,
            CASE WHEN recommendation <> '' THEN recommendation ELSE fix END AS recommendation, fix, '' AS fix_code, '' AS fix_source, cvss_score, coalesce(cvss_vector, '') AS cvss_vector, status,
            coalesce(validator, '') AS validator, 'python' AS fix_language, CASE WHEN attack_chain <> '' THEN attack_chain ELSE 'An attacker may use this weakness against the application.' END AS attacker_scenario,
            CASE false_positive_risk WHEN 'high' THEN 'low' WHEN 'medium' THEN 'medium' ELSE 'high' END AS confidence,
            'claude=false|gemini=' || CASE WHEN confirmed_by <> '' THEN 'true' ELSE 'false' END || '|gpt4o=false' || CASE WHEN confirmed_by <> '' THEN '|reviewer=true' ELSE '' END AS consensus, confirmed_by FROM lab""",
    ),
    "scan_status": _with(
        [*MERGED, SCANS],
        """SELECT scan_id, scans.status, risk_score, verdict, files_scanned, CASE WHEN scans.status = 'complete' THEN coalesce(n, 0) ELSE 0 END AS findings_count
            FROM scans LEFT JOIN (SELECT repo_id AS scan_id, count(*) AS n FROM deduped GROUP BY repo_id) USING (scan_id)""",
    ),
    "scan_store": _with(
        [*MERGED, SCANS],
        """SELECT repo_id AS scan_id, severity, status, '' AS fix_source, false_positive_risk, count(*) AS n, CAST(0 AS BIGINT) AS refs, CAST(0 AS BIGINT) AS proofs FROM deduped
            WHERE repo_id NOT IN (SELECT scan_id FROM scans WHERE status = 'running') GROUP BY ALL""",
    ),
    "scan_headers": _with(
        [*_scan(), *B.scored("scanned"), "seen AS (SELECT repo_id, count(*) AS n FROM named WHERE NOT ignored GROUP BY repo_id)"],
        f"""SELECT repo_id AS repo_url, 'complete' AS status, coalesce(risk_score, 0) AS risk_score, CASE WHEN risk_score IS NULL THEN 'CLEAN' ELSE {B.VERDICT} END AS verdict,
            CAST(coalesce(n, 0) AS INTEGER) AS files_scanned, array_to_string(frameworks, '|') AS frameworks, kind,
            coalesce(n_findings, 0) AS n_stored FROM ctx LEFT JOIN scored USING (repo_id) LEFT JOIN seen USING (repo_id)""",
    ),
    "keyed_upsert": """SELECT email, epoch_us(min(ts)) AS created_at, first(source ORDER BY ts, source, ip) AS source, first(ip ORDER BY ts, source, ip) AS ip, epoch_us(max(ts)) AS last_seen_at,
        first(source ORDER BY ts DESC, source DESC) AS last_source
        FROM (SELECT 'u' || user_id || '@example.org' AS email, ts, event_type AS source, '10.0.0.' || (event_id % 250) AS ip FROM events) GROUP BY email""",
    "retention": _with([EVENTS], "SELECT event_id, key, endpoint FROM qe WHERE ts >= (SELECT max(ts) FROM qe) - INTERVAL 24 HOURS"),
    "quota_attempts": _with(
        [EVENTS, "t AS (SELECT key, endpoint, tick, count(*) AS attempts FROM qe GROUP BY ALL)"],
        "SELECT *, CAST(sum(attempts) OVER (PARTITION BY key, endpoint ORDER BY tick RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM t",
    ),
    "quota_admissions": _recursive(
        ADMIT,
        """SELECT key, endpoint, tick, count(*) AS attempts, count(*) FILTER (allowed) AS admitted, CAST(max(greatest(0, lim - before_n)) AS INTEGER) AS remaining,
            CAST(CASE WHEN bool_and(allowed) THEN 0 ELSE greatest(1, CAST(ceil((min(oldest) + 3600000 - tick) / 1000) AS BIGINT)) END AS INTEGER) AS retry_after FROM walk GROUP BY key, endpoint, tick
            UNION ALL SELECT key, endpoint, tick, count(*), count(*), NULL, 0 FROM seq WHERE lim IS NULL GROUP BY key, endpoint, tick""",
    ),
    "quota_decisions": _recursive(
        ADMIT, "SELECT event_id, key, endpoint, allowed FROM walk UNION ALL SELECT event_id, key, endpoint, true FROM seq WHERE lim IS NULL"
    ),
    "stream_status": """SELECT scan_id, first(status ORDER BY ts DESC, event_id DESC) AS status,
        CASE WHEN first(status ORDER BY ts DESC, event_id DESC) = 'failed' THEN 'code ' || first(event_id ORDER BY ts DESC, event_id DESC) END AS error_message, epoch_us(max(ts)) AS updated_at
        FROM (SELECT 'scan-' || user_id AS scan_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'running' ELSE 'queued' END AS status, ts, event_id FROM events) GROUP BY scan_id""",
    "taint_flows": _with(MODULE, "SELECT repo_id, path, category, line, confidence, sanitized, kinds FROM flow"),
    "taint_join": _with(
        [*MODULE, f"hit AS (SELECT repo_id, path, CAST(before + at_line AS INTEGER) AS line_number, category FROM part JOIN {_values(HIT_ROWS)} h(part_no, at_line, category) USING (part_no))"],
        """SELECT hit.repo_id, hit.path, line_number, hit.category, confidence AS flow_confidence, sanitized AS flow_sanitized
            FROM hit LEFT JOIN flow ON flow.path = hit.path AND flow.line = hit.line_number AND flow.category = hit.category""",
    ),
    "code_index": _with(
        [*MODULE, *FILES, "n AS (SELECT repo_id, path, CAST(count(*) AS INTEGER) AS n_flows FROM flow GROUP BY ALL)"],
        f"""SELECT repo_id, path, 'python' AS language, coalesce(n_flows, 0) AS n_flows FROM module LEFT JOIN n USING (repo_id, path)
            UNION ALL SELECT repo_id, path, CASE WHEN suffix = '.py' THEN 'python' WHEN suffix IN ({words(K.JS)}) THEN 'javascript' ELSE 'text' END, 0 FROM named""",
    ),
    "py_routes": _with(MODULE, "SELECT repo_id, path, route, method, line, false AS guarded FROM route"),
    "det_09": _with(
        [*MODULE,
         f"ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY CASE WHEN part_no = 7 THEN 1 ELSE 0 END, line) - 1 AS seq, {B.high_risk('route')} AS risky FROM route)"],
        """SELECT repo_id, path, CAST(1 AS INTEGER) AS scanner, CAST(0 AS INTEGER) AS chk, CAST(seq AS INTEGER) AS seq, 'missing_auth' AS category, CASE WHEN risky THEN 'critical' ELSE 'medium' END AS severity,
            CASE WHEN risky THEN 'candidate' ELSE 'needs_review' END AS status, line AS line_number, '@' || method || '(''' || route || ''') - no auth' AS evidence, 'medium' AS false_positive_risk, '' AS detail
            FROM ranked WHERE risky OR method IN ('POST', 'PUT', 'DELETE', 'PATCH')""",
    ),
    "syntax_check": _with([*MODULE, *FILES], "SELECT repo_id, path, true AS ok FROM module UNION ALL SELECT repo_id, path, false FROM named WHERE suffix = '.py'"),
    "module_scan": _with(
        MODULE,
        f"""SELECT repo_id, path, CAST(before + at_line AS INTEGER) AS line_number, category, status, severity, CAST(confidence AS DOUBLE) AS confidence, n_refs
            FROM part JOIN {_values(SCAN_ROWS)} s(part_no, at_line, category, status, severity, confidence, n_refs) USING (part_no)""",
    ),
    "patch_apply": _with(
        [*MODULE, PATCH],
        f"""SELECT id, fx.repo_id, CASE WHEN nofile THEN NULL ELSE fx.path END AS path, NOT nofile AND kind <> 3 AS ok, CASE WHEN NOT nofile AND kind <> 3 THEN length(text) - {len(_OLD)} + {_NEW_LEN} END AS n_chars,
            CASE WHEN nofile THEN 'The patch names no file.' WHEN kind = 3 THEN 'The patch does not fit ' || fx.path || '.' END AS error FROM fx JOIN module m ON m.path = fx.path""",
    ),
    "fix_verify": _with(
        [*MODULE, PATCH,
         "others AS (SELECT fx.id, count(*) AS n FROM fx JOIN part p ON p.path = fx.path AND p.event_id <> fx.event_id AND p.part_no IN (0, 6) GROUP BY fx.id)",
         """judged AS (SELECT id, CASE WHEN nofile THEN 'The patch names no file.' WHEN kind = 3 THEN 'The patch does not fit ' || path || '.'
            WHEN kind = 2 THEN 'After the patch ' || path || ' does not parse: ''('' was never closed.' WHEN kind = 1 OR coalesce(n, 0) > 0 THEN 'The weakness is still there after the patch.'
            ELSE 'The patch fits, the code parses and the weakness is gone.' END AS reasons FROM fx LEFT JOIN others USING (id))"""],
        "SELECT id, reasons = 'The patch fits, the code parses and the weakness is gone.' AS accepted, reasons FROM judged",
    ),
    "validate_requests": f"""WITH src AS (SELECT 'p' || page_id AS id, url AS value FROM pages
        UNION ALL SELECT 'd' || doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://github.com/' || source || '/' || lang || '.git/tree' WHEN 1 THEN ' github.com/' || source || '/r.x/ '
            WHEN 2 THEN source || '@' || lang || '.org' ELSE regexp_extract(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') END FROM documents),
        v AS (SELECT *, trim(value) AS t FROM src)
        SELECT id, regexp_extract(t, {q(K.REPO_URL)}, 1) AS owner, regexp_extract(t, {q(K.REPO_URL)}, 2) AS repo,
            CASE WHEN {rx('t', K.REPO_URL_STRICT)} THEN regexp_replace(t, '/$', '') WHEN {rx('t', K.REPO_URL_LOOSE)}
                THEN 'https://github.com/' || regexp_extract(t, {q(K.REPO_URL_LOOSE)}, 1) || '/' || regexp_extract(t, {q(K.REPO_URL_LOOSE)}, 2) END AS canonical,
            {rx('value', K.EMAIL)} AS is_email, length(value) % 2 = 0 AS patch_like, left(value, 2) = 'PK' AS is_zip FROM v""",
}
#: Streams give what their batch forms give.
ORACLES["stream_quota"] = ORACLES["quota_admissions"]
ORACLES["stream_upsert"] = ORACLES["keyed_upsert"]
ORACLES["stream_scan"] = ORACLES["scan_findings"]
ORACLES["stream_risk"] = ORACLES["scan_risk"]
ORACLES["own_rules"] = _with(
    [
        f"dl AS (SELECT 'd' || doc_id || '.yaml' AS path, {B.lines_of('text')} AS lines FROM documents)",
        "ln AS (SELECT path, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM dl)",
        "cap AS (SELECT *, length(line) - length(regexp_replace(line, '[A-Z]', '', 'g')) AS n FROM ln)",
        "tot AS (SELECT *, sum(n) OVER (PARTITION BY path) AS total FROM cap)",
    ],
    """SELECT 'CAPITALS' AS rule, path, 'ZeroDivisionError: integer division or modulo by zero' AS error, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS lines, CAST(NULL AS BIGINT) AS chars
        FROM (SELECT DISTINCT path FROM tot WHERE total = 0)
        UNION ALL SELECT 'CAPITALS', path, NULL, count(*), CAST(sum(i) AS BIGINT), CAST(sum(length(line)) AS BIGINT) FROM tot WHERE total > 0 AND 300 * n // total > 100 GROUP BY path
        UNION ALL SELECT 'LONG-WORDS', path, NULL, count(*), CAST(sum(i) AS BIGINT), CAST(sum(length(line)) AS BIGINT) FROM ln
            WHERE len(list_filter(string_split(line, ' '), lambda w: length(w) > 14)) > 0 GROUP BY path""",
)
ORACLES["fix_payloads"] = _with(
    [
        *_scan(),
        f"t AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {B.FOUND_ORDER}) - 1 AS place FROM scanned WHERE status = 'confirmed')",
        f"src AS (SELECT repo_id, path, {B.lines_of('text')} AS src_lines FROM code)",
        """cut AS (SELECT t.repo_id, place, id, t.path, line_number, greatest(line_number - 8, 1) AS first_line,
            src_lines[greatest(line_number - 8, 1) : line_number + 8] AS near FROM t JOIN src USING (repo_id, path))""",
    ],
    """SELECT repo_id, CAST(place // 4 AS INTEGER) AS batch, id, path, line_number, CAST(len(near) AS BIGINT) AS n_lines, CAST(first_line AS INTEGER) AS first_line,
        array_to_string(near, chr(10)) AS code FROM cut""",
)
ORACLES["scan_texts"] = _with(
    [
        """texts AS (SELECT source AS repo_id, 'corpus/' || doc_id || (['.py', '.js', '.ts', '.json', '.yaml', '.sql'])[doc_id % 6 + 1] AS path, coalesce(text, '') AS text FROM documents
            UNION ALL SELECT 'pages', 'web/' || page_id || '.js', coalesce(html, '') FROM pages
            UNION ALL SELECT 'turns', 'chat/' || conv_id || '-' || turn || '.py', coalesce(text, '') FROM conversations)""",
        *B.file_ctes("texts"), *B.candidate_ctes(),
    ],
    f"SELECT {B.COLUMNS} FROM cand",
)
ORACLES["archive_expand"] = """WITH d AS (SELECT doc_id, doc_id // 40 AS a, coalesce(text, '') AS t FROM documents), g AS (SELECT DISTINCT a FROM d)
    SELECT 'z' || a AS repo_id, CASE WHEN a % 2 = 0 THEN 'src/d' WHEN doc_id % 2 = 0 THEN 'a/d' ELSE 'b/d' END || doc_id || '.txt' AS path,
        CAST(octet_length(encode(t)) AS BIGINT) AS size, md5(t) AS digest, CAST(NULL AS VARCHAR) AS error FROM d WHERE a % 7 NOT IN (3, 5)
    UNION ALL SELECT 'z' || a, 'c/info.txt', 4, md5('info'), NULL FROM g WHERE a % 2 = 1 AND a % 7 NOT IN (3, 5)
    UNION ALL SELECT 'z' || a, '../evil.txt', NULL, NULL, 'unsafe member name' FROM g WHERE a % 7 = 3
    UNION ALL SELECT 'z' || a, NULL, NULL, NULL, 'not a zip archive' FROM g WHERE a % 7 = 5"""
