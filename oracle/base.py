"""Building blocks of the checking SQL: the same corpora and rules, told relationally.

Nothing here imports an operator; only the fixed values and the corpus texts are
shared.
"""

from __future__ import annotations

from riskloom.functions import fixed as K
from riskloom.functions.prose import TEXTS
from riskloom.plans import corpus, modules


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values) -> str:
    return ", ".join(q(v) for v in values)


def lst(values) -> str:
    return "[" + words(values) + "]"


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def has(col: str, values) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(v)})" for v in values) + ")"


def pick(values, index: str) -> str:
    return f"list_extract({lst(values)}, CAST(({index}) AS BIGINT) + 1)"


NL = "chr(10)"
BREAK = K.LINE_BREAK


def lines_of(text: str) -> str:
    return (
        f"CASE WHEN {text} = '' THEN CAST([] AS VARCHAR[]) ELSE "
        f"string_split_regex(regexp_replace({text}, {q('(?:' + BREAK + ')\\z')}, ''), {q(BREAK)}) END"
    )


def strip(col: str) -> str:
    return f"trim({col}, {q(K.WHITESPACE)})"


def suffix_of(path: str) -> str:
    name = f"list_extract(string_split({path}, '/'), -1)"
    return f"lower(regexp_extract({name}, '^.+(\\.[^.]+)$', 1))"


def frame(lines: str, n: str, before: int, after: int) -> str:
    return f"list_slice({lines}, greatest({n} - {before}, 1), {n} + {after})"


def ignored(path: str, size: str) -> str:
    low = f"lower({path})"
    folders = f"list_slice(string_split({low}, '/'), 1, len(string_split({low}, '/')) - 1)"
    name = f"list_extract(string_split({low}, '/'), -1)"
    ends = " OR ".join(f"ends_with({name}, {q(e)})" for e in K.SKIP_ENDINGS)
    readable = f"({suffix_of(path)} IN ({words(K.SCAN_SUFFIXES)}) OR {name} = '.env' OR starts_with({name}, '.env.') OR {name} IN ({words(K.RULE_FILES)}))"
    return f"(list_has_any({folders}, {lst(K.SKIP_DIRS)}) OR {name} IN ({words(K.SKIP_FILES)}) OR {ends} OR NOT {readable})"


# ------------------------------------------------------------------ corpora
def corpus_ctes() -> list[str]:
    n = len(corpus.KINDS)
    cases = []
    for kind, texts in corpus.CHUNKS.items():
        numbers = ", ".join(str(i) for i, k in enumerate(corpus.KINDS) if k[0] == kind)
        cases.append(f"WHEN kind_no IN ({numbers}) THEN {pick(texts, f'(event_id * 7 + user_id) % {len(texts)}')}")
    guard_kinds = ", ".join(str(i) for i, k in enumerate(corpus.KINDS) if k[0] in ("py", "js", "handler"))

    def col(i: int) -> str:
        return pick([k[i] for k in corpus.KINDS], "kind_no")

    commas = ", ".join(str(i) for i, k in enumerate(corpus.KINDS) if k[4] != "\n")
    return [
        f"""ev AS (SELECT event_id, user_id, event_id // {corpus.CHUNKS_PER_FILE} AS file_no, event_id % {corpus.CHUNKS_PER_FILE} AS position,
            (event_id // {corpus.CHUNKS_PER_FILE}) % {n} AS kind_no FROM events)""",
        f"""chunk AS (SELECT file_no, position, kind_no,
            CASE WHEN file_no % 3 = 0 THEN 'repo-big' ELSE 'repo-' || (file_no // 60) END AS repo_id,
            CASE WHEN position = 5 AND (file_no // 40) % 2 = 0 AND kind_no IN ({guard_kinds}) THEN {pick(corpus.GUARDS, f'(file_no // 3) % {len(corpus.GUARDS)}')}
            ELSE replace(replace(CASE {' '.join(cases)} END, '{{u}}', CAST(user_id AS VARCHAR)), '{{e}}', CAST(event_id AS VARCHAR)) END AS chunk
            FROM ev)""",
        f"""code AS (SELECT repo_id, replace({col(1)}, '{{f}}', CAST(file_no AS VARCHAR)) AS path,
            {col(2)} || {NL} || body || {NL} || {col(3)} AS text
            FROM (SELECT repo_id, file_no, kind_no, CASE WHEN kind_no IN ({commas}) THEN array_to_string(list(chunk ORDER BY position), ',' || {NL})
                  ELSE array_to_string(list(chunk ORDER BY position), {NL}) END AS body FROM chunk GROUP BY repo_id, file_no, kind_no))""",
    ]


def module_ctes() -> list[str]:
    m = modules.PARTS_PER_MODULE
    return [
        f"""part AS (SELECT event_id, user_id, event_id // {m} AS module_no, event_id % {m} AS position,
            (event_id * 5 + user_id) % {len(modules.PARTS)} AS part_no,
            CASE WHEN (event_id // {m}) % 3 = 0 THEN 'mod-big' ELSE 'mod-' || ((event_id // {m}) // 50) END AS repo_id,
            'svc/m' || (event_id // {m}) || '.py' AS path, (event_id % {m}) * 6 AS before FROM events)""",
        f"""module AS (SELECT repo_id, path, array_to_string(list(replace(replace({pick(modules.PARTS, 'part_no')}, '{{u}}', CAST(user_id AS VARCHAR)),
            '{{e}}', CAST(event_id AS VARCHAR)) ORDER BY position), {NL}) AS text FROM part GROUP BY repo_id, path)""",
    ]


# ------------------------------------------------------------------ files and lines
def file_ctes(source: str = "code") -> list[str]:
    ai = f"(suffix IN ({words(K.AI_CODE)}) AND NOT generated)"
    return [
        f"""named AS (SELECT repo_id, path, text, list_extract(string_split(path, '/'), -1) AS name, {suffix_of('path')} AS suffix,
            (ends_with(lower(path), '.d.ts') OR list_has_any(string_split(lower(path), '/'), {lst(K.GENERATED_PARTS)})) AS generated,
            {lines_of('text')} AS lines, {ignored('path', 'octet_length(encode(text))')} AS ignored FROM {source})""",
        f"""file AS (SELECT *,
            ({has('text', K.AUTH_WORDS_PY)} OR {rx('text', K.ROUTER_AUTH_PY)}) AS auth_py,
            ({has('text', K.AUTH_WORDS_JS)} OR {rx('text', K.ROUTER_AUTH_JS)}) AS auth_js,
            ({has('text', K.LIMIT_WORDS_PY)} OR {rx('text', K.ROUTER_LIMIT_PY)}) AS limit_py,
            ({has('text', K.LIMIT_WORDS_JS)} OR {rx('text', K.ROUTER_LIMIT_JS)}) AS limit_js,
            ({ai} AND {rx('text', K.MODEL_CALL)}) AS model_call,
            ({ai} AND {rx('text', K.RETRIEVAL)}) AS retrieval,
            ({ai} AND {rx('text', K.SENSITIVE_DATA)}) AS sensitive,
            ({ai} AND ({rx('text', K.MODEL_CALL)} OR {rx('text', K.RETRIEVAL)} OR {rx('text', K.PROMPT_ASSIGN)} OR {rx('text', K.MODEL_OUTPUT)})) AS model_context,
            (starts_with(lower(path), 'app/api/') AND (ends_with(lower(path), '/route.ts') OR ends_with(lower(path), '/route.js'))
                AND {rx('text', K.HANDLER_EXPORT)}) AS handler,
            (suffix = '.py' AND NOT generated AND {rx('text', K.AUTH_ROUTE_PY)}) AS py_routes,
            CASE WHEN suffix = '.json' AND NOT generated AND json_valid(text) THEN coalesce(json_exists(text, '$.mcpServers'), false) ELSE false END AS mcp,
            (suffix IN ({words(K.JS_DB)}) AND {rx('text', K.CLIENT_CALL)} AND {rx('text', K.ANON_KEY)} AND {rx('text', K.WRITE_CALL)}) AS anon_client,
            {rx('text', K.WEB_HINT)} AS web_hint,
            (lower(name) = '.env' OR starts_with(lower(name), '.env.')) AS env_file,
            CASE WHEN starts_with(path, 'app/api/') THEN '/api/' || regexp_replace(substr(path, 9), '(?:^|/)route\\.(?:ts|js)$', '') ELSE '' END AS handler_route
            FROM named)""",
        f"""flags AS (SELECT repo_id,
            bool_or(NOT generated AND {has('lower(path)', K.AUTH_PROJECT_PATHS)} AND (auth_py OR auth_js)) AS project_auth,
            bool_or(NOT generated AND {has('lower(path)', K.LIMIT_PROJECT_PATHS)} AND (limit_py OR limit_js)) AS project_rate_limit,
            bool_or(contains(lower(path), 'supabase') OR (name IN ({words(K.DEPENDENCY_FILES)}) AND {rx('text', '(?i)supabase')})
                OR ((suffix IN ({words(K.CONFIG_SUFFIXES)}) OR env_file) AND {has('text', ['SUPABASE_URL', 'SUPABASE_ANON_KEY'])})
                OR (suffix = '.sql' AND {rx('text', K.SUPABASE_SQL)})) AS supabase_project
            FROM file GROUP BY repo_id)""",
        f"""line AS (SELECT * EXCLUDE (lines, text), array_to_string({frame('lines', 'line_no', 6, 6)}, {NL}) AS ctx,
            array_to_string({frame('lines', 'line_no', 2, 3)}, {NL}) AS near, {strip('line')} AS stripped,
            regexp_matches({strip('line')}, '^(?:#|//|[*])') AS comment, {has('line', K.SAFE_REFERENCES)} AS safe
            FROM (SELECT *, unnest(lines) AS line, CAST(generate_subscripts(lines, 1) AS INTEGER) AS line_no FROM file))""",
    ]


# ------------------------------------------------------------------ detectors
COLUMNS = "repo_id, path, scanner, chk, seq, category, severity, status, line_number, evidence, false_positive_risk, detail"


def _row(source: str, where: str, scanner: int, chk: int, category: str, severity: str, status: str, risk: str, detail="''", seq=0, line="line_no", evidence=None) -> str:
    evidence = evidence or "stripped"
    return (
        f"SELECT repo_id, path, CAST({scanner} AS INTEGER) AS scanner, CAST({chk} AS INTEGER) AS chk, CAST({seq} AS INTEGER) AS seq, {category} AS category, "
        f"{severity} AS severity, {status} AS status, CAST({line} AS INTEGER) AS line_number, {evidence} AS evidence, {risk} AS false_positive_risk, {detail} AS detail "
        f"FROM {source} WHERE {where}"
    )


def _first(rules) -> str:
    return "CASE " + " ".join(f"WHEN {rx('line', p)} THEN {q(label)}" for label, p, _ in rules) + " END"


def _any(rules) -> str:
    return "(" + " OR ".join(rx("line", p) for _, p, _ in rules) + ")"


def _in(values) -> str:
    return f"suffix IN ({words(values)})"


def high_risk(route: str) -> str:
    return has(f"lower({route})", K.HIGH_RISK_PATHS)


def needs_limit(route: str) -> str:
    low = f"lower({route})"
    login = f"({has(low, K.STRONG_LOGIN_WORDS)} OR ({has(low, K.WEAK_LOGIN_WORDS)} AND {has(low, K.LOGIN_CONTEXT_WORDS)}))"
    return f"(CASE WHEN {has(low, K.AUTH_FRAGMENTS)} THEN {login} WHEN {has(low, K.PAYMENT_FRAGMENTS)} THEN true ELSE false END)"


def _block_lines(pattern: str, source: str, alias: str, group: int = 0) -> str:
    """(file columns, match, line): matches with the line they start on, found by counting
    line ends in the text before each match."""
    return f"""{alias}_m AS (SELECT *, unnest(regexp_extract_all(text, {q(pattern)})) AS match, generate_subscripts(regexp_extract_all(text, {q(pattern)}), 1) AS nth
        FROM {source} WHERE {rx('text', pattern)}),
        {alias} AS (SELECT * EXCLUDE (pre), 1 + length(pre) - length(replace(pre, {NL}, '')) AS start_line FROM (
            SELECT *, array_to_string(list_slice(string_split_regex(text, {q(pattern)}), 1, nth), '')
                || array_to_string(list_slice(regexp_extract_all(text, {q(pattern)}), 1, nth - 1), '') AS pre FROM {alias}_m))"""


def detector_ctes() -> tuple[list[str], dict[str, str]]:
    """Helper CTEs and one SELECT per detector."""
    method = f"upper(regexp_extract(line, {q(K.HANDLER_EXPORT)}, 1))"
    handler_evidence = f"'export async function ' || {method} || '(''' || handler_route || ''')'"
    log_status = f"CASE WHEN {rx('line', K.CRLF_SIGNAL)} THEN 'candidate' ELSE 'needs_review' END"
    py_route = f"regexp_extract(line, {q(K.AUTH_ROUTE_PY)}, 1)"
    js_route = f"regexp_extract(line, {q(K.AUTH_ROUTE_JS)}, 1)"
    lim_py, lim_js = f"regexp_extract(line, {q(K.LIMIT_ROUTE_PY)}, 1)", f"regexp_extract(line, {q(K.LIMIT_ROUTE_JS)}, 1)"
    creds = rx("near", K.CORS_HEADER_CREDENTIALS)
    rules = f"CASE WHEN {rx('line', K.RULES_READ_WRITE)} THEN 'critical' WHEN {rx('line', K.RULES_READ)} THEN 'high' WHEN {rx('line', K.RULES_WRITE)} THEN 'critical' END"
    jwt_none, jwt_short = rx("line", K.JWT_NONE), f"({rx('line', K.JWT_SHORT)} AND NOT {rx('line', K.JWT_SHORT_ENV)})"
    secret_prompt = f"{rx('line', K.SECRET_NEAR_PROMPT)} AND {rx('line', K.SECRET_SOURCE)} AND {has('line', K.PROMPT_WORDS)} AND {has('line', K.ASSIGN_MARKS)}"
    shape = rx("line", K.SECRET_SHAPE)
    review = "CASE WHEN sensitive THEN 'candidate' ELSE 'needs_review' END"

    def inj(rules_, suffixes, chk, category, severity, risk, status="'candidate'", label=False, more="true"):
        detail = _first(rules_) if label else "''"
        return _row("line", f"{_in(suffixes)} AND NOT comment AND {more} AND {_any(rules_)}", 2, chk, q(category), q(severity), status, q(risk), detail)

    def ai(seq, category, severity, where, status="'candidate'"):
        return _row("line", f"{_in(K.AI_CODE)} AND NOT generated AND NOT comment AND {where}", 3, 0, q(category), q(severity), status, "'medium'", seq=seq)

    own_py, own_js = f"{_in(K.PY)} AND NOT generated", f"{_in(K.JS)} AND NOT generated"
    open_auth = ("'missing_auth'", "'critical'", "'needs_review'", "'medium'")
    open_limit = ("'missing_rate_limit'", "'medium'", "'needs_review'", "'medium'")

    def cors(kind, source, pattern, star, credentials, suffixes):
        inner = f"regexp_extract(match, {q(pattern)}, 1)"
        both = rx(inner, credentials)
        return _row(
            source, f"{_in(suffixes)} AND {rx(inner, star)}", 4, 0, f"CASE WHEN {both} THEN 'cors_wildcard_credentials' ELSE 'cors_wildcard' END",
            f"CASE WHEN {both} THEN 'critical' ELSE 'high' END", "'candidate'", "'low'", "'block'", line="start_line",
            evidence=f"CASE WHEN {both} THEN {q(K.CORS_EVIDENCE[kind, True])} ELSE {q(K.CORS_EVIDENCE[kind, False])} END",
        )

    helpers = [
        _block_lines(K.CORS_PY_BLOCK, "file", "cors_py"),
        _block_lines(K.CORS_JS_BLOCK, "file", "cors_js"),
        _block_lines(K.CREATE_TABLE, "(SELECT * FROM file WHERE suffix = '.sql')", "created"),
        f"""made AS (SELECT repo_id, path, lower(regexp_extract(match, {q(K.CREATE_TABLE)}, 1)) AS t, max(start_line) AS line_no,
            any_value({rx('text', K.RLS_ANY)}) AS any_rls FROM created
            WHERE lower(regexp_extract(match, {q(K.CREATE_TABLE)}, 1)) NOT IN ({words(K.SYSTEM_TABLES)}) GROUP BY ALL)""",
        f"""enabled AS (SELECT DISTINCT repo_id, path, lower(unnest(regexp_extract_all(text, {q(K.RLS_ALTER)}, 1))) AS t FROM file WHERE suffix = '.sql')""",
        """bare AS (SELECT made.*, made.t AS name_of FROM (SELECT *, count(*) OVER (PARTITION BY repo_id, path) AS n_tables FROM made) made
            ANTI JOIN enabled USING (repo_id, path, t) WHERE NOT (any_rls AND n_tables = 1))""",
        f"""client AS (SELECT * FROM line WHERE anon_client AND {rx('line', K.CLIENT_CALL)}
            QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY line_no) = 1)""",
        f"""env_line AS (SELECT * FROM line WHERE env_file AND {rx('line', K.ENV_SECRET_KEY)} AND NOT comment AND NOT {rx('line', K.SECRET_PLACEHOLDER)}
            QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY line_no) = 1)""",
    ]
    selects = {
        "DET-01": inj(K.PY_SQL, K.PY, 0, "sql_injection", "critical", "low", label=True),
        "DET-02": inj(K.JS_SQL, K.JS, 0, "sql_injection", "critical", "low", label=True),
        "DET-03": inj(K.PY_LOG, K.PY, 1, "log_injection", "high", "medium", log_status),
        "DET-04": inj(K.JS_LOG, K.JS, 1, "log_injection", "high", "medium", log_status),
        "DET-05": inj(K.PY_CMD, K.PY, 2, "command_injection", "critical", "low"),
        "DET-06": inj(K.JS_CMD, K.JS, 2, "command_injection", "critical", "low"),
        "DET-07": inj(K.JS_DYNAMIC, K.JS, 3, "unsafe_dynamic_code", "high", "low"),
        "DET-08": inj(K.JS_PATH, K.JS, 4, "path_traversal", "high", "medium", more=f"NOT {rx('line', K.PATH_SANITIZER)}"),
        # no Python file of this corpus parses, so the line form applies to all of them
        "DET-10": _row("line", f"{own_py} AND NOT auth_py AND {high_risk(py_route)}", 1, 0, *open_auth),
        "DET-11": _row("line", f"{own_js} AND NOT auth_js AND {high_risk(js_route)}", 1, 2, *open_auth),
        "DET-12": _row("line", f"{own_js} AND handler AND NOT auth_js AND {method} <> '' AND {high_risk('handler_route')}", 1, 1, *open_auth, evidence=handler_evidence),
        "DET-13": _row("line", f"{own_py} AND NOT limit_py AND {needs_limit(lim_py)}", 6, 0, *open_limit),
        "DET-14": _row("line", f"{own_js} AND NOT limit_js AND {needs_limit(lim_js)}", 6, 1, *open_limit),
        "DET-15": _row("line", f"{own_js} AND handler AND NOT limit_js AND {method} IN ('POST', 'PUT', 'PATCH', 'DELETE') AND {needs_limit('handler_route')}", 6, 0, *open_limit, evidence=handler_evidence),
        "DET-16": cors("py", "cors_py", K.CORS_PY_BLOCK, K.CORS_PY_STAR, K.CORS_PY_CREDENTIALS, K.PY),
        "DET-17": cors("js", "cors_js", K.CORS_JS_BLOCK, K.CORS_JS_STAR, K.CORS_JS_CREDENTIALS, K.JS),
        "DET-18": _row(
            "line", f"{_in(K.JS)} AND {rx('line', K.CORS_HEADER_STAR)}", 4, 1, f"CASE WHEN {creds} THEN 'cors_wildcard_credentials' ELSE 'cors_wildcard' END",
            f"CASE WHEN {creds} THEN 'critical' ELSE 'high' END", "'candidate'", "'low'", "'header'",
        ),
        "DET-19": _row(
            "bare", "repo_id IN (SELECT repo_id FROM flags WHERE supabase_project)", 5, 0, "'rls_disabled'", "'high'", "'candidate'", "'medium'",
            evidence="'CREATE TABLE ' || name_of || ' — ENABLE ROW LEVEL SECURITY not found'",
        ),
        "DET-20": _row("line", f"name IN ('firestore.rules', 'storage.rules') AND {rules} IS NOT NULL", 5, 0, "'firebase_public'", rules, "'candidate'", "'low'", "'rules'"),
        "DET-21": _row("line", f"name IN ('firebase.json', 'database.rules.json') AND {rx('line', K.RTDB_PUBLIC)}", 5, 0, "'firebase_public'", "'critical'", "'candidate'", "'low'", "'realtime'"),
        "DET-22": _row("client", "true", 5, 0, "'supabase_anon_write'", "'medium'", "'candidate'", "'medium'"),
        "DET-23": _row(
            "line", f"{_in(K.JS_DB)} AND NOT comment AND NOT safe AND ({jwt_none} OR {jwt_short})", 5, 1, "'weak_jwt'", f"CASE WHEN {jwt_none} THEN 'critical' ELSE 'high' END",
            "'candidate'", f"CASE WHEN {jwt_none} THEN 'low' ELSE 'medium' END", f"CASE WHEN {jwt_none} THEN 'none' ELSE 'short' END",
        ),
        "DET-24": _row("line", f"{_in(K.PY)} AND NOT comment AND NOT safe AND {jwt_none}", 5, 0, "'weak_jwt'", "'critical'", "'candidate'", "'low'", "'none'"),
        "DET-25": ai(0, "prompt_injection", "medium", f"model_call AND {rx('line', K.PROMPT_ASSIGN)} AND {rx('line', K.UNTRUSTED_INPUT)}", review),
        "DET-26": ai(1, "unsafe_tool_execution", "high", f"{rx('line', K.TOOL_EXEC)} AND {rx('line', K.MODEL_OUTPUT)}"),
        "DET-27": ai(2, "llm_secret_exposure", "high", f"model_context AND {secret_prompt}"),
        "DET-28": ai(3, "agent_memory_poisoning", "medium", f"model_context AND {rx('line', K.MEMORY_WRITE)} AND {rx('line', K.UNTRUSTED_INPUT)}"),
        "DET-29": ai(4, "retrieval_poisoning", "medium", f"retrieval AND model_call AND {rx('line', K.RETRIEVAL)}", review),
        "DET-30": _row("line", f"mcp AND {has('line', K.MCP_KEYS)}", 3, 0, "'mcp_untrusted_server'", "'high'", "'candidate'", "'medium'"),
        "DET-31": _row(
            "line", f"NOT env_file AND ({shape} OR {rx('line', K.SECRET_ASSIGN)}) AND NOT safe AND NOT {rx('line', K.SECRET_PLACEHOLDER)}", 0, 1, "'hardcoded_secret'",
            f"CASE WHEN {shape} THEN 'critical' ELSE 'high' END", "'candidate'", "'low'",
        ),
        "DET-32": _row("env_line", "true", 0, 0, "'committed_env_file'", "'critical'", "'candidate'", "'low'"),
    }
    return helpers, selects


def candidate_ctes(keys=None) -> list[str]:
    helpers, selects = detector_ctes()
    chosen = [selects[k] for k in (keys or selects)]
    every = " UNION ALL ".join(chosen)
    return [*helpers, f"cand AS (SELECT * FROM ({every}) WHERE (repo_id, path) NOT IN (SELECT (repo_id, path) FROM named WHERE ignored))"]


# ------------------------------------------------------------------ repository context
def context_ctes() -> list[str]:
    sample = f"CASE WHEN NOT ignored THEN lower(text) END"

    def count(col: str, values) -> str:
        return " + ".join(f"CAST(bool_or(contains({col}, {q(v)})) AS INTEGER)" for v in values)

    def part(values) -> str:
        return f"((NOT ignored AND list_has_any(string_split(lower(path), '/'), {lst(values)})) OR lower(list_extract(string_split(path, '/'), 1)) IN ({words(values)}))"

    fw = {
        "node": f"in_root AND name IN ({words(K.NODE_ROOT_FILES)})",
        "python": f"in_root AND name IN ({words(K.PYTHON_ROOT_FILES)})",
        "supabase": "NOT ignored AND contains(lower(path), 'supabase')",
        "firebase": "NOT ignored AND name IN ('firebase.json', 'firestore.rules')",
        **{k: f"in_root AND name = 'package.json' AND contains(text, {q(v)})" for k, v in K.NODE_FRAMEWORKS.items()},
        **{k: f"in_root AND name IN ({words(K.PYTHON_ROOT_FILES)}) AND contains(lower(text), {q(k)})" for k in K.PYTHON_FRAMEWORKS},
    }
    fw["nextjs"] = (
        f"({fw['nextjs']}) OR (in_root AND name IN ('next.config.js', 'next.config.ts')) "
        "OR (NOT in_root AND list_extract(string_split(path, '/'), 1) IN ('app', 'pages'))"
    )
    names = "list_filter([" + ", ".join(f"CASE WHEN bool_or({v}) THEN {q(k)} END" for k, v in sorted(fw.items())) + "], lambda x: x IS NOT NULL)"
    local = "list_filter([" + ", ".join(f"CASE WHEN bool_or(contains(sample, {q(w)})) THEN {q(w)} END" for w in K.LOCAL_HINTS) + "], lambda x: x IS NOT NULL)"
    return [
        f"ctx_file AS (SELECT *, NOT contains(path, '/') AS in_root, {sample} AS sample FROM named)",
        f"""ctx_all AS (SELECT repo_id, {names} AS frameworks, bool_or({part(K.INTERNAL_PARTS)}) AS internal_names, bool_or({part(K.AGENT_PARTS)}) AS agent_names,
            bool_or(NOT ignored AND lower(name) IN ({words(K.LIBRARY_FILES)})) AS library_file,
            bool_or(NOT ignored AND lower(name) IN ({words(K.APPLICATION_NAMES)})) AS application_name FROM ctx_file GROUP BY repo_id)""",
        f"""ctx_sample AS (SELECT * FROM ctx_file WHERE NOT ignored)""",
        f"""ctx_heard AS (SELECT repo_id, {count('sample', K.APPLICATION_HINTS)} AS app_words, {count('sample', K.ML_HINTS)} AS ml_words,
            {count('sample', K.FRAMEWORK_TOKENS)} AS fw_words, {local} AS local_network_hints,
            bool_or({has('sample', K.EXPOSURE_HINTS)}) AS exposure, bool_or({has('sample', K.AGENT_WORDS)}) AS agent_words,
            bool_or({has('sample', K.LIBRARY_PHRASES)}) AS phrases, bool_or({has('sample', K.LIBRARY_PACKAGES)}) AS packages,
            list_sort(list_distinct(flatten(list(regexp_extract_all(sample, {q(K.PUBLIC_ROUTE)}, 1))))) AS routes
            FROM ctx_sample GROUP BY repo_id)""",
        f"""ctx_score AS (SELECT *,
            app_words + CASE WHEN len(list_filter(routes, lambda r: {has('r', K.APPLICATION_ROUTES)})) > 0 THEN 2 ELSE 0 END
                + CASE WHEN application_name THEN 1 ELSE 0 END AS app_score,
            fw_words + CASE WHEN list_has_any(frameworks, {lst(K.FRAMEWORK_PACKAGES)}) THEN 2 ELSE 0 END AS framework_score,
            CASE WHEN library_file THEN 1 ELSE 0 END + CASE WHEN packages THEN 2 ELSE 0 END + CASE WHEN phrases THEN 1 ELSE 0 END
                + CASE WHEN list_has_any(frameworks, {lst(K.LIBRARY_PACKAGES)}) THEN 1 ELSE 0 END AS library_score,
            ml_words AS ml_score,
            len(list_filter(routes, lambda r: {has('r', K.SENSITIVE_ROUTE_WORDS)})) > 0 AS sensitive_public_surface
            FROM ctx_all JOIN ctx_heard USING (repo_id))""",
        """ctx_rule AS (SELECT *, exposure AND len(routes) > 0 AS seen_exposed,
            CASE WHEN agent_names AND agent_words THEN 'agent_platform'
                 WHEN app_score >= 2 AND app_score >= ml_score + 1 THEN 'application'
                 WHEN internal_names AND len(local_network_hints) > 0 THEN 'internal_service'
                 WHEN framework_score > 0 AND framework_score >= library_score THEN 'framework'
                 WHEN library_score > 0 THEN 'library'
                 WHEN ml_score > 0 THEN 'ml_platform'
                 WHEN len(routes) > 0 OR len(frameworks) > 0 THEN 'public_application'
                 ELSE 'unknown' END AS rule FROM ctx_score)""",
        "ctx AS (SELECT *, CASE WHEN rule = 'public_application' THEN 'application' ELSE rule END AS kind, "
        "list_filter([CASE WHEN internal_names THEN " + q(K.REASONS["internal"]) + " END, CASE WHEN len(local_network_hints) > 0 THEN " + q(K.REASONS["local"]) + " END, CASE "
        + " ".join(f"WHEN rule = {q(k)} THEN {q(v)}" for k, v in K.REASONS.items() if k not in ("internal", "local"))
        + " END], lambda x: x IS NOT NULL) AS reasons, "
        "seen_exposed OR (rule IN ('application', 'public_application') AND len(routes) > 0) AS external_exposure_proven FROM ctx_rule)",
    ]


# ------------------------------------------------------------------ evidence
def prefilter(category="category", path="path", evidence="evidence", ctx="ctx") -> str:
    secret = f"{category} IN ({words(K.SECRET_LIKE)})"
    reasons = [
        (has(f"lower({path})", K.TEST_PATH_WORDS), "Rejected: the path belongs to tests, examples or documentation."),
        (f"{secret} AND {rx(evidence, K.PLACEHOLDER)}", "Rejected: the value is a placeholder."),
        (f"{secret} AND {rx(evidence, K.CURRENCY)}", "Rejected: the value is an amount of money."),
        (f"{secret} AND {rx(f'replace({ctx}, chr(10), chr(32))', K.PROMPT_NAME)}", "Rejected: the surroundings are prompt or template text."),
        (f"{category} = 'log_injection' AND NOT {rx(evidence, K.ATTACKER_INPUT)}", "Rejected: the log call quotes no attacker-controlled input."),
    ]
    return notes_list(reasons)


def notes_list(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for c, n in pairs) + "], lambda x: x IS NOT NULL)"


def variables(line: str) -> str:
    pct = f"regexp_extract({line}, {q(K.VARIABLES_AFTER_PERCENT)}, 1)"
    names = (
        f"list_concat(list_concat(regexp_extract_all({line}, {q(K.VARIABLES_IN_BRACES)}, 1), CASE WHEN {pct} <> '' THEN [{pct}] ELSE CAST([] AS VARCHAR[]) END), "
        f"regexp_extract_all({line}, {q(K.VARIABLES_AFTER_PLUS)}, 1))"
    )
    return f"list_distinct(list_transform({names}, lambda v: list_extract(string_split(v, '.'), 1)))"


def assigned(evidence: str, ctx: str) -> str:
    test = (
        f"(({rx('l', K.ATTACKER_INPUT)} AND regexp_matches(l, '(?i)\\b' || v || '\\b\\s*=\\s*.+')) "
        "OR regexp_matches(l, '(?i)(?:def|function)\\s+\\w+\\s*\\([^)]*\\b' || v || '\\b'))"
    )
    return f"(len(list_filter(string_split({ctx}, {NL}), lambda l: len(list_filter({variables(evidence)}, lambda v: {test})) > 0)) > 0)"


def sanitized(evidence: str, ctx: str, category: str) -> str:
    every = f"({has(evidence, K.SANITIZER_WORDS)} OR {has(ctx, K.SANITIZER_WORDS)})"
    sql = f"({category} = 'sql_injection' AND ({has(evidence, K.SQL_SANITIZER_WORDS)} OR {has(ctx, K.SQL_SANITIZER_WORDS)}))"
    return f"({every} OR {sql})"


def action(route: str, method: str, category: str) -> str:
    return (
        f"CASE WHEN {route} = '' THEN false WHEN {rx(f'lower({route})', K.INTERNAL_ROUTE)} THEN false WHEN {rx(f'lower({route})', K.SENSITIVE_ROUTE)} THEN true "
        f"WHEN {category} = 'missing_rate_limit' THEN {method} IN ('POST', 'PUT', 'PATCH', 'DELETE') "
        f"WHEN {category} = 'missing_auth' THEN {method} IN ('PUT', 'PATCH', 'DELETE') ELSE false END"
    )


def case_map(col: str, mapping: dict, default: str = "NULL") -> str:
    def value(v):
        return q(v) if isinstance(v, str) else str(v)

    return f"CASE {col} " + " ".join(f"WHEN {q(k)} THEN {value(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


ORD = "(CAST(scanner AS BIGINT) * 100000000 + chk * 10000000 + seq)"


def evidence_ctes() -> list[str]:
    flow, route, ai = f"category IN ({words(K.FLOW)})", f"category IN ({words(K.ROUTE)})", f"category IN ({words(K.AI)})"
    known = f"category IN ({words([*K.LITERAL_PROOF, *K.AI, *K.OTHER_DIRECT])})"
    loose = "category IN ('command_injection', 'path_traversal', 'unsafe_dynamic_code')"
    promotable = f"category IN ({words(K.PROMOTABLE)})"
    exposure = (
        "CASE WHEN route_path = '' THEN false WHEN internal_kind AND NOT external_exposure_proven THEN false WHEN external_exposure_proven THEN true "
        f"WHEN {rx('lower(route_path)', K.INTERNAL_ROUTE)} THEN false "
        f"WHEN {rx('evidence', K.ROUTE_DECORATOR)} AND ({' OR '.join(f'starts_with(lower(route_path), {q(p)})' for p in K.EXPOSED_PREFIXES)}) THEN true "
        f"ELSE ({rx('evidence', K.WEB_HINT)} OR {rx('ctx', K.WEB_HINT)} OR web_hint) AND starts_with(lower(route_path), '/') END"
    )
    score = (
        f"0.30 * CAST({case_map('category', K.PRIOR, str(K.PRIOR_DEFAULT))} AS DOUBLE)"
        + "".join(f" + CASE WHEN {w} THEN CAST({p} AS DOUBLE) ELSE 0 END" for w, p in (("source_present", 0.20), ("sink_present", 0.20), ("path_present", 0.15), ("NOT sanitizer_present", 0.10)))
        + f" - CASE WHEN {rx('evidence', K.PLACEHOLDER)} THEN 0.25 ELSE 0 END"
        + f" - CASE WHEN {rx('evidence', K.CURRENCY)} OR {rx('evidence', K.PROMPT_NAME)} THEN 0.20 ELSE 0 END"
        + f" - CASE WHEN {has('lower(path)', K.TEST_PATH_WORDS)} THEN 0.20 ELSE 0 END"
    )
    cap = f"CASE WHEN category = 'log_injection' THEN 0.74 WHEN {route} AND scanner_status = 'needs_review' THEN 0.69 ELSE 1.0 END"
    impact = "Exploit scenario held back until line-break or parser impact is shown."
    held = f"{route} AND scanner_status <> 'needs_review'"
    complete = "(source_present AND sink_present AND path_present)"
    notes = notes_list(
        [
            (f"category = 'log_injection' AND source_present AND path_present AND NOT sanitizer_present", impact),
            (f"{route} AND internal_kind AND NOT external_exposure_proven", "Route of an internal service: external exposure must be proven first."),
            (ai, "Model-risk candidate: a verifier has to confirm it first."),
            (f"{flow} AND NOT {complete}", "Rejected: source, sink and path are not all proven."),
            (f"{held} AND NOT source_present", "Exposure of the route is not proven; kept for review."),
            (f"{held} AND NOT path_present", "The route's action is not clearly sensitive; kept for review."),
            (ai, "Model-risk finding kept for review until it is proven exploitable."),
        ]
    )
    meaning = case_map("category", {k: v[0] for k, v in TEXTS.items()}, "'A risky construct was found.'")
    return [
        # what surrounds each candidate comes from the lines by a join here
        f"""ev0 AS (SELECT c.* REPLACE (
                CASE WHEN category = 'missing_auth' AND project_auth THEN 'needs_review' ELSE status END AS status,
                CASE WHEN category = 'missing_auth' AND project_auth THEN 'high' ELSE false_positive_risk END AS false_positive_risk),
            coalesce(l.ctx, '') AS ctx, l.web_hint, kind, external_exposure_proven, sensitive_public_surface
            FROM cand c JOIN flags USING (repo_id) JOIN ctx USING (repo_id)
            LEFT JOIN line l ON l.repo_id = c.repo_id AND l.path = c.path AND l.line_no = c.line_number
            WHERE (c.repo_id, c.path) NOT IN (SELECT (repo_id, path) FROM named WHERE ignored))""",
        f"""ev1 AS (SELECT *, status AS scanner_status, evidence = '' OR line_number <= 0 AS no_source, {prefilter()} AS reject_notes,
            {rx('evidence', K.ATTACKER_INPUT)} AS direct, regexp_extract(evidence, {q(K.ROUTE_PATH)}, 1) AS route_path,
            upper(regexp_extract(evidence, {q(K.ROUTE_METHOD)}, 1)) AS route_method, kind IN ('internal_service', 'ml_platform') AS internal_kind FROM ev0)""",
        f"""ev2 AS (SELECT *,
            CASE WHEN {flow} THEN direct OR {assigned('evidence', 'ctx')} WHEN {route} THEN {exposure} ELSE {known} OR ctx <> '' END AS source_present,
            CASE WHEN {flow} THEN true WHEN {route} THEN route_path <> '' ELSE {known} OR ctx <> '' END AS sink_present,
            CASE WHEN {flow} THEN {has('evidence', K.INTERPOLATION_MARKS)} OR ({loose} AND direct) WHEN {route} THEN {action('route_path', 'route_method', 'category')}
                WHEN {ai} THEN evidence <> '' ELSE {known} OR ctx <> '' END AS path_present,
            CASE WHEN {flow} THEN {sanitized('evidence', 'ctx', 'category')} ELSE false END AS sanitizer_present FROM ev1)""",
        f"""ev3 AS (SELECT *,
            CASE WHEN {flow} OR {route} THEN source_present ELSE category IN ({words(K.AI_ATTACKER)}) END AS attacker_controlled,
            CASE WHEN {flow} THEN {promotable} AND source_present AND path_present AND NOT sanitizer_present WHEN {route} THEN source_present AND path_present
                ELSE category IN ({words([*K.LITERAL_EXPLOITABLE, *K.OTHER_DIRECT])}) END AS exploitability_proven,
            no_source OR len(reject_notes) > 0 AS dropped FROM ev2)""",
        f"""ev4 AS (SELECT *, round(greatest(0.0, least({cap}, {score})), 4) AS score,
            CASE WHEN dropped THEN 'rejected' WHEN {flow} AND NOT {complete} THEN 'rejected'
                WHEN {flow} AND {promotable} AND attacker_controlled AND exploitability_proven AND NOT sanitizer_present THEN 'confirmed'
                WHEN {flow} THEN 'candidate'
                WHEN {route} AND scanner_status <> 'needs_review' AND source_present AND path_present THEN 'candidate'
                WHEN {route} OR {ai} THEN 'needs_review' WHEN {known} THEN 'candidate' ELSE 'needs_review' END AS new_status FROM ev3)""",
        f"""evidenced AS (SELECT repo_id,
            sha256(concat_ws(chr(1), repo_id, category, path, CAST(line_number AS VARCHAR), evidence, CAST({ORD} AS VARCHAR))) AS id,
            category AS rule_id, category, new_status AS status, severity,
            CASE WHEN dropped THEN 0.0 WHEN {flow} AND NOT {complete} THEN least(score, 0.45) WHEN {route} AND new_status = 'needs_review' THEN least(score, 0.69)
                WHEN {ai} THEN least(score, 0.55) ELSE score END AS confidence,
            path, line_number, evidence, CAST(CASE WHEN evidence = '' THEN 0 ELSE 1 END AS INTEGER) AS n_refs,
            {', '.join(f'(NOT dropped AND {f}) AS {f}' for f in ('source_present', 'sink_present', 'path_present', 'sanitizer_present', 'attacker_controlled', 'exploitability_proven'))},
            CASE WHEN no_source THEN ['Rejected: no quoted evidence or source line.'] WHEN len(reject_notes) > 0 THEN reject_notes ELSE {notes} END AS note_list,
            {meaning} || CASE WHEN detail = '' THEN '' ELSE ' [' || detail || ']' END || ' At ' || path || ':' || line_number || '.' AS description,
            {case_map('category', K.OWASP)} AS owasp_cat, false_positive_risk, {ORD} AS ord, kind, external_exposure_proven, sensitive_public_surface FROM ev4)""",
    ]


# ------------------------------------------------------------------ findings
PROOF = ["source_present", "sink_present", "path_present", "sanitizer_present", "attacker_controlled", "exploitability_proven"]
SEV = case_map("severity", {s: i for i, s in enumerate(K.SEVERITIES)})
STA = case_map("status", {s: i for i, s in enumerate(K.STATUSES)})
FOUND_ORDER = "ord // 100000000, lower(path), path, ord // 10000000, line_number, ord, evidence, id"
REPORT_ORDER = f"{SEV} DESC, {STA} DESC, round(confidence, 4) DESC, {FOUND_ORDER}"


def downgrade(source: str, name: str) -> list[str]:
    """Context rule over a relation with kind, exposure, surface and note_list."""
    inward = "(kind IN ('internal_service', 'ml_platform') AND NOT external_exposure_proven)"
    packaged = "(kind IN ('library', 'framework') AND NOT (external_exposure_proven AND sensitive_public_surface))"
    hit = f"(category IN ({words(K.ROUTE)}) AND (({inward} AND status = 'confirmed') OR ({packaged} AND NOT {inward} AND status IN ('confirmed', 'candidate'))))"
    note = f"'Rated lower, as this is a ' || kind || CASE WHEN {inward} THEN ' that nothing shows to be reachable from outside.' ELSE ' without both a public route and a sensitive action.' END"
    return [
        f"{name}_hit AS (SELECT *, {hit} AS hit, {note} AS new_note FROM {source})",
        f"""{name} AS (SELECT * REPLACE (CASE WHEN hit THEN 'needs_review' ELSE status END AS status,
            CASE WHEN hit THEN least(CASE WHEN confidence = 0 THEN 1.0 ELSE confidence END, 0.49) ELSE confidence END AS confidence,
            CASE WHEN hit THEN 'high' ELSE false_positive_risk END AS false_positive_risk,
            CASE WHEN hit AND severity IN ('high', 'critical') THEN 'medium' ELSE severity END AS severity,
            CASE WHEN hit AND NOT list_contains(note_list, new_note) THEN list_append(note_list, new_note) ELSE note_list END AS note_list) FROM {name}_hit)""",
    ]


def scored(source: str, name: str = "scored") -> list[str]:
    """Risk score per repository by the plain definition: every finding at its place."""
    weight = case_map("severity", K.SEVERITY_WEIGHT)
    mult = case_map("status", K.STATUS_MULTIPLIER, "0.25")
    return [
        f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, category ORDER BY {REPORT_ORDER}) - 1 AS position FROM {source} WHERE status <> 'rejected')""",
        f"""{name}_s AS (SELECT repo_id, sum({weight} * CAST({mult} AS DOUBLE) * CASE WHEN category IN ({words(K.AI)}) AND NOT exploitability_proven THEN {K.UNPROVEN_AI_FACTOR} ELSE 1 END
            * greatest({K.SATURATION_FLOOR}, 1.0 / (1.0 + position * {K.SATURATION_STEP}))) AS raw, count(*) AS n_findings FROM {name}_r GROUP BY repo_id)""",
        f"{name} AS (SELECT repo_id, CAST(least(100, floor(round(raw, 6))) AS INTEGER) AS risk_score, n_findings FROM {name}_s)",
    ]


VERDICT = "CASE WHEN risk_score = 0 THEN 'CLEAN' WHEN risk_score <= 15 THEN 'LOW' WHEN risk_score <= 35 THEN 'MEDIUM' WHEN risk_score <= 65 THEN 'HIGH' ELSE 'CRITICAL' END"


def final(source: str, name: str = "final") -> list[str]:
    """Final scoring over a relation without rejected rows, with attack_chain."""
    vec = K.CVSS_BY_CATEGORY
    sql_p, sql_u, cmd, log, sec_c, sec_o, jwt_n, jwt_o, slop = (vec[k] for k in vec)
    secret = "category IN ('hardcoded_secret', 'committed_env_file')"
    none = "contains(lower(evidence), 'none')"
    cases = [
        ("category = 'sql_injection' AND exploitability_proven", sql_p), ("category = 'sql_injection'", sql_u), ("category = 'command_injection'", cmd),
        ("category = 'log_injection'", log), (f"{secret} AND severity = 'critical'", sec_c), (secret, sec_o), (f"category = 'weak_jwt' AND {none}", jwt_n),
        ("category = 'weak_jwt'", jwt_o), ("category = 'slopsquatting'", slop),
        *[(f"severity = {q(s)}", (None, n, v)) for s, (n, v) in K.CVSS_BY_SEVERITY.items()],
    ]

    def pick_(i, default):
        return f"CASE WHEN status <> 'confirmed' THEN {default} " + " ".join(
            f"WHEN {w} THEN {default if o[i] is None else q(o[i]) if isinstance(o[i], str) else o[i]}" for w, o in cases
        ) + " END"

    say = (
        "CASE WHEN category = 'sql_injection' THEN 'attacker-controlled input reaches a SQL statement that binds no parameters' "
        "WHEN category = 'command_injection' THEN 'attacker-controlled input reaches a shell command' "
        f"WHEN category = 'weak_jwt' AND {none} THEN 'the signature of tokens is not checked' END"
    )
    chain = (
        f"CASE WHEN status <> 'confirmed' OR category = 'log_injection' THEN '' WHEN exploitability_proven AND {say} IS NOT NULL THEN "
        f"'Confirmed exploitability: ' || {say} || '. Evidence is quoted at ' || path || ':' || line_number || '.' "
        f"WHEN category = 'weak_jwt' AND {none} THEN '' ELSE attack_chain END"
    )
    return [
        f"""{name} AS (SELECT * REPLACE ({pick_(0, 'severity')} AS severity, {chain} AS attack_chain),
            CAST({pick_(1, 'NULL')} AS DOUBLE) AS cvss_score, {pick_(2, 'NULL')} AS cvss_vector FROM {source})""",
    ]
