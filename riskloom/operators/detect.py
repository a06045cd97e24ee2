"""Detectors: files in, candidate findings out.

One pass over the files table.  File-wide signals are boolean columns; only lines
that hold one of a detector's key words leave the line array, so neither text nor
lines travel past the first explode.  A detector maps a line to an outcome number;
what the outcome means (category, severity, ...) is looked up once per candidate.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions import paths as P
from riskloom.functions import sqltext as Q
from riskloom.functions import text as X
from riskloom.model import CANDIDATE_FIELDS, FLOW, SCANNERS
from riskloom.operators.pyfacts import python_facts
from riskloom.plans.staging import stage

# ------------------------------------------------------------------ file signals
_CHECKED = "NOT generated"
_AI_CODE = Q.all_of(Q.among("suffix", K.AI_CODE), _CHECKED)


def _text(pattern: str, words: list[str]) -> str:
    """Pattern over the whole text, tried only where one of the words occurs in ``low``."""
    return Q.all_of(Q.has("low", words), Q.matches("text", pattern))


# file-wide booleans over the columns path, suffix, name, generated, text and low; the
# later ones build on the earlier ones
SIGNALS: dict[str, str] = {
    "f_auth_py": Q.any_of(
        Q.has("text", K.AUTH_WORDS_PY), _text(K.ROUTER_AUTH_PY, ["dependencies", "add_middleware", "@app.middleware"])
    ),
    "f_auth_js": Q.any_of(
        Q.has("text", K.AUTH_WORDS_JS), _text(K.ROUTER_AUTH_JS, [".use(", "withauth", "next-auth/middleware", "clerkmiddleware"])
    ),
    "f_limit_py": Q.any_of(
        Q.has("text", K.LIMIT_WORDS_PY),
        _text(K.ROUTER_LIMIT_PY, ["@limiter.limit", "add_middleware", "dependencies", "@app.middleware"]),
    ),
    "f_limit_js": Q.any_of(
        Q.has("text", K.LIMIT_WORDS_JS), _text(K.ROUTER_LIMIT_JS, [".use(", "express-rate-limit", "throttler"])
    ),
    "f_auth_project": Q.all_of(_CHECKED, Q.has("lower(path)", K.AUTH_PROJECT_PATHS), "(f_auth_py OR f_auth_js)"),
    "f_limit_project": Q.all_of(_CHECKED, Q.has("lower(path)", K.LIMIT_PROJECT_PATHS), "(f_limit_py OR f_limit_js)"),
    "f_supabase": Q.any_of(
        "contains(lower(path), 'supabase')",
        Q.all_of(Q.among("name", K.DEPENDENCY_FILES), "contains(low, 'supabase')"),
        Q.all_of(
            Q.any_of(Q.among("suffix", K.CONFIG_SUFFIXES), Q.is_env_file("path")),
            Q.has("text", ["SUPABASE_URL", "SUPABASE_ANON_KEY"]),
        ),
        Q.all_of("suffix = '.sql'", Q.matches("text", K.SUPABASE_SQL)),
    ),
    "f_model_call": Q.all_of(_AI_CODE, Q.has("low", K.MODEL_CALL_WORDS)),
    "f_retrieval": Q.all_of(_AI_CODE, Q.has("low", K.RETRIEVAL_WORDS)),
    "f_sensitive": Q.all_of(_AI_CODE, "(f_model_call OR f_retrieval)", Q.matches("text", K.SENSITIVE_DATA)),
    "f_model_context": Q.any_of(
        "f_model_call",
        "f_retrieval",
        Q.all_of(
            _AI_CODE,
            Q.any_of(Q.has("low", K.MODEL_OUTPUT_WORDS), _text(K.PROMPT_ASSIGN, ["prompt", "messages", "instructions"])),
        ),
    ),
    "f_handler": Q.all_of(
        Q.matches("lower(path)", r"^app/api/.*/route\.(?:ts|js)$"), Q.matches("text", K.HANDLER_EXPORT)
    ),
    "f_python_routes": Q.all_of("suffix = '.py'", _CHECKED, "contains(text, '@')", Q.matches("text", K.AUTH_ROUTE_PY)),
    "f_mcp": Q.all_of(
        "suffix = '.json'",
        _CHECKED,
        "contains(text, 'mcpServers')",
        "coalesce(array_contains(json_object_keys(text), 'mcpServers'), false)",
        "try_parse_json(text) IS NOT NULL",
    ),
    "f_anon_client": Q.all_of(
        Q.among("suffix", K.JS_DB),
        "contains(text, 'createClient')",
        Q.matches("text", K.CLIENT_CALL),
        Q.matches("text", K.ANON_KEY),
        Q.matches("text", K.WRITE_CALL),
    ),
    "f_web_hint": Q.all_of(
        Q.has("text", ["FastAPI", "APIRouter", "Flask", "Blueprint", "django.urls", "path("]),
        Q.matches("text", K.WEB_HINT),
    ),
}
# signals made of other signals
_NEEDS = {
    "f_auth_project": ["f_auth_py", "f_auth_js"],
    "f_limit_project": ["f_limit_py", "f_limit_js"],
    "f_sensitive": ["f_model_call", "f_retrieval"],
    "f_model_context": ["f_model_call", "f_retrieval"],
}
REPO_SIGNALS = ["f_auth_project", "f_limit_project", "f_supabase"]


def with_file_columns(files: DataFrame, signals: Iterable[str] | None = None) -> DataFrame:
    """Add name, suffix, generated, lines and the requested file-wide signals."""
    base = files.withColumns(
        {
            "name": P.file_name(F.col("path")),
            "suffix": P.suffix(F.col("path")),
            "generated": P.is_generated(F.col("path")),
        }
    )
    wanted = set(SIGNALS if signals is None else signals)
    below = {n for s in wanted for n in _NEEDS.get(s, [])} | {s for s in wanted if s not in _NEEDS}
    base = base.withColumns({"low": F.lower("text"), "lines": X.split_lines(F.col("text"))})
    base = base.withColumns({s: F.expr(SIGNALS[s]) for s in SIGNALS if s in below})
    return base.withColumns({s: F.expr(SIGNALS[s]) for s in SIGNALS if s in wanted and s in _NEEDS})


# ------------------------------------------------------------------ outcomes
@dataclass(frozen=True)
class Outcome:
    """What a detector reports; ``evidence`` is 'line' or 'handler' or comes with a block."""

    scanner: str
    chk: int
    category: str
    severity: str
    status: str
    risk: str
    detail: str = ""
    seq: int = 0
    evidence: str = "line"


OUTCOMES: list[Outcome] = []


def outcome(*args, **kwargs) -> int:
    """Number of an outcome, which is added where it is new."""
    new = Outcome(*args, **kwargs)
    if new not in OUTCOMES:
        OUTCOMES.append(new)
    return OUTCOMES.index(new)


# the files a line detector reads
SCOPES: dict[str, str] = {
    "py": Q.among("suffix", K.PY),
    "js": Q.among("suffix", K.JS),
    "js_db": Q.among("suffix", K.JS_DB),
    "own_py": Q.all_of(Q.among("suffix", K.PY), _CHECKED),
    "own_js": Q.all_of(Q.among("suffix", K.JS), _CHECKED),
    "ai": _AI_CODE,
    "json": "suffix = '.json'",
    "rules": Q.among("name", ["firestore.rules", "storage.rules"]),
    "realtime": Q.among("name", ["firebase.json", "database.rules.json"]),
    "not_env": f"NOT {Q.is_env_file('path')}",
}


@dataclass(frozen=True)
class LineDetector:
    """Looks at one line plus file-wide signals.  The first case that holds wins.

    ``words``: lower-case words of which a line must hold one to be looked at.
    """

    key: str
    scope: str
    words: list[str]
    keep: str
    cases: list[tuple[str, int]]
    signals: list[str] = field(default_factory=list)

    def sql(self) -> str:
        whens = " ".join(f"WHEN {condition} THEN {number}" for condition, number in self.cases)
        return f"CASE WHEN {SCOPES[self.scope]} AND {self.keep} THEN CASE {whens} END END"


def _rule(pattern: str, words: list[str]) -> str:
    return Q.all_of(Q.has("lowered", words), Q.matches("line", pattern))


def _injection(key: str, chk: int, scope: str, rules, category: str, severity: str, risk: str, keep="NOT comment", labels=False) -> LineDetector:
    cases = []
    for label, pattern, words in rules:
        detail = label if labels else ""
        if category == "log_injection":
            loud = outcome("injection", chk, category, severity, "candidate", risk)
            quiet = outcome("injection", chk, category, severity, "needs_review", risk)
            cases.append((Q.all_of(_rule(pattern, words), Q.matches("line", K.CRLF_SIGNAL)), loud))
            cases.append((_rule(pattern, words), quiet))
        else:
            cases.append((_rule(pattern, words), outcome("injection", chk, category, severity, "candidate", risk, detail)))
    every = sorted({w for _, _, words in rules for w in words})
    return LineDetector(key, scope, every, keep, cases)


def _extract(pattern: str) -> str:
    return f"regexp_extract(line, {Q.lit(pattern)}, 1)"


# lower-case routes and methods of a line, taken out once for all tests on them
_LINE_COLUMNS = {
    "comment": Q.matches("stripped", "^(?:#|//|[*])"),
    "safe": Q.has("line", K.SAFE_REFERENCES),
    "auth_route": f"CASE WHEN suffix = '.py' AND contains(line, '@') THEN lower({_extract(K.AUTH_ROUTE_PY)}) "
    f"WHEN {Q.among('suffix', K.JS)} AND {Q.has('line', ['router', 'app', 'server'])} THEN lower({_extract(K.AUTH_ROUTE_JS)}) ELSE '' END",
    "limit_route": f"CASE WHEN suffix = '.py' AND contains(line, '@') THEN lower({_extract(K.LIMIT_ROUTE_PY)}) "
    f"WHEN {Q.among('suffix', K.JS)} AND {Q.has('lowered', ['router', 'app', 'server'])} THEN lower({_extract(K.LIMIT_ROUTE_JS)}) ELSE '' END",
    "method": f"IF(contains(lowered, 'export'), upper({_extract(K.HANDLER_EXPORT)}), '')",
}
_HANDLER_ROUTE = Q.handler_route("path")
_AUTH_OPEN = ("auth", "missing_auth", "critical", "needs_review", "medium")
SECRET_IN_PROMPT = Q.all_of(
    Q.matches("line", K.SECRET_NEAR_PROMPT),
    Q.matches("line", K.SECRET_SOURCE),
    Q.has("line", K.PROMPT_WORDS),
    Q.has("line", K.ASSIGN_MARKS),
)


def _auth(chk: int, evidence: str = "line") -> int:
    return outcome("auth", chk, "missing_auth", "critical", "needs_review", "medium", evidence=evidence)


def _limit(chk: int, evidence: str = "line") -> int:
    return outcome("rate_limit", chk, "missing_rate_limit", "medium", "needs_review", "medium", evidence=evidence)


def _ai(seq: int, category: str, severity: str, status: str = "candidate") -> int:
    return outcome("ai", 0, category, severity, status, "medium", seq=seq)


_JWT_QUIET = "NOT comment AND NOT safe"

LINE_DETECTORS: list[LineDetector] = [
    _injection("DET-01", 0, "py", K.PY_SQL, "sql_injection", "critical", "low", labels=True),
    _injection("DET-02", 0, "js", K.JS_SQL, "sql_injection", "critical", "low", labels=True),
    _injection("DET-03", 1, "py", K.PY_LOG, "log_injection", "high", "medium"),
    _injection("DET-04", 1, "js", K.JS_LOG, "log_injection", "high", "medium"),
    _injection("DET-05", 2, "py", K.PY_CMD, "command_injection", "critical", "low"),
    _injection("DET-06", 2, "js", K.JS_CMD, "command_injection", "critical", "low"),
    _injection("DET-07", 3, "js", K.JS_DYNAMIC, "unsafe_dynamic_code", "high", "low"),
    _injection("DET-08", 4, "js", K.JS_PATH, "path_traversal", "high", "medium", keep=f"NOT comment AND NOT {Q.matches('line', K.PATH_SANITIZER)}"),
    LineDetector("DET-10", "own_py", ["@"], "f_python_routes AND NOT f_auth_py AND NOT py_parses", [(Q.high_risk("auth_route"), _auth(0))], ["f_python_routes", "f_auth_py"]),
    LineDetector("DET-11", "own_js", ["router", "app", "server"], "NOT f_auth_js", [(Q.high_risk("auth_route"), _auth(2))], ["f_auth_js"]),
    LineDetector("DET-12", "own_js", ["export"], "f_handler AND NOT f_auth_js AND method != ''", [(Q.high_risk("file_route"), _auth(1, "handler"))], ["f_handler", "f_auth_js"]),
    LineDetector("DET-13", "own_py", ["@"], "NOT f_limit_py", [(Q.rate_limited_route("limit_route"), _limit(0))], ["f_limit_py"]),
    LineDetector("DET-14", "own_js", ["router", "app", "server"], "NOT f_limit_js", [(Q.rate_limited_route("limit_route"), _limit(1))], ["f_limit_js"]),
    LineDetector(
        "DET-15", "own_js", ["export"], "f_handler AND NOT f_limit_js AND method IN ('POST', 'PUT', 'PATCH', 'DELETE')",
        [(Q.rate_limited_route("file_route"), _limit(0, "handler"))], ["f_handler", "f_limit_js"],
    ),
    LineDetector(
        "DET-18", "js", ["access-control-allow-origin"], Q.matches("line", K.CORS_HEADER_STAR),
        [
            (Q.matches("near", K.CORS_HEADER_CREDENTIALS), outcome("cors", 1, "cors_wildcard_credentials", "critical", "candidate", "low", "header")),
            ("true", outcome("cors", 1, "cors_wildcard", "high", "candidate", "low", "header")),
        ],
    ),
    LineDetector(
        "DET-20", "rules", ["allow"], "true",
        [
            (Q.matches("line", K.RULES_READ_WRITE), outcome("database", 0, "firebase_public", "critical", "candidate", "low", "rules")),
            (Q.matches("line", K.RULES_READ), outcome("database", 0, "firebase_public", "high", "candidate", "low", "rules")),
            (Q.matches("line", K.RULES_WRITE), outcome("database", 0, "firebase_public", "critical", "candidate", "low", "rules")),
        ],
    ),
    LineDetector("DET-21", "realtime", ['".read"', '".write"'], "true", [(Q.matches("line", K.RTDB_PUBLIC), outcome("database", 0, "firebase_public", "critical", "candidate", "low", "realtime"))]),
    LineDetector(
        "DET-23", "js_db", ["algorithm", "sign"], _JWT_QUIET,
        [
            (Q.matches("line", K.JWT_NONE), outcome("database", 1, "weak_jwt", "critical", "candidate", "low", "none")),
            (f"{Q.matches('line', K.JWT_SHORT)} AND NOT {Q.matches('line', K.JWT_SHORT_ENV)}", outcome("database", 1, "weak_jwt", "high", "candidate", "medium", "short")),
        ],
    ),
    LineDetector("DET-24", "py", ["algorithm"], _JWT_QUIET, [(Q.matches("line", K.JWT_NONE), outcome("database", 0, "weak_jwt", "critical", "candidate", "low", "none"))]),
    LineDetector(
        "DET-25", "ai", ["prompt", "messages", "instructions"],
        Q.all_of("f_model_call", "NOT comment", Q.matches("line", K.PROMPT_ASSIGN), Q.matches("line", K.UNTRUSTED_INPUT)),
        [("f_sensitive", _ai(0, "prompt_injection", "medium")), ("true", _ai(0, "prompt_injection", "medium", "needs_review"))],
        ["f_model_call", "f_sensitive"],
    ),
    LineDetector(
        "DET-26", "ai", ["llm_response", "model_output", "assistant_message", "completion", "response.choices"], "NOT comment",
        [(Q.all_of(Q.matches("line", K.TOOL_EXEC), Q.matches("line", K.MODEL_OUTPUT)), _ai(1, "unsafe_tool_execution", "high"))],
    ),
    LineDetector("DET-27", "ai", ["prompt", "message", "instruction"], "f_model_context AND NOT comment", [(SECRET_IN_PROMPT, _ai(2, "llm_secret_exposure", "high"))], ["f_model_context"]),
    LineDetector(
        "DET-28", "ai", ["memory.", "vectorstore.add", "add_documents(", "upsert(", "insert("], "f_model_context AND NOT comment",
        [(Q.all_of(Q.matches("line", K.MEMORY_WRITE), Q.matches("line", K.UNTRUSTED_INPUT)), _ai(3, "agent_memory_poisoning", "medium"))], ["f_model_context"],
    ),
    LineDetector(
        "DET-29", "ai", ["similarity_search", "retriever", "vectorstore"],
        Q.all_of("f_retrieval", "f_model_call", "NOT comment", Q.matches("line", K.RETRIEVAL)),
        [("f_sensitive", _ai(4, "retrieval_poisoning", "medium")), ("true", _ai(4, "retrieval_poisoning", "medium", "needs_review"))],
        ["f_retrieval", "f_model_call", "f_sensitive"],
    ),
    LineDetector("DET-30", "json", K.MCP_KEYS, "f_mcp", [(Q.has("line", K.MCP_KEYS), outcome("ai", 0, "mcp_untrusted_server", "high", "candidate", "medium"))], ["f_mcp"]),
    LineDetector(
        "DET-31", "not_env", ["sk-", "ghp_", "xox", "akia", "key", "secret", "token", "passw"], f"NOT safe AND NOT {Q.matches('line', K.SECRET_PLACEHOLDER)}",
        [
            (Q.matches("line", K.SECRET_SHAPE), outcome("secrets", 1, "hardcoded_secret", "critical", "candidate", "low")),
            (Q.matches("line", K.SECRET_ASSIGN), outcome("secrets", 1, "hardcoded_secret", "high", "candidate", "low")),
        ],
    ),
]


# ------------------------------------------------------------------ whole-text detectors
BLOCK = "struct<outcome:int,line_no:int,evidence:string,seq:int>"
_NO_BLOCK = f"CAST(array() AS array<{BLOCK}>)"


@dataclass(frozen=True)
class FileDetector:
    """Looks at a whole text; its expression yields an array of blocks."""

    key: str
    sql: str
    signals: list[str] = field(default_factory=list)
    python: bool = False


def _block(number, line: str, evidence: str, seq: str = "0") -> str:
    return f"named_struct('outcome', {number}, 'line_no', {line}, 'evidence', {evidence}, 'seq', {seq})"


def _first_line(where: str, line_test: str, number: int) -> str:
    numbered = "transform(lines, (l, i) -> named_struct('n', i + 1, 'l', l))"
    hits = f"slice(filter({numbered}, h -> {line_test}), 1, 1)"
    evidence = Q.strip("h.l")
    return f"CASE WHEN {where} THEN transform({hits}, h -> {_block(number, 'h.n', evidence)}) ELSE {_NO_BLOCK} END"


def _cors(kind: str, suffixes, pattern: str, star: str, credentials: str) -> str:
    both = outcome("cors", 0, "cors_wildcard_credentials", "critical", "candidate", "low", "block", evidence="block")
    open_ = outcome("cors", 0, "cors_wildcard", "high", "candidate", "low", "block", evidence="block")
    inner = f"regexp_extract(m.match, {Q.lit(pattern)}, 1)"
    loose = Q.matches(inner, credentials)
    blocks = f"filter({Q.match_lines('text', pattern)}, m -> {Q.matches(inner, star)})"
    evidence = f"IF({loose}, {Q.lit(K.CORS_EVIDENCE[kind, True])}, {Q.lit(K.CORS_EVIDENCE[kind, False])})"
    made = f"transform({blocks}, m -> {_block(f'IF({loose}, {both}, {open_})', 'm.line', evidence)})"
    return f"CASE WHEN {Q.among('suffix', suffixes)} AND {Q.matches('text', pattern)} THEN {made} ELSE {_NO_BLOCK} END"


def _rls() -> str:
    found = outcome("database", 0, "rls_disabled", "high", "candidate", "medium", evidence="block")
    name = f"lower(regexp_extract(m.match, {Q.lit(K.CREATE_TABLE)}, 1))"
    made = f"transform({Q.match_lines('text', K.CREATE_TABLE)}, m -> named_struct('t', {name}, 'n', m.line))"
    own = f"array_sort(filter({made}, c -> NOT {Q.among('c.t', K.SYSTEM_TABLES)}))"
    enabled = f"transform(regexp_extract_all(text, {Q.lit(K.RLS_ALTER)}, 1), e -> lower(e))"
    # a repeated name counts once, with its last line; the one-element transforms bind a value once
    last = "filter(o, (c, i) -> get(o, i + 1) IS NULL OR get(o, i + 1).t != c.t)"
    # fixed format of the evidence text
    evidence = "concat('CREATE TABLE ', c.t, ' — ENABLE ROW LEVEL SECURITY not found')"
    # the enabled tables are looked up once per file, not once per created table
    open_ = f"transform(filter(u, c -> NOT array_contains(on, c.t)), c -> {_block(found, 'c.n', evidence)})"
    bare = f"get(transform(array({enabled}), on -> {open_}), 0)"
    result = (
        f"get(transform(transform(array({own}), o -> {last}), "
        f"u -> IF(size(u) = 1 AND {Q.matches('text', K.RLS_ANY)}, {_NO_BLOCK}, {bare})), 0)"
    )
    return f"CASE WHEN suffix = '.sql' AND {Q.matches('text', K.CREATE_TABLE)} THEN {result} ELSE {_NO_BLOCK} END"


def _ast_routes() -> str:
    risky = outcome("auth", 0, "missing_auth", "critical", "candidate", "medium", evidence="block")
    write = outcome("auth", 0, "missing_auth", "medium", "needs_review", "medium", evidence="block")
    changes = "coalesce(r.method IN ('POST', 'PUT', 'DELETE', 'PATCH'), false)"
    # fixed format of the evidence text
    evidence = "concat('@', coalesce(r.method, 'route'), '(\\'', r.route, '\\') - no auth')"
    made = (
        f"transform(filter(py.routes, r -> NOT r.guarded AND ({Q.high_risk('lower(r.route)')} OR {changes})), "
        f"r -> {_block(f'IF({Q.high_risk('lower(r.route)')}, {risky}, {write})', 'r.line', evidence, 'r.seq')})"
    )
    return f"CASE WHEN f_python_routes AND NOT f_auth_py AND py.routes IS NOT NULL THEN {made} ELSE {_NO_BLOCK} END"


FILE_DETECTORS: list[FileDetector] = [
    FileDetector("DET-09", _ast_routes(), ["f_python_routes", "f_auth_py"], python=True),
    FileDetector("DET-16", _cors("py", K.PY, K.CORS_PY_BLOCK, K.CORS_PY_STAR, K.CORS_PY_CREDENTIALS)),
    FileDetector("DET-17", _cors("js", K.JS, K.CORS_JS_BLOCK, K.CORS_JS_STAR, K.CORS_JS_CREDENTIALS)),
    FileDetector("DET-19", _rls()),
    FileDetector(
        "DET-22",
        _first_line("f_anon_client", Q.matches("h.l", K.CLIENT_CALL), outcome("database", 0, "supabase_anon_write", "medium", "candidate", "medium", evidence="block")),
        ["f_anon_client"],
    ),
    FileDetector(
        "DET-32",
        _first_line(
            Q.is_env_file("path"),
            Q.all_of(Q.matches("h.l", K.ENV_SECRET_KEY), f"NOT {Q.matches(Q.strip('h.l'), '^(?:#|//|[*])')}", f"NOT {Q.matches('h.l', K.SECRET_PLACEHOLDER)}"),
            outcome("secrets", 0, "committed_env_file", "critical", "candidate", "low", evidence="block"),
        ),
    ),
]

DETECTOR_KEYS = sorted([d.key for d in LINE_DETECTORS] + [d.key for d in FILE_DETECTORS])


def _select(keys: Iterable | None) -> tuple[list[LineDetector], list[FileDetector]]:
    """Detectors by key; detectors of one's own may stand among the keys.

    A rule of one's own is a LineDetector or FileDetector whose cases name outcomes made
    with ``outcome``.
    """
    chosen = list(DETECTOR_KEYS if keys is None else keys)
    own = [k for k in chosen if not isinstance(k, str)]
    wanted = {k for k in chosen if isinstance(k, str)}
    lines = [d for d in LINE_DETECTORS if d.key in wanted] + [d for d in own if isinstance(d, LineDetector)]
    return lines, [d for d in FILE_DETECTORS if d.key in wanted] + [d for d in own if isinstance(d, FileDetector)]


# ------------------------------------------------------------------ the pass
ITEM = f"struct<line_no:int,line:string,ctx:string,near:string,flows:array<{FLOW}>,ready:{BLOCK}>"
_FLOW_WORDS = ["execute", ".raw", "subprocess.", "os.system", "os.popen", "eval(", "exec(", "logger.", "logging.", "print"]


def read_files(files: DataFrame) -> DataFrame:
    """The files that a scan reads."""
    return files if "ignored" in files.columns else files.filter(~P.is_ignored(F.col("path")))


def file_items(
    files: DataFrame,
    keys: Iterable[str] | None = None,
    *,
    context: bool = False,
    flows: bool = False,
    keep: Iterable[str] = (),
    carry: Iterable[str] = (),
) -> DataFrame:
    """One row per file: its signals and ``items``, the lines and blocks worth a look.

    ``files`` holds (repo_id, path, text).  Paths outside a scan are left out here, unless
    ``ignored`` marks them for the caller.  With ``context`` an item carries the lines
    around it, so that the evidence step needs no join.  With ``flows`` each Python file
    is parsed once and its data flows are attached to the lines they end on.
    """
    line_dets, file_dets = _select(keys)
    signals = sorted({s for d in [*line_dets, *file_dets] for s in d.signals} | set(keep))
    df = with_file_columns(read_files(files), signals)

    needs_tree = flows or any(d.python for d in file_dets) or any(d.key == "DET-10" for d in line_dets)
    if needs_tree:
        reasons = (["f_python_routes"] if "f_python_routes" in signals else []) + ([Q.has("text", _FLOW_WORDS)] if flows else [])
        wanted = F.expr(Q.all_of("suffix = '.py'", Q.any_of(*reasons)))
        df = df.withColumn("py", python_facts(F.col("text"), F.col("path"), wanted, flows=flows))
        df = df.withColumn("py_parses", F.coalesce(F.col("py.parses"), F.lit(True)))

    headers = any(d.key == "DET-18" for d in line_dets)

    def item(line_no: str, line: str, ready: str) -> str:
        window = K.EVIDENCE_WINDOW
        ctx = Q.frame("lines", line_no, window, window) if context else "CAST(NULL AS string)"
        near = Q.frame("lines", line_no, 2, 3) if headers else "CAST(NULL AS string)"
        nothing = f"CAST(array() AS array<{FLOW}>)"
        ends = f"coalesce(filter(py.flows, f -> f.line = {line_no}), {nothing})" if flows else nothing
        return f"named_struct('line_no', {line_no}, 'line', {line}, 'ctx', {ctx}, 'near', {near}, 'flows', {ends}, 'ready', {ready})"

    parts = []
    if line_dets:
        words: dict[str, set[str]] = {}
        for d in line_dets:
            words.setdefault(d.scope, set()).update(d.words)

        def worth(lowered: str) -> str:
            return Q.any_of(*[Q.all_of(SCOPES[s], Q.has(lowered, sorted(w))) for s, w in words.items()])

        # the lower-case form is kept beside the line, so that it is made once
        numbered = "transform(lines, (l, i) -> named_struct('n', i + 1, 'l', l, 'w', lower(l)))"
        hits = f"filter({numbered}, h -> {worth('h.w')})"
        made = f"transform({hits}, h -> {item('h.n', 'h.l', f'CAST(NULL AS {BLOCK})')})"
        parts.append(f"CASE WHEN {worth('low')} THEN {made} ELSE CAST(array() AS array<{ITEM}>) END")
    for d in file_dets:
        parts.append(f"transform({d.sql}, b -> {item('b.line_no', 'CAST(NULL AS string)', 'b')})")
    items = F.expr(parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})")
    columns = ["repo_id", "path", "name", "suffix", "generated", *signals, *carry]
    if needs_tree:
        columns.append("py_parses")
    return df.select(*columns, items.alias("items"))


def _outcome_table() -> str:
    rows = [
        f"named_struct('scanner', {SCANNERS.index(o.scanner)}, 'chk', {o.chk}, 'seq', {o.seq}, 'category', {Q.lit(o.category)}, "
        f"'severity', {Q.lit(o.severity)}, 'status', {Q.lit(o.status)}, 'risk', {Q.lit(o.risk)}, 'detail', {Q.lit(o.detail)}, "
        f"'handler', {str(o.evidence == 'handler').lower()})"
        for o in OUTCOMES
    ]
    return f"array({', '.join(rows)})"


def candidates_from_items(items: DataFrame, keys: Iterable[str] | None = None, carry: Iterable[str] = ()) -> DataFrame:
    """Explode the items and run the line detectors on them."""
    line_dets, _ = _select(keys)
    # the outer form: for the plain one Spark adds a filter on the size of the array, and
    # pushes it down to where the whole items expression would be computed a second time
    rows = items.withColumn("item", F.explode_outer("items")).drop("items").filter(F.col("item").isNotNull())
    rows = rows.select("*", "item.*").drop("item").withColumns(
        {"lowered": F.lower("line"), "stripped": X.strip(F.col("line"))}
    )
    rows = rows.withColumns({n: F.expr(t) for n, t in _LINE_COLUMNS.items()})
    rows = rows.withColumn("file_route", F.expr(f"lower({_HANDLER_ROUTE})"))
    tried = ", ".join(d.sql() for d in line_dets)
    found = f"CASE WHEN ready IS NULL THEN array_compact(array({tried})) ELSE array(ready.outcome) END" if line_dets else "array(ready.outcome)"
    out = rows.withColumn("number", F.explode(F.expr(found)))
    out = out.withColumn("o", F.expr(f"element_at({_outcome_table()}, number + 1)"))
    # fixed format of the evidence text of a file-based handler
    handler = f"concat('export async function ', method, '(\\'', {_HANDLER_ROUTE}, '\\')')"
    evidence = f"CASE WHEN ready IS NOT NULL THEN ready.evidence WHEN o.handler THEN {handler} ELSE stripped END"
    values = {
        "seq": "o.seq + coalesce(ready.seq, 0)",
        "line_number": "line_no",
        "evidence": evidence,
        "false_positive_risk": "o.risk",
    }
    return out.select(
        "repo_id", "path", *[F.expr(values.get(n, f"o.{n}")).cast(t).alias(n) for n, t in CANDIDATE_FIELDS], *carry
    )


def candidates(files: DataFrame, keys: Iterable[str] | None = None) -> DataFrame:
    """Candidate findings of the chosen detectors (all by default).

    Findings about row-level security are kept only in repositories that show a Supabase
    signal.  The items of files carry what they say of their repository and are written
    first, so that the files are read once for both.
    """
    wanted = list(DETECTOR_KEYS if keys is None else keys)
    if "DET-19" not in wanted:
        return candidates_from_items(file_items(files, wanted), wanted)
    items = stage(file_items(files, wanted, keep=REPO_SIGNALS), "file-items")
    flags = collect_repo_flags(items.select("repo_id", *REPO_SIGNALS))
    return only_in_supabase_projects(candidates_from_items(items, wanted), flags)


def only_in_supabase_projects(found: DataFrame, flags: DataFrame) -> DataFrame:
    projects = flags.filter("supabase_project").select("repo_id", F.lit(True).alias("gate"))
    kept = found.join(projects, "repo_id", "left")
    return kept.filter((F.col("category") != "rls_disabled") | F.col("gate")).drop("gate")


def repo_flags(files: DataFrame) -> DataFrame:
    """Per repository: auth middleware, rate limiting and Supabase signals anywhere."""
    return collect_repo_flags(with_file_columns(read_files(files), REPO_SIGNALS))


def collect_repo_flags(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("repo_id").agg(
        F.bool_or("f_auth_project").alias("project_auth"),
        F.bool_or("f_limit_project").alias("project_rate_limit"),
        F.bool_or("f_supabase").alias("supabase_project"),
    )
