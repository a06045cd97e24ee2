"""Evidence: from candidates with their surroundings to findings with proof, confidence and status."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions import sqltext as Q
from riskloom.functions.prose import TEXTS
from riskloom.model import FINDING_COLUMNS, PROOF_FLAGS, REF

IMPACT = "Exploit scenario held back until line-break or parser impact is shown."


def _notes(pairs: list[tuple[str, str]]) -> str:
    """Array of the notes whose condition holds; a note is an SQL expression."""
    return "array_compact(array(" + ", ".join(f"IF({c}, {note}, NULL)" for c, note in pairs) + "))"


def _case(col: str, mapping: dict, default: str) -> str:
    def value(v) -> str:
        return Q.lit(v) if isinstance(v, str) else f"{v}D"

    return f"CASE {col} " + " ".join(f"WHEN {Q.lit(k)} THEN {value(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def prefilter_sql(category="category", low_path="lower(path)", evidence="evidence", ctx="ctx") -> str:
    secret = Q.among(category, K.SECRET_LIKE)
    joined = f"replace({ctx}, '\\n', ' ')"
    return _notes(
        [
            (Q.has(low_path, K.TEST_PATH_WORDS), Q.lit("Rejected: the path belongs to tests, examples or documentation.")),
            (Q.all_of(secret, Q.matches(evidence, K.PLACEHOLDER)), Q.lit("Rejected: the value is a placeholder.")),
            (Q.all_of(secret, Q.matches(evidence, K.CURRENCY)), Q.lit("Rejected: the value is an amount of money.")),
            (Q.all_of(secret, Q.matches(joined, K.PROMPT_NAME)), Q.lit("Rejected: the surroundings are prompt or template text.")),
            (
                Q.all_of(f"{category} = 'log_injection'", f"NOT {Q.matches(evidence, K.ATTACKER_INPUT)}"),
                Q.lit("Rejected: the log call quotes no attacker-controlled input."),
            ),
        ]
    )


def prefilter_notes() -> Column:
    """Reasons to reject a candidate outright; an empty array keeps it."""
    return F.expr(prefilter_sql())


def variables_sql(line: str) -> str:
    percent = f"regexp_extract({line}, {Q.lit(K.VARIABLES_AFTER_PERCENT)}, 1)"
    found = (
        f"concat(regexp_extract_all({line}, {Q.lit(K.VARIABLES_IN_BRACES)}, 1), filter(array({percent}), v -> v != ''), "
        f"regexp_extract_all({line}, {Q.lit(K.VARIABLES_AFTER_PLUS)}, 1))"
    )
    return f"array_distinct(transform({found}, v -> substring_index(v, '.', 1)))"


def interpolated_variables() -> Column:
    """Base names of the variables the evidence puts into a string."""
    return F.expr(variables_sql("evidence"))


def assignment_sql(evidence: str, ctx: str) -> str:
    attacker = Q.matches("l", K.ATTACKER_INPUT)
    assigned = "l RLIKE concat('(?i)\\\\b', v, '\\\\b\\\\s*=\\\\s*.+')"
    parameter = "l RLIKE concat('(?i)(?:def|function)\\\\s+\\\\w+\\\\s*\\\\([^)]*\\\\b', v, '\\\\b')"
    # the plain test keeps most lines from compiling a pattern
    test = f"contains(lower(l), lower(v)) AND (({attacker} AND {assigned}) OR {parameter})"
    each = f"vars -> exists(split({ctx}, '\\n'), l -> exists(vars, v -> {test}))"
    return f"coalesce(get(transform(array({variables_sql(evidence)}), {each}), 0), false)"


def attacker_assignment() -> Column:
    """Is an interpolated variable assigned from attacker input, or a parameter, nearby?"""
    return F.expr(assignment_sql("evidence", "ctx"))


def has_interpolation() -> Column:
    return F.expr(Q.has("evidence", K.INTERPOLATION_MARKS))


def sanitizer_sql() -> str:
    def named(values: list[str]) -> str:
        return Q.any_of(Q.has("evidence", values), Q.has("ctx", values))

    return Q.any_of(named(K.SANITIZER_WORDS), Q.all_of("category = 'sql_injection'", named(K.SQL_SANITIZER_WORDS)))


def has_sanitizer() -> Column:
    return F.expr(sanitizer_sql())


def exposure_sql() -> str:
    """Needs route_path, evidence, ctx, f_web_hint, internal_kind and external_exposure_proven."""
    low = "lower(route_path)"
    hint = Q.any_of(Q.matches("evidence", K.WEB_HINT), Q.matches("ctx", K.WEB_HINT), "f_web_hint")
    exposed = Q.any_of(*[f"startswith({low}, {Q.lit(p)})" for p in K.EXPOSED_PREFIXES])
    return (
        "CASE WHEN route_path = '' THEN false WHEN internal_kind AND NOT exposed THEN false WHEN exposed THEN true "
        f"WHEN {Q.matches(low, K.INTERNAL_ROUTE)} THEN false "
        f"WHEN {Q.matches('evidence', K.ROUTE_DECORATOR)} AND {exposed} THEN true "
        f"ELSE {hint} AND startswith({low}, '/') END"
    )


def action_sql(route="route_path", method="route_method", category="category") -> str:
    low = f"lower({route})"
    return (
        f"CASE WHEN {route} = '' THEN false WHEN {Q.matches(low, K.INTERNAL_ROUTE)} THEN false WHEN {Q.matches(low, K.SENSITIVE_ROUTE)} THEN true "
        f"WHEN {category} = 'missing_rate_limit' THEN {method} IN ('POST', 'PUT', 'PATCH', 'DELETE') "
        f"WHEN {category} = 'missing_auth' THEN {method} IN ('PUT', 'PATCH', 'DELETE') ELSE false END"
    )


def score_sql() -> str:
    """Needs the proof columns, evidence_refs, scanner_status and the candidate columns."""
    gains = [("source_present", 0.20), ("sink_present", 0.20), ("path_present", 0.15), ("NOT sanitizer_present", 0.10), ("size(evidence_refs) > 1", 0.05)]
    losses = [
        (Q.matches("evidence", K.PLACEHOLDER), 0.25),
        (Q.any_of(Q.matches("evidence", K.CURRENCY), Q.matches("evidence", K.PROMPT_NAME)), 0.20),
        (Q.has("low_path", K.TEST_PATH_WORDS), 0.20),
    ]
    score = f"0.30D * {_case('category', K.PRIOR, f'{K.PRIOR_DEFAULT}D')}"
    score += "".join(f" + IF({c}, {p}D, 0D)" for c, p in gains) + "".join(f" - IF({c}, {p}D, 0D)" for c, p in losses)
    cap = f"CASE WHEN category = 'log_injection' THEN 0.74D WHEN {Q.among('category', K.ROUTE)} AND scanner_status = 'needs_review' THEN 0.69D ELSE 1D END"
    return f"round(greatest(0D, least({cap}, {score})), 4)"


_SAME = "filter(flows, f -> f.category = category)"
# the flow of the category with the highest confidence, the first on a tie
BEST_FLOW = f"get(filter({_SAME}, f -> f.confidence = array_max(transform({_SAME}, g -> g.confidence))), 0)"
ORDER_KEY = "CAST(scanner AS bigint) * 100000000 + CAST(chk AS bigint) * 10000000 + CAST(seq AS bigint)"


def describe_sql() -> str:
    sentence = _case("category", {k: v[0] for k, v in TEXTS.items()}, "'A risky construct was found.'")
    return f"concat({sentence}, IF(coalesce(detail, '') = '', '', concat(' [', detail, ']')), ' At ', path, ':', line_number, '.')"


def build_evidence(df: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
    """Proof, confidence and status of every candidate.

    Needs the candidate columns plus ctx, flows, f_web_hint, kind and
    external_exposure_proven; ``carry`` names further columns to keep.  A row-wise step:
    no shuffle.
    """
    flow, route, ai = (Q.among("category", v) for v in (K.FLOW, K.ROUTE, K.AI))
    known = Q.among("category", [*K.LITERAL_PROOF, *K.AI, *K.OTHER_DIRECT])
    loose = Q.among("category", ["command_injection", "path_traversal", "unsafe_dynamic_code"])
    promotable = Q.among("category", K.PROMOTABLE)

    def step(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
        return frame.withColumns({n: F.expr(t) for n, t in columns.items()})

    df = step(df, {"ctx": "coalesce(ctx, '')", "low_path": "lower(path)"})
    df = step(
        df,
        {
            "scanner_status": "status",
            "no_source": "evidence = '' OR line_number <= 0",
            "reject_notes": prefilter_sql(low_path="low_path"),
            "flow": f"IF({flow}, {BEST_FLOW}, NULL)",
            "direct": f"IF({flow}, {Q.matches('evidence', K.ATTACKER_INPUT)}, false)",
            "route_path": f"IF({route}, regexp_extract(evidence, {Q.lit(K.ROUTE_PATH)}, 1), '')",
            "route_method": f"IF({route}, upper(regexp_extract(evidence, {Q.lit(K.ROUTE_METHOD)}, 1)), '')",
            "internal_kind": "coalesce(kind IN ('internal_service', 'ml_platform'), false)",
            "exposed": "coalesce(external_exposure_proven, false)",
        },
    )
    literal = (
        f"named_struct('kind', 'literal', 'file_path', path, 'line_start', greatest(line_number, 1), 'line_end', greatest(line_number, 1), "
        f"'quote', left(evidence, {K.QUOTE_CHARS}))"
    )
    empty = f"CAST(array() AS array<{REF}>)"
    df = step(
        df,
        {
            "by_flow": "flow IS NOT NULL",
            "evidence_refs": f"IF(evidence = '', {empty}, concat(array({literal}), coalesce(flow.refs, {empty})))",
        },
    )
    # chains of CASEs, so the costly neighbourhood test only runs where it decides
    df = step(
        df,
        {
            "source_present": f"CASE WHEN by_flow THEN true WHEN {flow} THEN direct OR {assignment_sql('evidence', 'ctx')} "
            f"WHEN {route} THEN {exposure_sql()} ELSE {known} OR ctx != '' END",
            "sink_present": f"CASE WHEN {flow} THEN true WHEN {route} THEN route_path != '' ELSE {known} OR ctx != '' END",
            "path_present": f"CASE WHEN by_flow THEN true WHEN {flow} THEN {Q.has('evidence', K.INTERPOLATION_MARKS)} OR ({loose} AND direct) "
            f"WHEN {route} THEN {action_sql()} WHEN {ai} THEN size(evidence_refs) > 0 ELSE {known} OR ctx != '' END",
            "sanitizer_present": f"CASE WHEN by_flow THEN flow.sanitized WHEN {flow} THEN {sanitizer_sql()} ELSE false END",
        },
    )
    df = step(
        df,
        {
            "attacker_controlled": f"CASE WHEN {flow} OR {route} THEN source_present ELSE {Q.among('category', K.AI_ATTACKER)} END",
            "exploitability_proven": "CASE WHEN by_flow THEN category IN ('sql_injection', 'command_injection') AND NOT sanitizer_present "
            f"WHEN {flow} THEN {promotable} AND source_present AND path_present AND NOT sanitizer_present "
            f"WHEN {route} THEN source_present AND path_present ELSE {Q.among('category', [*K.LITERAL_EXPLOITABLE, *K.OTHER_DIRECT])} END",
            "score": score_sql(),
            "dropped": "no_source OR size(reject_notes) > 0",
            "complete": "source_present AND sink_present AND path_present",
        },
    )
    df = step(
        df,
        {
            "status": f"CASE WHEN dropped THEN 'rejected' WHEN {flow} AND NOT complete THEN 'rejected' "
            f"WHEN {flow} AND {promotable} AND attacker_controlled AND exploitability_proven AND NOT sanitizer_present THEN 'confirmed' "
            f"WHEN {flow} THEN 'candidate' "
            f"WHEN {route} AND scanner_status != 'needs_review' AND source_present AND path_present THEN 'candidate' "
            f"WHEN {route} OR {ai} THEN 'needs_review' WHEN {known} THEN 'candidate' ELSE 'needs_review' END",
        },
    )
    held = f"{route} AND scanner_status != 'needs_review'"
    notes = _notes(
        [
            ("by_flow AND category = 'log_injection'", Q.lit(IMPACT)),
            ("by_flow", "format_string('Syntax-tree data flow, confidence %.2f.', flow.confidence)"),
            ("NOT by_flow AND category = 'log_injection' AND source_present AND path_present AND NOT sanitizer_present", Q.lit(IMPACT)),
            (f"{route} AND internal_kind AND NOT exposed", Q.lit("Route of an internal service: external exposure must be proven first.")),
            (ai, Q.lit("Model-risk candidate: a verifier has to confirm it first.")),
            (f"{flow} AND NOT complete", Q.lit("Rejected: source, sink and path are not all proven.")),
            (f"{held} AND NOT source_present", Q.lit("Exposure of the route is not proven; kept for review.")),
            (f"{held} AND NOT path_present", Q.lit("The route's action is not clearly sensitive; kept for review.")),
            (ai, Q.lit("Model-risk finding kept for review until it is proven exploitable.")),
        ]
    )
    flags = ", ".join(f"'{f}', NOT dropped AND {f}" for f in PROOF_FLAGS)
    all_notes = f"CASE WHEN no_source THEN array('Rejected: no quoted evidence or source line.') WHEN dropped THEN reject_notes ELSE {notes} END"
    key = f"concat_ws('\\u0001', repo_id, category, path, line_number, evidence, {ORDER_KEY})"
    made = {
        "id": f"sha2({key}, 256)",
        "rule_id": "category",
        "confidence": f"CASE WHEN dropped THEN 0D WHEN {flow} AND NOT complete THEN least(score, 0.45D) "
        f"WHEN {route} AND status = 'needs_review' THEN least(score, 0.69D) WHEN {ai} THEN least(score, 0.55D) ELSE score END",
        "proof": f"named_struct({flags}, 'notes', {all_notes})",
        "description": describe_sql(),
        "attack_chain": "''",
        "recommendation": "''",
        "fix": "''",
        "fix_source": "''",
        "confirmed_by": "array()",
        "owasp_cat": _case("category", K.OWASP, "NULL"),
        "ord": ORDER_KEY,
    }
    blank = ("fix_code", "cvss_score", "cvss_vector", "validator")
    return df.selectExpr(
        *[f"CAST({'NULL' if n in blank else made.get(n, n)} AS {t}) AS {n}" for n, t in FINDING_COLUMNS], *carry
    )
