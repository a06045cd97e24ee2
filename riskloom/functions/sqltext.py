"""Spark SQL text for conditions that are generated from rule tables.

A rule set becomes one expression text that Spark parses in one go, instead of
thousands of single column calls.
"""

from __future__ import annotations

from collections.abc import Iterable

from riskloom.functions import fixed as K


def lit(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def words(values: Iterable[str]) -> str:
    return ", ".join(lit(v) for v in values)


def matches(col: str, pattern: str) -> str:
    return f"({col} RLIKE {lit(pattern)})"


def has(col: str, values: Iterable[str]) -> str:
    """Holds one of the words.  Plain searches run on the bytes and are several times
    faster than one pattern with many branches."""
    return any_of(*[f"contains({col}, {lit(v)})" for v in values])


def among(col: str, values: Iterable[str]) -> str:
    return f"({col} IN ({words(values)}))"


def all_of(*conditions: str) -> str:
    return "(" + " AND ".join(conditions) + ")"


def any_of(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def strip(col: str) -> str:
    return f"trim(BOTH {lit(K.WHITESPACE)} FROM {col})"


def overlap(array: str, values: Iterable[str]) -> str:
    return f"arrays_overlap({array}, array({words(values)}))"


def newlines(col: str) -> str:
    return f"(length({col}) - length(replace({col}, '\\n', '')))"


def match_lines(text: str, pattern: str) -> str:
    """``array<struct<line int, match string>>``: every match of a pattern over the whole
    text with the line its first character is on."""
    p = lit(pattern)
    found = "array<struct<line:int,match:string>>"
    return (
        f"aggregate(filter(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), "
        f"(g, m) -> named_struct('g', {newlines('g')}, 'm', m)), s -> s.m IS NOT NULL), "
        f"named_struct('line', 1, 'out', CAST(array() AS {found})), "
        f"(acc, s) -> named_struct('line', acc.line + s.g + {newlines('s.m')}, "
        f"'out', concat(acc.out, array(named_struct('line', acc.line + s.g, 'match', s.m)))), "
        "acc -> acc.out)"
    )


def frame(lines: str, line_no: str, before: int, after: int) -> str:
    """Text of the lines from ``line_no - before`` to ``line_no + after`` that exist."""
    first = f"greatest({line_no} - {before}, 1)"
    return f"array_join(slice({lines}, {first}, {line_no} + {after} - {first} + 1), '\\n')"


def high_risk(route: str) -> str:
    """For a route in lower case."""
    return has(route, K.HIGH_RISK_PATHS)


def rate_limited_route(route: str) -> str:
    """For a route in lower case: a payment route, or an auth route that is worth
    brute-forcing; auth comes first."""
    login = any_of(has(route, K.STRONG_LOGIN_WORDS), all_of(has(route, K.WEAK_LOGIN_WORDS), has(route, K.LOGIN_CONTEXT_WORDS)))
    return f"(CASE WHEN {has(route, K.AUTH_FRAGMENTS)} THEN {login} ELSE {has(route, K.PAYMENT_FRAGMENTS)} END)"


def handler_route(path: str) -> str:
    inner = f"regexp_replace(substr({path}, {len('app/api/') + 1}), '(?:^|/)route[.](?:ts|js)$', '')"
    return f"(CASE WHEN startswith({path}, 'app/api/') THEN concat('/api/', {inner}) ELSE '' END)"


def is_env_file(path: str) -> str:
    return matches(f"lower({path})", r"(?:^|/)\.env(?:\.[^/]*)?$")
