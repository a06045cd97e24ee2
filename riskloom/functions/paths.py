"""Column helpers for repository paths and routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions.text import contains_any, ends_with_any, matches


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case ending with its dot; names such as ``.env`` have none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    ending = suffix(path)
    return (
        F.when(ending.isin(*K.PY), "python")
        .when(ending.isin(*K.JS), "javascript")
        .otherwise("text")
    )


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def is_env_file(path: Column) -> Column:
    name = F.lower(file_name(path))
    return (name == ".env") | F.startswith(name, F.lit(".env."))


def is_ignored(path: Column, strict: bool = False) -> Column:
    """True for paths that are not scanned.

    ``strict`` keeps two oddities of the original filter: a file called ``.env`` is
    dropped as if it were a folder, and rule files whose ending is not a source
    ending (``firestore.rules``, ``requirements.txt``) never get through.
    """
    lowered = F.lower(path)
    parts = F.split(lowered, "/")
    name = F.element_at(parts, -1)
    folders = parts if strict else F.slice(parts, F.lit(1), F.size(parts) - 1)
    skip_dirs = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in K.SKIP_DIRS]))
    readable = suffix(path).isin(*K.SCAN_SUFFIXES) | is_env_file(path)
    if not strict:
        readable = readable | name.isin(*K.RULE_FILES)
    return skip_dirs | name.isin(*K.SKIP_FILES) | ends_with_any(name, K.SKIP_ENDINGS) | ~readable


def is_generated(path: Column) -> Column:
    """Generated, vendored or declaration files; several rules leave them out."""
    lowered = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.endswith(lowered, F.lit(".d.ts")) | F.arrays_overlap(
        F.split(lowered, "/"), F.array(*[F.lit(p) for p in K.GENERATED_PARTS])
    )


def is_high_risk_route(route: Column) -> Column:
    return contains_any(F.lower(route), K.HIGH_RISK_PATHS)


def sensitive_class(route: Column) -> Column:
    """'auth', 'payment' or null; auth is looked at first."""
    lowered = F.lower(route)
    return F.when(contains_any(lowered, K.AUTH_FRAGMENTS), "auth").when(
        contains_any(lowered, K.PAYMENT_FRAGMENTS), "payment"
    )


def is_login_target(route: Column) -> Column:
    lowered = F.lower(route)
    return contains_any(lowered, K.STRONG_LOGIN_WORDS) | (
        contains_any(lowered, K.WEAK_LOGIN_WORDS) & contains_any(lowered, K.LOGIN_CONTEXT_WORDS)
    )


def needs_rate_limit(route: Column) -> Column:
    """A payment route, or an auth route that is worth brute-forcing."""
    kind = sensitive_class(route)
    return F.coalesce((kind == "payment") | ((kind == "auth") & is_login_target(route)), F.lit(False))


def handler_route(path: Column) -> Column:
    """URL of a file-based handler: ``app/api/users/route.ts`` -> ``/api/users``."""
    inner = F.substr(path, F.lit(len("app/api/") + 1))
    trimmed = F.regexp_replace(inner, r"(?:^|/)route\.(?:ts|js)$", "")
    return F.when(F.startswith(path, F.lit("app/api/")), F.concat(F.lit("/api/"), trimmed)).otherwise("")


def sensitive_action(route: Column, method: Column, category: Column) -> Column:
    """A route whose action is worth protecting; internal-only routes never are."""
    lowered = F.lower(route)
    return (
        F.when(route == "", False)
        .when(matches(lowered, K.INTERNAL_ROUTE), False)
        .when(matches(lowered, K.SENSITIVE_ROUTE), True)
        .when(category == "missing_rate_limit", method.isin("POST", "PUT", "PATCH", "DELETE"))
        .when(category == "missing_auth", method.isin("PUT", "PATCH", "DELETE"))
        .otherwise(False)
    )


def owner_and_repo(url: Column) -> Column:
    cleaned = F.trim(url)
    return F.struct(
        F.regexp_extract(cleaned, K.REPO_URL, 1).alias("owner"),
        F.regexp_extract(cleaned, K.REPO_URL, 2).alias("repo"),
    )


def normalise_repo(value: Column) -> Column:
    """Canonical repository URL of a strict or loose spelling, else null."""
    v = F.trim(value)
    return F.when(matches(v, K.REPO_URL_STRICT), F.regexp_replace(v, "/$", "")).when(
        matches(v, K.REPO_URL_LOOSE),
        F.concat(
            F.lit("https://github.com/"),
            F.regexp_extract(v, K.REPO_URL_LOOSE, 1),
            F.lit("/"),
            F.regexp_extract(v, K.REPO_URL_LOOSE, 2),
        ),
    )
