"""Repository context: frameworks, exposure and kind of each repository.

Word hits of a file are bits of a BIGINT, so one ``bit_or`` per repository merges
them with map-side combining; only the routes of the sampled files are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions import sqltext as Q
from riskloom.functions import text as X

# bit layout of the two word masks
_WORDS_A = [("app", w) for w in K.APPLICATION_HINTS] + [("ml", w) for w in K.ML_HINTS] + [("fw", w) for w in K.FRAMEWORK_TOKENS]
_WORDS_B = (
    [("local", w) for w in K.LOCAL_HINTS]
    + [("exposed", w) for w in K.EXPOSURE_HINTS]
    + [("agent", w) for w in K.AGENT_WORDS]
    + [("phrase", w) for w in K.LIBRARY_PHRASES]
    + [("package", w) for w in K.LIBRARY_PACKAGES]
)
FRAMEWORKS = sorted({"node", "python", "supabase", "firebase", *K.NODE_FRAMEWORKS, *K.PYTHON_FRAMEWORKS})
_NAME_BITS = ["internal", "agent", "library", "application"]


def _mask(conditions: list[str]) -> str:
    """BIGINT with bit i set where condition i holds."""
    return " + ".join(f"IF({c}, {1 << i}L, 0L)" for i, c in enumerate(conditions))


def _bits(group: str, words: list[tuple[str, str]]) -> int:
    return sum(1 << i for i, (g, _) in enumerate(words) if g == group)


def _has(mask: str, bits: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(bits).cast("bigint")) != 0


def _count(mask: str, bits: int) -> Column:
    return F.bit_count(F.col(mask).bitwiseAND(F.lit(bits).cast("bigint")))


def file_context(files: DataFrame) -> DataFrame:
    """Context columns of every file; ``files`` holds (repo_id, path, text, ignored).

    Ignored files count only as names in the root folder.
    """
    return with_sample(files).select("repo_id", "path", "ignored", *file_context_columns())


CONTEXT_COLUMNS = ["names", "frameworks", "words_a", "words_b", "routes"]


def file_context_columns() -> list[Column]:
    parts, name = "split(lower(path), '/')", "substring_index(path, '/', -1)"
    in_root, root_part = "NOT contains(path, '/')", "substring_index(path, '/', 1)"

    def part_of(values: list[str]) -> str:
        return Q.any_of(Q.all_of("NOT ignored", Q.overlap(parts, values)), Q.among(f"lower({root_part})", values))

    names = _mask(
        [
            part_of(K.INTERNAL_PARTS),
            part_of(K.AGENT_PARTS),
            Q.all_of("NOT ignored", Q.among(f"lower({name})", K.LIBRARY_FILES)),
            Q.all_of("NOT ignored", Q.among(f"lower({name})", K.APPLICATION_NAMES)),
        ]
    )
    root_package = Q.all_of(in_root, f"{name} = 'package.json'")
    root_python = Q.all_of(in_root, Q.among(name, K.PYTHON_ROOT_FILES))
    found = {
        "node": Q.all_of(in_root, Q.among(name, K.NODE_ROOT_FILES)),
        "python": root_python,
        "supabase": "(NOT ignored AND contains(lower(path), 'supabase'))",
        "firebase": Q.all_of("NOT ignored", Q.among(name, ["firebase.json", "firestore.rules"])),
        **{fw: Q.all_of(root_package, f"contains(text, {Q.lit(token)})") for fw, token in K.NODE_FRAMEWORKS.items()},
        **{fw: Q.all_of(root_python, f"contains(lower(text), {Q.lit(fw)})") for fw in K.PYTHON_FRAMEWORKS},
    }
    found["nextjs"] = Q.any_of(
        found["nextjs"],
        Q.all_of(in_root, Q.among(name, ["next.config.js", "next.config.ts"])),
        Q.all_of("contains(path, '/')", Q.among(root_part, ["app", "pages"])),
    )
    return [
        F.expr(names).alias("names"),
        F.expr(_mask([found[fw] for fw in FRAMEWORKS])).alias("frameworks"),
        F.expr(_mask([f"contains(sample, {Q.lit(w)})" for _, w in _WORDS_A])).alias("words_a"),
        F.expr(_mask([f"contains(sample, {Q.lit(w)})" for _, w in _WORDS_B])).alias("words_b"),
        F.expr(f"array_distinct(regexp_extract_all(sample, {Q.lit(K.PUBLIC_ROUTE)}, 1))").alias("routes"),
    ]


def with_sample(files: DataFrame, chars: int | None = None) -> DataFrame:
    """Add ``sample``, the lower-case text of a file, or its head if ``chars`` is given; null for ignored ones."""
    text = F.col("text") if chars is None else F.left("text", F.lit(chars))
    return files.withColumn("sample", F.when(~F.col("ignored"), F.lower(text)))


def first_files(files: DataFrame, limit: int) -> DataFrame:
    """The first files of each repository by lower-case path.

    The filter on row_number lets Spark cut every partition to ``limit`` rows per
    repository before the shuffle, so a huge repository stays cheap.
    """
    order = W.partitionBy("repo_id").orderBy(F.lower("path"), "path")
    return files.withColumn("file_no", F.row_number().over(order)).filter(F.col("file_no") <= limit)


def repo_frameworks(contexts: DataFrame) -> DataFrame:
    merged = contexts.groupBy("repo_id").agg(F.bit_or("frameworks").alias("mask"))
    return merged.select("repo_id", _framework_names("mask").alias("frameworks"))


def _framework_names(mask: str) -> Column:
    return F.array_compact(F.array(*[F.when(_has(mask, 1 << i), F.lit(fw)) for i, fw in enumerate(FRAMEWORKS)]))


def repo_contexts(contexts: DataFrame, max_files: int | None = None) -> DataFrame:
    """Kind, reasons, hints and exposure of each repository, from ``file_context`` rows: of all its
    files, or the first ones by path if ``max_files`` is given."""
    everything = contexts.groupBy("repo_id").agg(
        F.bit_or("names").alias("names"), F.bit_or("frameworks").alias("fw_mask")
    )
    sampled = contexts.filter(~F.col("ignored")).select("repo_id", "path", "words_a", "words_b", "routes")
    if max_files is not None:
        sampled = first_files(sampled, max_files)
    words = sampled.groupBy("repo_id").agg(F.bit_or("words_a").alias("words_a"), F.bit_or("words_b").alias("words_b"))
    # distinct routes first, so that a large repository's files do not meet in one row with all their repetitions
    routes = sampled.select("repo_id", F.explode("routes").alias("route")).distinct().groupBy("repo_id").agg(
        F.sort_array(F.collect_list("route")).alias("public_api_signals")
    )
    heard = words.join(routes, "repo_id", "left")
    joined = everything.join(heard, "repo_id", "left").withColumns(
        {
            "words_a": F.coalesce("words_a", F.lit(0).cast("bigint")),
            "words_b": F.coalesce("words_b", F.lit(0).cast("bigint")),
            "public_api_signals": F.coalesce("public_api_signals", F.array().cast("array<string>")),
        }
    )
    return _classify(joined)


def context_masks(contexts: DataFrame, flags: list[str]) -> DataFrame:
    """What ``file_context`` rows and boolean signals say of each repository, in a form that merges:
    masks, signals and distinct routes."""
    read = ~F.col("ignored")
    return contexts.groupBy("repo_id").agg(
        F.bit_or("names").alias("names"), F.bit_or("frameworks").alias("fw_mask"),
        *[F.bit_or(F.when(read, F.col(w))).alias(w) for w in ("words_a", "words_b")],
        F.array_distinct(F.flatten(F.collect_set(F.when(read, F.col("routes"))))).alias("routes"),
        *[F.bool_or(F.when(read, F.col(f))).alias(f) for f in flags],
    )


def merged_masks(masks: DataFrame, flags: list[str]) -> DataFrame:
    """The masks of parts of repositories put together; equal parts may come twice."""
    return masks.groupBy("repo_id").agg(
        *[F.bit_or(m).alias(m) for m in ("names", "fw_mask", "words_a", "words_b")],
        F.array_distinct(F.flatten(F.collect_set("routes"))).alias("routes"), *[F.bool_or(f).alias(f) for f in flags],
    )


def masked_contexts(masks: DataFrame) -> DataFrame:
    """Contexts as ``repo_contexts`` gives them, from masks."""
    words = {w: F.coalesce(w, F.lit(0).cast("bigint")) for w in ("words_a", "words_b")}
    return _classify(masks.withColumns(words | {"public_api_signals": F.sort_array("routes")}))


def _classify(df: DataFrame) -> DataFrame:
    c = F.col
    routes = c("public_api_signals")
    name_bit = {n: 1 << i for i, n in enumerate(_NAME_BITS)}
    fw_bit = {fw: 1 << i for i, fw in enumerate(FRAMEWORKS)}

    def one(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    known_packages = sum(fw_bit[fw] for fw in FRAMEWORKS if fw in K.FRAMEWORK_PACKAGES)
    library_packages = sum(fw_bit[fw] for fw in K.LIBRARY_PACKAGES)
    local_words = [(i, w) for i, (g, w) in enumerate(_WORDS_B) if g == "local"]
    df = df.withColumns(
        {
            "has_routes": F.size(routes) > 0,
            "local_network_hints": F.array_compact(
                F.array(*[F.when(_has("words_b", 1 << i), F.lit(w)) for i, w in local_words])
            ),
            "app_score": _count("words_a", _bits("app", _WORDS_A))
            + one(F.exists(routes, lambda r: X.contains_any(r, K.APPLICATION_ROUTES)), 2)
            + one(_has("names", name_bit["application"]), 1),
            "framework_score": one(_has("fw_mask", known_packages), 2) + _count("words_a", _bits("fw", _WORDS_A)),
            "library_score": one(_has("names", name_bit["library"]), 1)
            + one(_has("words_b", _bits("package", _WORDS_B)), 2)
            + one(_has("words_b", _bits("phrase", _WORDS_B)), 1)
            + one(_has("fw_mask", library_packages), 1),
            "ml_score": _count("words_a", _bits("ml", _WORDS_A)),
            "sensitive_public_surface": F.exists(routes, lambda r: X.contains_any(r, K.SENSITIVE_ROUTE_WORDS)),
            "internal_names": _has("names", name_bit["internal"]),
        }
    )
    df = df.withColumns(
        {
            "seen_exposed": _has("words_b", _bits("exposed", _WORDS_B)) & c("has_routes"),
            "rule": F.when(_has("names", name_bit["agent"]) & _has("words_b", _bits("agent", _WORDS_B)), "agent_platform")
            .when((c("app_score") >= 2) & (c("app_score") >= c("ml_score") + 1), "application")
            .when(c("internal_names") & (F.size("local_network_hints") > 0), "internal_service")
            .when((c("framework_score") > 0) & (c("framework_score") >= c("library_score")), "framework")
            .when(c("library_score") > 0, "library")
            .when(c("ml_score") > 0, "ml_platform")
            .when(c("has_routes") | (c("fw_mask") != 0), "public_application")
            .otherwise("unknown"),
        }
    )
    reasons = F.array_compact(
        F.array(
            F.when(c("internal_names"), F.lit(K.REASONS["internal"])),
            F.when(F.size("local_network_hints") > 0, F.lit(K.REASONS["local"])),
            X.lookup({k: v for k, v in K.REASONS.items() if k not in ("internal", "local")}, c("rule")),
        )
    )
    kind = F.when(c("rule") == "public_application", "application").otherwise(c("rule"))
    return df.select(
        "repo_id",
        kind.alias("kind"),
        reasons.alias("reasons"),
        "local_network_hints",
        "public_api_signals",
        (c("seen_exposed") | (c("has_routes") & (kind == "application"))).alias("external_exposure_proven"),
        "sensitive_public_surface",
        "app_score",
        "framework_score",
        "library_score",
        "ml_score",
        _framework_names("fw_mask").alias("frameworks"),
    )


def apply_context(findings: DataFrame) -> DataFrame:
    """Downgrade route findings in repositories that do not show outside exposure.

    ``findings`` carries kind, external_exposure_proven and sensitive_public_surface.
    """
    c = F.col
    route = c("category").isin(*K.ROUTE)
    exposed = F.coalesce(c("external_exposure_proven"), F.lit(False))
    inward = c("kind").isin("internal_service", "ml_platform") & ~exposed
    packaged = c("kind").isin("library", "framework") & ~(exposed & c("sensitive_public_surface"))
    hit = F.coalesce(
        route
        & ((inward & (c("status") == "confirmed")) | (packaged & ~inward & c("status").isin("confirmed", "candidate"))),
        F.lit(False),
    )
    note = F.concat(
        F.lit("Rated lower, as this is a "),
        c("kind"),
        F.when(inward, " that nothing shows to be reachable from outside.").otherwise(
            " without both a public route and a sensitive action."
        ),
    )
    confidence = F.least(F.when(c("confidence") == 0, F.lit(1.0)).otherwise(c("confidence")), F.lit(0.49))
    return (
        findings.withColumn("downgraded", hit)
        .withColumns(
            {
                "status": F.when(c("downgraded"), "needs_review").otherwise(c("status")),
                "confidence": F.when(c("downgraded"), confidence).otherwise(c("confidence")),
                "false_positive_risk": F.when(c("downgraded"), "high").otherwise(c("false_positive_risk")),
                "severity": F.when(c("downgraded") & c("severity").isin("high", "critical"), "medium").otherwise(c("severity")),
                "proof": F.when(
                    c("downgraded"),
                    c("proof").withField("notes", F.array_union(c("proof.notes"), F.array(note))),
                ).otherwise(c("proof")),
            }
        )
        .drop("downgraded")
    )
