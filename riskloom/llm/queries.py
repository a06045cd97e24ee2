"""Named queries: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    curriculum, dom_boost, fim_fenwick, lsh_forest, ngram_screen, phrase_automata, ppm, retrieval_packing, rule_ledger, segment_bounds,
    stream_dedup, suffix_sort, token_store,
)
from riskloom.llm.common import new_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "token-store")
    token_store.write_store(table(spark, sf, "documents"), folder, tokenizer_file("word_bpe_49k.json"), "words", end_id=1)
    return token_store.read_store(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_phrase_automata(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_automata.without_repeats(table(spark, sf, "documents"), with_text=False).drop("kept_text")


def op3_rule_ledger(spark: SparkSession, sf: str) -> DataFrame:
    book = rule_ledger.ledger(table(spark, sf, "documents"))
    base = F.col("failed").bitwiseAND(F.lit(rule_ledger.mask(rule_ledger.BASE))) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & rule_ledger.passes(F.col("failed"))).alias("kept"), F.col("failed").alias("failed_rules"),
    )


def op4_stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return stream_dedup.duplicates(table(spark, sf, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_dom_boost(spark: SparkSession, sf: str) -> DataFrame:
    return dom_boost.extract(table(spark, sf, "pages"))


def op6_curriculum(spark: SparkSession, sf: str) -> DataFrame:
    got = curriculum.totals(table(spark, sf, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position")).sortWithinPartitions("position")


def op7_retrieval_packing(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval_packing.pack(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), "bytes", end_id=1).drop("ids")


def op8_lsh_forest(spark: SparkSession, sf: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf, "documents"), words=3, percent=85)


def op9_suffix_sort(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_sort.without_repeats(table(spark, sf, "documents")).drop("starts", "ends")


def op10_ppm(spark: SparkSession, sf: str) -> DataFrame:
    return ppm.scores(table(spark, sf, "documents"))


def op11_ngram_screen(spark: SparkSession, sf: str) -> DataFrame:
    met = ngram_screen.screened(table(spark, sf, "documents"), table(spark, sf, "benchmark"), size=10)
    return met.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_segment_bounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('infinity'))"
    )
    vectors = rows.select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"),
    )
    return segment_bounds.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op13_fim_fenwick(spark: SparkSession, sf: str) -> DataFrame:
    made = fim_fenwick.rearranged(table(spark, sf, "documents"), seed=1)
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim_fenwick.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_token_store": op1_token_store,
    "op2_phrase_automata": op2_phrase_automata,
    "op3_rule_ledger": op3_rule_ledger,
    "op4_stream_dedup": op4_stream_dedup,
    "op5_dom_boost": op5_dom_boost,
    "op6_curriculum": op6_curriculum,
    "op7_retrieval_packing": op7_retrieval_packing,
    "op8_lsh_forest": op8_lsh_forest,
    "op9_suffix_sort": op9_suffix_sort,
    "op10_ppm": op10_ppm,
    "op11_ngram_screen": op11_ngram_screen,
    "op12_segment_bounds": op12_segment_bounds,
    "op13_fim_fenwick": op13_fim_fenwick,
}
