"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaloom.llm import chat_format, classify, decontaminate, exact_dedup, language_model, ngram_join, packing, prefix_trie, sharding, spelling_variants, substring_dedup, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(*chat_format.prefix_trees(told.unionByName(own)))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"), largest=True)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = classify.remainder("doc_id", 3)
    return classify.identify(table(spark, sf_dir, "documents"), fold != 1, fold == 1)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = classify.remainder("doc_id", 5)
    return classify.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 0, fold == 0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = classify.remainder("doc_id", 7)
    return language_model.score(table(spark, sf_dir, "documents"), fold != 2, fold == 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_decontaminate": op6_decontaminate,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLE: dict[str, str] = {
    "op1_chat_format": chat_format.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_ngram_jaccard_join": ngram_join.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op11_spelling_variants": spelling_variants.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
