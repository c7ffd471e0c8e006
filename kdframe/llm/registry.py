"""Queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kdframe.llm import (
    decontaminate,
    language,
    licenses,
    line_dedup,
    near_duplicates,
    oracles,
    packing,
    pii,
    prefix_trie,
    quality_model,
    quality_rules,
    sharding,
    spelling,
    substrings,
)
from kdframe.llm.common import table
from kdframe.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The other queries hash, tokenise, learn or link by sketches, which SQL doesn't; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op5_quality_rules": oracles.QUALITY_RULES,
    "op7_near_duplicates": oracles.NEAR_DUPLICATES,
    "op10_decontamination": oracles.DECONTAMINATION,
    "op12_substring_dedup": oracles.REPEATED_PASSAGES,
}

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SHARDS = 256


def query(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[plan.__name__] = plan
    return plan


def tokenizer_files() -> tuple[str, str]:
    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    names = ("email", "ip", "card", "phone")
    count = {f"n_{name}": F.size(pii.of_kinds(F.col("pii"), name)).cast("long") for name in names}
    base = pii.listed(pii.of_kinds(F.col("pii"), *names))
    return found.select(
        "doc_id",
        *(c.alias(name) for name, c in count.items()),
        F.sha2(base, 256).alias("base_sha256"),
        pii.listed(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
    )


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(language.fold("doc_id") == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language.predictor(docs, model)("text").alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.element_at(F.array_sort(F.transform("licenses", lambda m: F.struct((-m["dice"]).alias("d"), m["license"], m["unit"]))), 1)
    # a line's number, or the number of the first paragraph of a run and how many there are
    unit = lambda m: F.when(m["paragraphs"] > 0, F.concat_ws("+", m["unit"], m["paragraphs"])).otherwise(m["unit"])
    listed = F.array_join(F.transform("licenses", lambda m: F.concat_ws(":", unit(m), m["license"])), ",")
    top = found.withColumn("best", F.when(F.size("licenses") > 0, best))
    return top.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_matches"),
        F.col("best.license").alias("license"),
        F.round(-F.col("best.d"), 6).alias("dice"),
        listed.alias("matches"),
    )


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), *tokenizer_files(), keep_ids=False)
    return packing.pack(pieces).drop("ids")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.apply_rules(docs).select("doc_id", *names)


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, complete=True, removed_col="n_removed")


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", near_duplicates.is_kept().alias("kept"))


@query
def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.classify(docs).select("doc_id", "weak_score", "quality_score", "good")


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    placed = sharding.assign_shards(docs, ["doc_id"], [f"shard-{i:03d}" for i in range(SHARDS)])
    split = sharding.split_shards(placed, ["doc_id"], F.coalesce("size", F.lit(0)))
    return split.select("doc_id", "slot", "shard", "part")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "hits.n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", substrings.digest("text").alias("told")).select("doc_id", "told.*")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), thinned=spelling.THINNED)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(prefix_trie.ranked_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(*prefix_trie.with_borrowed_heads(turns))
