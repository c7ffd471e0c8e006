"""A training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's docs. All but the last return the columns of ``documents``.

Defined cases, for every stage: an empty table gives an empty result; columns other than ``doc_id``,
``text``, ``lang`` and ``n_chars`` are kept as they are, whatever their names, but by packing, which returns
pieces; texts of any length are processed whole. A null or letterless text has no language and goes
with the first stage; in a later one it has no shingles and no hits, and line dedup drops it only if it
is null or empty. Rows that repeat whole are one document: they get the same result in every stage. Of
lines and documents that are equal under different ids, those of the smallest id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kdframe.llm import decontaminate, language, line_dedup, near_duplicates, packing
from kdframe.llm.common import table, unused
from kdframe.llm.registry import tokenizer_files
from kdframe.session import materialize

#: Least share of the best language in the evidence of a document.
LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or whose language is in doubt, go."""
    model = language.fit(docs.where(F.coalesce(language.fold("doc_id") != 2, F.lit(False))))
    name = unused("_found", docs)
    found = docs.withColumn(name, language.predictor(docs, model)("text"))
    sure = (F.col(name)["lang_pred"] != language.UNKNOWN) & (F.col(name)["score"] >= LANGUAGE_SCORE)
    return found.where(sure).drop(name)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so does a document of which nothing is left."""
    kept = line_dedup.dedup_lines(docs, complete=True).where("text != ''")
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_duplicates.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter hits are cut out of the others."""
    kept = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, placed in sequences."""
    return packing.pack(packing.tokenize(docs, *tokenizer_files()))


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Tokenisers, trained classifiers and connected groups can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
