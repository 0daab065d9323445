"""Corpus pipeline: quality rules, language ID, near-duplicate removal, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table that is stored and read again as
the next one's ``docs``. All but the last return the columns of ``docs`` as they were. Each stage
learns what it compares with (language references, profiles) from all documents it is given.
Rows without an id are kept by the filters like any other; see the operators for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import prepare
from quantloom.llm.langid import UND, learn_profiles, predict_lang
from quantloom.llm.queries import packed
from quantloom.llm.rules import references, verdict
from quantloom.llm.simhash import keep_representatives, near_duplicates
from quantloom.session import materialise

MIN_SCORE = 0.4  # of the language; below it a document fits none of the learned ones


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rules and are near some language's reference."""
    prepare(spark)
    return docs.where(verdict(F.col("text"), references(docs))["kept"])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have letters and fit one of the learned languages.

    Where no row names a language there is nothing to fit, and every text with letters stays.
    """
    prepare(spark)
    profiles = learn_profiles(docs)
    if not profiles.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predict_lang(F.col("text"), profiles)
    return docs.where((found["lang_pred"] != UND) & (found["score"] >= MIN_SCORE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the least id (then fingerprint, text hash)."""
    prepare(spark)
    return keep_representatives(near_duplicates(docs, shingle=3, max_bits=3, seed=42, carry=True))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of at most 4096 tokens."""
    prepare(spark)
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

# Fingerprints, letter vectors and tokens are beyond SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
