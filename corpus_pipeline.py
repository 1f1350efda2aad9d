"""From raw documents to packed training sequences, each stage over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact, jaccard, langid, mixing, packing
from plumbline.llm.common import keep, read, remainder

#: A language below this probability is no language; neither is `und`.
MIN_SCORE = 0.5
#: No SQL: classification, permutations and packing; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from two thirds of them."""
    model = langid.fit(docs.where(remainder("doc_id", 3) != 1))
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    judged = langid.predict(docs, model, keep=names)
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*names)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the documents that the mix takes, a row for each pass."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of permitted lengths."""
    return packing.sequences(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("source_mixing", source_mix),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
