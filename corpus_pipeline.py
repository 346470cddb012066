"""A corpus pipeline: language ID, exact and near deduplication, packing into training windows.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.
Between stages the result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watttrail.llm.exact_dedup import drop_exact_duplicates
from watttrail.llm.langid import UNDETERMINED, predict, train
from watttrail.llm.memory import bound_batches
from watttrail.llm.packing import pack_documents
from watttrail.llm.queries import word_bpe
from watttrail.llm.shingle_dedup import drop_similar
from watttrail.session import stage, table

#: A document goes unless one language holds at least half of its letters.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones among ``docs`` teach."""
    bound_batches(spark)
    found = predict(docs, train(docs))
    sure = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return found.where(sure).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 of five-word shingles.

    SimHash blocks propose texts a few bits apart, MinHash bands those further apart; the exact similarity decides.
    """
    return drop_similar(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into windows; one row per piece."""
    bound_batches(spark)
    return pack_documents(docs, word_bpe())


STAGES = [("language", language), ("exact", exact), ("near", near), ("pack", pack)]

#: The stages learn, hash and tokenize; SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
