"""A corpus pipeline: quality, exact and near duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorframe.llm import packing, quality
from sensorframe.llm.common import table
from sensorframe.llm.decontaminate import drop_contaminated
from sensorframe.llm.exact_dedup import drop_exact
from sensorframe.llm.minhash import drop_near
from sensorframe.llm.queries import vocabulary
from sensorframe.session import stored

# A document goes only if the classifier is that sure of its low quality.
LEAST_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rule ensemble, fitted on the labels, does not reject.

    Every row is judged by its whole text; null and empty texts are scored like any other, repeated rows share
    their score. Extra columns pass through. Without labels of both kinds all scores are equal; an empty table
    stays empty.
    """
    return quality.keep_scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")), LEAST_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, by row; see ``drop_exact`` for nulls, ties and repeated rows."""
    return drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more), by row.

    See ``drop_near`` for nulls, empty and long texts, ties, repeated rows, empty tables and extra columns.
    """
    return drop_near(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, by row; see ``drop_contaminated`` for the other cases."""
    return drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as token pieces, placed in sequences of 2048 tokens.

    A null or empty text is its end mark alone; rows of equal or null id are packed each for itself; texts of any
    length are cut into pieces; an empty table gives none. Only doc_id and text are read.
    """
    return packing.pack(spark, packing.tokenised(docs, vocabulary()))


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table documents; each but the last is stored before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs


# Fitted rules and latent vectors have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
