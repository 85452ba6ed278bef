"""From raw documents to packed training sequences, stage by stage.

Each stage takes what the one before has written, in the columns of ``documents``; the last one
gives the pieces of the sequences.  A stage that is lost is run again from its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm import langid, mixing, ngram_join, packing, pii
from wattframe.session import stored

#: Probability of its language below which a document is rejected.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters or without a clear one go."""
    model = langid.fit(docs.select("doc_id", "text", "lang").filter(~langid.held_out()))
    added = ("_stage_lang", "_stage_score")
    told = langid.predict(docs, model, names_added=added)
    return told.filter((F.col(added[0]) != langid.UNKNOWN) & (F.col(added[1]) >= LEAST_SCORE)).drop(*added)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them masked."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, in training order."""
    return mixing.curriculum(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: SQL has no way to train a classifier or to tokenise; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
