"""A corpus pipeline of four operators: language ID, near-dedup, pseudonyms, packing.

Each stage takes the documents its predecessor kept; the last one returns their packed pieces.
Defined results: texts that are null or have no letter, and those whose best language has a
probability under one half, go. Documents whose sets of five-word shingles have a similarity of 0.8
or more are near duplicates; of each group the row with the smallest doc_id stays (null last),
whichever doc_ids other groups have. Columns beside doc_id and text pass through; n_chars, where
it is there, follows the text. Empty tables give empty results. The pseudonyms' key is the
session's (pseudonyms.KEY_SETTING).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import language, packing, pseudonyms, simhash
from vecloom.llm.common import materialize

LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told."""
    told = language.identify(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns}), language.train(docs), [f"own_{c}" for c in docs.columns], "own_text")
    kept = told.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(f"own_{c}").alias(c) for c in docs.columns))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies: the one with the smallest doc_id."""
    return simhash.without_copies(docs)


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text by its pseudonyms."""
    done = pseudonyms.pseudonymize(docs, pseudonyms.key_of(spark))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences; one row for each piece."""
    return packing.pack(docs)


STAGES = [("language", known_language), ("near_copies", without_near_copies), ("pseudonyms", pseudonymous), ("packing", packed)]

#: No stage but the joins between them can be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
