"""The corpus pipeline: documents in, token ids of the mixed and cleaned corpus out.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the
columns of documents; the last returns their token ids. An empty table goes through to an
empty result. A null or empty text goes at the first stage, and without labelled rows so
does every text; repeated rows of an id are one document from dedup on; other columns are
kept as they are until the last stage, which leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parleynet.llm import bpe, language_id, mixture, near_duplicates, quality_rules
from parleynet.llm._run import saved


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin; the dictionaries come from the labelled rows of docs."""
    return language_id.accepted(docs, language_id.fit(docs.where(~language_id.held_out())))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits on repetition."""
    return quality_rules.clean(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more)."""
    return near_duplicates.distinct_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the seeded prefix of their leaf's budget, at most once each."""
    return mixture.mixed(docs, mixture.WEIGHTS, max_epochs=1)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, ids) of each document."""
    encoded = bpe.encode(docs)
    return encoded.select("doc_id", F.coalesce(F.octet_length("ids") / 4, F.lit(0)).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES = [("language", language), ("quality", quality), ("dedup", dedup), ("mixing", mixing), ("encoding", encoding)]

#: Compression and MinHash components can't be said in SQL. Of the stages, dedup and encoding are tested against brute force; the others against their operators, which have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
