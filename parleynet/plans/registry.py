"""The reference operators' queries and their SQL, put together from the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, slice_queries, source_queries, store_queries, text_queries

MODULES = (graph_queries, slice_queries, text_queries, store_queries, source_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["liaison"](spark, sf_dir)
