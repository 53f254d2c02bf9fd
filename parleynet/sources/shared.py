"""The folder that driver and executors share, and rows written to it once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside the cluster's shared one; a local one only where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    base = base or tempfile.mkdtemp(prefix="streams-")
    return f"{base}/{uuid.uuid4().hex}"


#: Spark's setting that removes a query's shuffle files when the query has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that are made inside are removed when they have ended, not when the driver collects."""
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)


def written(df: DataFrame) -> DataFrame:
    """The rows of df, worked out once and read back from the shared folder, for plans that read them several times; nothing reads the shuffles below any more."""
    folder = shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
