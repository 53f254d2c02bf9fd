"""Incremental collection, extraction and slicing.

Progress lives in the query's checkpoint, each run takes what is new and stops
(`availableNow`), and late rows are taken up to a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.gates import not_yet_done


def read_stream(spark: SparkSession, folder: str, schema, kind: str = "parquet", pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).format(kind).load(folder)


def first_seen(articles: DataFrame, key: str = "url", time: str = "pub_ts", late: str = "2 days") -> DataFrame:
    """Each key once within the watermark; rows later than it are left out, so state stays bounded."""
    return articles.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sliding_counts(events: DataFrame, time: str = "ts", keys: tuple[str, ...] = (), span: str = "28 days", slide: str = "7 days", offset: str = "4 days", late: str = "2 days") -> DataFrame:
    """Counts of each sliding window; the offset aligns weeks (Mondays by default, as the epoch was a Thursday)."""
    return events.withWatermark(time, late).groupBy(F.window(time, span, slide, offset).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> None:
    """Takes all that is there and stops; the next run goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_in_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Hands each micro-batch to `write`, once for each batch number."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def extract_new(chunks: DataFrame, store: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], record_schema: str, retry_errors: bool = False) -> None:
    """Runs `extract` on chunks without a record in the store and appends their records."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.schema(record_schema).json(store)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = spark.createDataFrame([], record_schema)
        extract(not_yet_done(batch.dropDuplicates(["doc_id"]), done, retry_errors)).write.mode("append").json(store)

    chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
