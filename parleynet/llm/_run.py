"""Materialising helpers: lineage is cut in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir; make a folder of our own only where none is named (tests, local runs)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


#: Spark's setting that removes a query's shuffle files when the query has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written to the shared checkpoint folder; the shuffles below are removed when they are written, as nothing reads them any more."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        # A query takes the setting when it is made.
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)


def forget(*frames: DataFrame) -> None:
    """Remove the written rows of saved() frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """df itself if its rows come from files in a fixed order; after a shuffle, whose order may change when a lost task runs again, its saved rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return saved(df) if "Exchange" in plan else df


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the undirected graph edges(a, b): label is the smallest node that can be reached.

    Minimum labels spread along edges and jump along labels, so the number of
    rounds grows with the logarithm of a component's diameter. Each round is
    written out. Edges of a null end and loops are ignored.
    """
    both = edges.where("a <> b").select("a", "b")
    both = saved(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        spread = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "label")
        lower = labels.unionByName(spread).groupBy("node").agg(F.min("label").alias("label"))
        lower = saved(lower)
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = saved(lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = after.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        forget(labels, lower)
        labels = after
        if not changed:
            forget(both)
            return labels
