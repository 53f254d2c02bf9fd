"""A payload in pieces against a plain dump."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from parleynet.plans import slice_queries as Q
from parleynet.sources import payload as P, shared


def text_of(folder):
    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    return "".join("".join(open(os.path.join(folder, f), encoding="utf-8").read().splitlines()) for f in parts)


@pytest.mark.parametrize("n", [0, 1, 2000])
def test_pieces_equal_a_plain_dump(spark, tmp_path, n):
    items = spark.range(n).repartition(5).select("id", F.to_json(F.struct("id", F.concat(F.lit('é "x" '), F.col("id").cast("string")).alias("t"))).alias("piece"))
    fields = spark.range(n).repartition(3).select((-F.col("id")).alias("k"), F.concat(F.lit('"f'), "id", F.lit('":'), "id").alias("piece"))
    one = spark.range(n).limit(1).select(F.lit('{"a":1}').alias("piece"))
    sections = [P.Section("items", "list", items, ("id",)), P.Section("meta", "value", one), P.Section("by", "fields", fields, ("k",))]
    pieces = P.payload_pieces(spark, "V", sections)
    assert sorted(r.piece_no for r in pieces.collect()) == list(range(2 * n + min(n, 1) + 6))
    P.write_payload(pieces, str(tmp_path / "out"))
    want = {"items": [{"id": i, "t": f'é "x" {i}'} for i in range(n)], "meta": {"a": 1} if n else None, "by": {f"f{i}": i for i in reversed(range(n))}}
    assert text_of(tmp_path / "out") == "window.V = " + json.dumps(want, separators=(",", ":"), ensure_ascii=False) + ";"


def shuffled(spark):
    """Bytes of shuffle files of the session."""
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return sum(size for d in dirs for name, size in files(d) if name.startswith("shuffle_"))


def files(folder):
    return [(f, os.path.getsize(os.path.join(root, f))) for root, _, names in os.walk(folder) for f in names if os.path.exists(os.path.join(root, f))]


def settled(read, at_most, seconds=10):
    """What is read when it is no more than at_most, or else after some seconds: files are removed a little later."""
    end = time.time() + seconds
    while (now := read()) > at_most and time.time() < end:
        time.sleep(0.1)
    return now


def moved(spark, run):
    """Bytes that run() writes for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        time.sleep(0.5)
        summaries = store.executorList(False)
        return sum(summaries.apply(i).totalShuffleWrite() for i in range(summaries.size()))

    before = total()
    run()
    return total() - before


@pytest.fixture
def nothing_broadcast(spark):
    """As with rows too many to be broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_a_payload_is_held_once_compressed_and_sorted_once(spark, nothing_broadcast):
    base = spark.conf.get("spark.checkpoint.dir")
    text = F.to_json(F.struct("id", F.sha2(F.col("id").cast("string"), 256).alias("name of a long field"), F.repeat(F.lit("the same words "), 20).alias("quote")))
    rows = spark.range(20000, numPartitions=3).select("id", text.alias("piece"))
    size = rows.select(F.sum(F.length("piece"))).first()[0]
    once = moved(spark, lambda: rows.repartitionByRange("id").write.format("noop").mode("overwrite").save())
    assert once > 1000000
    held = sum(n for _, n in files(base))
    found = []
    assert moved(spark, lambda: found.append(P.payload_pieces(spark, "V", [P.Section("items", "list", rows, ("id",))]))) < 1.2 * once
    # Reading numbers the pieces where they are; only the sizes of files are shuffled.
    assert moved(spark, lambda: found[0].write.format("noop").mode("overwrite").save()) < once / 100
    assert sum(n for _, n in files(base)) - held < size / 4
    assert found[0].count() == 20002


def test_the_display_holds_less_than_its_text(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    held = sum(n for _, n in files(base))
    pieces = Q.QUERIES["display_pieces"](spark, "/root/testdata/sf0.01")
    size = pieces.agg(F.sum(F.length("value"))).first()[0]
    assert size > 1000000 and sum(n for _, n in files(base)) - held < size / 3


def test_shuffles_below_written_rows_are_removed(spark):
    before = shuffled(spark)
    rows = shared.written(spark.range(50000).repartition(4).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).repartition(3, "t"))
    assert settled(lambda: shuffled(spark), before) <= before
    assert rows.count() == 50000


@pytest.mark.parametrize("settings", [{"spark.sql.files.openCostInBytes": "1"}, {"spark.sql.files.maxPartitionBytes": "1000"}, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "11"}])
def test_pieces_of_many_files_are_numbered_through(spark, monkeypatch, settings):
    monkeypatch.setattr(P, "FILE_PIECES", 70)
    settings = settings | {"spark.sql.execution.arrow.maxRecordsPerBatch": "33"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        items = spark.range(3000).repartition(5).select("id", (F.col("id") % 7).alias("r"))
        none = items.where("id < 0")
        pieces = P.payload_pieces(spark, "V", [P.Section("none", "fields", none, ("id",), F.col("r").cast("string")), P.Section("items", "list", items, ("id",), F.to_json(F.struct("id", "r")))])
        got = pieces.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.piece_no for r in got) == list(range(3004))
    text = "".join(r.value for r in sorted(got, key=lambda r: r.piece_no))
    assert text == "window.V = " + json.dumps({"none": {}, "items": [{"id": i, "r": i % 7} for i in range(3000)]}, separators=(",", ":")) + ";"
