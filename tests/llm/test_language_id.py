"""Held-out accuracy on invented languages, and defined answers at the edges."""

import random
import zlib

from pyspark.sql import functions as F

from parleynet.llm import language_id as LI

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"aa": "the th er on ing and tion", "bb": "der sch ein ung keit und ver", "cc": "que le ment eau tion des é"}


def text(r, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def corpus(n=300):
    r = random.Random(9)
    langs = ["aa", "aa", "aa", "bb", "cc"]
    return [(i, text(r, lang, r.randrange(20, 80)), lang) for i in range(n) for lang in [r.choice(langs)]]


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = LI.fit(docs.where(~LI.held_out()))
    got = LI.identify(docs, model).withColumn("held_out", LI.held_out()).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = LI.fit(docs)
    odd = [(1, None, None), (2, "", None), (3, "123 !!! 45\n", None), (4, "é", None), (None, text(random.Random(1), "bb", 50), "aa"), (6, text(random.Random(2), "cc", 60000), None), (7, text(random.Random(3), "aa", 40).upper() + "!!", None)]
    df = spark.createDataFrame(odd, SCHEMA).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    got = {r.doc_id: r for r in LI.identify(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in SYLLABLES
    assert (got[None].lang_pred, got[6].lang_pred, got[7].lang_pred) == ("bb", "cc", "aa")
    kept = LI.accepted(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {None, 6, 7} and not {1, 2, 3} & {r.doc_id for r in kept.collect()}


def test_no_one_and_repeated_labels(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert LI.identify(none, LI.fit(none)).count() == 0
    rows = spark.createDataFrame([(1, "abc def", None), (2, "x", "aa")], SCHEMA)
    assert {r.lang_pred for r in LI.identify(rows, LI.fit(rows.where("lang IS NULL"))).collect()} == {"und"}
    assert {r.lang_pred for r in LI.identify(rows, LI.fit(rows)).collect()} == {"aa"}
    same = spark.createDataFrame([(1, "one and the same text", "aa")] * 500 + [(2, "ein anderer text", "bb")] * 3, SCHEMA)
    model = LI.fit(same, sample_docs=4)
    assert len(model.contents["aa"]) < 100 and LI.identify(same, model).where("lang_pred = 'bb'").count() == 3


def test_the_sample_is_bounded(spark):
    rows = spark.createDataFrame([(i, f"word{i} " * 2000, "aa") for i in range(200)], SCHEMA)
    model = LI.fit(rows, sample_docs=8, doc_bytes=100)
    assert len(model.contents["aa"]) <= 8 * 101
