"""Verified links in groups whose buckets' pivots are no partners."""

import random

from tests_support import brute_components, shingle_set

from parleynet.llm import fingerprints as FP
from parleynet.llm._run import components

SCHEMA = "doc_id long, text string"


def passage_rows():
    """Documents that share a passage, and among the later ones pairs that are near copies of one another."""
    r = random.Random(5)
    word = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, rows = word(150), []
    for i in range(40):
        rows.append((i, " ".join(passage + word(45))))
    for i in range(40, 80, 2):
        own = passage + word(45)
        rows += [(i, " ".join(own)), (i + 1, " ".join(own[:-8] + word(8)))]
    return rows + [(200, rows[3][1]), (201, rows[-1][1]), (202, ""), (203, None)]


def test_links_of_a_shared_passage(spark):
    rows = passage_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    pairs = {(x.a, x.b) for x in FP.similar_pairs(df).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    assert all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in pairs)
    expected = brute_components(rows, 80)
    labels = {x.node: x.label for x in components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert sum(i != c for i, c in expected.items()) >= 22
    assert {i: labels.get(i, i) for i in expected} == expected


def test_fingerprints_come_with_components(spark, tmp_path):
    rows = passage_rows()
    spark.createDataFrame(rows + [(None, "x"), (7, "another text of the same id")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(x.doc_id, x.component_id) for x in FP.op6_fingerprints(spark, str(tmp_path)).collect()]
    expected = brute_components(rows, 80)
    assert sorted(got, key=str) == sorted([*expected.items(), (None, None), (7, 7)], key=str)
