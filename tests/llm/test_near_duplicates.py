"""Near-duplicates against brute force, and hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from parleynet.llm import fingerprints as FP, near_duplicates as ND
from tests_support import brute_components, shingle_set

SCHEMA = "doc_id long, text string"


def check(spark, rows, numerator=85, **settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = ND.near_duplicates(df, settings=ND.Settings(numerator=numerator, **settings)).collect()
    assert len(got) == len(rows)
    expected = brute_components(rows, numerator)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id]), r
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sorted((r.doc_id or 0, r.n_shingles) for r in got) == sorted((i or 0, len(shingle_set(t))) for i, t in rows)
    return got


def words(r, n):
    return [f"{r.choice('abcdefgh')}{r.randrange(400)}" for _ in range(n)]


def edited(r, base, changes):
    out = list(base)
    for _ in range(changes):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return " ".join(out)


def test_edge_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "one two three four five"), (8, "One two three four FIVE"), (9, None), (None, "a b"), (None, None)]
    got = {r.doc_id: r for r in check(spark, rows) if r.doc_id}
    assert got[5].component_id == 4 and got[8].component_id == 7 and got[2].component_id == 2


def test_copies_near_copies_and_chains(spark):
    r = random.Random(1)
    rows, n = [], 0
    for size in (2, 3, 40, 1, 1, 25):
        base = words(r, 120)
        for k in range(size):
            rows.append((n := n + 1, edited(r, base, 0 if k == 0 else r.randrange(0, 4))))
    chain = words(r, 150)
    for k in range(12):  # neighbours are alike, ends are not
        rows.append((n := n + 1, " ".join(chain)))
        at = 12 * k
        chain[at : at + 2] = [f"c{k}", f"d{k}"]
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1].upper())]
    r.shuffle(rows)
    check(spark, rows)
    check(spark, rows, numerator=70)


def test_group_whose_members_link_only_in_parts(spark):
    """Members share most of a passage, so buckets are large while most pairs don't link: blocks must find the ones that do."""
    r = random.Random(2)
    passage = words(r, 100)
    rows = []
    for i in range(60):
        rows.append((i, " ".join(passage + words(r, r.randrange(10, 60)))))
    for i in range(0, 60, 7):
        rows.append((100 + i, edited(r, rows[i][1].split(), 2)))
    check(spark, rows, block=8)


def test_repeated_ids_are_one_node(spark):
    r = random.Random(3)
    a, b = words(r, 80), words(r, 80)
    rows = [(1, " ".join(a)), (2, " ".join(a)), (2, " ".join(b)), (3, " ".join(b)), (4, "x y z")]
    got = ND.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]


def test_ids_with_several_texts_in_large_buckets(spark):
    r = random.Random(8)
    passage = words(r, 100)
    rows = [(i, " ".join(passage + words(r, 20 + i))) for i in range(30)] + [(i, " ".join(words(r, 80))) for i in range(0, 30, 2)]
    rows += [(50, edited(r, rows[3][1].split(), 1)), (51, edited(r, rows[30][1].split(), 1))]
    got = {(x.doc_id, x.n_shingles): x.component_id for x in ND.near_duplicates(spark.createDataFrame(rows, SCHEMA), settings=ND.Settings(numerator=85, block=8)).collect()}
    expected = brute_components(rows, 85)
    assert {i: c for (i, _), c in got.items()} == expected and len({n for _, n in got}) > 20


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ND.near_duplicates(empty).count() == 0 and ND.distinct_documents(empty).count() == 0
    names = ["a", "b", "rep", "label", "bucket", "n", "size", "signature", "component_id", "kept", "key1", "gone_id"]
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "q")], SCHEMA)
    rows = rows.select("*", *(F.lit(7).alias(c) for c in names))
    assert ND.near_duplicates(rows).where("kept").count() == 2
    kept = ND.distinct_documents(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_one_row_of_a_repeated_id_stays(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "other text entirely of five words"), (None, "x"), (None, "x")], SCHEMA)
    assert sorted(r.doc_id or 0 for r in ND.distinct_documents(rows).collect()) == [0, 0, 1, 2]


def test_posterior_bounds():
    assert ND.least_matches(25, 0.85, 1e-7) < ND.least_matches(25, 0.85, 1e-2) <= 25
    assert ND.least_matches(125, 0.85, 1e-7) > 60
    with pytest.raises(TypeError):
        ND.Settings("five", numerator=None)


def test_banded_pairs_are_verified(spark):
    r = random.Random(5)
    base = words(r, 100)
    rows = [(1, " ".join(base)), (2, edited(r, base, 1)), (3, " ".join(words(r, 100))), (4, " ".join(base[:50] + words(r, 50)))]
    got = {tuple(sorted((x.a, x.b))) for x in FP.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 2)}
