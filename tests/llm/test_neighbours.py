"""Neighbours of the forest against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parleynet.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int"
ASKS = "vec_id % 100 = 0"


def brute(rows, k=10, every=100):
    """Each query's nearest by plain double-precision distances."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = {}
            for j, w in good:
                if j != i and len(w) == len(v):
                    near[j] = min(near.get(j, np.inf), float(np.sqrt(((v - w) ** 2).sum())))
            out.setdefault(i, []).append(near)
    merged = {i: {j: min(n[j] for n in found if j in n) for j in set().union(*found)} for i, found in out.items()}
    return {i: sorted((d, j) for j, d in near.items())[:k] for i, near in merged.items() if near}


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(i, d) for _, i, d in sorted(x)] for q, x in out.items()}


def same(got, want):
    assert set(got) == set(want)
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [j for _, j in near]
        assert np.allclose([d for _, d in got[q]], [d for d, _ in near], rtol=1e-14, atol=0)


def test_query_finds_nine_tenths_of_the_nearest(spark):
    table = "/root/testdata/sf0.1/embeddings.parquet"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(table).collect()]
    want, got = brute(rows), answers(N.op12_neighbours(spark, "/root/testdata/sf0.1"))
    hits = 0
    for q, near in want.items():
        distance = {j: d for d, j in near}
        assert len(got[q]) == 10
        hits += sum(i in distance for i, _ in got[q])
        assert all(abs(d - distance[i]) <= 1e-14 * d for i, d in got[q] if i in distance)
        assert got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))
    assert hits >= 0.9 * 10 * len(want)


def test_clusters_open_few_leaves():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16)) * 20
    x = np.concatenate([c + rng.standard_normal((200, 16)) * 0.05 for c in centres])
    ids = np.arange(len(x))
    at = rng.permutation(len(x))[:4096]
    forest = N.Forest(ids[at], x[at], len(x), N.Settings())
    rows, trees, leaves = forest.search(x[::100], ids[::100])
    assert len(rows) / len(x[::100]) < 0.1 * forest.trees * forest.leaves
    placed, hits = forest.leaf(x), 0
    for k, i in enumerate(ids[::100]):
        open_ = {(t, v) for r, t, v in zip(rows, trees, leaves) if r == k}
        near = [j for j in np.argsort(((x - x[i]) ** 2).sum(axis=1), kind="stable") if j != i][:10]
        hits += sum(any((t, placed[t, j]) in open_ for t in range(forest.trees)) for j in near)
    assert hits >= 0.9 * 10 * len(x[::100])


def test_broken_vectors_take_no_part_and_ties_go_to_smaller_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (None, [1.0, 0.0]), (100, [0.0, 0.0]), (200, [0.0, 2.0]), (300, [1.0, 2.0, 3.0]), (2, [0.0, 1.0])]
    got = answers(N.nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), F.expr(ASKS)))
    same(got, brute(rows))
    assert [i for i, _ in got[0]] == [1, 2, 3, 200] and 300 not in got


def test_repeated_ids_are_one_candidate_and_one_query(spark):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (0, [5.0, 5.0]), (7, [2.0, 1.0]), (7, [9.0, 9.0]), (8, [6.0, 5.0])]
    rows += [(5, [1.0, 1.0])] * 30 + [(6, [1.0, 1.0]), (9, [3.0, 1.0])]
    same(answers(N.nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), F.expr(ASKS))), brute(rows))


@pytest.mark.parametrize("hot", [True, False])
def test_small_blocks_and_copies_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 50)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(700)]
    if hot:
        rows = [(i, [0.5, 0.25, 1.0, -1.0] if i % 3 == 0 else v) for i, v in rows]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(5)
    same(answers(N.nearest(df, F.col("vec_id") % 20 == 0, settings=N.Settings(miss=0.0))), brute(rows, every=20))


def test_doubles_extra_columns_and_empty_tables(spark):
    rows = [(i, [float(i), 1e-9 * i + 1]) for i in range(1, 9)] + [(0, [1e200, 1.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, query_id string, score double")
    got = answers(N.nearest(df, F.expr(ASKS)))
    assert [i for i, _ in got[100]] == [1, 2, 3, 4, 5, 6, 7, 8, 0] and [i for i, _ in got[0]] == [1, 2, 3, 4, 5, 6, 7, 8, 100]
    empty = N.nearest(spark.createDataFrame([], SCHEMA), F.expr(ASKS))
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert N.nearest(spark.createDataFrame([(1, [1.0], 0)], SCHEMA), F.expr(ASKS)).collect() == []
    assert N.nearest(spark.createDataFrame([(0, [1.0], 0)], SCHEMA), F.expr(ASKS)).collect() == []
