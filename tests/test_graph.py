"""Kernels in closed form and against brute force; network identities."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parleynet.operators import kernels as K, measures as M, network as N


def weights(n, arcs):
    w = np.zeros((n, n))
    for a, b in arcs:
        w[a, b] = w[b, a] = 1
    return w


@pytest.mark.parametrize(
    "n, arcs, expected",
    [
        (3, [(0, 1), (1, 2)], {0: 0, 1: 1, 2: 0}), (4, [(0, 1), (0, 2), (0, 3)], {0: 1, 1: 0, 2: 0, 3: 0}), (3, [(0, 1), (1, 2), (0, 2)], dict.fromkeys(range(3), 1 / 3)),
        (4, [(0, 1), (1, 2), (2, 3), (3, 0)], dict.fromkeys(range(4), 1 / 3)), (4, list(itertools.combinations(range(4), 2)), dict.fromkeys(range(4), 0.25)), (2, [(0, 1)], {}), (3, [], {}), (5, [(0, 1), (2, 3), (3, 4)], {2: 0, 3: 1, 4: 0}),
    ],
)
def test_current_flow_closed_forms(n, arcs, expected):
    got = K.current_flow(weights(n, arcs))
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-9 for k, v in expected.items())


def brute_flow(w):
    n = len(w)
    p = np.linalg.pinv(np.diag(w.sum(axis=1)) - w)
    out = np.zeros(n)
    for s, t in itertools.combinations(range(n), 2):
        v = p[:, s] - p[:, t]
        through = (w * np.abs(v[:, None] - v[None, :])).sum(axis=1) / 2
        out += np.where([k in (s, t) for k in range(n)], 0, through)
    return out * 2 / ((n - 1) * (n - 2))


@settings(max_examples=25, deadline=None)
@given(st.integers(3, 7).flatmap(lambda n: st.lists(st.integers(1, 9), min_size=n * (n - 1) // 2, max_size=n * (n - 1) // 2).map(lambda x: (n, x))))
def test_current_flow_equals_pairwise_sum(graph):
    n, x = graph
    w = np.zeros((n, n))
    w[np.triu_indices(n, 1)] = x
    w = w + w.T
    got = K.current_flow(w)
    assert np.allclose([got[i] for i in range(n)], brute_flow(w))


def test_collapse_of_reciprocal_arcs():
    s, t, w = np.array([0, 1]), np.array([1, 0]), np.array([5.0, 2.0])
    assert K.collapse(2, s, t, w)[0, 1] == 2.0  # the later node's arc stays
    assert K.collapse(2, s, t, w, "sum")[0, 1] == 7.0


def test_paths_and_betweenness():
    s, t = np.array([0, 1, 0, 2, 1, 3, 2, 3]), np.array([1, 3, 2, 3, 0, 1, 0, 2])
    assert K.path_share(4, s, t, np.ones(8), 1, 0, 3) == 0.5
    assert np.allclose(K.betweenness(4, s, t, np.ones(8)), [1 / 6] * 4)
    assert K.path_share(4, s[:1], t[:1], np.ones(1), 2, 0, 3) == 0.0
    assert abs(K.pagerank(4, s, t, np.ones(8)).sum() - 1) < 1e-9


EDGES = [("o", "pre", a, b, v, verb, d) for a, b, v, verb, d in [
    ("A", "B", "coop", "hosted", "1"), ("A", "B", "coop", "said", "1"), ("A", "B", "conflict", "struck", "2"), ("B", "C", "coop", "hosted", "2"), ("C", "A", "neutral", "met", "3"), ("C", "B", "coop", "facilitated", "3"), ("B", "A", "coop", "hostile", "4"),
]]
SCHEMA = "outlet string, phase string, source string, target string, valence string, raw_verb string, doc_id string"


@pytest.fixture()
def net(spark):
    return N.signed_network(spark.createDataFrame(EDGES, SCHEMA))


def test_votes_are_conserved(net):
    row = net.agg(F.sum(F.col("coop") + F.col("conf") + F.col("neu")).alias("n"), F.sum("broker").alias("b")).first()
    assert row.n == len(EDGES)
    assert row.b == 4  # hosted twice, facilitated, and `host` is in hostile


def test_shares_sum_to_one(net):
    assert abs(sum(r.share for r in N.influence_share(net).collect()) - 1) < 1e-12


def test_liaison_needs_three_blocs(spark, net):
    blocs = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "z")], "actor string, bloc string")
    got = {r.broker: r.liaison for r in N.liaison(N.project(net, "coop"), blocs).collect()}
    assert got == {"B": 2.0}  # A-B-C and C-B-A, one vote each at the weaker side
    same = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "x")], "actor string, bloc string")
    assert N.liaison(N.project(net, "coop"), same).count() == 0


def test_flow_over_groups_and_empty_graph(spark, net):
    view = N.project(net, "coop")
    got = {r.actor: r.score for r in M.flow_brokerage(view, {"A": 0, "B": 1, "C": 2}).collect()}
    assert abs(got["B"] - 1) < 1e-9
    assert M.flow_brokerage(view.limit(0), {"A": 0, "B": 1}).count() == 0


def test_constraint_and_effective_size(net):
    view = N.project(net, "coop")
    c = {r.actor: r.constraint for r in N.constraint(view).collect()}
    e = {r.actor: r.effective_size for r in N.effective_size(view).collect()}
    assert abs(c["A"] - 1) < 1e-12 and abs(e["B"] - 2) < 1e-12  # A has one tie; B's two neighbours aren't tied


def test_bootstrap_covers_the_mean(spark):
    rows = [("o", "pre", str(d), "A", "B", 1.0) for d in range(200)]
    e = spark.createDataFrame(rows, "outlet string, phase string, doc_id string, source string, target string, weight double")
    r = M.bootstrap(e, lambda frame: float(frame["strength"].sum()), n=60).first()
    assert 190 < r["mean"] < 210 and r.low < r["mean"] < r.high


def test_permutation_invariance(spark):
    a = N.signed_network(spark.createDataFrame(EDGES, SCHEMA)).orderBy("source", "target").collect()
    b = N.signed_network(spark.createDataFrame(EDGES[::-1], SCHEMA)).orderBy("source", "target").collect()
    assert a == b


@pytest.mark.parametrize("seed", range(5))
def test_flow_of_a_series_equals_that_of_each_graph(seed):
    r = np.random.default_rng(seed)
    n, series, updated = 12, K.FlowSeries(renew=40), 0
    w = np.triu((r.random((n, n)) < 0.4) * r.integers(1, 9, (n, n)), 1).astype(float)
    for _ in range(120):
        for _ in range(r.integers(0, 4)):
            i, j = sorted(r.choice(n, 2, replace=False))
            w[i, j] = r.integers(0, 9) * (r.random() < 0.6)
        if r.random() < 0.05:
            w[: r.integers(1, n)] = 0
        both = w + w.T
        nodes = K.largest_component(both)
        got = series.step(both)
        updated += series.age > 0
        if len(nodes) < 3:
            assert got == {}
            continue
        h = both[np.ix_(nodes, nodes)]
        # Throughput by its definition: half the currents at a node, over the pairs that it doesn't end.
        inverse, want = np.linalg.pinv(np.diag(h.sum(axis=1)) - h), np.zeros(len(nodes))
        for s in range(len(nodes)):
            for t in range(s + 1, len(nodes)):
                potential = inverse[:, s] - inverse[:, t]
                through = np.abs(h * (potential[:, None] - potential[None, :])).sum(axis=1) / 2
                through[[s, t]] = 0
                want += through
        want *= 2.0 / ((len(nodes) - 1) * (len(nodes) - 2))
        assert list(got) == nodes.tolist() and np.abs(np.array(list(got.values())) - want).max() < 1e-9
    assert updated > 20


def test_series_of_frames_equal_single_frames(spark, monkeypatch):
    monkeypatch.setattr(M, "SERIES", 3)
    r = np.random.default_rng(2)
    rows = [("o", k, "ABCDE"[i], "ABCDE"[j], float(r.integers(1, 5))) for k in range(8) for i in range(5) for j in range(5) if i != j and r.random() < 0.5]
    view = spark.createDataFrame(rows, "outlet string, week int, source string, target string, strength double")
    order = {x: i for i, x in enumerate("ABCDE")}
    plain = {(x.outlet, x.week, x.actor): x.score for x in M.flow_brokerage(view, order, ("outlet", "week")).collect()}
    got = {(x.outlet, x.week, x.actor): x.score for x in M.flow_series(view, order, ("outlet", "week")).collect()}
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-9 for k in got)
