"""Frames a week in both modes, and resamples without arcs."""

import json

import numpy as np
import pyarrow as pa
import pytest

from parleynet.functions.verbs import with_substance
from parleynet.operators import kernels as K, measures as M, timeline as T
from parleynet.plans import fixtures as X, slice_queries as Q

SF_DIR = "/root/testdata/sf0.001"


def test_frames_are_weekly_in_both_modes(spark, monkeypatch):
    short = T.with_week(X.edges(spark, SF_DIR).where("outlet <> 'P' AND event_date < '1995-02-20'"))
    monkeypatch.setattr(Q, "events", lambda spark, d: short)
    weeks = T.date_range(short).first().weeks
    got = {(r.outlet, r.mode, r.week): json.loads(r.frame) for r in Q.QUERIES["export_frames"](spark, SF_DIR).collect()}
    outlets = {k[0] for k in got}
    assert weeks > 5 and outlets and set(got) == {(o, m, w) for o in outlets for m in ("window", "cumulative") for w in range(weeks)}
    # The window of the first four weeks holds what the cumulative frame does.
    assert all(got[o, "window", w] == got[o, "cumulative", w] for o in outlets for w in range(4))
    assert any(got[o, "window", weeks - 1] != got[o, "cumulative", weeks - 1] for o in outlets)
    flow = {(r.outlet, r.mode, r.week, r.actor): round(r.score, 4) for r in Q.QUERIES["frame_flow"](spark, SF_DIR).collect()}
    nodes = {(*k, n["actor"]): n["broker"] for k, f in got.items() for n in f["nodes"]}
    assert flow and {k: v for k, v in flow.items() if v} == {k: v for k, v in nodes.items() if v}
    top = Q.QUERIES["frame_extremes"](spark, SF_DIR).first()
    assert (top.max_size, top.max_score) == (max(n["size"] for f in got.values() for n in f["nodes"]), max(nodes.values()))


def test_focus_rank_beyond_the_shown(spark):
    scores = spark.createDataFrame([("o", 0, f"a{i:02}", 1.0 - i / 100, None, 0.5) for i in range(12)] + [("o", 0, "zz", 0.0, None, None)], "outlet string, week int, actor string, flat double, graded double, brokering double")
    sizes = spark.createDataFrame([("o", 0, f"a{i:02}", 2) for i in range(12)], "outlet string, week int, actor string, size long")
    edges = spark.createDataFrame([], "outlet string, week int, source string, target string, coop long, conf long, neu long, w long, pol string")
    grid = spark.createDataFrame([("o", 0, "2020-01-07"), ("o", 1, "2020-01-14")], "outlet string, week int, frame_date string")
    nodes = T.ranked_nodes(sizes, scores, ("outlet", "week"))
    got = {r.week: json.loads(r.frame) for r in T.export_frames(nodes, edges, ("outlet", "week"), "a10", grid).collect()}
    assert len(got[0]["nodes"]) == 12 and [x["actor"] for x in got[0]["leaderboard"]] == [f"a{i:02}" for i in range(8)] and got[0]["focus_rank"] == 11
    assert got[1] == {"date": "2020-01-14", "nodes": [], "edges": [], "leaderboard": [], "focus_rank": None}


def test_resamples_without_an_arc_count(spark):
    rows = [("o", "p", "1", "A", "B", 1.0), ("o", "q", "2", "A", "B", 0.0)]
    e = spark.createDataFrame(rows, "outlet string, phase string, doc_id string, source string, target string, weight double")
    got = {r.phase: r for r in M.bootstrap(e, lambda frame: float(len(frame) > 0)).collect()}
    assert 0.5 < got["p"].mean < 0.75 and got["p"].low == 0.0 and got["p"].high == 1.0
    assert (got["q"].mean, got["q"].low, got["q"].high) == (0.0, 0.0, 0.0)


def test_path_share_of_a_bridge(spark):
    rows = [("o", "p", str(i), s, t, 1.0) for i in range(40) for s, t in (("A", "K"), ("K", "B"))]
    e = spark.createDataFrame(rows, "outlet string, phase string, doc_id string, source string, target string, weight double")
    r = M.bootstrap(e, M.path_share({"A": 0, "K": 1, "B": 2}, "K", "A", "B"), n=20).first()
    assert (r["mean"], r.low, r.high) == (1.0, 1.0, 1.0)


def test_multiplicities_follow_a_poisson_law():
    times = M.multiplicities(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 2000), 500)
    shares = np.bincount(times.ravel(), minlength=4) / times.size
    assert np.abs(shares[:4] - [np.exp(-1.0) / k for k in (1, 1, 2, 6)]).max() < 0.002
    assert abs(np.corrcoef(times[:, 0], times[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(times[0], times[1])[0, 1]) < 0.15


def test_sums_of_a_task_equal_those_of_single_rows(monkeypatch):
    monkeypatch.setattr(M, "ROWS", 7)
    monkeypatch.setattr(M, "HELD", 3)
    rows = [(f"o{i % 2}" if i % 5 else None, "A", "BC"[i % 3 == 0], float(i % 4 + 1), i * 7919) for i in range(100)]
    names = ["outlet", "source", "target", "w", "document"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k : k + 30]], schema=pa.schema(list(zip(names, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()))))) for k in range(0, 100, 30)]
    got, want = {}, {}
    for batch in M._drawn(3, 20)(iter(batches)):
        for r in batch.to_pylist():
            at = (r["outlet"], r["source"], r["target"])
            got[at] = got.get(at, 0) + np.array(r["drawn"])
    for *at, w, document in rows:
        want[tuple(at)] = want.get(tuple(at), 0) + w * M.multiplicities(np.array([document]), 20)[0]
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)


EDGES = "outlet string, phase string, doc_id string, source string, target string, weight double"


@pytest.mark.parametrize("leaf_docs", [1024, 5])
def test_each_resample_has_exactly_as_many_documents(spark, leaf_docs):
    rows = [("o", p, f"{p}{i}", "A", "B", 1.0) for p, k in (("p", 90), ("q", 1), (None, 7)) for i in range(k)]
    e = spark.createDataFrame(rows, EDGES)
    got = {r.phase: (r["mean"], r.low, r.high) for r in M.exact_bootstrap(e, lambda f: float(f["strength"].sum()), n=40, leaf_docs=leaf_docs).collect()}
    assert got == {"p": (90.0,) * 3, "q": (1.0,) * 3, None: (7.0,) * 3}


def test_splits_of_a_tree_add_up():
    sizes = {(): 1000, (0,): 600, (1,): 400, (0, 0): 350, (0, 1): 250, (1, 0): 399, (1, 1): 1}
    leaves = [M.leaf_draws(("o",), [sizes[()], sizes[(a,)], sizes[(a, b)]], 2 * a + b, 300, 7) for a in (0, 1) for b in (0, 1)]
    assert (sum(leaves) == 1000).all()
    assert all(abs(x.mean() - sizes[(k >> 1, k & 1)]) < 4 for k, x in enumerate(leaves))
    times = M.leaf_multiplicities(("o",), [50, 30], 0, 400, 7)
    assert (times.sum(axis=0) == M.leaf_draws(("o",), [50, 30], 0, 400, 7)).all() and abs(times.mean() - 1) < 0.05


@pytest.mark.parametrize("leaf_docs", [1024, 8])
def test_interval_equals_that_of_plain_resampling(spark, leaf_docs):
    r = np.random.default_rng(5)
    docs = [(f"d{i}", [("A", "K", float(r.integers(0, 3))), ("K", "B", float(r.integers(0, 2)))]) for i in range(60)]
    e = spark.createDataFrame([("o", "p", d, *a) for d, arcs in docs for a in arcs], EDGES)
    weight = lambda f: float(f.loc[f["source"] == "A", "strength"].sum())
    got = M.exact_bootstrap(e, weight, n=2000, leaf_docs=leaf_docs).first()
    one = np.array([arcs[0][2] for _, arcs in docs])
    plain = np.array([one[r.integers(0, 60, 60)].sum() for _ in range(20_000)])
    want = (plain.mean(), *np.percentile(plain, [2.5, 97.5]))
    assert np.abs(np.array([got["mean"], got.low, got.high]) - want).max() < 1.6


def test_edges_of_resamples_are_worked_out_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    e = spark.createDataFrame([("o", "pq"[i % 2], f"{i // 3}", "A", "B", float(i % 4)) for i in range(90)], EDGES).mapInArrow(counted, EDGES)
    assert M.exact_bootstrap(e, lambda f: float(len(f)), n=10, leaf_docs=4).count() == 2 and rows.value == 90


def test_parts_of_tasks_are_added_up_as_arrays(monkeypatch):
    monkeypatch.setattr(M, "HELD", 2)
    schema = pa.schema([("outlet", pa.string()), ("source", pa.string()), ("drawn", pa.list_(pa.float64()))])
    parts = [(None, "A", [1.0, 2.0]), (None, "A", [3.0, 4.0]), ("o", None, [5.0, 6.0]), ("o", "A", [0.0, 1.0]), ("o", "A", [0.5, 0.0]), ("o", "B", [7.0, 7.0])]
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in parts[k : k + 4]], schema=schema) for k in (0, 4)]
    got = [tuple(r.values()) for b in M._added_up(2)(iter(batches)) for r in b.to_pylist()]
    assert got == [(None, "A", [4.0, 6.0]), ("o", None, [5.0, 6.0]), ("o", "A", [0.5, 1.0]), ("o", "B", [7.0, 7.0])]


def test_leaves_that_follow_one_another_share_their_splits():
    sizes, met = [80, 40, 20, 10], {}
    for key, leaf in (("o", 0), ("o", 1), ("o", 2), ("o", 7), ("p", 7), ("p", 0), (None, 0)):
        assert (M.leaf_draws((key,), sizes, leaf, 30, 5, met) == M.leaf_draws((key,), sizes, leaf, 30, 5)).all()


def by_definition(w):
    """Current-flow betweenness of the largest component: half the currents at a node over all pairs that it doesn't end."""
    nodes = K.largest_component(w)
    n, h = len(nodes), w[np.ix_(nodes, nodes)]
    if n < 3:
        return {}
    inverse, out = np.linalg.pinv(np.diag(h.sum(axis=1)) - h), np.zeros(n)
    for s in range(n):
        for t in range(s + 1, n):
            p = inverse[:, s] - inverse[:, t]
            through = np.abs(h * (p[:, None] - p[None, :])).sum(axis=1) / 2
            through[[s, t]] = 0
            out += through
    return dict(zip(nodes.tolist(), out * 2 / ((n - 1) * (n - 2))))


def test_boards_and_sparklines_rank_by_substance_flow(spark):
    axis = X.axis(spark, SF_DIR)
    names = list(axis.order)
    rows = with_substance(Q.events(spark, SF_DIR).where("polarity = 'positive'")).where("substance > 0").select("outlet", "week", "source", "target", "substance").collect()
    weeks = range(Q.T.calendar(Q.events(spark, SF_DIR)).count())
    scores = {}
    for outlet in {r.outlet for r in rows}:
        for week in weeks:
            a = np.zeros((len(names), len(names)))
            for r in rows:
                if r.outlet == outlet and week - 3 <= r.week <= week:
                    a[axis.order[r.source], axis.order[r.target]] += r.substance
            low = np.tril(np.where(a > 0, a, a.T), -1)
            scores[outlet, week] = {names[v]: round(x, 4) for v, x in by_definition(low + low.T).items()}
    board = {}
    for r in Q.QUERIES["flow_board"](spark, SF_DIR).collect():
        board.setdefault((r.outlet, r.week), []).append((r["rank"], r.actor, r.score))
    line = {(r.outlet, r.week): r.value for r in Q.QUERIES["flow_sparkline"](spark, SF_DIR).collect()}
    near = 0
    for key, found in scores.items():
        want = sorted(((x, a) for a, x in found.items() if x > 0 and a not in axis.principals), key=lambda p: (-p[0], p[1]))[:5]
        got = [s for _, _, s in sorted(board.get(key, []))]
        assert np.abs(np.array(got) - [x for x, _ in want]).max(initial=0) < 2e-4 and len(got) == len(want)
        near += [a for _, a, _ in sorted(board.get(key, []))] == [a for _, a in want]
        assert abs(line[key] - found.get(axis.focus, 0)) < 2e-4
    # Scores that rounding makes equal or not may change places.
    assert near >= 0.98 * len(scores) and any(line.values())
