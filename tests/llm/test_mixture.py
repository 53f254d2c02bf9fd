"""Budgets and prefixes against a sequential version."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parleynet.llm import mixture as M

SCHEMA = "domain string, lang string, source string, doc_id long, n_tokens long"


def split(budget, children):
    """children: {name: (weight, cap)}; whole tokens by weight, full ones first, largest remainder."""
    out, open_ = {}, dict(children)
    while True:
        total = sum(w for w, _ in open_.values())
        left = budget - sum(out.values())
        full = [n for n, (w, cap) in open_.items() if cap * total <= w * left]
        if not full:
            break
        name = min(full, key=lambda n: (open_[n][1] / open_[n][0] if open_[n][0] else -1, n))
        out[name] = open_.pop(name)[1]
    shares = {n: divmod(w * left, total) for n, (w, _) in open_.items()}
    spare = left - sum(q for q, _ in shares.values())
    for k, n in enumerate(sorted(shares, key=lambda n: (-shares[n][1], n))):
        out[n] = shares[n][0] + (k < spare)
    return out


def brute(rows, weights, percent, max_epochs, seed):
    rows = [(d or "(none)", lg or "(none)", s or "(none)", i, n) for d, lg, s, i, n in rows if n and n > 0]
    w = lambda *path: weights.get("/".join(path), weights.get("*/" * (len(path) - 1) + path[-1], 1))
    leaves = {}
    for d, lg, s, i, n in rows:
        leaves.setdefault((d, lg, s), []).append((i, n))
    cap = {k: 0 if 0 in (w(k[0]), w(*k[:2]), w(*k)) else sum(n for _, n in v) * max_epochs for k, v in leaves.items()}
    under = lambda *path: sum(c for k, c in cap.items() if k[: len(path)] == path)
    root = min(sum(n for *_, n in rows) * percent // 100, under())
    taken, total = {}, 0
    for d, b in split(root, {d: (w(d), under(d)) for d in {k[0] for k in leaves}}).items():
        for lg, b2 in split(b, {x: (w(d, x), under(d, x)) for x in {k[1] for k in leaves if k[0] == d}}).items():
            for s, b3 in split(b2, {x: (w(d, lg, x), cap[d, lg, x]) for x in {k[2] for k in leaves if k[:2] == (d, lg)}}).items():
                docs, epoch = leaves[d, lg, s], 1
                total += b3
                while b3 > 0:
                    order = docs if b3 >= sum(n for _, n in docs) else sorted(docs, key=lambda x: (hashlib.md5(f"{seed}|{epoch}|{x[0]}".encode()).hexdigest(), x[0]))
                    for i, n in order:
                        if b3 > 0:
                            taken[i, epoch] = min(n, b3)
                            b3 -= min(n, b3)
                    epoch += 1
    assert total == root
    return taken


@pytest.mark.parametrize("seed, percent, max_epochs, weights", [(1, 80, 4, M.WEIGHTS), (2, 37, 1, {"a": 5, "*/y": 7, "*/*/s1": 0}), (3, 100, 1, {}), (4, 300, 2, {"b": 0}), (5, 60, 3, {"a/x": 0, "b/y/s2": 9})])
def test_against_brute_force(spark, monkeypatch, seed, percent, max_epochs, weights):
    monkeypatch.setattr(M, "CUT_DOCS", 5)
    r = random.Random(seed)
    rows = [(r.choice("ab"), r.choice(["x", "y", None]), r.choice(["s0", "s0", "s0", "s1", "s2"]), i, r.choice([0, 1, 5, 50, r.randrange(2000)])) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("epoch", "budget", "rest", "cut", "place")})
    got = {(x.doc_id, x.epoch): x.tokens_taken for x in M.mix(df, weights, percent, max_epochs, seed).collect()}
    assert got == brute(rows, weights, percent, max_epochs, seed)


def test_empty_and_tokenless(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert M.mix(spark.createDataFrame([("a", "x", "s", 1, 0), (None, None, None, None, None)], SCHEMA)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [("a", "x", "s", 1, 10), ("a", "x", "s", 1, 10), ("a", "x", "s", None, 10)]
    got = M.mix(spark.createDataFrame(rows, SCHEMA), percent=100, max_epochs=1).collect()
    assert len(got) == 3 and sum(r.tokens_taken for r in got) == 30


def test_token_counts(spark):
    texts = ["", None, " a\tb\x0bc\n", "é 中", " x", "word " * 50000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(M.count_tokens(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [0, 0, 3, 2, 1, 50000]


def test_mixed_documents_keep_their_columns(spark):
    rows = [(i, f"w {'x ' * (i % 40)}", ["en", "fr", None][i % 3], f"src{i % 12}", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("epoch", F.lit("clash")).withColumn("domain", F.lit("clash"))
    kept = M.mixed(docs, M.WEIGHTS)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    chosen = {r.doc_id for r in M.mix(M.with_domain(docs), M.WEIGHTS, max_epochs=1).collect()}
    assert set(ids) == chosen
