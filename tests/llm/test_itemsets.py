"""Closed itemsets and rules against plain enumeration."""

import hashlib
import itertools
import random

import pytest

from parleynet.llm import itemsets as I


def brute(rows, s):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    total = len(baskets)
    support = {}
    for b in baskets.values():
        for k in range(1, len(b) + 1):
            for x in itertools.combinations(sorted(b), k):
                support[x] = support.get(x, 0) + 1
    frequent = {x: n for x, n in support.items() if n >= s.count and n * s.share >= total}
    out = {}
    for x, n in frequent.items():
        if any(len(y) == len(x) + 1 and m == n and set(x) < set(y) for y, m in frequent.items()):
            continue
        made = []
        for c in x if len(x) > 1 else ():
            a, of = support[tuple(i for i in x if i != c)], support[(c,)]
            if 100 * n >= s.confidence * a and n * total > a * of:
                made.append((c, a, of))
        best = min(((a, c) for c, a, _ in made), default=(None, None))[1]
        text = ";".join(f"{c}:{a}:{of}" for c, a, of in made)
        out[",".join(map(str, x))] = (len(x), n, len(made), best, hashlib.sha256(text.encode()).hexdigest())
    return out


def mined(spark, rows, s):
    df = I.itemsets_with_rules(spark.createDataFrame(rows, "basket long, item long").repartition(3), settings=s)
    got = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_random_baskets_equal_enumeration(spark, seed):
    r = random.Random(seed)
    rows = []
    for b in range(120):
        own = {r.choice([1, 2, 3, 40, 500]) for _ in range(r.randrange(1, 5))}
        if r.random() < 0.5:
            own |= {7, 8, 9} if r.random() < 0.7 else {7, 8}
        if r.random() < 0.2:
            own |= {11, 12, 13, 14}
        if seed == 3:
            own.add(99)  # in every basket
        rows += [(b, i) for i in own] + [(b, min(own))]
    s = I.Settings(count=2 + seed, share=30, confidence=30)
    assert mined(spark, rows, s) == brute(rows, s)


def test_small_products_and_held_sums_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(I, "PRODUCT_CELLS", 7)
    monkeypatch.setattr(I, "HELD_SUMS", 5)
    rows = [(b, i) for b in range(40) for i in range(1, 9) if (b * i) % 7 < 4]
    s = I.Settings(count=3, share=20)
    assert mined(spark, rows, s) == brute(rows, s)


def test_one_huge_basket_and_one_item_everywhere(spark):
    rows = [(0, i) for i in range(300)] + [(b, 5) for b in range(1, 60)] + [(b, 6) for b in range(1, 30)] + [(b, 7) for b in range(10, 25)]
    got = mined(spark, rows, I.Settings(count=3))
    small = [(b, i) for b, i in rows if b or i in (5, 6, 7)]
    assert got == brute(small, I.Settings(count=3))


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, 2), (1, 2), (None, 2), (3, None), (2, 2), (2, 3), (1, 3), (4, 3)]
    s = I.Settings(count=2, share=10)
    assert mined(spark, rows, s) == brute(rows, s)
    assert mined(spark, [], s) == {}
    assert mined(spark, [(1, 1), (2, 2)], s) == {}


def test_returned_lines_are_left_out_and_other_columns_ignored(spark):
    lines = spark.createDataFrame([(1, 5, "kept", "x"), (1, 6, "returned", "x"), (2, 5, "swapped", "x"), (2, 6, None, "x")], "sale_id long, item_id long, flag string, support string")
    assert sorted(map(tuple, I.sold(lines).collect())) == [(1, 5), (2, 5), (2, 6)]
