"""Periodic runs against plain search, and the suffix kernels below them."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from parleynet.llm import _suffix as S, _text as T, periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, times=4, least=6):
    """(start, length, period) of all runs: longest stretches equal to themselves a period on, whose smallest period that is."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                part = w[i : i + length]
                if not any(part[: length - d] == part[d:] for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def rewritten(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def row(doc_id, text):
    w = rewritten(doc_id, text)
    found = brute(w)
    gone = {k for i, n, q in found for k in range(i + q, i + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *numbers, sha("".join(f"{i},{n},{q}\n" for i, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=5), st.integers(2, 4), st.integers(1, 7))
def test_runs_equal_plain_search(texts, times, least):
    ids = np.array([x for t in texts for x in t], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = P.runs(ids, first, P.Settings(times, least)).tolist()
    assert got == [[d, i, n, q] for d, t in enumerate(texts) for i, n, q in sorted(brute(t, times, least))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=300))
def test_next_smaller_and_range_minima(values):
    v = np.array(values, dtype=np.int64) * 1000 + np.arange(len(values))[::-1]
    want = [next((j for j in range(i + 1, len(v)) if v[j] < v[i]), len(v)) for i in range(len(v))]
    assert S.next_smaller(v).tolist() == want
    if len(v) > 1:
        low, high = np.array([0, len(v) // 2]), np.array([len(v), len(v) // 2 + 1])
        assert S.RangeMinimum(v).minimum(low, high).tolist() == [v.min(), v[len(v) // 2]]


def test_next_smaller_of_long_falls_and_rises():
    v = np.concatenate([[0], np.arange(5000, 0, -1), np.arange(10_000, 15_000)])
    assert S.next_smaller(v).tolist() == [10_001, *range(2, 5001), *[10_001] * 5001]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=30), min_size=1, max_size=4), st.booleans())
def test_suffix_orders_and_extensions(texts, backwards):
    ids = np.array([x for t in texts for x in t], dtype=np.int64)
    s = S.Sequence(ids, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    rank, _, step = s.ranks(backwards)
    symbols = [x for d, t in enumerate(texts) for x in [*((1, d, -c if backwards else c) for c in t), (0, d, 0)]]
    assert np.argsort(rank).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    a, b = np.nonzero(~np.eye(len(symbols), dtype=bool))
    same = lambda i, j: next((k for k in range(len(symbols)) if max(i, j) + k >= len(symbols) or symbols[i + k] != symbols[j + k]), 0)
    if len(symbols) > 1:
        assert S.Extensions(s, rank, step).common(a, b).tolist() == [same(i, j) for i, j in zip(a.tolist(), b.tolist())]


def test_multiplication_modulo_the_prime():
    r = np.random.default_rng(2)
    a, b = (np.concatenate([[0, 1, T.PRIME - 1], r.integers(0, T.PRIME, 500)]).astype(np.uint64) for _ in range(2))
    assert T.times(a, b).tolist() == [int(x) * int(y) % T.PRIME for x, y in zip(a, b)]


def test_query_equals_plain_search(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, P.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(row(r.doc_id, r.text) for r in rows)
    assert any(r[1] for r in got)


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    schema = "doc_id long, text string, runs int, start long"
    texts = ["a b " * 60_000, None, "", " \n ", "x x x x x", "x x x x x x", "é中 é中 é中 é中 é中 é中 é中\tend", "y " * 7]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, texts[5], 1, 2), (5, texts[5], 1, 2)]
    got = sorted(map(tuple, P.periodic_runs(spark.createDataFrame(rows, schema)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        found = brute(w) if len(w) < 1000 else [(0, len(w), 2)]
        gone = {k for a, n, q in found for k in range(a + q, a + n)}
        want.append((i, len(w), [tuple(f) for f in found], " ".join(x for k, x in enumerate(w) if k not in gone)))
    plain = lambda r: (r[0], r[1], [tuple(x) for x in r[2]], r[3])
    assert [plain(r) for r in got] == sorted(want, key=str) or sorted(map(str, map(plain, got))) == sorted(map(str, want))
    assert P.periodic_runs(spark.createDataFrame([], schema)).collect() == []


def test_a_run_has_two_periods_at_least():
    with pytest.raises(ValueError):
        P.Settings(times=1)
