"""Fingerprints' signatures against plain Python, and links of the band join against all pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
from tests_support import shingle_set

from parleynet.llm import _text as T, fingerprints as FP

SCHEMA = "doc_id long, text string"


def test_signature_is_the_least_of_each_permutation():
    texts = ["one two three four five six seven", "a b", "", "x " * 300, "Déjà vu encore et encore une fois de plus"]
    sets, at = T.shingle_sets(pa.array(texts), FP.WORDS)
    family = T.MinHash(FP.N, FP.SEED)
    got = family.signatures(sets, at)
    for i in range(len(texts)):
        own = [int(x) >> 32 for x in sets[at[i] : at[i + 1]]]
        assert len(own) == len(shingle_set(texts[i]))
        for k in range(FP.N):
            a, b = int(family.a[k]), int(family.b[k])
            assert int(got[i, k]) == min(((a * x + b) % (1 << 32) for x in own), default=0xFFFFFFFF)


def test_likeness_estimates_the_similarity():
    r = random.Random(2)
    base = [f"w{k}" for k in range(400)]
    errors = []
    for share in (0, 5, 20, 60):
        other = list(base)
        for k in r.sample(range(400), share):
            other[k] = f"v{k}"
        a, b = " ".join(base), " ".join(other)
        x, y = FP.signatures(pa.array([a, b]))
        u, v = shingle_set(a), shingle_set(b)
        errors.append(abs((x == y).mean() - len(u & v) / len(u | v)))
    assert np.mean(errors) < 0.06


def linked_texts(r, n):
    """Groups of texts whose members share between all and few of their words, some with a common passage."""
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for g in range(n):
        base = [f"g{g}w{r.randrange(1000)}" for _ in range(50)] + (passage if g % 3 == 0 else [])
        for _ in range(r.randrange(2, 7)):
            words = list(base)
            for k in r.sample(range(len(words)), r.choice([0, 1, 1, 2, 4, 9])):
                words[k] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_links_lose_nothing(spark):
    """Recall of the band join: each truly similar pair is inside one component of verified links, and no link is false."""
    rows = linked_texts(random.Random(6), 40)
    sets = {i: shingle_set(t) for i, t in rows}
    true = {(i, j) for i, j in itertools.combinations(sets, 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS bucket", "2 AS cls", "3 AS a").repartition(4)
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in FP.similar_pairs(df).collect()}
    assert pairs <= true
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[root(i)] = root(j)
    caught = sum(root(i) == root(j) for i, j in true)
    assert len(true) > 40 and caught == len(true)


def test_links_of_nothing(spark):
    assert FP.similar_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f g"), (1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "a b c d e f g")]
    assert {(r.a, r.b) for r in FP.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == {(4, 3)}
