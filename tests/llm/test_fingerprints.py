"""Fingerprints, edited texts and neighbours against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from parleynet.llm import fingerprints as FP

SCHEMA = "doc_id long, text string"


def rows_of(spark, rows, per_block):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS head", "3 AS k").repartition(3)
    return FP.with_next(df, rows_per_block=per_block).collect()


@pytest.mark.parametrize("per_block", [3, 1000])
def test_next_document(spark, per_block):
    r = random.Random(1)
    rows = [(i * 7 % 101 - 50, " ".join(r.choice(["ab", "é", "中文", "x"]) for _ in range(r.randrange(0, 60)))) for i in range(80)] + [(400, None), (401, ""), (402, "one"), (403, "long " * 40000)]
    order = sorted(rows)
    got = {x.doc_id: x for x in rows_of(spark, rows, per_block)}
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        x = got[doc_id]
        assert x.n_chars == len(text) and x.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        same = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) * 4 / len(a)
        assert x.near_edited == same(x.fingerprint, x.edited_fingerprint)
        assert x.near_next == same(x.fingerprint, got[order[(i + 1) % len(order)][0]].fingerprint)


def test_equal_texts_and_ties(spark):
    rows = [(1, "a b c d e f"), (1, "z y x w v u"), (2, "a b c d e f"), (None, "n"), (None, "m")]
    got = rows_of(spark, rows, 2)
    assert len(got) == 5
    prints = {x.fingerprint for x in got if x.n_chars == 11}
    assert len(prints) == 2


def test_alone_and_empty(spark):
    one = rows_of(spark, [(5, "a b c d e f g h")], 10)[0]
    assert one.near_next == 1.0
    assert FP.with_next(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.doc_id: r.fingerprint for r in FP.fingerprints(spark.createDataFrame([(5, "a b c d e f g h")], SCHEMA)).collect()} == {5: one.fingerprint}


def test_bands_are_of_the_fingerprint(spark):
    from parleynet.llm import near_duplicates as ND

    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "one"), (3, None)], SCHEMA)
    prints = {r.doc_id: r.fingerprint for r in FP.fingerprints(docs).collect()}
    for r in ND.sign(docs, FP.BANDED).collect():
        assert FP.written(np.frombuffer(r.signature, dtype=np.uint16)[None, :]) == [prints[r.doc_id]]
