"""Rules and repeats against counting windows."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parleynet.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, least):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def windows(k):
        c = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return [i for i in range(len(w) - k + 1) if c[tuple(w[i : i + k])] > 1]

    cover = lambda k: len({j for i in windows(k) for j in range(i, i + k)})
    longest = max((k for k in range(1, len(w)) if windows(k)), default=0)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), cover(3), cover(least), longest)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab é#|\n中", max_size=60), max_size=6), st.integers(2, 6))
def test_measures(texts, least):
    m = Q.measures(pa.array(texts, type=pa.string()), least)
    assert list(zip(*(m[k].tolist() for k in Q.MEASURES))) == [brute(t, least) for t in texts] or not texts


def test_long_and_repetitive():
    m = Q.measures(pa.array(["word " * 20000, "a b " * 5000]), 12)
    assert m["longest_repeat"].tolist() == [19999, 9998] and m["n_covered_words"].tolist() == [20000, 10000]


CLEAN = " ".join(f"w{i}" for i in range(100))


@pytest.mark.parametrize(
    "text, base_failed, kept",
    [(CLEAN, False, True), (None, True, False), ("short", True, False), ("x y z " * 40, True, False), (CLEAN + " " + " ".join(f"v{i}" for i in range(150)) + " " + " ".join(f"w{i}" for i in range(99)), True, False), (CLEAN + " " + " ".join(f"v{i}" for i in range(400)) + " " + CLEAN, False, False), (CLEAN + "\n" + " ".join(f"w{i}" for i in range(15)), False, True)],
)
def test_verdicts(spark, text, base_failed, kept):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("kept", F.lit("clash"))
    r = Q.quality(df).first()
    assert (r.base_failed, r.kept) == (base_failed, kept)
    assert Q.clean(df).count() == int(kept) and Q.clean(df).columns == df.columns


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert Q.quality(spark.createDataFrame([], schema)).count() == 0
    assert Q.quality(spark.createDataFrame([(1, CLEAN), (1, CLEAN), (None, CLEAN)], schema)).where("kept").count() == 3


@pytest.mark.parametrize("n", [1024, 4096])
def test_sequences_that_collide_as_polynomials_modulo_powers_of_two_are_no_repeats(n):
    from test_text_kernels import thue_morse

    one, other = thue_morse(n), thue_morse(n, "b", "a")
    glued = ["".join(one), "".join(other)]
    text = "\n".join(glued)
    assert Q.measures(pa.array([text]), 3)["n_dup_lines"].tolist() == [0]
    assert Q.measures(pa.array([text]), 1)["longest_repeat"].tolist() == [0]
    # Two unlike sequences that sums modulo 2^64 can't tell apart.
    apart = " ".join(one) + " x " + " ".join(other)
    assert 3 <= Q.measures(pa.array([apart]), 3)["longest_repeat"][0] < n
