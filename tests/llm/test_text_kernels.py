"""Byte kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from parleynet.llm import _text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet="ab é\n\t Zß中😀", max_size=40)


def shingle_set(text, size=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.integers(2, 5))
def test_sets_have_the_size_and_overlap_of_real_sets(texts, size):
    sets, at = T.shingle_sets(pa.array(texts, type=pa.string()), size)
    real = [shingle_set(t, size) for t in texts]
    assert np.diff(at).tolist() == [len(x) for x in real]
    for i in range(len(texts)):
        for j in range(i):
            both = np.intersect1d(sets[at[i] : at[i + 1]], sets[at[j] : at[j + 1]])
            assert len(both) == len(real[i] & real[j])


def test_words_longer_than_a_slice():
    long = "x" * (T.SLICE_BYTES + 5)
    sets, at = T.shingle_sets(pa.array([f"a {long} b", f"a {long} b", f"a {long}y b"]), 5)
    assert sets[0] == sets[1] != sets[2] and np.diff(at).tolist() == [1, 1, 1]


def test_slices_cover_all_rows():
    texts = ["x" * n for n in (0, T.SLICE_BYTES + 1, 3, 0, T.SLICE_BYTES, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert [t for part in T.slices(batch, "text") for t in part.column(0).to_pylist()] == texts
    assert list(T.slices(batch.slice(0, 0), "text")) == []


def test_sliced_arrays_and_empty_sets():
    column = pa.array(["zero", "a b", None, "", "c"]).slice(1, 3)
    data, at = T.flat(column)
    assert bytes(data) == b"a b" and at.tolist() == [0, 3, 3, 3]
    sig = T.MinHash(4, 1).signatures(*T.shingle_sets(column, 5))
    assert (sig[1] == 0xFFFFFFFF).all() and (sig[1] == sig[2]).all() and not (sig[0] == sig[1]).all()


def test_signatures_estimate_similarity():
    words = [f"w{i}" for i in range(1200)]
    texts = [" ".join(words[:1000]), " ".join(words[100:1100])]
    sig = T.MinHash(512, 3).signatures(*T.shingle_sets(pa.array(texts), 5))
    assert abs((sig[0] == sig[1]).mean() - 896 / 1096) < 0.07


def thue_morse(n, a="a", b="b"):
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return out[:n]


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_as_polynomials_modulo_powers_of_two_differ(n):
    one, other = "".join(thue_morse(n)), "".join(thue_morse(n, "b", "a"))
    sets, at = T.shingle_sets(pa.array([one, other, one]), 5)
    assert sets[0] == sets[2] != sets[1]
    data, at = T.flat(pa.array([f"{one}\n{other}\nx {one} {other} {one}"]))
    start, end, _ = T.words(data, at)
    assert len(set(T.range_hashes(data, start, end))) == 3 and T.numbered(data, start, end)[0].tolist() == [0, 1, 2, 0, 1, 0]


def test_numbers_and_hashes_of_adjacent_and_empty_ranges():
    data = np.frombuffer(b"ababx", dtype=np.uint8)
    start, end = np.array([0, 2, 4, 5]), np.array([2, 4, 4, 5])
    numbers, strings = T.numbered(data, start, end)
    assert numbers.tolist() == [0, 0, 1, 1] and strings.to_pylist() == [b"ab", b""]
    none = np.zeros(0, dtype=np.int64)
    assert len(T.range_hashes(np.zeros(0, np.uint8), none, none)) == 0
