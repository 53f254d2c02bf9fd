"""Encoding against the library, round trips, and counts against encoding."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parleynet.llm import bpe, token_counts

SCHEMA = "doc_id long, text string"
LIBRARY = Tokenizer.from_file(bpe.vocabulary_path())
OWN = bpe.load(None)
PARTS = ["the", " The", "'s", "'ll", " 123", "\n\n", "\t", " ", " ", "\x1c", "\x85", "é", "中文", "😀", "\U00012475", "\U00011de3", "<|endoftext|>", "<|", "...", "_", "aaaaaaa", "ing", "　", "ß", "́"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=12).map("".join))
def test_encoding_equals_the_library(text):
    got = OWN.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids(text)
    assert OWN.decode(got) == LIBRARY.decode(ids(text), skip_special_tokens=False) == text


def test_pre_tokens_of_every_character_class():
    r = random.Random(1)
    for c in [*range(0x20, 0x3000), *(r.randrange(0x3000, 0xD800) for _ in range(2000)), *(r.randrange(0xE000, 0x20000) for _ in range(6000))]:
        text = f"a {chr(c)}{chr(c)} b1{chr(c)}"
        assert bpe.pre_tokens(text) == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_long_runs_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    small = bpe.Bpe(bpe.vocabulary_path())
    for text in ("ab" * 5000, "=" * 3000, " one two three four five six one two"):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == ids(text)


ROWS = [(1, "Hello world, hello!"), (2, None), (3, ""), (2, "x<|endoftext|>y" * 3), (None, "naïve 中文 " * 50), (5, "again " * 30000)]


def test_frames(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("ids", F.lit("clash")).withColumn("piece", F.lit(1)).repartition(3)
    back = bpe.decode(bpe.encode(df)).collect()
    assert sorted((r.doc_id or 0, r.text, bytes(r.ids)) for r in back) == sorted((i or 0, t or "", np.array(ids(t or ""), "<u4").tobytes()) for i, t in ROWS)
    counts = token_counts.token_counts(df).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counts) == sorted((i or 0, len((t or "").encode()), len(ids(t or ""))) for i, t in ROWS)
    none = spark.createDataFrame([], SCHEMA)
    assert token_counts.token_counts(none).count() == 0 and bpe.decode(bpe.encode(none)).count() == 0


def test_many_blocks_and_small_sums(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "ing", "the"]) for _ in range(r.randrange(60)))) for i in range(300)]
    got = {x.doc_id: x.n_tokens for x in token_counts.token_counts(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == {i: len(ids(t)) for i, t in rows}


def test_packing_of_large_frequencies():
    entries, n = token_counts.pack(np.array([1, 2]), np.array([token_counts.MOST * 2 + 1, 5]))
    assert n.tolist() == [3, 1]
    assert (entries & token_counts.MOST)[:3].sum() == token_counts.MOST * 2 + 1 and (entries >> token_counts.COUNT_BITS).tolist() == [1, 1, 1, 2]


@pytest.mark.parametrize("text", ["", "a", "déjà vu"])
def test_registered_query_shape(spark, tmp_path, text):
    spark.createDataFrame([(7, text)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    r = bpe.op4_bpe(spark, str(tmp_path)).first()
    assert r.ids_sha256 == hashlib.sha256(np.array(ids(text), "<u4").tobytes()).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_tokens == len(ids(text))
    c = token_counts.op8_token_counts(spark, str(tmp_path)).first()
    assert (c.n_tokens, c.over_limit) == (len(ids(text)), False)
