"""One pre-token, one pivot, one leaf that holds most rows: no task gets more than its share. Kernels within their stated memory."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests_support import brute_components

from parleynet.llm import bpe, language_id as L, mixture as M, near_duplicates as ND, quality_rules as Q, token_counts as TC

SCHEMA = "doc_id long, text string"


def test_a_common_pre_token_is_dealt_into_parts(spark, monkeypatch):
    rows = [(i, "the " * (1 + i % 5) + f"w{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    whole = sorted(TC.token_counts(docs).collect())
    monkeypatch.setattr(TC, "TASKS_PER_PART", 1)
    assert sorted(TC.token_counts(docs).collect()) == whole
    frequencies = TC.piece_frequencies(TC.settled(docs), None).where("piece = ' the'")
    part = F.floor(F.shiftright("base", TC.ROW_BITS) / TC.TASKS_PER_PART)
    held = [r.n for r in frequencies.groupBy(part).agg(F.sum(F.octet_length("payload")).alias("n")).collect()]
    # A task's share of the pre-token is what its part's blocks hold, an eighth here.
    assert len(held) == 8 and max(held) * 4 <= sum(held)


def near_copies(r, n):
    base = [f"w{r.randrange(50)}x{k}" for k in range(80)]
    out = []
    for i in range(n):
        words = list(base)
        words[r.randrange(80)] = f"own{i}"
        out.append((i, " ".join(words)))
    return out + [(1000 + i, " ".join(f"z{i}y{k}" for k in range(40))) for i in range(n // 10)]


@pytest.mark.parametrize("sent", [0, 500_000])
def test_a_hot_pivot_is_dealt_into_parts(spark, monkeypatch, sent):
    rows = near_copies(random.Random(3), 90)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(ND, "PART_ROWS", 8)
    monkeypatch.setattr(ND, "SENT_ROWS", sent)
    got = {r.doc_id: r.component_id for r in ND.near_duplicates(docs, settings=ND.Settings(block=16)).collect()}
    assert got == brute_components(rows, 80)


def test_parts_of_a_hot_pivot_hold_a_share_each(spark, monkeypatch):
    monkeypatch.setattr(ND, "PART_ROWS", 8)
    s = ND.Settings()
    classes = ND.sign(spark.createDataFrame(near_copies(random.Random(3), 90), SCHEMA), s).where("n_shingles > 0").select(F.col("key1").alias("cls"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "signature")
    bands = ND.band_rows(classes, s)
    rows = bands.join(bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket")
    best = rows.groupBy("bucket").agg(F.max("cls").alias("pivot"), F.max("size").alias("size"))
    pivots = best.join(best.groupBy("pivot").agg(F.ceil(F.max("size") / ND.PART_ROWS).cast("int").alias("parts")), "pivot")
    found = ND.pivot_candidates(rows, pivots, classes, s).groupBy("b", "part").agg(F.count_distinct("a").alias("n")).collect()
    assert max(r.n for r in found) * 2 <= max(Counter(r.b for r in found for _ in range(r.n)).values())


def test_documents_of_a_hot_leaf_stay_where_they_are(spark, monkeypatch):
    rows = [("core", "en", "one" if i % 10 else f"s{i % 7}", i, 1 + i % 13) for i in range(500)]
    docs = spark.createDataFrame(rows, "domain string, lang string, source string, doc_id long, n_tokens long").repartition(5)
    sent = sorted(M.mix(docs, M.WEIGHTS, percent=70, max_epochs=2).collect())
    plan = M.with_leaves(docs, docs.select(*M.LEVELS).distinct())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    monkeypatch.setattr(M, "SENT_LEAVES", 0)
    assert sorted(M.mix(docs, M.WEIGHTS, percent=70, max_epochs=2).collect()) == sent


def test_quality_measures_take_some_bytes_a_byte():
    r = random.Random(1)
    base = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(60_000))
    text = (base + " ") * (6_000_000 // len(base))
    tracemalloc.start()
    m = Q.measures(pa.array([text]), 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert m["longest_repeat"][0] >= 60_000
    assert peak < 32 * len(text)


def test_the_cache_holds_short_pre_tokens_only():
    model = bpe.Bpe(bpe.vocabulary_path())
    for i in range(50):
        model.encode("x" * (5000 + i) + f" word{i}")
    assert max(map(len, model.packed)) <= bpe.CACHED_CHARS


def test_the_smallest_code_wins():
    """Each language's code sizes worked out anew, one encoder at a time."""
    import zstandard

    r = random.Random(8)
    words = {lang: ["".join(r.choice(letters) for _ in range(r.randrange(3, 8))) for _ in range(60)] for lang, letters in (("aa", "abcdefg"), ("bb", "fghijkl"), ("cc", "klmnopa"))}
    text = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    model = L.Dictionaries({lang: text(lang, 400).encode() for lang in words}, 9)
    for lang in words:
        for n in (3, 40, 9000):
            said = text(lang, n)
            data = L.normalised(said)
            sizes = {}
            for x, content in model.contents.items():
                encoder = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
                sizes[x] = sum(len(encoder.compress(data[i : i + L.PIECE_BYTES])) for i in range(0, len(data), L.PIECE_BYTES))
            best, after = sorted(sizes, key=lambda x: (sizes[x], x))[:2]
            found, score = model.predict(said)
            assert (found, score) == (best, max(0.0, 1 - sizes[best] / sizes[after]))


def test_fitting_takes_bytes_from_all_of_a_text():
    data = bytes(range(256)) * 40
    cut = L.spread(data, 400)
    assert len(cut) <= 404 and cut.startswith(data[:100]) and cut.endswith(data[-100:])
    assert L.spread(data[:300], 400) == data[:300]


def test_no_labelled_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert [(r.lang_pred, r.rejected) for r in L.identify(docs, model).collect()] == [("und", True)] * 2
    assert L.accepted(docs, model).count() == 0


def test_pairs_of_one_partner_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(ND, "PART_ROWS", 10)
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 201)] + [(i, i + 1000) for i in range(5)], "a long, b long")
    got = ND._dealt(pairs).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(map(tuple, pairs.collect()))
    held = Counter(r.part for r in got if r.b == 0)
    assert len(held) == 20 and max(held.values()) <= 25 and {r.part for r in got if r.b} == {0}


def test_of_repeated_ids_the_least_text_by_digest_stays(spark):
    import hashlib

    texts = [f"text number {i} of one id" for i in range(6)]
    docs = spark.createDataFrame([(1, t) for t in texts] + [(2, None), (2, "x")], SCHEMA)
    for n in (1, 3):
        kept = {r.doc_id: r.text for r in ND.distinct_documents(docs.repartition(n)).collect()}
        assert kept == {1: min(texts, key=lambda t: hashlib.sha256(t.encode()).hexdigest()), 2: None}
