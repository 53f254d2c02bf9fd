"""The stages in turn against brute-force versions of what each keeps."""

import hashlib

import numpy as np
from pyspark.sql import functions as F
from tests_support import brute_components
from tokenizers import Tokenizer

import corpus_pipeline as P
from parleynet.llm import bpe, language_id, mixture, quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_follow_their_operators(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "12 34", None, None, 5)], docs.schema)
    docs = docs.unionByName(extra)
    stage = dict(P.STAGES)
    assert list(stage) == ["language", "quality", "dedup", "mixing", "encoding"]

    kept = stage["language"](spark, docs, "").cache()
    model = language_id.fit(docs.where(~language_id.held_out()))
    expected = {r.doc_id for r in docs.collect() if (p := model.predict(r.text))[0] != "und" and p[1] >= 0.005}
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == expected and not expected & {9001, 9002, 9003}

    good = stage["quality"](spark, kept, "").cache()
    verdict = {r.doc_id for r in quality_rules.quality(kept).where("kept").collect()}
    assert good.columns == COLUMNS and {r.doc_id for r in good.collect()} == verdict

    one = stage["dedup"](spark, good, "").cache()
    groups = brute_components([(r.doc_id, r.text) for r in good.collect()], 80)
    assert one.columns == COLUMNS and {r.doc_id for r in one.collect()} == {i for i, c in groups.items() if i == c}

    mixed = stage["mixing"](spark, one, "").cache()
    taken = {r.doc_id for r in mixture.mix(mixture.with_domain(one), mixture.WEIGHTS, max_epochs=1).collect()}
    assert mixed.columns == COLUMNS and {r.doc_id for r in mixed.collect()} == taken and taken

    library = Tokenizer.from_file(bpe.vocabulary_path())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    rows = stage["encoding"](spark, mixed, "").collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, bytes(r.ids)) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), ids)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name
    assert docs.select(F.sum("n_tokens")).first()[0] is None
