"""The chain from articles to results: every run goes on where the one before ended."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from parleynet.config import Axis
from parleynet.operators.chain import Chain
from parleynet.operators.vocabulary import Vocabulary
from parleynet.sources import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])
WORDS = Vocabulary(("A", "B", "K", "D"), {"A": "x", "B": "y", "K": "z", "D": "y"}, {"A": ["alpha"], "B": ["beta"], "K": ["kappa"], "D": ["delta"]}, {})
AXIS = Axis(dict(WORDS.blocs), focal=("A", "B", "K"), dyad=("A", "B"), focus="K", boundary="2026-04-08")
SCHEMA = "url string, seq int, timestamp string, date string, outlet string, body string"
TEXT = "Alpha met kappa and kappa met beta over a long afternoon."


def listing(spark, *urls, body=TEXT):
    return spark.createDataFrame([(u, i, f"2026-01-0{i + 1}T00:00:00Z", "2026-01-02", "O", body) for i, u in enumerate(urls)], SCHEMA)


def found(source, target, quote):
    return {"source": source, "target": target, "polarity": "positive", "raw_verb": "hosted", "quote_span": quote}


def provider(prompts):
    if any("broken" in p for p in prompts):
        raise OSError("no answer")
    return [json.dumps([found("alpha", "kappa", "Alpha met kappa"), found("kappa", "beta", "kappa met beta"), found("alpha", "delta", "never said")]) for _ in prompts]


def never(prompts):
    raise AssertionError("asked again")


def test_a_second_run_does_no_work(spark, tmp_path):
    chain = Chain(spark, str(tmp_path), AXIS, WORDS, "{actors}\n{chunk}", provider)
    first = listing(spark, "u1", "u2").unionByName(listing(spark, "u2", body=TEXT + " Once more.").withColumn("seq", F.col("seq") + 9))
    assert chain.run(first) == {"collected": 2, "extracted": 2, "analysed": True}
    assert {r.url: r.body for r in chain.articles().collect()} == {"u1": TEXT, "u2": TEXT + " Once more."}
    r = chain.results().collect()
    assert [(x.outlet, x.phase, x.pos_edges, x.n_arcs, x["rank"], x.liaison, x.share) for x in r] == [("o", "pre", 4, 2, 1, 2.0, 0.5)] and abs(r[0].flow - 1) < 1e-9
    versions = [store.manifest(chain.path(s))["version"] for s in ("articles", "records", "results")]
    chain.provider = never
    assert chain.run(first) == {"collected": 0, "extracted": 0, "analysed": False}
    assert [store.manifest(chain.path(s))["version"] for s in ("articles", "records", "results")] == versions


def test_new_articles_alone_are_asked_for(spark, tmp_path):
    chain = Chain(spark, str(tmp_path), AXIS, WORDS, "{actors}\n{chunk}", provider)
    chain.run(listing(spark, "u1"))
    assert chain.run(listing(spark, "u1", "u0", "u2")) == {"collected": 2, "extracted": 2, "analysed": True}
    assert sorted((r.article_row, r.url) for r in chain.articles().collect()) == [(0, "u1"), (1, "u0"), (2, "u2")]
    assert chain.results().first().pos_edges == 6
    assert sorted(r.doc_id for r in chain.records().collect()) == ["0_0", "1_0", "2_0"]


def test_errors_are_records_and_are_retried_on_demand(spark, tmp_path):
    chain = Chain(spark, str(tmp_path), AXIS, WORDS, "{actors}\n{chunk}", provider)
    both = listing(spark, "u1").unionByName(listing(spark, "u2", body=TEXT + " It is broken."))
    assert chain.run(both)["extracted"] == 2 and chain.results().first().pos_edges == 2
    assert chain.run(both) == {"collected": 0, "extracted": 0, "analysed": False}
    chain.provider = lambda prompts: provider([p.replace("broken", "mended") for p in prompts])
    assert chain.run(both, retry_errors=True) == {"collected": 0, "extracted": 1, "analysed": True}
    assert chain.results().first().pos_edges == 4


def test_a_run_that_breaks_off_goes_on(spark, tmp_path):
    chain = Chain(spark, str(tmp_path), AXIS, WORDS, "{actors}\n{chunk}", provider)
    both = listing(spark, "u1", "u2")
    assert chain.collect(both) == 2
    chain.provider = sys.exit
    with pytest.raises(Exception):
        chain.run(both)
    assert chain.records().count() == 0
    chain.provider = provider
    assert chain.run(both) == {"collected": 0, "extracted": 2, "analysed": True}
    assert chain.run(listing(spark)) == {"collected": 0, "extracted": 0, "analysed": False}
