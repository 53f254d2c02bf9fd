"""Articles to records, with a provider that reads its prompt."""

import json

from parleynet.config import Axis
from parleynet.operators import extraction as X, gates
from parleynet.operators.vocabulary import Vocabulary

WORDS = Vocabulary(("US", "Iran", "Pakistan"), {"US": "w", "Iran": "i", "Pakistan": "p"}, {"US": ["washington"], "Iran": ["tehran"]})
AXIS = Axis(WORDS.blocs, focal=("US", "Iran", "Pakistan"), dyad=("US", "Iran"), boundary="2026-04-08")
LONG = "Pakistan hosted talks between Washington and Tehran last week."


def make_provider():
    """A closure, so that workers needn't import this file."""

    def provider(prompts):
        out = []
        for p in prompts:
            if "fails" in p:
                raise RuntimeError("refused")
            edge = {"source": "Pakistan", "target": "Tehran", "polarity": "positive", "raw_verb": "hosted", "quote_span": "hosted talks"}
            out.append(json.dumps({"interactions": [edge, edge | {"polarity": "odd"}]}))
        return out

    return provider


def test_articles_to_records(spark):
    rows = [(0, "Daily", "2026-04-07T01:02", f"{LONG}\n\nshort\n\n{LONG} It fails."), (1, "Daily", "2026-05-01", "Nothing of interest here at all, not at all."), (2, "G", "2026-05-01", LONG), (3, "G", None, None)]
    articles = spark.createDataFrame(rows, "article_row long, outlet string, date string, body string")
    chunks = X.chunked(articles, AXIS, WORDS).cache()
    assert sorted(r.doc_id for r in chunks.collect()) == ["0_0", "0_1", "2_0"]
    assert X.chunked(articles, AXIS, WORDS, n=1).select("article_row").distinct().count() == 1
    asked = chunks.withColumn("prompt", chunks["text"])
    answered = gates.call_provider(asked, make_provider()).cache()
    checked = gates.gated(X.candidates(answered, AXIS.boundary), WORDS)
    recs = X.records(answered, checked, AXIS.boundary).cache()
    got = {r.doc_id: (r.phase, r.n_parsed, len(r.edges or []), [d.gate for d in r.drops or []], r.error) for r in recs.collect()}
    assert got["0_0"] == ("pre", 2, 1, ["G4"], None) and got["2_0"][0] == "post"
    assert got["0_1"][1:3] == (0, 0) and "refused" in got["0_1"][4]
    t = X.totals(recs).first()
    assert (t.records, t.errors, t.parsed, t.edges, t.drops) == (3, 1, 4, 2, 2)
    stored = spark.createDataFrame([(0, "u0", "h0"), (2, None, "h2")], "article_row long, url string, headline string")
    edges = X.with_article(gates.kept(checked), stored)
    assert {(r.doc_id, r.url, r.headline) for r in edges.collect()} == {("0_0", "u0", "h0"), ("2_0", "", "h2")}


def test_library_entry(spark):
    chunks = spark.createDataFrame([("0_0", "2026-01-01", "o", LONG)], "doc_id string, date string, outlet string, text string")
    checked = X.extract(chunks, WORDS, "2026-04-08", "Actors: {actors}\n{chunk}", make_provider())
    assert gates.kept(checked).count() == 1
    assert gates.kept(X.extract(chunks, WORDS, "2026-04-08", "{chunk}", gates.mock_provider)).count() == 0
