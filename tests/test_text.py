"""Text functions, vocabulary and gates on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from parleynet.functions import text as FT, verbs
from parleynet.operators import gates, vocabulary as V

WORDS = V.Vocabulary(
    ("US", "Iran", "Pakistan", "IAEA"),
    {"US": "w", "Iran": "i", "Pakistan": "p", "IAEA": "n"},
    {"US": ["united states", "the united states", "u.s.", "us", "washington", "white house"], "Iran": ["iranian", "tehran"], "Pakistan": ["islamabad"]},
    {"India": "other theatre", "AI": "not an actor", "Sharif": "ambiguous"},
)


def col(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_resolver(spark):
    names = ["Islamabad", "Sharif", "AI", "Washington", "India", "the United States", "the US", "the Iranians", "IAEA", "", None, "the Iranian"]
    rows = V.resolve(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, m string"), "m", WORDS).orderBy("i").collect()
    # "the US" loses its s in the fallback unless the form itself is listed; "the united states" is listed.
    assert [r.actor for r in rows] == ["Pakistan", None, None, "US", None, "US", None, "Iran", "IAEA", None, None, "Iran"]


def test_mentions_are_whole_tokens(spark):
    got = col(spark, ["the house", "told us so", "U.S. and Tehran", None, "virus", "Iranian-US ties"], lambda c: V.mentioned(c, WORDS))
    assert got == [[], ["US"], ["US", "Iran"], [], [], ["US", "Iran"]]


def test_on_axis(spark):
    got = col(spark, ["us tehran", "islamabad iaea", "us"], lambda c: V.on_axis(V.mentioned(c, WORDS), ("US", "Iran", "Pakistan"), ("US", "Iran")))
    assert got == [True, False, False]


def test_canon_text(spark):
    got = col(spark, ["“A  b—c…” ", None, "Straße ​x", "a b"], FT.canon_text)
    assert got == ['"a b-c..."', "", "strasse x", "a b"]


def test_chunks(spark):
    long = "x" * 45
    got = col(spark, [f"{long}\n\nshort\n\n{long}.  {long}", "short", "  ", None, f"{long}.\n{long}"], FT.chunk_paragraphs)
    assert got == [[long, f"{long}.", long], ["short"], [], [], [f"{long}.\n{long}"]]


def test_candidates(spark):
    raw = ['```json\n[{"source": "a", "target": "b"}, 3]\n```', '{"note": "x", "interactions": [{"source": "a"}]}', '{"source": "a", "target": "b", "polarity": "positive"}', '{"note": 1}', "no json", "", None, '{"s": "[1]", "source": "x", "target": "y"}']
    got = col(spark, raw, lambda c: F.transform(FT.parse_candidates(c), lambda x: F.concat_ws("|", x.is_object.cast("string"), F.coalesce(x.source, F.lit("-")), F.coalesce(x.target, F.lit("-")))))
    assert got == [["true|a|b", "false|-|-"], ["true|a|-"], ["true|a|b"], [], [], [], [], ["true|x|y"]]


def test_prompt(spark):
    assert col(spark, ["T"], lambda c: FT.build_prompt("<{actors}> {chunk}", F.lit("A, B"), c)) == ["<A, B> T"]


def test_article_fields(spark):
    urls = ["http://x.com/news/1234567890/a1", "http://x.com/opinion#top", "http://y.org/editorial"]
    assert col(spark, urls, FT.article_id) == ["5678901", "", ""]
    assert col(spark, urls, FT.without_fragment)[1] == "http://x.com/opinion"
    assert col(spark, urls, lambda c: FT.guess_genre(c, F.lit("Happy Writer"))) == ["wire"] * 3
    assert col(spark, urls, lambda c: FT.guess_genre(c, F.lit("A. Writer"))) == ["news", "editorial/opinion", "editorial/opinion"]
    assert col(spark, urls, lambda c: FT.outlet_of(c, ["x.com", "y.org"])) == ["x.com", "x.com", "y.org"]


def test_timestamps(spark):
    got = col(spark, ["2026-01-01T05:00:00+05:00", "2026-01-01T00:00:00Z", "", "soon", None], lambda c: FT.utc_timestamp(c).cast("string"))
    assert got == ["2026-01-01 00:00:00", "2026-01-01 00:00:00", None, None, None]


def test_labels(spark):
    assert col(spark, [" Y", "no", "1", "maybe", None], FT.yes_no) == [True, False, True, None, None]
    assert col(spark, ["Positive ", "good"], lambda c: FT.one_of(c, "positive", "negative")) == ["positive", None]


@pytest.mark.parametrize(
    "verb, polarity, weight, tier",
    [
        ("said", "positive", 0.0, "report_drop"), ("announced new sanctions", "negative", -5.0, "sanction"), ("offered to host", "positive", 3.0, "intent"), ("de-escalate", "positive", 2.0, "other_positive"),
        ("downed", "negative", -9.0, "assault"), ("down", "negative", -3.0, "other_negative"), ("met", "positive", 3.0, "positioning"), ("hosted talks", "neutral", 0.0, "neutral"), ("denied", "negative", -4.0, "reject"), ("", "positive", 2.0, "other_positive"), (None, "negative", -3.0, "other_negative"),
    ],
)
def test_substance(spark, verb, polarity, weight, tier):
    row = verbs.with_substance(spark.createDataFrame([(verb, polarity)], "raw_verb string, polarity string")).first()
    assert (row.substance, row.tier) == (weight, tier)


TEXT = "Pakistan hosted talks with the US — “at last”."
GOOD = {"source": "Islamabad", "target": "Washington", "polarity": "positive", "raw_verb": "Hosted", "speaker": "official", "modality": "asserted", "quote_span": 'hosted talks with the US - "at last"'}
CASES = [
    ({}, None), ({"source": "Nobody"}, "G1"), ({"target": "India"}, "G2"), ({"target": "Pakistan"}, "G3"), ({"polarity": "mixed"}, "G4"), ({"modality": "future"}, "G5"), ({"quote_span": "  "}, "G6"), ({"quote_span": "never said"}, "G7"), ({"speaker": "analyst"}, "G8"),
    ({"modality": "historical"}, None), ({"modality": None, "speaker": None}, None), ({"polarity": None}, "G4"), ({"source": "Nobody", "polarity": "mixed"}, "G1"), ({"quote_span": None}, "G6"),
]


def test_gates_in_order(spark):
    rows = [(i, TEXT, True, *(GOOD | change).values(), "d", "pre", "o", "{}") for i, (change, _) in enumerate(CASES)]
    rows.append((len(CASES), TEXT, False, *[None] * 7, "d", "pre", "o", "3"))
    schema = "i int, text string, is_object boolean, source string, target string, polarity string, raw_verb string, speaker string, modality string, quote_span string, doc_id string, phase string, outlet string, raw string"
    checked = gates.gated(spark.createDataFrame(rows, schema), WORDS)
    assert [r.gate for r in checked.orderBy("i").collect()] == [g for _, g in CASES] + ["G0"]
    edges, drops = gates.kept(checked).collect(), gates.dropped(checked)
    assert len(edges) + drops.count() == len(rows)
    assert edges[0].source == "Pakistan" and edges[0].valence == "coop" and edges[0].raw_verb == "hosted"
    assert {r.label: r.n for r in gates.tally(drops).collect()}["unresolved source"] == 2


def test_phase(spark):
    assert col(spark, ["2026-04-07", "2026-04-08", None], lambda c: gates.phase_of(c, "2026-04-08")) == ["pre", "post", None]


def test_provider_failures_are_kept(spark):
    def provider(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("refused")
        return ["[]"] * len(prompts)

    chunks = spark.createDataFrame([("1", "ok"), ("2", "bad"), ("3", "ok")], "doc_id string, prompt string").coalesce(1)
    rows = {r.doc_id: (r.raw_response, r.error) for r in gates.call_provider(chunks, provider).collect()}
    assert rows == {"1": ("[]", None), "2": (None, "ValueError: refused"), "3": ("[]", None)}
    done = spark.createDataFrame([("1", None), ("2", "x")], "doc_id string, error string")
    assert [r.doc_id for r in gates.not_yet_done(chunks, done).collect()] == ["3"]
    assert sorted(r.doc_id for r in gates.not_yet_done(chunks, done, retry_errors=True).collect()) == ["2", "3"]
    replayed = gates.replay(chunks, spark.createDataFrame([("1", "[1]")], "doc_id string, raw_response string"))
    assert {r.doc_id: r.error is None for r in replayed.collect()} == {"1": True, "2": False, "3": False}
