"""The tagger's spans and what is mined from them."""

import re
from collections import Counter

import pytest

from parleynet.operators import recon, tagger as TG

SEEDS = {"Polo": ["marco polo", "polo"], "Khan": ["kublai khan", "khan"], "Venice": ["venice", "venetian"]}
TAGGER = TG.Tagger(("call", "meet", "urge", "rule", "back", "reach", "look"), known={"Venice": "GPE"})


def spans(text):
    return [(s[0], s[4], s[5]) for s in TAGGER.spans(text)]


@pytest.mark.parametrize(
    "text, verbs",
    [
        ("Khan called on Polo.", ["call on"]), ("Khan ruled out a deal with Polo.", ["rule out with"]), ("Khan called him back to Venice.", ["call back to"]), ("Khan met Polo in the city of Venice.", ["meet in"]),
        ("Khan looked into it, and urged Polo.", ["look into", "urge"]), ("Khan reached out after the talks with Polo from Venice.", ["reach out after w"]), ("khan said.", []),
    ],
)
def test_verb_phrases_with_particles_and_prepositions(text, verbs):
    assert [t for kind, t, _ in spans(text) if kind == TG.VERB] == verbs


@pytest.mark.parametrize(
    "text, names",
    [
        ("President Polo spoke.", [("President Polo", "PERSON")]), ("Marco Polo left Venice.", [("Marco Polo", "PERSON"), ("Venice", "GPE")]), ("the Council of Trade", [("Council", "ORG"), ("Trade", "GPE")]),
        ("the UN met Persian and Chinese envoys", [("UN", "ORG"), ("Persian", "NORP"), ("Chinese", "NORP")]), ("in New York, Polo's ship", [("New York", "GPE"), ("Polo", "GPE")]), ("I saw A and it", []), (None, []), ("", []),
    ],
)
def test_names_and_labels(text, names):
    assert [(t, label) for kind, t, label in spans(text) if kind == TG.NAME] == names


def test_spans_name_their_place():
    text = "Khan called on Polo.  He met Khan! \n Polo met  Marco Polo?"
    for kind, number, start, end, span, _ in TAGGER.spans(text):
        assert text[start:end] == span if kind == TG.NAME else text[start:end].lower() in TAGGER.forms
    assert [s[1] for s in TAGGER.spans(text) if s[4] == "Marco Polo"] == [2]


def brute(texts, keep=80):
    counts = Counter()
    for text in texts:
        for sentence in re.split(r"(?<=[.?!])\s+", text or ""):
            found = list(TAGGER.spans(sentence))
            actors = set()
            for kind, *_, name, label in found:
                if kind == TG.NAME:
                    plain = re.sub(r"[^a-z\s]", "", name.lower()).strip()
                    actors |= {next((a for a, forms in SEEDS.items() if any(plain == f or f in plain.split() or plain in f for f in forms)), None)} - {None}
            if len(actors) > 1:
                counts.update(s[4] for s in found if s[0] == TG.VERB)
    rows = {}
    for phrase, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        relation = next((r for r, cues in recon.CUES.items() if any(c in phrase or phrase in c for c in cues)), "UNMAPPED")
        rows.setdefault(relation, []).append((phrase, n))
    return {(r, p): n for r, found in rows.items() for p, n in found[:keep]}


def test_mined_phrases_equal_plain_counts(spark):
    texts = ["Khan called on Polo. Khan called on Venice to back Polo. Polo met nobody.", "Marco Polo met Kublai Khan in Venice. Khan met Polo in Venice!", None, "", "Khan ruled out a deal with Polo. Venice looked at Khan."]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string")
    for keep in (80, 1):
        got = {(r.relation_bucket, r.verb_phrase): r["count"] for r in recon.mine_phrases(docs, "doc_id", SEEDS, keep=keep, tagger=TAGGER).collect()}
        assert got == brute(texts, keep)
        assert (("CONSULT", "call on") in got) == (keep == 80)


def test_texts_are_tagged_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    texts = ["Khan called on Polo. Polo met nobody.", "Polo met Khan in Venice.", "none"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).mapInArrow(counted, "doc_id long, text string")
    assert {r.verb_phrase: r["count"] for r in recon.mine_phrases(docs, "doc_id", SEEDS, tagger=TAGGER).collect()} == {"call on": 4, "meet in": 4}
    assert rows.value == len(texts)


def test_sentences_hold_their_names_and_verbs(spark):
    docs = spark.createDataFrame([(1, "Polo met Khan. Venice slept. Khan met nobody. The UN called on Mr Polo."), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.sentence, [tuple(x) for x in r.names], r.verbs) for r in TG.tagged_sentences(docs, TAGGER).collect())
    assert got == [(1, 0, [("Polo", "GPE"), ("Khan", "GPE")], ["meet"]), (1, 3, [("The UN", "PERSON"), ("Mr Polo", "PERSON")], ["call on"])]


def test_cue_verbs_are_known_in_all_forms():
    assert recon.CUE_TAGGER.forms["called"] == "call" and recon.CUE_TAGGER.forms["urges"] == "urge"
    assert [s[4] for s in recon.CUE_TAGGER.spans("Khan condemned Polo and called on Venice") if s[0] == TG.VERB] == ["condemn", "call on"]


def test_discovered_names_have_their_most_frequent_label(spark):
    docs = spark.createDataFrame([(1, "in Polo. Mr Polo came. Mr Polo left. Khan met Mr Khan.",), (2, None)], "doc_id long, text string")
    got = {r.surface: (r.label, r["count"]) for r in TG.discovered(TG.tagged(docs, TAGGER)).collect()}
    assert got["Polo"] == ("GPE", 1) and got["Mr Polo"] == ("PERSON", 2) and got["Khan"] == ("GPE", 1)
