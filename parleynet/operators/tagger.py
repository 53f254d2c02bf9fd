"""A rule tagger as a table function: labelled names and verb phrases of texts, a row each.

It knows no language model: names are runs of capitalised words, labelled by known forms, by
what stands before them and by their words; verbs are known forms. A model-backed tagger is
any table function with the same columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

from ..functions.verbs import inflected

SPANS = "kind string, sentence int, start int, end int, span string, label string"
#: A sentence's labelled names and verb phrases.
SENTENCES = "sentence int, names array<struct<span string, label string>>, verbs array<string>"
NAME, VERB = "name", "verb"
#: The labels of names that count as actors.
LABELS = ("GPE", "ORG", "PERSON", "NORP")
#: Words that can follow a verb as its particle, and prepositions that can begin what hangs on it.
PARTICLES = frozenset("about across along apart around aside away back by down forward in off on out over through together under up".split())
PREPOSITIONS = frozenset("about after against among at before between by during for from in into of on over through to toward towards under upon with without".split())
TITLES = frozenset("mr mrs ms dr sir president minister premier king queen prince general senator ambassador secretary chancellor mullah ayatollah sheikh".split())
BODIES = frozenset("agency army association authority bank council committee congress court force forces group guard institute league ministry movement office organisation organization parliament party senate union university".split())
PLACED = frozenset("in at from to into near across".split())
#: Past forms and participles of irregular verbs.
IRREGULAR = {"bring": "brought", "deal": "dealt", "give": "gave given", "hold": "held", "meet": "met", "say": "said", "send": "sent", "speak": "spoke spoken", "strike": "struck", "take": "took taken", "tell": "told"}
PEOPLE = re.compile(r"(?:[a-z]{2,}(?:ian|ese|ish|ani|aqi|eli)s?)$", re.IGNORECASE)
SENTENCE = re.compile(r"(?<=[.?!])\s+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]")
#: The reference's limit on the length of what follows a verb.
TAIL = 12


class Tagger:
    """forms: verb by inflected form; known: label by name. None of them: the forms of `verbs`."""

    def __init__(self, verbs: tuple[str, ...] = (), known: dict[str, str] | None = None, forms: dict[str, str] | None = None):
        self.forms = forms if forms is not None else {form: v for v in verbs for form in (*inflected(v), *IRREGULAR.get(v, "").split())}
        self.known = known or {}

    def label(self, words: list[str], before: str) -> str:
        """The label of a name by its words and the word before it."""
        name = " ".join(words)
        if name in self.known:
            return self.known[name]
        lower = [w.lower() for w in words]
        if not BODIES.isdisjoint(lower) or (len(words) == 1 and name.isupper() and 2 <= len(name) <= 6):
            return "ORG"
        if before.lower() in TITLES or lower[0] in TITLES:
            return "PERSON"
        if len(words) == 1 and PEOPLE.search(name):
            return "NORP"
        return "PERSON" if len(words) > 1 and before.lower() not in PLACED else "GPE"

    def spans(self, text: str | None) -> Iterator[tuple[str, int, int, int, str, str]]:
        """SPANS of a text; places are of characters in the text, a verb's label is empty and its span the phrase."""
        at = 0
        for number, sentence in enumerate(SENTENCE.split(text or "")):
            at = (text or "").index(sentence, at)
            tokens = [(m[0], at + m.start(), at + m.end()) for m in TOKEN.finditer(sentence)]
            i = 0
            while i < len(tokens):
                word, start, end = tokens[i]
                if word[0].isupper():
                    j = i
                    while j + 1 < len(tokens) and tokens[j + 1][0][0].isupper() and tokens[j + 1][1] == tokens[j][2] + 1:
                        j += 1
                    words = [re.sub(r"['’]s$", "", w) for w, _, _ in tokens[i : j + 1]]
                    if len(" ".join(words)) > 1 and words != ["I"]:
                        yield NAME, number, start, tokens[j][2], " ".join(words), self.label(words, tokens[i - 1][0] if i else "")
                    i = j
                elif word.lower() in self.forms:
                    phrase, particle = self.phrase(tokens, i)
                    yield VERB, number, start, end, phrase, ""
                    i = max(i, particle)
                i += 1
            at += len(sentence)

    def phrase(self, tokens: list[tuple[str, int, int]], i: int) -> tuple[str, int]:
        """The verb at i with its particle and the prepositions that hang on it, and the particle's place (0: none).

        A particle stands right after the verb or after one word between, even if it is a
        verb elsewhere. A preposition hangs on the verb up to the next verb or mark, but
        `of`, which hangs on the noun before it, hangs on the verb only right after it.
        """
        tail, particle = "", 0
        for k in range(i + 1, len(tokens)):
            word = tokens[k][0].lower()
            near = k - i <= 2 and not tail and word in PARTICLES
            if not near and (not word[0].isalnum() or word in self.forms):
                break
            if near:
                particle = k
            if near or (word in PREPOSITIONS and (word != "of" or k == i + 1)):
                tail += f" {word}"
        return (self.forms[tokens[i][0].lower()] + tail[:TAIL]).strip(), particle


def tagged(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """The rows of docs, each with its SPANS; texts without any, and null ones, give no rows."""

    class Spans:
        def eval(self, value: str):
            yield from tagger.spans(value)

    spans = F.udtf(Spans, returnType=SPANS)
    return docs.lateralJoin(spans(F.col(text).outer()))


def tagged_sentences(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """The rows of docs, each with its SENTENCES that hold two names or more and a verb; a sentence's spans stay together, so that nothing has to bring them together."""

    class Sentences:
        def eval(self, value: str):
            for number, found in groupby(tagger.spans(value), key=lambda s: s[1]):
                names, verbs = [], []
                for kind, *_, span, label in found:
                    if kind == NAME:
                        names.append((span, label))
                    else:
                        verbs.append(span)
                if verbs and len(names) > 1:
                    yield number, names, verbs

    sentences = F.udtf(Sentences, returnType=SENTENCES)
    return docs.lateralJoin(sentences(F.col(text).outer()))


def discovered(spans: DataFrame, keep: int | None = 200) -> DataFrame:
    """(surface, label, count): names by how often they occur, the most frequent label of each; ties go to the first label by name."""
    names = spans.where((F.col("kind") == NAME) & F.col("label").isin(*LABELS)).groupBy(F.col("span").alias("surface"), "label").agg(F.count("*").alias("n"))
    out = names.groupBy("surface").agg(F.max_by("label", F.struct("n", F.expr("transform(split(label, ''), c -> -ascii(c))"))).alias("label"), F.sum("n").alias("count"))
    return out if keep is None else out.orderBy(F.desc("count"), "surface").limit(keep)
