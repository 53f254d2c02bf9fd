"""Actor vocabulary: dimensions, resolution of mentions, and coarse mention search in texts."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import norm

#: Forms up to which the lookup is sent to every task; a larger vocabulary is joined by shuffling.
BROADCAST_FORMS = 100_000


@dataclass(frozen=True)
class Vocabulary:
    """actors in order, their blocs, their surface forms, and forms that must never resolve (with the reason)."""

    actors: tuple[str, ...]
    blocs: dict[str, str]
    aliases: dict[str, list[str]] = field(default_factory=dict)
    excluded: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Vocabulary:
        v = json.loads(text)
        return cls(tuple(v["actors"]), dict(v["bloc"]), {k: list(x) for k, x in v.get("aliases", {}).items()}, dict(v.get("excluded_frequent", {})))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Vocabulary:
        """From one small JSON file, by any path Spark can read."""
        return cls.parse("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))

    def actor_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a, self.blocs.get(a), i) for i, a in enumerate(self.actors)], "actor string, bloc string, ord int")

    def forms(self) -> list[tuple[str, str]]:
        """(form, actor): canonical names with and without underscores, then aliases; the last listing of a form counts."""
        pairs = [(f, a) for a in self.actors for f in (a.replace("_", " "), a)]
        pairs += [(f, a) for a, forms in self.aliases.items() for f in forms]
        last = {_plain(f): a for f, a in pairs}
        return sorted(last.items())

    def form_rows(self, spark: SparkSession) -> DataFrame:
        """(form, actor) without excluded forms."""
        gone = {_plain(f) for f in self.excluded}
        pairs = [(f, a) for f, a in self.forms() if f and f not in gone]
        rows = spark.createDataFrame(pairs, "form string, actor string")
        return F.broadcast(rows) if len(pairs) <= BROADCAST_FORMS else rows

    def excluded_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(_plain(f), why) for f, why in sorted(self.excluded.items())], "form string, why string")

    def pattern(self, actor: str) -> str:
        """A pattern that finds any form of the actor as a whole token, longest form first."""
        forms = {actor.lower(), actor.lower().replace("_", " "), *(f.lower() for f in self.aliases.get(actor, []))}
        return r"(?i)(?<![a-z0-9])(?:" + "|".join(r"\Q" + f + r"\E" for f in sorted(forms, key=lambda f: (-len(f), f))) + r")(?![a-z0-9])"

    def prompt_list(self) -> str:
        return ", ".join(self.actors)


def _plain(form: str) -> str:
    return re.sub("[^a-z0-9 ]", "", form.lower()).strip()


def fallback_form(form: Column) -> Column:
    """`the X...s` without the article and without any trailing s; every other form as it is."""
    return F.when(form.startswith("the "), F.regexp_replace(F.substring(form, 5, 1 << 30), "s+$", "")).otherwise(form)


def resolve(df: DataFrame, mention: str, vocabulary: Vocabulary, into: str = "actor") -> DataFrame:
    """df with the canonical actor of a mention: exact normal form, then one fallback; null if neither or if excluded."""
    spark = df.sparkSession
    forms = vocabulary.form_rows(spark)
    gone = list({_plain(f) for f in vocabulary.excluded})
    key = norm(F.col(mention))
    df = df.withColumn("_form", F.when((key != "") & (~key.isin(gone) if gone else F.lit(True)), key))
    first = forms.withColumnsRenamed({"form": "_form", "actor": "_first"})
    second = forms.withColumnsRenamed({"form": "_fallback", "actor": "_second"})
    df = df.join(first, "_form", "left").withColumn("_fallback", fallback_form(F.col("_form"))).join(second, "_fallback", "left")
    return df.withColumn(into, F.coalesce("_first", "_second")).drop("_form", "_fallback", "_first", "_second")


def mentioned(text: Column, vocabulary: Vocabulary, actors: tuple[str, ...] | None = None) -> Column:
    """The actors, in vocabulary order, of which the text holds a form as a whole token; case doesn't matter."""
    text = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*(F.when(text.rlike(vocabulary.pattern(a)), a) for a in (actors or vocabulary.actors))))


def on_axis(mentions: Column, focal: tuple[str, ...], dyad: tuple[str, ...]) -> Column:
    """At least two of the focal actors, and one of the dyad among them."""
    found = F.array_intersect(mentions, F.array(*map(F.lit, focal)))
    return (F.size(found) >= 2) & F.arrays_overlap(mentions, F.array(*map(F.lit, dyad)))
