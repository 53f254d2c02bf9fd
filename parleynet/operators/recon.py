"""Vocabulary discovery: frequent names, alias groups, and verbs between actors.

A tagger is a parameter. The default reads names as runs of capitalised words and verbs
as the words of a cue list in any regular form, in JVM expressions; a model-backed
tagger is any function from texts to the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.verbs import inflected
from . import tagger as TG

#: Relation buckets and the cues that name them, first match wins.
CUES = {
    "HOST_TALKS": ("host", "convene", "bring together", "welcome"),
    "MEDIATE": ("mediate", "broker", "facilitate", "shuttle", "go-between"),
    "CONSULT": ("meet", "talk", "discuss", "phone", "call", "hold talks", "consult"),
    "AGREE": ("agree", "sign", "reach", "accept", "deal", "ceasefire"),
    "SUPPORT": ("back", "support", "praise", "side", "welcome", "endorse"),
    "AID": ("aid", "supply", "assist", "provide", "send"),
    "DEMAND": ("urge", "call on", "press", "demand", "insist"),
    "REJECT": ("reject", "refuse", "dismiss", "rule out", "deny"),
    "ACCUSE": ("accuse", "condemn", "blame", "criticise", "criticize", "slam"),
    "THREATEN": ("threaten", "warn", "vow", "retaliate"),
    "SANCTION": ("sanction", "blacklist", "impose", "penalise", "penalize"),
    "ASSAULT": ("strike", "bomb", "attack", "hit", "launch", "kill", "target"),
}
NAME = r"\p{Lu}[\p{L}'’-]*(?: \p{Lu}[\p{L}'’-]*)*"


def names(text: Column) -> Column:
    """Runs of capitalised words, more than one character long."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NAME), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"['’-]+$", ""))), lambda x: F.length(x) > 1)


def discover(docs: DataFrame, text: str = "text", keep: int | None = 200, tagger=names) -> DataFrame:
    """(surface, count): the most frequent names; null texts are left out."""
    counts = docs.where(F.col(text).isNotNull()).select(F.explode(tagger(F.col(text))).alias("surface")).groupBy("surface").agg(F.count("*").alias("count"))
    return counts if keep is None else counts.orderBy(F.desc("count"), "surface").limit(keep)


def canon_for(surface: Column, seeds: dict[str, list[str]]) -> Column:
    """The first actor one of whose forms is the name, a word of the name, or holds the name; permissive on purpose, names are read by people next."""
    n = F.trim(F.regexp_replace(F.lower(surface), r"[^a-z\s]", ""))
    out = F.lit(None).cast("string")
    for actor, forms in reversed(list(seeds.items())):
        hit = F.lit(False)
        for f in forms:
            hit = hit | (n == f) | F.array_contains(F.split(n, r"\s+"), f) | F.contains(F.lit(f), n)
        out = F.when(hit, actor).otherwise(out)
    return out


def alias_groups(counts: DataFrame, seeds: dict[str, list[str]]) -> DataFrame:
    """(canon, surface, count); names that match no seed are UNRESOLVED."""
    return counts.withColumn("canon", F.coalesce(canon_for(F.col("surface"), seeds), F.lit("UNRESOLVED"))).groupBy("canon", "surface").agg(F.sum("count").alias("count"))


def bucket(phrase: Column) -> Column:
    """The first relation with a cue inside the phrase or around it."""
    out = F.lit("UNMAPPED")
    for relation, cues in reversed(list(CUES.items())):
        hit = F.lit(False)
        for cue in cues:
            hit = hit | phrase.contains(cue) | F.contains(F.lit(cue), phrase)
        out = F.when(hit, relation).otherwise(out)
    return out


def cue_verbs(sentence: Column) -> Column:
    """Words of a sentence that are a form of a one-word cue, as the cue."""
    base = {form: cue for cues in CUES.values() for cue in cues if " " not in cue for form in inflected(cue)}
    table = F.create_map(*(F.lit(x) for kv in base.items() for x in kv))
    return F.array_compact(F.transform(F.regexp_extract_all(F.lower(sentence), F.lit("[a-z-]+"), F.lit(0)), lambda w: F.try_element_at(table, w)))


def mine_verbs(docs: DataFrame, seeds: dict[str, list[str]], text: str = "text", keep: int = 80, tagger=names, verbs=cue_verbs) -> DataFrame:
    """(relation_bucket, verb_phrase, count): verbs of sentences with two actors or more, the most frequent of each bucket."""
    sentences = docs.where(F.col(text).isNotNull()).select(F.explode(F.split(F.col(text), r"(?<=[.?!])\s+")).alias("s"))
    actors = F.array_distinct(F.array_compact(F.transform(tagger(F.col("s")), lambda x: canon_for(x, seeds))))
    found = sentences.where(F.size(actors) >= 2).select(F.explode(verbs(F.col("s"))).alias("verb_phrase")).groupBy("verb_phrase").agg(F.count("*").alias("count"))
    found = found.withColumn("relation_bucket", bucket(F.col("verb_phrase")))
    rank = F.row_number().over(Window.partitionBy("relation_bucket").orderBy(F.desc("count"), "verb_phrase"))
    return found.withColumn("_k", rank).where(F.col("_k") <= keep).select("relation_bucket", "verb_phrase", "count")


#: The one-word cues, as verbs to find.
CUE_TAGGER = TG.Tagger(tuple(dict.fromkeys(cue for cues in CUES.values() for cue in (*cues, "call", "hold", "bring", "rule", "give") if " " not in cue and "-" not in cue)))


def mine_phrases(docs: DataFrame, id_col: str, seeds: dict[str, list[str]], text: str = "text", keep: int = 80, tagger: TG.Tagger = CUE_TAGGER) -> DataFrame:
    """(relation_bucket, verb_phrase, count): verb phrases of sentences that name two actors or more, the most frequent of each bucket.

    docs has one row for each id; null texts are left out, as are rows with a null id. Texts are
    dealt out by id and tagged once; a sentence's actors and verbs are met where it was tagged.
    """
    texts = docs.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text).repartition(id_col)
    sentences = TG.tagged_sentences(texts, tagger, text)
    names = F.filter("names", lambda x: x["label"].isin(*TG.LABELS))
    actors = F.array_distinct(F.array_compact(F.transform(names, lambda x: canon_for(x["span"], seeds))))
    found = sentences.select(F.when(F.size(actors) > 1, F.col("verbs")).alias("verbs")).select(F.explode("verbs").alias("verb_phrase")).groupBy("verb_phrase").agg(F.count("*").alias("count"))
    found = found.withColumn("relation_bucket", bucket(F.col("verb_phrase")))
    rank = F.row_number().over(Window.partitionBy("relation_bucket").orderBy(F.desc("count"), "verb_phrase"))
    return found.withColumn("_k", rank).where(F.col("_k") <= keep).select("relation_bucket", "verb_phrase", "count")


def bloc_skeleton(seeds: dict[str, list[str]]) -> dict[str, str]:
    """A mapping for a person to fill in: every seeded actor with an empty bloc."""
    return {actor: "" for actor in seeds}
