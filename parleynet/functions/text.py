"""Text functions: normal forms, chunks, prompts, payload parsing, article fields. All are JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Typographic characters and their plain forms; the last group is deleted.
TYPOGRAPHIC = (
    ("\u2018\u2019\u201a\u201b", "'"),
    ("\u201c\u201d\u201e\u201f", '"'),
    ("\u2013\u2014\u2015\u2212", "-"),
    ("\u00a0\u2009\u202f\u2007\u2022\u00b7\u2027", " "),
    ("\ufeff\u200b", ""),
)
CANDIDATE_FIELDS = ("source", "target", "polarity", "raw_verb", "speaker", "modality", "quote_span")


def norm(c: Column) -> Column:
    """Lower case with everything but a-z, 0-9 and space removed; inner spaces stay as they are."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))


def canon_text(c: Column) -> Column:
    """Typography folded to ASCII, white space of any kind collapsed and trimmed, case folded; null is empty."""
    plain = "".join(to * len(chars) for chars, to in TYPOGRAPHIC)
    text = F.translate(F.coalesce(c, F.lit("")), "".join(chars for chars, _ in TYPOGRAPHIC), plain)
    text = F.replace(text, F.lit("\u2026"), F.lit("..."))
    return F.replace(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def strip(c: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: An empty line, or two or more white-space characters after the end of a sentence.
PARAGRAPH = r"\n{2,}|(?<=[.?!])(?U:\s{2,})"


def chunk_paragraphs(c: Column, min_len: int = 40, boundary: str = PARAGRAPH) -> Column:
    """Trimmed pieces of min_len characters or more; if none is, the whole trimmed text; none of a blank text."""
    whole = strip(F.coalesce(c, F.lit("")))
    pieces = F.filter(F.transform(F.split(whole, boundary), strip), lambda p: F.length(p) >= min_len)
    return F.when(F.length(whole) == 0, F.array().cast("array<string>")).when(F.size(pieces) > 0, pieces).otherwise(F.array(whole))


def build_prompt(template: str, actors: Column, chunk: Column) -> Column:
    """The template with its places {actors} and {chunk} filled."""
    return F.replace(F.replace(F.lit(template), F.lit("{actors}"), actors), F.lit("{chunk}"), chunk)


def parse_candidates(raw: Column) -> Column:
    """array<struct<raw, is_object, source, ..., quote_span>> of a model's answer.

    Code fences go. A list is its elements; an object is the elements of its first field
    that holds a list, else itself if it has a source and a target; anything else, bad
    JSON included, is no candidate. A field that isn't a string is read as its JSON text.
    """
    text = strip(F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"(?m)^```(?:json)?|```$", ""))
    none = F.array().cast("array<string>")

    def of_object(s: Column) -> Column:
        fields = F.from_json(s, "map<string,string>")
        lists = F.filter(F.json_object_keys(s), lambda k: F.rlike(s, F.concat(F.lit(r'"\Q'), k, F.lit(r'\E"\s*:\s*\['))) & F.from_json(F.element_at(fields, k), "array<string>").isNotNull())
        bare = F.when(F.map_contains_key(fields, "source") & F.map_contains_key(fields, "target"), F.array(s))
        return F.coalesce(F.from_json(F.element_at(fields, F.get(lists, 0)), "array<string>"), bare, none)

    parsed = F.when(F.try_parse_json(text).isNull(), none).when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), none)).when(text.startswith("{"), of_object(text)).otherwise(none)

    def candidate(x: Column) -> Column:
        is_object = F.coalesce(x.startswith("{"), F.lit(False))
        fields = F.when(is_object, F.from_json(x, ", ".join(f"{k} string" for k in CANDIDATE_FIELDS)))
        return F.struct(x.alias("raw"), is_object.alias("is_object"), *(fields[k].alias(k) for k in CANDIDATE_FIELDS))

    return F.transform(parsed, candidate)


def utc_timestamp(c: Column) -> Column:
    """ISO text as UTC time (a time zone is applied, none means UTC); null if it can't be read. The session's zone is UTC."""
    return F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")))


def day(c: Column) -> Column:
    return F.substring(c, 1, 10)


def article_id(url: Column, otherwise: Column | None = None) -> Column:
    """The last seven digits of all digits of the url."""
    digits = F.regexp_replace(url, r"\D", "")
    return F.coalesce(F.nullif(F.right(digits, F.lit(7)), F.lit("")), otherwise if otherwise is not None else F.lit(""))


def without_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def guess_genre(url: Column, author: Column) -> Column:
    """wire by agency names anywhere in the author (also inside words), opinion by the url's parts, else news."""
    a = F.lower(F.coalesce(author, F.lit("")))
    wire = reduce(lambda x, y: x | y, (a.contains(w) for w in ("afp", "reuters", "app", "ap ", "anadolu")))
    opinion = reduce(lambda x, y: x | y, (url.contains(w) for w in ("/opinion", "/newspaper/column", "editorial")))
    return F.when(wire, "wire").when(opinion, "editorial/opinion").otherwise("news")


def outlet_of(url: Column, domains: list[str]) -> Column:
    """The first of the domains that the url contains, else the empty string."""
    out = F.lit("")
    for d in reversed(domains):
        out = F.when(url.contains(d), d).otherwise(out)
    return F.coalesce(out, F.lit(""))


def dyad_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def pretty(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" "))


def escaped(c: Column) -> Column:
    """Text as it is shown inside HTML."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def yes_no(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("y", "yes", "true", "1"), True).when(s.isin("n", "no", "false", "0"), False)


def one_of(c: Column, *allowed: str) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(*allowed), s)
