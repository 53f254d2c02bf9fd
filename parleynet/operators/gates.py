"""Extraction: candidates from a provider, validated against their text by ordered gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import config
from ..functions.text import canon_text, strip
from .vocabulary import Vocabulary, resolve


def phase_of(date: Column, boundary: str) -> Column:
    """pre before the boundary as text, post from it on; null for a null date."""
    return F.when(date < boundary, "pre").when(date.isNotNull(), "post")


def valence_of(polarity: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in config.VALENCE.items() for x in kv))[polarity]


def gated(candidates: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """candidates(text, is_object, source, ..., quote_span) with resolved actors, `gate` and `reason`; gate is null where all pass.

    The first gate that fails is the one reported: not an object, unresolved source or
    target, self-loop, bad polarity, non-event modality, empty quote, quote not in the
    text, commentary speaker. Missing modality is asserted; a missing speaker passes.
    """
    df = candidates.withColumnsRenamed({"source": "said_source", "target": "said_target"})
    df = resolve(resolve(df, "said_source", vocabulary, "source"), "said_target", vocabulary, "target")
    quote = strip(F.coalesce("quote_span", F.lit("")))
    # Candidates of extraction carry their chunk's canonical text.
    text = F.col("text_canon") if "text_canon" in candidates.columns else canon_text(F.col("text"))
    said = lambda c: F.coalesce(F.col(c), F.lit("None"))
    rules: list[tuple[str, Column, Column]] = [
        ("G0", ~F.col("is_object"), F.lit("not an object")),
        ("G1", F.col("source").isNull(), F.concat(F.lit("unresolved source: "), said("said_source"))),
        ("G2", F.col("target").isNull(), F.concat(F.lit("unresolved target: "), said("said_target"))),
        ("G3", F.col("source") == F.col("target"), F.concat(F.lit("self-loop ("), F.col("source"), F.lit(")"))),
        ("G4", ~F.coalesce(F.col("polarity").isin(*config.VALENCE), F.lit(False)), F.concat(F.lit("bad polarity: "), said("polarity"))),
        ("G5", F.coalesce(F.col("modality").isin(*config.NON_EVENTS), F.lit(False)), F.concat(F.lit("non-event modality: "), said("modality"))),
        ("G6", quote == "", F.lit("empty quote_span")),
        ("G7", ~F.contains(text, canon_text(quote)), F.lit("quote_span not in text (hallucination gate)")),
        ("G8", F.coalesce(F.col("speaker").isin(*config.COMMENTATORS), F.lit(False)), F.concat(F.lit("commentary speaker: "), said("speaker"))),
    ]
    gate, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, fails, why in reversed(rules):
        gate, reason = F.when(fails, name).otherwise(gate), F.when(fails, why).otherwise(reason)
    return df.withColumn("quote", quote).withColumn("gate", gate).withColumn("reason", reason)


def kept(checked: DataFrame) -> DataFrame:
    """Validated edges of gated candidates(…, doc_id, phase, outlet)."""
    return checked.where("gate IS NULL").select("source", "target", "polarity", valence_of(F.col("polarity")).alias("valence"), F.lower(F.coalesce("raw_verb", F.lit(""))).alias("raw_verb"), "quote", "doc_id", "phase", "outlet")


def dropped(checked: DataFrame) -> DataFrame:
    return checked.where("gate IS NOT NULL").select("doc_id", F.col("raw").alias("edge"), "reason", "gate")


def tally(drops: DataFrame) -> DataFrame:
    """(label, n): drops by the reason's first words."""
    label = F.split_part(F.split_part(F.col("reason"), F.lit(":"), F.lit(1)), F.lit(" ("), F.lit(1))
    return drops.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def mock_provider(prompts: list[str]) -> list[str]:
    """Answers every prompt with an empty list."""
    return ["[]"] * len(prompts)


def call_provider(chunks: DataFrame, provider: Callable[[list[str]], list[str]], batch: int = 64) -> DataFrame:
    """chunks(…, prompt) with `raw_response` and `error`: a failed batch is tried prompt by prompt, and a failure is kept as a row."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("raw_response", T.StringType()), T.StructField("error", T.StringType())])

    def ask(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(a, None) for a in provider(prompts)]
        except Exception as e:
            return [(None, f"{type(e).__name__}: {e}")] if len(prompts) == 1 else [x for p in prompts for x in ask([p])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts = frame["prompt"].tolist()
            answers = [x for i in range(0, len(prompts), batch) for x in ask(prompts[i : i + batch])]
            yield frame.assign(raw_response=[a for a, _ in answers], error=[e for _, e in answers])

    return chunks.mapInPandas(run, schema)


def replay(chunks: DataFrame, recorded: DataFrame) -> DataFrame:
    """chunks with the recorded raw_response of their doc_id; an error where none was recorded."""
    known = recorded.select("doc_id", "raw_response")
    return chunks.join(known, "doc_id", "left").withColumn("error", F.when(F.col("raw_response").isNull(), "no recorded response"))


def not_yet_done(chunks: DataFrame, done: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Chunks without a record; with retry_errors those whose record is an error come again."""
    done = done.where("error IS NULL") if retry_errors and "error" in done.columns else done
    return chunks.join(done.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_anti")


def event_edges(candidates: DataFrame, actors: tuple[str, ...]) -> DataFrame:
    """Event-typed mode: edges with relation, weight and valence.

    Only canonical names resolve, the quote is looked for with white space collapsed and
    case kept, and commentary and non-events go.
    """
    spark = candidates.sparkSession
    relations = F.broadcast(spark.createDataFrame([(r, w, v) for r, (w, v) in config.RELATIONS.items()], "relation string, weight double, valence string"))
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", " ")
    quote = strip(squeeze(F.coalesce("quote_span", F.lit(""))))
    ok = F.col("source").isin(*actors) & F.col("target").isin(*actors) & (F.col("source") != F.col("target"))
    ok &= ~F.coalesce(F.col("modality").isin(*config.NON_EVENTS), F.lit(False)) & (quote != "") & F.contains(squeeze(F.col("text")), quote)
    ok &= ~F.coalesce(F.col("speaker").isin(*config.COMMENTATORS), F.lit(False))
    return candidates.where(ok).join(relations, "relation").select("source", "target", "relation", "weight", "valence", "doc_id", "phase", "outlet")
