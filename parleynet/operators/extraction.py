"""Articles to validated edges: relevance filter, sample, chunks, provider, parsing, gates, records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..config import Axis
from ..functions.text import build_prompt, canon_text, chunk_paragraphs, day, parse_candidates
from .gates import call_provider, gated, kept, phase_of
from .validation import sample
from .vocabulary import Vocabulary, mentioned, on_axis


def chunked(articles: DataFrame, axis: Axis, vocabulary: Vocabulary, n: int = 0, seed: int = 0, min_len: int = 40, **chunking) -> DataFrame:
    """(article_row, chunk_no, doc_id, date, outlet, text) of on-axis articles(article_row, outlet, date, body), n of them or all (0)."""
    on = on_axis(mentioned(F.col("body"), vocabulary, tuple(dict.fromkeys((*axis.focal, *axis.dyad)))), axis.focal, axis.dyad)
    rows = sample(articles.where(on), n, "article_row", seed=seed)
    rows = rows.select("article_row", day(F.col("date")).alias("date"), F.lower("outlet").alias("outlet"), F.posexplode(chunk_paragraphs(F.col("body"), min_len, **chunking)).alias("chunk_no", "text"))
    return rows.select("article_row", "chunk_no", F.concat_ws("_", "article_row", "chunk_no").alias("doc_id"), "date", "outlet", "text")


def candidates(answered: DataFrame, boundary: str) -> DataFrame:
    """One row for each candidate of answered chunks(doc_id, date, outlet, text, raw_response), ready for the gates."""
    # A chunk's text is made canonical once, not once for each of its candidates.
    rows = answered.withColumn("phase", phase_of(F.col("date"), boundary)).withColumn("text_canon", canon_text(F.col("text")))
    rows = rows.withColumn("c", F.explode(parse_candidates(F.col("raw_response"))))
    return rows.select("doc_id", "phase", "outlet", "text", "text_canon", "c.*")


def extract(chunks: DataFrame, vocabulary: Vocabulary, boundary: str, template: str, provider: Callable[[list[str]], list[str]]) -> DataFrame:
    """Gated candidates of the provider's answers to every chunk; a provider is asked once for each chunk, so write the answers before reusing them."""
    asked = chunks.withColumn("prompt", build_prompt(template, F.lit(vocabulary.prompt_list()), F.col("text")))
    return gated(candidates(call_provider(asked, provider), boundary), vocabulary)


def records(answered: DataFrame, checked: DataFrame, boundary: str) -> DataFrame:
    """One record for each answered chunk, with its edges and drops; failed calls are records with an error."""
    edge = F.struct("source", "target", "polarity", F.lower(F.coalesce("raw_verb", F.lit(""))).alias("raw_verb"), "quote")
    drop = F.struct(F.col("raw").alias("edge"), "reason", "gate")
    by_doc = checked.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_parsed"), F.collect_list(F.when(F.col("gate").isNull(), edge)).alias("edges"), F.collect_list(F.when(F.col("gate").isNotNull(), drop)).alias("drops"))
    rows = answered.select("doc_id", "date", phase_of(F.col("date"), boundary).alias("phase"), "outlet", "text", "error", "raw_response").join(by_doc, "doc_id", "left")
    return rows.withColumn("n_parsed", F.coalesce("n_parsed", F.lit(0)))


def totals(recs: DataFrame) -> DataFrame:
    """One row (records, errors, parsed, edges, drops)."""
    return recs.agg(F.count("*").alias("records"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("n_parsed").alias("parsed"), F.sum(F.coalesce(F.size("edges"), F.lit(0))).alias("edges"), F.sum(F.coalesce(F.size("drops"), F.lit(0))).alias("drops"))


def with_article(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """edges with url and headline of the article that their doc_id names; empty where there is none."""
    a = articles.select("article_row", F.col("url").alias("_url"), F.col("headline").alias("_headline"))
    rows = edges.withColumn("article_row", F.split_part("doc_id", F.lit("_"), F.lit(1)).try_cast("long")).join(a, "article_row", "left")
    return rows.withColumn("url", F.coalesce("_url", F.lit(""))).withColumn("headline", F.coalesce("_headline", F.lit(""))).drop("_url", "_headline", "article_row")


__all__ = ["candidates", "chunked", "extract", "kept", "records", "totals", "with_article"]
