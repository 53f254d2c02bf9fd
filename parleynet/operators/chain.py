"""One resumable chain from articles to results: collect, extract, analyse, each stage's rows committed as a whole.

A stage takes what the stage before has committed and it has not yet seen, so a run that
broke off goes on where it was, and a run without anything new does no work: no provider is
asked again and no store gets a new version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..config import Axis
from ..sources import articles as A, store
from . import extraction as E, gates, measures as M, network as N
from .vocabulary import Vocabulary

ARTICLES, RECORDS, RESULTS = "articles", "records", "results"
ARTICLE = f"article_row long, {schemas.ARTICLE}"
RESULT = "outlet string, phase string, pos_edges long, n_arcs long, flow double, rank int, liaison double, share double"


class Chain:
    """Stores under one folder, and what the analysis is about."""

    def __init__(self, spark: SparkSession, folder: str, axis: Axis, vocabulary: Vocabulary, template: str, provider: Callable[[list[str]], list[str]]):
        self.spark, self.folder, self.axis, self.vocabulary = spark, folder, axis, vocabulary
        self.template, self.provider = template, provider

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def articles(self) -> DataFrame:
        return store.read_store(self.spark, self.path(ARTICLES), ARTICLE)

    def records(self) -> DataFrame:
        return store.read_store(self.spark, self.path(RECORDS), schemas.RECORD)

    def results(self) -> DataFrame:
        return store.read_store(self.spark, self.path(RESULTS), RESULT)

    def collect(self, listings: DataFrame) -> int:
        """Adds the listings(url, seq, …) of urls that the store doesn't hold, the last listing of each, and gives how many.

        Rows are numbered on from the store's, by time of publication, then url.
        """
        new = A.last_wins(listings.where("url IS NOT NULL"), "url", "seq").join(self.articles().select("url"), "url", "left_anti")
        if not new.limit(1).count():
            return 0
        held = store.manifest(self.path(ARTICLES))["rows"]
        late = F.lit("9999").alias("_")
        new = new.withColumn("_time", F.coalesce(F.nullif("timestamp", F.lit("")), late) if "timestamp" in new.columns else late)
        numbered = A.with_article_row(new, ("_time", "url")).withColumn("article_row", F.col("article_row") + held)
        rows = numbered.select("article_row", *((F.col(c).cast("string") if c in numbered.columns else F.lit("")).alias(c) for c in schemas.ARTICLE_COLUMNS))
        store.write_store(rows, self.path(ARTICLES))
        return store.manifest(self.path(ARTICLES))["rows"] - held

    def extract(self, retry_errors: bool = False) -> int:
        """Asks the provider for the chunks without a record, and adds their records with edges and drops; gives how many.

        Answers are written before they are read twice, so a chunk is asked for once. With
        retry_errors, chunks whose last record is an error are asked for again.
        """
        chunks = E.chunked(self.articles(), self.axis, self.vocabulary)
        left = gates.not_yet_done(chunks, self.records(), retry_errors)
        if not left.limit(1).count():
            return 0
        held = store.manifest(self.path(RECORDS))["rows"]
        asked = left.withColumn("prompt", E.build_prompt(self.template, F.lit(self.vocabulary.prompt_list()), F.col("text")))
        draft = self.path(f"answers-{held}")
        gates.call_provider(asked, self.provider).write.mode("overwrite").parquet(draft)
        answered = self.spark.read.parquet(draft)
        checked = gates.gated(E.candidates(answered, self.axis.boundary), self.vocabulary)
        store.write_store(E.records(answered, checked, self.axis.boundary), self.path(RECORDS))
        return store.manifest(self.path(RECORDS))["rows"] - held

    def edges(self) -> DataFrame:
        """Validated edges of all records; of a chunk that was asked for twice, those of the record without an error."""
        rows = self.records().where("error IS NULL").select("doc_id", "phase", "outlet", F.explode("edges").alias("e"))
        return rows.select("e.source", "e.target", "e.polarity", gates.valence_of(F.col("e.polarity")).alias("valence"), "e.raw_verb", "e.quote", "doc_id", "phase", "outlet")

    def analyse(self) -> bool:
        """Works the results out anew if records have come since; whether they have."""
        version = store.manifest(self.path(RECORDS))["version"]
        if not version or store.progress(self.path(RESULTS)).get("records") == version:
            return False
        edges, actors, a = self.edges(), self.vocabulary.actor_rows(self.spark), self.axis
        # Arcs are few; all measures come from them.
        signed = N.signed_network(edges)
        view = N.project(signed, "coop")
        key = list(N.KEYS)
        flow = N.ranked(M.flow_brokerage(view, a.order), "score", actors).where(F.col("actor") == a.focus).select(*key, F.col("score").alias("flow"), "rank")
        out = N.positive_counts(edges).join(signed.groupBy(*key).agg(F.count("*").alias("n_arcs")), key, "left").join(flow, key, "left")
        out = out.join(N.liaison(view, actors).where(F.col("broker") == a.focus).select(*key, "liaison"), key, "left")
        out = out.join(N.influence_share(signed).where(F.col("actor") == a.focus).select(*key, "share"), key, "left")
        store.write_store(out.select(*(c.split()[0] for c in RESULT.split(", "))), self.path(RESULTS), {"records": version}, fresh=True)
        return True

    def run(self, listings: DataFrame, retry_errors: bool = False) -> dict:
        """All stages; what each has done."""
        return {"collected": self.collect(listings), "extracted": self.extract(retry_errors), "analysed": self.analyse()}
