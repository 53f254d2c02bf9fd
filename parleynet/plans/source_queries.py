"""Queries on sources that are crawled or paged, on the transactional store, and on attempts with state.

Sites are recorded: Spark writes what they would answer, made from the given tables, to a
shared folder, and a source's fetch function reads it from there page by page.
"""

from __future__ import annotations

import json
import re
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Axis
from ..operators.chain import Chain
from ..sources import articles as A, rest, search, store
from ..streaming import attempts as AT, incremental as S
from . import fixtures as X
from .fixtures import shared_folder
from .text_queries import CHUNKS, HITS, docs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SITES, MOST = 10, 40
#: Short one-part links count as results, so that some page brings none that is new; the last site has one page only.
OUTLETS = [search.Outlet(f"site{k}.example", f"http://site{k}.example/search?q={{q}}", "page" if k < SITES - 1 else None, "nav", None, "^/[a-z]{1,3}$") for k in range(SITES)]


class SearchSite:
    """Recorded search pages by url."""

    def __init__(self, pages: X.Recorded):
        self.pages = pages

    def __call__(self, url: str) -> str | None:
        site = re.match(r"http://site(\d+)\.", url)[1]
        return self.pages.page(site, parse_qs(urlsplit(url).query).get("page", ["1"])[0])


NAVS = r"n AS (SELECT page_id, url, html, unnest(regexp_extract_all(html, '(?s)<nav>(.*?)</nav>', 1)) AS nav, unnest(range(len(regexp_extract_all(html, '(?s)<nav>(.*?)</nav>', 1)))) AS story FROM pages), h AS (SELECT page_id, url, story, unnest(regexp_extract_all(nav, 'href=\"([^\"]*)\"', 1)) AS href, unnest(range(len(regexp_extract_all(nav, 'href=\"([^\"]*)\"', 1)))) AS place FROM n)"


@query(f"""WITH {NAVS}, l AS (SELECT page_id % {SITES} AS site, page_id // {SITES} + 1 AS page, story, place, 'http://site' || (page_id % {SITES}) || '.example' || href AS url FROM h WHERE regexp_matches(href, '^/[a-z]{{1,3}}$')),
f AS (SELECT site, url, min(page * 1000000 + story * 1000 + place) AS k FROM l GROUP BY ALL),
s AS (SELECT site, min(page) AS stop FROM (SELECT page_id % {SITES} AS site, page_id // {SITES} + 1 AS page FROM pages) p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.site = p.site AND f.k // 1000000 = p.page) GROUP BY site),
r AS (SELECT f.site, url, k, row_number() OVER (PARTITION BY f.site ORDER BY k) AS i FROM f LEFT JOIN s ON f.site = s.site WHERE k // 1000000 < coalesce(stop, 1000000000) AND (f.site < {SITES - 1} OR k // 1000000 = 1))
SELECT 'site' || site || '.example' AS outlet, CAST(k // 1000000 AS INTEGER) AS page, CAST(k % 1000 AS INTEGER) AS place, url FROM r WHERE i <= {MOST}""")
def search_links(spark, d):
    """Links of ten outlets' search pages, crawled page by page."""
    pages = X.table(spark, d, "pages").select((F.col("page_id") % SITES).alias("site"), (F.floor(F.col("page_id") / SITES) + 1).alias("page"), F.col("html").alias("value"))
    site = SearchSite(X.Recorded.record(pages, shared_folder(spark), "site", "page"))
    source = search.search_source("recorded_search", site, OUTLETS, "talks", MOST)
    spark.dataSource.register(source)
    return spark.read.format("recorded_search").load()


@query(f"WITH {NAVS}, w AS (SELECT page_id, url, story, min(place) AS place, min(CASE WHEN regexp_full_match(href, '/[a-z][a-z0-9-]*') THEN place END) AS hinted FROM h GROUP BY ALL), x AS (SELECT regexp_extract(w.url, '^[a-z]+://[^/]+') || split_part(l.href, '#', 1) AS url, coalesce(substr(i.href, 2), '') AS hint, w.url AS page, w.story FROM w JOIN h l ON l.page_id = w.page_id AND l.story = w.story AND l.place = w.place LEFT JOIN h i ON i.page_id = w.page_id AND i.story = w.story AND i.place = w.hinted) SELECT url, arg_min(hint, page || '|' || story) AS hint, min(page) AS page FROM x GROUP BY url")
def story_hints(spark, d):
    """The first link of each story container of the pages, with the container's own section hint; each menu stands in for a story."""
    return search.story_links(X.table(spark, d, "pages"), "nav", marker="/")


PAGE_ROWS = 50
MONTHS = [(f"2024-{m:02d}", f"2024-{m:02d}-01", f"2024-{m:02d}-28") for m in range(1, 7)]
RESULTS = f"SELECT doc_id, '2024-' || lpad(CAST(doc_id % 6 + 1 AS STRING), 2, '0') AS month, CAST(floor(doc_id / {6 * PAGE_ROWS}) + 1 AS INT) AS page, '2024-' || lpad(CAST(doc_id % 6 + 1 AS STRING), 2, '0') || '-' || lpad(CAST(CAST(floor(doc_id / 6) AS INT) % 28 + 1 AS STRING), 2, '0') AS day, coalesce(source, '') AS section, CASE WHEN doc_id % 5 = 0 THEN 'liveblog' ELSE 'article' END AS type FROM {{documents}}"


class PagedSite:
    """A recorded API: pages of a month, of which a request's filters keep some results."""

    def __init__(self, pages: X.Recorded):
        self.pages = pages

    def __call__(self, parameters: dict) -> dict:
        month = parameters["from-date"][:7]
        found = [json.loads(x) for x in (self.pages.page(month, parameters["page"]) or "").splitlines()]
        kept = [r for r in found if parameters["from-date"] <= r["webPublicationDate"][:10] <= parameters["to-date"] and parameters.get("section") in (None, r["sectionId"]) and parameters.get("type") in (None, r["type"])]
        return {"pages": self.pages.count(month), "results": kept}

    def count(self, parameters: dict) -> int:
        return self.pages.count(parameters["from-date"][:7])


def paged_site(spark: SparkSession, d: str) -> PagedSite:
    rows = spark.sql(RESULTS, documents=docs(spark, d))
    result = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "type", F.col("section").alias("sectionId"), F.concat("day", F.lit("T00:00:00Z")).alias("webPublicationDate")))
    return PagedSite(X.Recorded.record(rows.select("month", "page", result.alias("value")), shared_folder(spark), "month", "page"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, month, page, CAST(day AS DATE) AS published FROM ({RESULTS.format(documents='documents')}) WHERE day BETWEEN '2024-02-10' AND '2024-04-20' AND type = 'article' AND section = 'src3'")
def pushed_articles(spark, d):
    """Articles of one section and some weeks from a paged source, the filters in its requests."""
    site = paged_site(spark, d)
    source = rest.rest_source("recorded_api", site, MONTHS, A.request_parameters)
    rows = rest.read_rest(spark, source, "published BETWEEN DATE '2024-02-10' AND DATE '2024-04-20' AND type = 'article' AND section = 'src3'")
    return rows.select(F.get_json_object("result", "$.id").alias("id"), "month", "page", "published")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, month, page FROM ({RESULTS.format(documents='documents')})")
def streamed_pages(spark, d):
    """All pages of a paged source, taken as a stream that is stopped after its first batch and goes on from its checkpoint."""
    site, folder = paged_site(spark, d), shared_folder(spark)
    here = site.count(A.request_parameters(*MONTHS[0][1:]))
    # Tasks don't grow with the pages: some sixteen for each month of a batch.
    source = rest.rest_source("recorded_stream", site, MONTHS, A.request_parameters, site.count, batch_pages=max(3, here * 2), task_pages=max(1, here // 16))
    spark.dataSource.register(source)
    first = spark.readStream.format(source.name()).load().writeStream.format("json").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    first.trigger(once=True).start().awaitTermination()
    rest.collect_pages(spark, source, f"{folder}/out", f"{folder}/state")
    rows = spark.read.schema(rest.SCHEMA).json(f"{folder}/out")
    return rows.select(F.get_json_object("result", "$.id").alias("id"), "month", "page")


@query("SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 3 END AS version FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT -1, 'files 2 progress 3', 3")
def committed_records(spark, d):
    """Records of three jobs on a store: the second replaces the first's, the third adds to it; a job that fails between them leaves nothing.

    A job's files, one a task, count as one in the row about the store.
    """
    path = f"{shared_folder(spark)}/store"
    rows = docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 3).alias("k"))
    store.write_store(rows.where("k < 2").select("doc_id", "text", F.lit(1).alias("version")), path, {"job": 1})
    store.write_store(rows.where("k = 2").select("doc_id", "text", F.lit(2).alias("version")), path, {"job": 2}, fresh=True)
    try:
        store.write_store(rows.where("k = 0").select("doc_id", F.assert_true(F.col("doc_id") < 0, F.lit("broken")).cast("string").alias("text"), F.lit(9).alias("version")), path, {"job": 9})
    except Exception as e:
        if "broken" not in str(e):
            raise
    store.write_store(rows.where("k = 1").select("doc_id", "text", F.lit(3).alias("version")), path, {"job": 3})
    store.vacuum(path)
    about = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(f"files {len(store.jobs(path))} progress {store.progress(path)['job']}").alias("text"), F.lit(3).alias("version"))
    return store.read_store(spark, path, "doc_id long, text string, version int").unionByName(about)


ATTEMPTS = "SELECT concat_ws('-', CAST(user_id AS STRING), CAST(floor(day(ts) / 4) AS STRING)) AS key, event_type = 'purchase' AS ok, CAST(ts AS TIMESTAMP) AS tried FROM {events}"
CUT = "2024-01-15"


@query(f"""WITH a AS ({ATTEMPTS.format(events='events').replace("CAST(floor(day(ts) / 4) AS STRING)", "CAST(day(ts) // 4 AS VARCHAR)")}),
r AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY key ORDER BY tried, ok) AS f, count(*) FILTER (ok) OVER (PARTITION BY key ORDER BY tried, ok) AS s FROM a),
e AS (SELECT key, tried, ok, f FROM r WHERE (ok AND s = 1 AND f < 4) OR (NOT ok AND s = 0 AND f = 4)),
d AS (SELECT key, CASE WHEN ok THEN 'done' ELSE 'given up' END AS status, CAST(f AS INTEGER) AS fails, tried FROM e),
late AS (SELECT max(tried) FILTER (tried < TIMESTAMP '{CUT}') - INTERVAL 1 HOUR AS w1, max(tried) - INTERVAL 1 HOUR AS w2 FROM a),
p AS (SELECT r.key, r.tried, r.f, r.tried < TIMESTAMP '{CUT}' AS early FROM r LEFT JOIN d ON r.key = d.key WHERE NOT ok AND (d.tried IS NULL OR r.tried < d.tried)),
l AS (SELECT key, max(tried) FILTER (early) AS t1, max(f) FILTER (early) AS f1, max(tried) FILTER (NOT early) AS t2, max(f) AS f2 FROM p GROUP BY key),
o AS (SELECT l.*, d.tried AS ended FROM l LEFT JOIN d ON l.key = d.key),
due AS (SELECT key, f1 AS f, t1 + INTERVAL 1 DAY AS tried FROM o, late WHERE t1 + INTERVAL 1 DAY <= w1 AND (ended IS NULL OR ended >= TIMESTAMP '{CUT}')
  UNION ALL SELECT key, f2, t2 + INTERVAL 1 DAY FROM o, late WHERE t2 + INTERVAL 1 DAY <= w2 AND ended IS NULL
  UNION ALL SELECT key, f1, t1 + INTERVAL 1 DAY FROM o, late WHERE t2 IS NULL AND ended IS NULL AND t1 + INTERVAL 1 DAY > w1 AND t1 + INTERVAL 1 DAY <= w2)
SELECT key, status, fails, strftime(tried, '%Y-%m-%d %H:%M:%S') AS tried FROM d UNION ALL SELECT key, 'due', CAST(f AS INTEGER), strftime(tried, '%Y-%m-%d %H:%M:%S') FROM due""")
def attempt_states(spark, d):
    """Attempts of keys made from events, in two runs of one stream: done at the first success, given up at the fourth failure, due a day after a failure."""
    folder = shared_folder(spark)
    rows = spark.sql(ATTEMPTS, events=X.table(spark, d, "events"))
    AT.use_rocks(spark)
    for part in (f"tried < '{CUT}'", f"tried >= '{CUT}'"):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        S.run_available(AT.attempt_changes(S.read_stream(spark, f"{folder}/in", rows.schema).withColumnRenamed("tried", "at")), f"{folder}/out", f"{folder}/state")
    out = spark.read.schema(AT.CHANGES).parquet(f"{folder}/out")
    return out.select("key", "status", "fails", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("tried"))


LISTED = "SELECT CAST(doc_id AS STRING) AS url, doc_id AS seq, '' AS timestamp, '2026-0' || CAST(doc_id % 6 + 1 AS STRING) || '-15' AS date, coalesce(lang, '') AS outlet, text AS body FROM {documents}"
#: (source, target, polarity) by the length of a chunk; the fourth has no known source.
SAID = (("The", "und", "positive"), ("And", "der", "negative"), ("von", "The", "positive"), ("nobody", "The", "positive"), ("in", "of", "neutral"))


def answers(prompts: list[str]) -> list[str]:
    """A provider that reads one interaction out of every chunk, by the chunk's length."""
    out = []
    for chunk in (p.split("\n", 1)[1] for p in prompts):
        source, target, polarity = SAID[len(chunk) % len(SAID)]
        out.append(json.dumps([{"source": source, "target": target, "polarity": polarity, "raw_verb": "Hosted", "modality": "asserted", "speaker": "actor", "quote_span": chunk[:30]}]))
    return out


def resumed(spark: SparkSession, d: str, folder: str) -> tuple[Chain, list[dict]]:
    """The chain over documents in three runs: a part of them, all, and all again."""
    words = X.WORDS
    axis = Axis(dict(words.blocs), focal=("The", "Of", "And"), dyad=("The", "And"), focus="The", boundary="2026-04-08")
    chain = Chain(spark, folder, axis, words, "Actors: {actors}\n{chunk}", answers)
    listings = spark.sql(LISTED, documents=docs(spark, d))
    return chain, [chain.run(part) for part in (listings.where("seq % 3 = 0"), listings, listings)]


@query(f"""WITH {CHUNKS}, m AS (SELECT doc_id, lang, {HITS} FROM documents), o AS (SELECT doc_id, coalesce(lang, '') AS outlet, CASE WHEN doc_id % 6 < 3 THEN 'pre' ELSE 'post' END AS phase FROM m WHERE (h0::INT + h1::INT + h2::INT) >= 2 AND (h0 OR h2)),
k AS (SELECT outlet, phase, length(chunk) % 5 AS k FROM (SELECT o.outlet, o.phase, unnest(cs) AS chunk FROM c JOIN o ON c.doc_id = o.doc_id)),
e AS (SELECT lower(outlet) AS outlet, phase, CASE k WHEN 0 THEN 'The' WHEN 1 THEN 'And' WHEN 2 THEN 'Of' ELSE 'In' END AS source, CASE k WHEN 0 THEN 'And' WHEN 4 THEN 'Of' ELSE 'The' END AS target, k IN (0, 2) AS pos FROM k WHERE k <> 3),
a AS (SELECT outlet, phase, source, target, count(*) AS n FROM e GROUP BY ALL)
SELECT e.outlet, e.phase, count(*) FILTER (pos) AS pos_edges, (SELECT count(*) FROM a WHERE a.outlet = e.outlet AND a.phase = e.phase) AS n_arcs, CAST(nullif(count(*) FILTER (source = 'The' OR target = 'The'), 0) AS DOUBLE) / (2 * count(*)) AS share,
  (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) || ' ' || (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) || ' 0 0 false' AS runs FROM e GROUP BY ALL""")
def chained_results(spark, d):
    """From documents to results in a chain of stores, run on a part, on all and once more for nothing: the results, and what the runs did."""
    chain, runs = resumed(spark, d, f"{shared_folder(spark)}/chain")
    did = f"{runs[0]['collected']} {runs[1]['collected']} {runs[2]['collected']} {runs[2]['extracted']} {str(runs[2]['analysed']).lower()}"
    return chain.results().select("outlet", "phase", "pos_edges", "n_arcs", "share", F.lit(did).alias("runs"))
