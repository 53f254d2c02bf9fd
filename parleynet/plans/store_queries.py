"""Queries on stores, links, payloads, records and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Axis
from ..functions import text as FT
from ..operators import extraction as E, gates, validation as V
from ..sources import articles as A, pages as P
from . import fixtures as X
from .text_queries import CHUNKS, GATED, HITS, _gated, docs, shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT CAST(doc_id AS VARCHAR) AS url, coalesce(source, '') AS outlet, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS body_md5 FROM documents")
def stored_articles(spark, d):
    """Articles written to two CSV stores and read back together."""
    folder = shared_folder(spark)
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("url"), F.col("source").alias("outlet"), F.col("text").alias("body"))
    for k in (0, 1):
        A.write_articles_csv(rows.where(F.col("url").cast("long") % 2 == k), f"{folder}/{k}")
    back = A.read_articles_csv(spark, f"{folder}/0", f"{folder}/1")
    body = F.coalesce("body", F.lit(""))
    return back.select("url", F.coalesce("outlet", F.lit("")).alias("outlet"), F.length(body).cast("long").alias("n_chars"), F.md5(body.cast("binary")).alias("body_md5"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 3 = 1 AS listed FROM documents WHERE doc_id % 3 <> 0")
def resumed_chunks(spark, d):
    """Chunks still to extract: a store holds a third of them, and another third as errors that are tried again."""
    path = f"{shared_folder(spark)}/records"
    chunks = docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "text", (F.col("doc_id") % 3).alias("k"))
    A.append_jsonl(chunks.select(F.lit("old").alias("doc_id")), path)
    A.append_jsonl(chunks.where("k = 0").select("doc_id", "text"), path, fresh=True)
    A.append_jsonl(chunks.where("k = 1").select("doc_id", "text", F.lit("timeout").alias("error")), path)
    left = gates.not_yet_done(chunks, A.read_jsonl(spark, path), retry_errors=True)
    listed = A.read_done_ids(spark, path).withColumn("listed", F.lit(True))
    return left.join(listed, "doc_id", "left").select("doc_id", F.coalesce("listed", F.lit(False)).alias("listed"))


LISTINGS = "SELECT CAST(o_custkey % 500 AS STRING) AS url, o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'soon' WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T10:00:00+05:00' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T08:30:00Z' END AS timestamp FROM {orders}"
#: DuckDB reads a timestamp without applying its offset.
UTC = "(TRY_CAST(replace(timestamp, '+05:00', '') AS TIMESTAMP) - CASE WHEN contains(timestamp, '+05:00') THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END)"
LAST = f"WITH l AS ({LISTINGS.format(orders='orders')}), m AS (SELECT url, max(seq) AS seq, max_by(timestamp, seq) AS timestamp, min(seq) AS first_seq FROM l GROUP BY url)"


def _merged(spark: SparkSession, d: str, raw: bool) -> DataFrame:
    """Two stores merged, numbered in the very order that merged() gives its rows."""
    rows = spark.sql(LISTINGS, orders=X.table(spark, d, "orders"))
    stores = [rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1").withColumn("extra", F.lit(1))]
    ordered = A.merged(stores, raw_order=raw).select("url", "seq", F.monotonically_increasing_id().alias("line"))
    return A.with_article_row(ordered, ("line",)).select("url", "seq", "article_row")


@query(f"{LAST} SELECT url, seq, row_number() OVER (ORDER BY coalesce({UTC}, TIMESTAMP '9999-01-01'), first_seq) - 1 AS article_row FROM m")
def merged_by_time(spark, d):
    """Stores merged, the last listing of a url kept, by UTC time with unreadable ones last; equal times by the first listing."""
    return _merged(spark, d, False)


@query(f"{LAST} SELECT url, seq, row_number() OVER (ORDER BY coalesce(nullif(timestamp, ''), '9999'), first_seq) - 1 AS article_row FROM m")
def merged_by_text(spark, d):
    """The same by the timestamp's text with blank ones last."""
    return _merged(spark, d, True)


@query(f"WITH l AS ({LISTINGS.format(orders='orders')}) SELECT seq, CAST({UTC} AS VARCHAR) AS utc, substr(timestamp, 1, 10) AS day FROM l")
def utc_times(spark, d):
    rows = spark.sql(LISTINGS, orders=X.table(spark, d, "orders"))
    return rows.select("seq", F.date_format(FT.utc_timestamp(F.col("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("utc"), FT.day(F.col("timestamp")).alias("day"))


ANSWERS = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '[{"source":"A","target":"B"},{"source":"C"}]' WHEN 1 THEN '```json
[{"source":"A' || CAST(doc_id AS STRING) || '","target":"B"}, 7]
```' WHEN 2 THEN '{"note":"x","interactions":[{"source":"D","target":"E","polarity":"positive"}]}' WHEN 3 THEN '{"source":"F","target":"G"}' WHEN 4 THEN '{"other":1}' WHEN 5 THEN 'no json at all' WHEN 6 THEN '' WHEN 7 THEN '[]' ELSE NULL END AS raw FROM {documents}"""
FENCES = "trim(regexp_replace(trim(coalesce(raw, ''), ' ' || chr(10)), '(?m)^```(?:json)?|```$', '', 'g'), ' ' || chr(10))"


@query(
    f"""WITH a AS ({ANSWERS.replace('{documents}', 'documents')}), t AS (SELECT doc_id, {FENCES} AS t FROM a), j AS (SELECT doc_id, CASE WHEN json_valid(t) AND t <> '' THEN CAST(t AS JSON) END AS j FROM t),
    l AS (SELECT doc_id, j, CASE json_type(j) WHEN 'ARRAY' THEN from_json(j, '["JSON"]') WHEN 'OBJECT' THEN
      CASE WHEN len(list_filter(json_keys(j), lambda k: json_type(j, '$."' || k || '"') = 'ARRAY')) > 0 THEN from_json(json_extract(j, '$."' || list_filter(json_keys(j), lambda k: json_type(j, '$."' || k || '"') = 'ARRAY')[1] || '"'), '["JSON"]')
           WHEN list_contains(json_keys(j), 'source') AND list_contains(json_keys(j), 'target') THEN [j] ELSE [] END ELSE [] END AS xs FROM j)
    SELECT doc_id, CAST(len(xs) AS BIGINT) AS n, CAST(len(list_filter(xs, lambda x: json_type(x) = 'OBJECT')) AS BIGINT) AS objects, array_to_string(list_transform(xs, lambda x: coalesce(x ->> '$.source', '?')), ',') AS sources FROM l"""
)
def parsed_payloads(spark, d):
    """Candidates of answers in and out of code fences: lists, objects with a list, bare objects, bad JSON."""
    a = spark.sql(_answers(), documents=docs(spark, d))
    c = FT.parse_candidates(F.col("raw"))
    return a.select("doc_id", F.size(c).cast("long").alias("n"), F.size(F.filter(c, lambda x: x.is_object)).cast("long").alias("objects"), F.concat_ws(",", F.transform(c, lambda x: F.coalesce(x.source, F.lit("?")))).alias("sources"))


def _answers() -> str:
    """ANSWERS with its braces doubled for the session's formatter, but for the table."""
    return ANSWERS.replace("{", "{{").replace("}", "}}").replace("{{documents}}", "{documents}")


TURNS = "SELECT CAST(conv_id % 400 AS STRING) || '_' || CAST(turn AS STRING) AS doc_id, CAST(conv_id AS STRING) AS source, role AS target FROM {conversations}"


@query(f"WITH e AS ({TURNS.format(conversations='conversations')}) SELECT e.source, e.target, e.doc_id, coalesce(p.url, '') AS url, coalesce(CASE WHEN p.page_id IS NOT NULL THEN 'Page ' || CAST(p.page_id AS VARCHAR) END, '') AS headline FROM e LEFT JOIN pages p ON p.page_id = CAST(split_part(e.doc_id, '_', 1) AS BIGINT)")
def edges_with_article(spark, d):
    edges = spark.sql(TURNS, conversations=X.table(spark, d, "conversations"))
    pages = X.table(spark, d, "pages").select(F.col("page_id").alias("article_row"), "url", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("headline"))
    return E.with_article(edges, pages).select("source", "target", "doc_id", "url", "headline")


DATED = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date FROM {orders}"


@query(f"SELECT id, CASE WHEN date IS NULL THEN NULL WHEN date < '{X.BOUNDARY}' THEN 'pre' ELSE 'post' END AS phase FROM ({DATED.format(orders='orders')})")
def order_phases(spark, d):
    return spark.sql(DATED, orders=X.table(spark, d, "orders")).select("id", gates.phase_of(F.col("date"), X.BOUNDARY).alias("phase"))


JUDGED = "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'Q' ELSE 'R' END AS source, CASE doc_id % 3 WHEN 0 THEN 'P' ELSE 'S' END AS target, CASE doc_id % 5 WHEN 0 THEN 'negative' ELSE ' Positive' END AS polarity, CASE doc_id % 7 WHEN 0 THEN 'mediation' WHEN 1 THEN 'Goodwill' WHEN 2 THEN 'maybe' WHEN 3 THEN NULL ELSE 'not' END AS mediation FROM {labels}"


@query(f"WITH j AS ({JUDGED.format(labels='labels')}), m AS (SELECT CASE WHEN lower(mediation) IN ('mediation', 'goodwill', 'not') THEN lower(mediation) END AS h FROM j WHERE (source IN ('P', 'Q') OR target IN ('P', 'Q')) AND lower(trim(polarity)) = 'positive') SELECT count(*) AS n, avg(CAST(h = 'mediation' AS INT)) AS share, count(*) FILTER (h = 'mediation') AS mediation, count(*) FILTER (h = 'goodwill') AS goodwill, count(*) FILTER (h = 'not') AS \"not\" FROM m WHERE h IS NOT NULL")
def mediation_share(spark, d):
    j = spark.sql(JUDGED, labels=X.table(spark, d, "labels"))
    blank = [F.lit("y").alias(c) for c in ("actors_ok", "direction_ok", "real_event")]
    key = j.select("id", "source", "target", F.lit("positive").alias("llm_polarity"))
    return V.mediation_share(V.labelled(key, j.select("id", "polarity", "mediation", *blank)), ("P", "Q"))


SECOND = "SELECT doc_id AS id, CASE quality WHEN 1 THEN 'y' ELSE 'n' END AS actors_ok, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'yes' END AS direction_ok, CASE toxic WHEN 1 THEN 'negative' ELSE 'positive' END AS polarity, CASE doc_id % 2 WHEN 0 THEN 'mediation' ELSE 'not' END AS mediation FROM {labels} WHERE doc_id % {m} <> 0"


def _kappa_sql(field: str, a: str, b: str) -> str:
    both = f"(SELECT {a} AS x, {b} AS y FROM a JOIN b ON a.id = b.id WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"""SELECT '{field}' AS field, t.n, CASE WHEN c.both = t.n * t.n THEN 1.0 ELSE ((t.same / t.n::DOUBLE) - (c.both / (t.n::DOUBLE * t.n))) / (1 - (c.both / (t.n::DOUBLE * t.n))) END AS kappa
    FROM (SELECT count(*) AS n, count(*) FILTER (x = y) AS same FROM {both}) t, (SELECT sum(p.n * q.n)::BIGINT AS both FROM (SELECT x, count(*) AS n FROM {both} GROUP BY x) p JOIN (SELECT y, count(*) AS n FROM {both} GROUP BY y) q ON p.x = q.y) c"""


_YES = "CASE WHEN lower(trim({0})) IN ('y', 'yes', 'true', '1') THEN true WHEN lower(trim({0})) IN ('n', 'no', 'false', '0') THEN false END"


@query(
    f"WITH a AS ({SECOND.format(labels='labels', m=7)}), b AS ({SECOND.format(labels='labels', m=5).replace('quality', 'toxic')}) "
    + " UNION ALL ".join([_kappa_sql("actors_ok", _YES.format("a.actors_ok"), _YES.format("b.actors_ok")), _kappa_sql("direction_ok", _YES.format("a.direction_ok"), _YES.format("b.direction_ok")), _kappa_sql("polarity", "a.polarity", "b.polarity"), _kappa_sql("mediation", "a.mediation", "b.mediation")])
)
def annotator_agreement(spark, d):
    """Two annotators' sheets met on their ids: kappa of each of four fields over rows that both filled."""
    labels = X.table(spark, d, "labels")
    one = spark.sql(SECOND.replace("{m}", "7"), labels=labels)
    two = spark.sql(SECOND.replace("{m}", "5").replace("quality", "toxic"), labels=labels)
    return V.agreement(one, two)


@query(f"WITH m AS (SELECT doc_id, text, {HITS} FROM documents), {CHUNKS.replace('FROM documents', 'FROM m WHERE (h0::INT + h1::INT + h2::INT) >= 2 AND (h0 OR h2)')} SELECT doc_id AS article_row, CAST(count(*) AS BIGINT) AS chunks FROM (SELECT doc_id, unnest(cs) FROM c) GROUP BY doc_id")
def axis_chunks(spark, d):
    """Chunk counts of the documents on the axis, all of them."""
    axis = Axis({a: "" for a in X.WORDS.actors}, focal=("The", "Of", "And"), dyad=("The", "And"))
    rows = docs(spark, d).select(F.col("doc_id").alias("article_row"), F.lit("o").alias("outlet"), F.lit("2020-01-01").alias("date"), F.col("text").alias("body"))
    return E.chunked(rows, axis, X.WORDS).groupBy("article_row").agg(F.count("*").alias("chunks"))


LINKS = "SELECT CAST(c_custkey AS STRING) AS url, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'world' WHEN 2 THEN 'sport' ELSE NULL END AS hint, c_custkey % 11 AS fails FROM {customer}"


@query(f"SELECT url, coalesce(hint, '') AS hint FROM ({LINKS.format(customer='customer')}) WHERE (coalesce(hint, '') = '' OR hint = 'world') AND fails < 4 AND url NOT IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_totalprice > 200000)")
def links_to_fetch(spark, d):
    links = spark.sql(LINKS, customer=X.table(spark, d, "customer"))
    scraped = X.table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").cast("string").alias("url"))
    rows = A.to_fetch(links.select("url", "hint"), scraped, ["world"], links.select("url", "fails"))
    return rows.select("url", F.coalesce("hint", F.lit("")).alias("hint"))


@query("SELECT coalesce(lang, '') AS section, '2020-01-0' || CAST(doc_id % 9 + 1 AS VARCHAR) AS date, CAST(doc_id AS VARCHAR) AS url, coalesce(source, '') AS author, CASE WHEN doc_id % 2 = 0 THEN 'H' || CAST(doc_id AS VARCHAR) ELSE 'W' END AS headline, md5(text) AS body_md5 FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND length(coalesce(text, '')) >= 1")
def api_articles(spark, d):
    i = F.col("doc_id")
    fields = F.struct(F.col("text").alias("bodyText"), F.when(i % 2 == 0, F.concat(F.lit("H"), i.cast("string"))).alias("headline"), F.col("source").alias("byline"))
    results = docs(spark, d).select(
        F.when(i % 5 == 0, "video").otherwise("article").alias("type"), F.when(i % 3 == 0, "pillar/sport").otherwise("pillar/news").alias("pillarId"), F.col("lang").alias("sectionId"),
        F.concat(F.lit("2020-01-0"), (i % 9 + 1).cast("string"), F.lit("T00:00:00Z")).alias("webPublicationDate"), i.cast("string").alias("webUrl"), F.lit("W").alias("webTitle"), fields.alias("fields"),
    )
    return A.api_rows(results, "pillar/news").select("section", "date", "url", "author", "headline", F.md5(F.col("body").cast("binary")).alias("body_md5"))


MAP = "SELECT o_orderkey AS k, '<urlset><url><loc> http://h/' || CASE o_orderkey % 3 WHEN 0 THEN 'video/' ELSE 'story/' END || CAST(o_orderkey AS STRING) || ' </loc><lastmod>' || CASE o_orderkey % 4 WHEN 0 THEN 'lately' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T01:00:00Z' END || '</lastmod></url></urlset>' AS xml FROM {orders}"


@query("SELECT 'http://h/story/' || CAST(o_orderkey AS VARCHAR) AS url, CAST(o_orderdate AS DATE) AS lastmod FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def sitemap_links(spark, d):
    return P.sitemap_links(spark.sql(MAP, orders=X.table(spark, d, "orders")), "/story/", "1996-01-01", "1997-06-30")


@query(f"{GATED} SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS records, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 10 = 9) AS errors, count(*) AS parsed, count(*) FILTER (gate IS NULL) AS edges, count(*) FILTER (gate IS NOT NULL) AS drops FROM g WHERE doc_id IS NOT NULL")
def record_totals(spark, d):
    """Totals over one record a conversation, with its edges and drops."""
    error = F.when(F.col("conv_id") % 10 == 9, "timeout")
    answered = X.table(spark, d, "conversations").where("conv_id IS NOT NULL").select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("doc_id"), F.lit("2020-01-01").alias("date"), F.lit("o").alias("outlet"), F.lit("").alias("text"), error.alias("error"), F.lit("[]").alias("raw_response"))
    return E.totals(E.records(answered, _gated(spark, d), "2021-01-01"))


@query("SELECT doc_id, md5('Actors: The, Of. Text: ' || coalesce(text, '') || ' Answer:') AS prompt_md5 FROM documents")
def prompts(spark, d):
    prompt = FT.build_prompt("Actors: {actors}. Text: {chunk} Answer:", F.lit("The, Of"), F.coalesce("text", F.lit("")))
    return docs(spark, d).select("doc_id", F.md5(prompt.cast("binary")).alias("prompt_md5"))


@query("SELECT page_id, least(CAST(page_id AS VARCHAR), url) || '|' || greatest(CAST(page_id AS VARCHAR), url) AS dyad, replace(url, '_', ' ') AS label, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')) AS escaped_md5 FROM pages")
def display_labels(spark, d):
    u = F.col("url")
    return X.table(spark, d, "pages").select("page_id", FT.dyad_key(F.col("page_id").cast("string"), u).alias("dyad"), FT.pretty(u).alias("label"), F.md5(FT.escaped(F.col("html")).cast("binary")).alias("escaped_md5"))
