"""Queries on texts, articles, pages, labels and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as FT
from ..operators import gates, recon, tagger as TG, validation as V, vocabulary as VO
from ..sources import articles as A, pages as P
from ..streaming import incremental as S
from . import fixtures as X
from .fixtures import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents")


def _has(actor: str) -> str:
    forms = sorted({actor.lower(), *X.WORDS.aliases[actor]})
    return f"regexp_matches(lower(text), '(^|[^a-z0-9])({'|'.join(forms)})([^a-z0-9]|$)')"


HITS = ", ".join(f"{_has(a)} AS h{i}" for i, a in enumerate(X.WORDS.actors))


@query(f"WITH m AS (SELECT doc_id, {HITS} FROM documents) SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN h{i} THEN '{a}' END" for i, a in enumerate(X.WORDS.actors)) + ") AS actors, (h0::INT + h1::INT + h2::INT) >= 2 AND (h0 OR h2) AS on_axis FROM m")
def mentions(spark, d):
    m = docs(spark, d).select("doc_id", VO.mentioned(F.col("text"), X.WORDS).alias("m"))
    return m.select("doc_id", F.concat_ws(",", "m").alias("actors"), VO.on_axis(F.col("m"), ("The", "Of", "And"), ("The", "And")).alias("on_axis"))


@query("WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS ws FROM documents), f AS (SELECT doc_id, unnest(ws) AS mention FROM w), n AS (SELECT mention, count(*) AS n, trim(regexp_replace(lower(mention), '[^a-z0-9 ]', '', 'g')) AS form FROM f GROUP BY mention) SELECT mention, n, CASE form WHEN 'a' THEN NULL WHEN 'the' THEN 'The' WHEN 'der' THEN 'The' WHEN 'la' THEN 'The' WHEN 'of' THEN 'Of' WHEN 'von' THEN 'Of' WHEN 'and' THEN 'And' WHEN 'und' THEN 'And' WHEN 'et' THEN 'And' WHEN 'to' THEN 'To' WHEN 'zu' THEN 'To' WHEN 'in' THEN 'In' END AS actor FROM n")
def resolve_mentions(spark, d):
    """Of all words; each distinct mention is counted first and resolved once."""
    words = docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0))).alias("mention"))
    return VO.resolve(words.groupBy("mention").agg(F.count("*").alias("n")), "mention", X.WORDS)


@query("SELECT doc_id, length(normal) AS n_chars, md5(normal) AS normal_md5 FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS normal FROM documents)")
def normal_forms(spark, d):
    """Of the whole text; as length and digest, the form itself being as wide as the text."""
    n = docs(spark, d).select("doc_id", FT.norm(F.col("text")).alias("normal"))
    return n.select("doc_id", F.length("normal").alias("n_chars"), F.md5(F.col("normal").cast("binary")).alias("normal_md5"))


#: Chunks c(doc_id, cs): sentence ends before two white-space characters or more are made a mark, then empty lines; pieces lie between marks.
CHUNKS = r"""t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS w FROM documents),
s AS (SELECT doc_id, w, list_filter(list_transform(string_split(regexp_replace(regexp_replace(w, '([.?!])\s{2,}', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: length(p) >= 40) AS ps FROM t),
c AS (SELECT doc_id, CASE WHEN length(w) = 0 THEN [] WHEN len(ps) > 0 THEN ps ELSE [w] END AS cs FROM s)"""


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_no, md5(cs[i]) AS chunk_md5 FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM c)")
def chunks(spark, d):
    c = docs(spark, d).select("doc_id", F.posexplode(FT.chunk_paragraphs(F.col("text"))).alias("chunk_no", "chunk"))
    return c.select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("SELECT page_id, CASE WHEN length(regexp_replace(url, '[^0-9]', '', 'g')) = 0 THEN '' ELSE right(regexp_replace(url, '[^0-9]', '', 'g'), 7) END AS article_id, split_part(url, '#', 1) AS plain_url, CASE WHEN contains(url, '.com') THEN '.com' WHEN contains(url, '.net') THEN '.net' ELSE '' END AS outlet, CASE WHEN page_id % 4 = 0 THEN 'wire' WHEN contains(url, 'editorial') THEN 'editorial/opinion' ELSE 'news' END AS genre FROM pages")
def url_fields(spark, d):
    u = F.col("url")
    return X.table(spark, d, "pages").select("page_id", FT.article_id(u).alias("article_id"), FT.without_fragment(u).alias("plain_url"), FT.outlet_of(u, [".com", ".net"]).alias("outlet"), FT.guess_genre(u, F.when(F.col("page_id") % 4 == 0, "Staff and AFP").otherwise("A writer")).alias("genre"))


@query("SELECT page_id, trim(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) AS headline FROM pages")
def page_headlines(spark, d):
    return X.table(spark, d, "pages").select("page_id", P.headline_of(F.col("html")).alias("headline"))


@query()
def page_articles(spark, d):
    return P.scraped(X.table(spark, d, "pages"), "site")


CANDIDATES = """
SELECT CAST(conv_id AS STRING) AS doc_id, text, CASE turn % 5 WHEN 0 THEN 'The' WHEN 1 THEN 'der' WHEN 2 THEN 'nobody' WHEN 3 THEN 'a' ELSE 'von' END AS source,
       CASE conv_id % 4 WHEN 0 THEN 'und' WHEN 1 THEN 'la' WHEN 2 THEN 'in' ELSE '???' END AS target,
       CASE conv_id % 7 WHEN 0 THEN 'negative' WHEN 1 THEN 'mixed' ELSE 'positive' END AS polarity, 'Hosted' AS raw_verb, CASE turn % 6 WHEN 5 THEN 'analyst' ELSE role END AS speaker,
       CASE conv_id % 11 WHEN 3 THEN 'future' WHEN 4 THEN NULL ELSE 'asserted' END AS modality, CASE conv_id % 13 WHEN 5 THEN ' ' WHEN 6 THEN 'not in there at all' ELSE substr(text, 3, 20) END AS quote_span, conv_id % 17 <> 3 AS is_object, text AS raw
FROM {conversations}
"""
RESOLVE = "CASE lower({0}) WHEN 'the' THEN 'The' WHEN 'der' THEN 'The' WHEN 'la' THEN 'The' WHEN 'of' THEN 'Of' WHEN 'von' THEN 'Of' WHEN 'and' THEN 'And' WHEN 'und' THEN 'And' WHEN 'to' THEN 'To' WHEN 'in' THEN 'In' END"
CANON = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
GATED = f"WITH c AS ({CANDIDATES.format(conversations='conversations')}), r AS (SELECT *, {RESOLVE.format('source')} AS s, {RESOLVE.format('target')} AS t FROM c), g AS (SELECT *, CASE WHEN NOT is_object THEN 'G0' WHEN s IS NULL THEN 'G1' WHEN t IS NULL THEN 'G2' WHEN s = t THEN 'G3' WHEN polarity NOT IN ('positive', 'negative', 'neutral') THEN 'G4' WHEN modality IN ('negated', 'hypothetical', 'future') THEN 'G5' WHEN trim(quote_span) = '' THEN 'G6' WHEN NOT contains({CANON.format('text')}, {CANON.format('quote_span')}) THEN 'G7' WHEN speaker IN ('analyst', 'journalist', 'unknown') THEN 'G8' END AS gate FROM r)"


def _gated(spark: SparkSession, d: str) -> DataFrame:
    return gates.gated(spark.sql(CANDIDATES, conversations=X.table(spark, d, "conversations")), X.WORDS)


@query(f"{GATED} SELECT gate, count(*) AS n FROM g GROUP BY gate")
def gate_counts(spark, d):
    return _gated(spark, d).groupBy("gate").agg(F.count("*").alias("n"))


@query(f"{GATED} SELECT s AS source, t AS target, polarity, CASE polarity WHEN 'positive' THEN 'coop' ELSE 'conflict' END AS valence, 'hosted' AS raw_verb, count(*) AS n FROM g WHERE gate IS NULL GROUP BY ALL")
def kept_edges(spark, d):
    e = gates.kept(_gated(spark, d).withColumns({"phase": F.lit("pre"), "outlet": F.lit("o")}))
    return e.groupBy("source", "target", "polarity", "valence", "raw_verb").agg(F.count("*").alias("n"))


@query(f"{GATED}, l AS (SELECT CASE gate WHEN 'G0' THEN 'not an object' WHEN 'G1' THEN 'unresolved source' WHEN 'G2' THEN 'unresolved target' WHEN 'G3' THEN 'self-loop' WHEN 'G4' THEN 'bad polarity' WHEN 'G5' THEN 'non-event modality' WHEN 'G6' THEN 'empty quote_span' WHEN 'G7' THEN 'quote_span not in text' WHEN 'G8' THEN 'commentary speaker' END AS label FROM g WHERE gate IS NOT NULL) SELECT label, count(*) AS n FROM l GROUP BY label")
def drop_tally(spark, d):
    return gates.tally(gates.dropped(_gated(spark, d)))


@query("WITH o AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderdate AS at, o_totalprice AS price FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS l, row_number() OVER (PARTITION BY k ORDER BY seq) AS f FROM o) SELECT a.k, a.seq AS last_seq, a.price AS last_price, b.seq AS first_seq FROM r a JOIN r b ON a.k = b.k AND a.l = 1 AND b.f = 1")
def dedupe_by_key(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
    last, first = A.last_wins(o, "k", "seq"), A.first_wins(o, "k", "seq")
    return last.select("k", F.col("seq").alias("last_seq"), F.col("price").alias("last_price")).join(first.select("k", F.col("seq").alias("first_seq")), "k")


def _order_dates(spark: SparkSession, d: str) -> tuple[str, str]:
    r = X.table(spark, d, "orders").agg(F.min("o_orderdate").cast("date").cast("string").alias("first"), F.max("o_orderdate").cast("date").cast("string").alias("last")).first()
    return r.first, r.last


ORDER_DATES = "b AS (SELECT CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last FROM orders)"


@query(f"WITH {ORDER_DATES}, m AS (SELECT first, last, CAST(unnest(generate_series(date_trunc('month', first), last, INTERVAL 1 MONTH)) AS DATE) AS m FROM b) SELECT CAST(greatest(m, first) AS DATE) AS month_start, CAST(least(last_day(m), last) AS DATE) AS month_end FROM m")
def month_windows(spark, d):
    """The months of the orders' dates, the first and last cut to them."""
    return A.month_windows(spark, *_order_dates(spark, d))


@query(f"WITH {ORDER_DATES} SELECT CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS day FROM b")
def day_range(spark, d):
    """Every day of the orders' dates."""
    return A.days(spark, *_order_dates(spark, d))


@query("SELECT c_custkey AS url FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def unseen_links(spark, d):
    links = X.table(spark, d, "customer").select(F.col("c_custkey").alias("url"))
    return A.new_links(links, X.table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("url")))


@query("SELECT count(*) AS n, (po - pe) / (1 - pe) AS kappa FROM (SELECT CAST(sum(same) AS DOUBLE) / count(*) AS po, (CAST(sum(q) AS DOUBLE) * sum(t) + (count(*) - CAST(sum(q) AS DOUBLE)) * (count(*) - sum(t))) / (CAST(count(*) AS DOUBLE) * count(*)) AS pe FROM (SELECT CAST(quality = toxic AS INT) AS same, quality AS q, toxic AS t FROM labels)) k, labels GROUP BY po, pe")
def label_kappa(spark, d):
    k = V.kappa(X.table(spark, d, "labels"), "quality", "toxic")
    return k


@query("SELECT CAST(quality AS VARCHAR) AS quality, count(*) FILTER (toxic = 0) AS t0, count(*) FILTER (toxic = 1) AS t1 FROM labels GROUP BY quality")
def label_confusion(spark, d):
    c = V.confusion(X.table(spark, d, "labels").select(F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")), "quality", "toxic", ("0", "1"))
    return c.select("quality", F.col("0").alias("t0"), F.col("1").alias("t1"))


HUMAN = "SELECT doc_id, 'o' || CAST(doc_id % 3 AS STRING) AS outlet, CASE quality WHEN 1 THEN 'y' ELSE 'no' END AS a, CASE WHEN doc_id % 5 = 0 THEN 'n' ELSE 'Yes' END AS dir, CASE toxic WHEN 1 THEN 'negative' ELSE 'positive' END AS pol, CASE WHEN doc_id % 17 = 0 THEN '?' ELSE 'TRUE' END AS ev FROM {labels}"


@query(f"WITH h AS ({HUMAN.format(labels='labels')}), c AS (SELECT outlet, CAST(a = 'y' AS INT) AS a, CAST(dir = 'Yes' AS INT) AS d, CAST(pol = 'positive' AS INT) AS p FROM h WHERE ev <> '?') SELECT outlet, count(*) AS n, avg(a * d * p) AS edge, avg(a) AS actors, avg(d) AS direction, avg(p) AS polarity, 1.0::DOUBLE AS real FROM c GROUP BY GROUPING SETS ((), (outlet))")
def edge_precision(spark, d):
    h = spark.sql(HUMAN, labels=X.table(spark, d, "labels"))
    key = h.select(F.col("doc_id").alias("id"), "outlet", F.lit("positive").alias("llm_polarity"))
    human = h.select(F.col("doc_id").alias("id"), F.col("a").alias("actors_ok"), F.col("dir").alias("direction_ok"), F.col("pol").alias("polarity"), F.col("ev").alias("real_event"), F.lit("not").alias("mediation"))
    return V.precision(V.labelled(key, human))


SAMPLE_COLS = ("doc_id", "source", "target", "ref")


@query(f"""WITH e AS ({X.EDGES_SQL}), s AS (SELECT *, md5('0|' || doc_id || '|' || source || '|' || target || '|' || ref) AS h, CASE polarity WHEN 'positive' THEN 'p' WHEN 'negative' THEN 'n' END AS stratum FROM e),
i AS (SELECT *, row_number() OVER (PARTITION BY stratum, outlet ORDER BY h, doc_id, source, target, ref) AS k FROM s WHERE stratum IS NOT NULL), q AS (SELECT *, CASE stratum WHEN 'p' THEN 90 ELSE 40 END AS quota FROM i WHERE k <= CASE stratum WHEN 'p' THEN 90 ELSE 40 END),
g AS (SELECT *, CASE WHEN k <= greatest(1, quota // (SELECT count(DISTINCT outlet) FROM q q2 WHERE q2.stratum = q.stratum)) THEN 0 ELSE 1 END AS late FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY late, h, doc_id, source, target, ref) AS z FROM g)
SELECT stratum, outlet, doc_id, source, target, ref FROM r WHERE z <= quota""")
def stratified_sample(spark, d):
    e = X.edges(spark, d)
    stratum = F.when(F.col("polarity") == "positive", "p").when(F.col("polarity") == "negative", "n")
    return V.stratified(e, stratum, {"p": 90, "n": 40}, SAMPLE_COLS).select("stratum", "outlet", "doc_id", "source", "target", "ref")


@query(f"WITH e AS (SELECT DISTINCT doc_id, source, target FROM ({X.EDGES_SQL})), t AS (SELECT *, md5('0|' || doc_id || '|' || source || '|' || target) AS h FROM e) SELECT 'E' || lpad(CAST(row_number() OVER (ORDER BY h, doc_id, source, target) AS VARCHAR), 3, '0') AS id, doc_id, source, target FROM (SELECT * FROM t ORDER BY h, doc_id, source, target LIMIT 200)")
def numbered_sheet(spark, d):
    e = X.edges(spark, d).select("doc_id", "source", "target").distinct()
    return V.numbered(V.sample(e, 200, "doc_id", "source", "target"), ("doc_id", "source", "target")).select("id", "doc_id", "source", "target")


NAMES = r"n AS (SELECT unnest(regexp_extract_all(text, '\p{Lu}[\p{L}''’-]*(?: \p{Lu}[\p{L}''’-]*)*')) AS x FROM documents WHERE text IS NOT NULL), names AS (SELECT surface, count(*) AS count FROM (SELECT trim(regexp_replace(x, '[''’-]+$', '')) AS surface FROM n) WHERE length(surface) > 1 GROUP BY surface)"
PLAIN = r"trim(regexp_replace(lower(surface), '[^a-z\s]', '', 'g'))"
SEEDED = " ".join("WHEN " + " OR ".join(f"p = '{f}' OR list_contains(regexp_split_to_array(p, '\\s+'), '{f}') OR contains('{f}', p)" for f in forms) + f" THEN '{actor}'" for actor, forms in (("The", ["the"]), ("Der", ["der", "die"])))


@query(f"WITH {NAMES} SELECT surface, count FROM names ORDER BY count DESC, surface LIMIT 200")
def frequent_names(spark, d):
    return recon.discover(docs(spark, d))


@query(f"WITH {NAMES}, s AS (SELECT surface, count, {PLAIN} AS p FROM names) SELECT CASE {SEEDED} ELSE 'UNRESOLVED' END AS canon, surface, CAST(count AS BIGINT) AS count FROM s")
def name_groups(spark, d):
    """Of all names; only the report of frequent_names stops at 200."""
    return recon.alias_groups(recon.discover(docs(spark, d), keep=None), {"The": ["the"], "Der": ["der", "die"]})


#: The documents' words are invented, so common ones stand in for verbs; they have no inflection.
STAND_IN_VERBS = TG.Tagger(forms={"is": "be", "was": "be", "are": "be", "be": "be", "it": "it", "that": "that", "die": "die", "und": "und", "les": "le", "le": "le"})


@query()
def mined_verbs(spark, d):
    """Verb phrases, with their particles and prepositions, of sentences that name two actors, from the tagger's spans."""
    actors = {x: [x.lower()] for x in ("The", "An", "Er", "In", "Of")}
    return recon.mine_phrases(docs(spark, d), "doc_id", actors, tagger=STAND_IN_VERBS)


@query()
def labelled_names(spark, d):
    """All names of the documents with their most frequent label."""
    # A file of texts can be one row group, and so one task.
    texts = docs(spark, d).select("doc_id", "text").repartition("doc_id")
    return TG.discovered(TG.tagged(texts, STAND_IN_VERBS), keep=None)


@query("WITH w AS (SELECT user_id % 5 AS bucket, ts FROM events), g AS (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS m FROM w), s AS (SELECT CAST(m + CAST(7 * k AS INTEGER) AS DATE) AS st FROM g, (SELECT unnest(range(-3, 1)) AS k)) SELECT CAST(st AS TIMESTAMP) AS start, CAST(st + 28 AS TIMESTAMP) AS \"end\", bucket, count(*) AS n FROM (SELECT DISTINCT st FROM s) JOIN w ON ts >= CAST(st AS TIMESTAMP) AND ts < CAST(st + 28 AS TIMESTAMP) GROUP BY ALL")
def stream_sliding_counts(spark, d):
    """Sliding 28-day windows by a streaming query that takes all there is; the shared checkpoint folder holds its state and result."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = S.read_stream(spark, d, schema, pattern="events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("bucket"))
    folder = shared_folder(spark)
    S.latest_in_batch(S.sliding_counts(stream, keys=("bucket",)), lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/result"), f"{folder}/state", mode="complete")
    return spark.read.parquet(f"{folder}/result")


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def stream_first_seen(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = S.read_stream(spark, d, schema, pattern="events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    stream = S.first_seen(rows, "user_id", "ts", "60 days")
    folder = shared_folder(spark)
    S.run_available(stream, f"{folder}/result", f"{folder}/state")
    return spark.read.parquet(f"{folder}/result").groupBy("user_id").agg(F.count("*").alias("n"))
