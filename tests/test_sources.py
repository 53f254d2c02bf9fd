"""Readers, merging, pages, validation, discovery and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from parleynet import schemas
from parleynet.operators import recon, validation as V
from parleynet.sources import articles as A, pages as P, rest
from parleynet.streaming import incremental as S

PAGE = """<html><head><meta property="article:section" content="World"><meta property="article:published_time" content="2026-01-02T03:04:05Z"></head><body><nav><a href="/world">World</a></nav>
<article><h1>The &amp; headline</h1><a href="/authors/7">By Someone</a><p>short</p><p>{0}</p><p>{0} <b>bold</b></p></article><footer><p>{0}</p></footer></body></html>""".format("A paragraph of more than thirty characters, twice over.")


def test_page_rows(spark):
    rows = [("http://x/1234567", PAGE), ("http://x/2", PAGE.replace("World", "Sport")), ("http://x/3", "<article><p>too short</p></article>"), ("http://x/4", None)]
    got = {r.url: r for r in P.scraped(spark.createDataFrame(rows, "url string, html string"), "o", ["world"], min_body=100).collect()}
    r = got["http://x/1234567"]
    assert (r.status, r.section, r.date, r.author, r.headline, r.article_id) == ("ok", "world", "2026-01-02", "By Someone", "The & headline", "1234567")
    assert r.body.endswith("bold") and r.body.count("thirty") == 2
    assert [got[f"http://x/{i}"].status for i in (2, 3, 4)] == ["drop"] * 3


def test_links(spark):
    xml = "<urlset><url><loc> http://x/news/1 </loc><lastmod>2026-01-05</lastmod></url><url><loc>http://x/news/2</loc><lastmod>bad</lastmod></url><url><loc>http://x/sport/3</loc><lastmod>2026-01-05</lastmod></url><url><loc>http://x/news/4</loc><lastmod>2025-01-05T00:00:00Z</lastmod></url></urlset>"
    maps = spark.createDataFrame([(xml,)], "xml string")
    assert [r.url for r in P.sitemap_links(maps, "/news/", "2026-01-01", "2026-02-01").collect()] == ["http://x/news/1"]
    page = '<a href="/world">W</a><a href="/news/9#top">n</a><a href="/news/9">n</a><a href="/about/us">x</a>'
    got = P.archive_links(spark.createDataFrame([("http://x/archive", page)], "url string, html string"), "/news/").collect()
    assert [(r.url, r.hint) for r in got] == [("http://x/news/9", "world")]


def test_csv_round_trip_with_line_breaks(spark, tmp_path):
    row = {c: c for c in schemas.ARTICLE_COLUMNS} | {"body": 'line one\nline "two", three', "author": None}
    A.write_articles_csv(spark.createDataFrame([tuple(row.values())], schemas.ARTICLE), str(tmp_path / "a"))
    back = A.read_articles_csv(spark, str(tmp_path / "a")).first()
    assert back.body == row["body"] and back.author in (None, "")


def test_json_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"doc_id": "1_0", "n_parsed": 2}\n\n{"doc_id": "1_1"}\n{broken\n{"other": 1}\n')
    assert sorted(r.doc_id for r in A.read_done_ids(spark, str(tmp_path / "r.jsonl")).collect()) == ["1_0", "1_1"]
    assert A.read_jsonl(spark, str(tmp_path / "r.jsonl"), strict=False).where("doc_id IS NOT NULL").count() == 2
    with pytest.raises(Exception):
        A.read_jsonl(spark, str(tmp_path / "r.jsonl")).collect()


def test_url_list_and_keys(spark, tmp_path):
    (tmp_path / "u.txt").write_text("http://a\n\n# note\n  http://b  \n")
    assert [r.url for r in A.read_url_list(spark, str(tmp_path / "u.txt")).collect()] == ["http://a", "http://b"]
    assert A.parse_keys("k1, k2", None, "k2\nk3") == ["k1", "k2", "k3"]


def test_merge_order(spark):
    rows = [(1, "u1", "2026-01-01T10:00:00+05:00"), (2, "u2", "2026-01-01T06:00:00Z"), (3, "u3", ""), (4, "u1", "2026-01-01T11:00:00+05:00"), (5, "u4", "junk")]
    s = spark.createDataFrame(rows, "seq int, url string, timestamp string")
    assert [r.url for r in A.merged([s]).collect()] == ["u1", "u2", "u3", "u4"]
    assert [r.url for r in A.merged([s], raw_order=True).collect()] == ["u2", "u1", "u3", "u4"]
    both = A.union_all([s, s.drop("timestamp").withColumn("genre", F.lit("news"))])
    assert both.columns == ["seq", "url", "timestamp", "genre"] and both.count() == 10


def test_article_rows_follow_the_order(spark):
    a = spark.range(1000).select((999 - F.col("id")).alias("k")).repartition(7)
    assert all(r.k == r.article_row for r in A.with_article_row(a, ("k",)).collect())


def test_rest_source(spark):
    def fetch(parameters, key):
        if key == "spent":
            raise OSError("quota")
        return {"pages": 2, "results": [{"type": "article", "webUrl": f"{parameters['from-date']}/{parameters['page']}"}]}

    source = rest.rest_source("rest_test", rest.with_retries(fetch, ["spent", "good"]), [("2026-01", "2026-01-01", "2026-01-31"), ("2026-02", "2026-02-01", "2026-02-28")], A.request_parameters)
    spark.dataSource.register(source)
    got = sorted(json.loads(r.result)["webUrl"] for r in spark.read.format("rest_test").load().collect())
    assert got == ["2026-01-01/1", "2026-01-01/2", "2026-02-01/1", "2026-02-01/2"]


def test_api_rows(spark):
    schema = "type string, pillarId string, sectionId string, webPublicationDate string, webUrl string, webTitle string, fields struct<byline:string,headline:string,bodyText:string>"
    rows = [("article", "news", "world", "2026-01-02T00:00:00Z", "u", "T", (None, None, "text")), ("liveblog", "news", "w", "", "v", "T", (None, None, "x")), ("article", "news", "w", "", "w", "T", (None, None, ""))]
    got = A.api_rows(spark.createDataFrame(rows, schema), "news").collect()
    assert [(r.url, r.date, r.author, r.headline) for r in got] == [("u", "2026-01-02", "", "T")]


def test_fetch_list(spark):
    links = spark.createDataFrame([("a", ""), ("b", "world"), ("c", "sport"), ("d", ""), ("e", "")], "url string, hint string")
    fails = spark.createDataFrame([("d", 4), ("e", 3)], "url string, fails int")
    assert sorted(r.url for r in A.to_fetch(links, links.where("url = 'b'"), ["world"], fails).collect()) == ["a", "e"]


@pytest.mark.parametrize("pairs, n, kappa", [([("y", "y"), ("n", "n")], 2, 1.0), ([("y", "y"), ("y", "y")], 2, 1.0), ([("y", "n"), ("n", "y")], 2, -1.0), ([("y", None)], 0, float("nan"))])
def test_kappa(spark, pairs, n, kappa):
    r = V.kappa(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()
    assert r.n == n and (r.kappa == kappa or kappa != kappa and r.kappa != r.kappa)


def test_sample_quotas_and_blinding(spark):
    rows = [("o" if i % 10 else "p", "pre", "A", "B", "positive", "hosted", f"d{i}", f"q{i}", "h", "u") for i in range(100)]
    e = spark.createDataFrame(rows, "outlet string, phase string, source string, target string, polarity string, raw_verb string, doc_id string, quote string, headline string, url string")
    s = V.stratified(e, F.lit("all"), {"all": 40}, ("doc_id",))
    counts = {r.outlet: r["count"] for r in s.groupBy("outlet").count().collect()}
    assert counts == {"p": 10, "o": 30}
    numbered = V.numbered(s, ("doc_id", "source", "target", "quote"))
    sheet = V.sheet(numbered)
    assert sheet.columns == [c.split()[0] for c in schemas.ANNOTATION_SHEET.split(", ")]
    assert {r.id for r in V.key(numbered).collect()} == {f"E{i:03d}" for i in range(1, 41)}
    assert not {"outlet", "phase", "llm_polarity"} & set(sheet.columns)


def test_mediation_share(spark):
    r = V.mediation_share(spark.createDataFrame([("A", "B", "positive", "mediation"), ("B", "A", "positive", "not"), ("C", "D", "positive", "mediation"), ("A", "B", "negative", "not")], "source string, target string, h_pol string, h_med string"), ("A",)).first()
    assert (r.n, r.share, r.mediation) == (2, 0.5, 1)


def test_discovery(spark):
    d = spark.createDataFrame([("Marco Polo met Kublai Khan. He met them. Khan urged Marco.",), (None,)], "text string")
    seeds = {"Polo": ["marco polo", "marco"], "Khan": ["kublai khan", "khan"]}
    names = {r.surface: r["count"] for r in recon.discover(d).collect()}
    assert names["Marco Polo"] == 1 and "He" in names
    groups = {r.surface: r.canon for r in recon.alias_groups(recon.discover(d), seeds).collect()}
    assert groups["Marco Polo"] == "Polo" and groups["Khan"] == "Khan"
    verbs = {(r.relation_bucket, r.verb_phrase): r["count"] for r in recon.mine_verbs(d, seeds).collect()}
    assert verbs == {("DEMAND", "urge"): 1}


def test_stream_takes_only_what_is_new(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "doc_id string, text string"
    spark.createDataFrame([("1", "a"), ("2", "b")], schema).write.parquet(folder)
    seen = []

    def extract(chunks):
        seen.append(sorted(r.doc_id for r in chunks.collect()))
        return chunks.select("doc_id", F.lit(None).cast("string").alias("error"))

    run = lambda: S.extract_new(S.read_stream(spark, folder, schema), out, state, extract, "doc_id string, error string")
    run()
    spark.createDataFrame([("2", "again"), ("3", "c")], schema).write.mode("append").parquet(folder)
    run()
    run()
    assert seen == [["1", "2"], ["3"]]


def test_entry_file(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60
    assert entry.entry(spark).count() > 0


def test_numbers_agree_where_partitions_of_the_rows_and_of_their_sizes_differ(spark):
    wide = F.concat(*(F.sha2(F.concat("k", F.lit(f"/{i}")), 512) for i in range(4)))
    rows = spark.range(20000).withColumnRenamed("id", "k").repartition(3).withColumn("text", wide)
    got = A.with_article_row(rows, ("k",)).collect()
    assert len(got) == 20000 and all(r.k == r.article_row for r in got)
