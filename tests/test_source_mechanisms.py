"""Crawling, paging, pushed filters, retries, the transactional store and attempts with state."""

import json
import os
import random
import sys
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from parleynet.plans import fixtures, source_queries
from parleynet.sources import articles as A, rest, search, store
from parleynet.streaming import attempts as AT, incremental as S

#: Workers can't import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
MONTHS = [("2026-01", "2026-01-01", "2026-01-31"), ("2026-02", "2026-02-01", "2026-02-28"), ("2026-03", "2026-03-01", "2026-03-31")]


def listing(*links):
    return "<a href='/menu'>m</a><div class='r hits'>" + "".join(f"<p><a href='{x}'>t</a></p>" for x in links) + "</div><a href='/foot'>f</a>"


SITE = {
    "http://a.org/?s=x+y": listing("/1", "/2#c", "http://b.org/9", "/1"), "http://a.org/?s=x+y&p=2": listing("/2", "http://a.org/3"), "http://a.org/?s=x+y&p=3": listing("/1", "/3#top"),
    "http://a.org/?s=x+y&p=4": listing("/4"), "http://one.org/?s=x+y": listing("/1"), "http://gone.org/?s=x+y": listing("/1"), "http://one.org/?s=x+y&p=2": listing("/2"),
}


def outlet(domain, page="p", **rules):
    return search.Outlet(domain, f"http://{domain}/?s={{q}}", page, "div", "hits", **rules)


@pytest.mark.parametrize(
    "site, most, found",
    [
        (outlet("a.org"), 40, [(1, "/1"), (1, "/2"), (2, "/3")]), (outlet("a.org"), 2, [(1, "/1"), (1, "/2")]), (outlet("a.org", pattern="[13]$"), 40, [(1, "/1"), (2, "/3")]),
        (outlet("one.org", None), 40, [(1, "/1")]), (outlet("one.org"), 40, [(1, "/1"), (2, "/2")]), (outlet("gone.org"), 40, [(1, "/1")]), (outlet("none.org"), 40, []), (outlet("a.org"), 0, []),
    ],
)
def test_crawl_stops_as_it_should(site, most, found):
    got = list(search.crawl(SITE.get, site, "x y", most))
    assert [(page, url) for page, _, url in got] == [(page, f"http://{site.domain}{path}") for page, path in found]


def test_search_source_has_a_partition_for_each_outlet(spark):
    sites = [outlet("a.org"), outlet("one.org", None), outlet("none.org")]
    spark.dataSource.register(search.search_source("search_test", SITE.get, sites, "x y"))
    df = spark.read.format("search_test").load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect())) == sorted((o.domain, *r) for o in sites for r in search.crawl(SITE.get, o, "x y", 40))


def test_each_story_has_its_own_hint(spark):
    page = """<a href="/top">t</a><div class="story x"><a href="/world">W</a><h2><a href="/news/1#c">one</a></h2><a href="/news/8">more</a></div>
    <div class="story"><a href="/news/2">two</a><a href="/about/us">x</a><div class="story"><a href="/sport-2">S</a><a href="/news/3">three</a></div></div><div class="story">none</div><a href="/news/7">loose</a>"""
    pages = spark.createDataFrame([("http://x/archive", page), ("http://x/b", page.replace("/world", "/business")), ("http://x/c", None)], "url string, html string")
    got = {r.url: (r.hint, r.page) for r in search.story_links(pages, "div", "story", "/news/").collect()}
    assert got == {"http://x/news/1": ("world", "http://x/archive"), "http://x/news/2": ("sport-2", "http://x/archive"), "http://x/news/3": ("sport-2", "http://x/archive")}
    loose = {r.url: r.hint for r in search.story_links(pages, None, marker="/news/").collect()}
    assert loose == {f"http://x/news/{i}": "" for i in (1, 2, 3, 7, 8)}


class Api:
    """Two pages a month, a result a day; it writes down each request, and `obeys` its parameters or not."""

    def __init__(self, log, obeys=True, breaks=None):
        self.log, self.obeys, self.breaks = str(log), obeys, breaks

    def __call__(self, p):
        if self.breaks and not os.path.exists(self.breaks) and (p["from-date"], p["page"]) == ("2026-02-01", "2"):
            open(self.breaks, "w").close()
            raise OSError("connection lost")
        with open(self.log, "a") as f:
            f.write(json.dumps(p) + "\n")
        month, days = p["from-date"][:7], range(1, 15) if p["page"] == "1" else range(15, 29)
        rows = [{"id": f"{month}-{d:02d}/{s}", "type": t, "sectionId": s, "webPublicationDate": f"{month}-{d:02d}T01:00:00Z"} for d in days for s, t in (("world", "article"), ("sport", "liveblog"))]
        keep = [r for r in rows if not self.obeys or (p["from-date"] <= r["webPublicationDate"][:10] <= p["to-date"] and p.get("section") in (None, r["sectionId"]) and p.get("type") in (None, r["type"]))]
        return {"pages": 2, "results": keep}

    def requests(self):
        with open(self.log) as f:
            return [json.loads(x) for x in f]


@pytest.mark.parametrize("obeys", [True, False])
def test_filters_are_in_the_requests_and_not_in_the_plan(spark, tmp_path, obeys):
    api = Api(tmp_path / "log", obeys)
    read = lambda where=None: rest.read_rest(spark, rest.rest_source(f"pushed_{obeys}", api, MONTHS, A.request_parameters), where)
    rows = read("published >= DATE '2026-01-20' AND published < DATE '2026-02-03' AND section = 'world' AND type = 'article'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter " not in plan and "Filter(" not in plan
    days = sorted(r.published.isoformat() for r in rows.collect())
    assert days == [f"2026-01-{d}" for d in range(20, 29)] + ["2026-02-01", "2026-02-02"]
    asked = {(p["from-date"], p["to-date"], p["section"], p["type"]) for p in api.requests()}
    assert asked == {("2026-01-20", "2026-01-31", "world", "article"), ("2026-02-01", "2026-02-02", "world", "article")}
    other = read("month = '2026-03' AND section IN ('sport', 'x') AND page = 2")
    assert other.count() == 14 and {p["from-date"] for p in api.requests()[len(asked) * 2 :]} == {"2026-03-01"}
    assert read("section = 'world' AND section = 'sport'").count() == 0 and read().count() == 168


def test_a_stream_that_breaks_goes_on_at_its_page(spark, tmp_path):
    api = Api(tmp_path / "log", breaks=str(tmp_path / "broken"))
    source = rest.rest_source("stream_test", api, MONTHS, A.request_parameters, pages_of=lambda p: 2, batch_pages=1)
    run = lambda: rest.collect_pages(spark, source, str(tmp_path / "out"), str(tmp_path / "state"))
    with pytest.raises(Exception, match="connection lost"):
        run()
    before = [(p["from-date"], p["page"]) for p in api.requests()]
    assert before == [("2026-01-01", "1"), ("2026-01-01", "2"), ("2026-02-01", "1")]
    run()
    run()
    read = [(p["from-date"], p["page"]) for p in api.requests()]
    assert read == [(start, page) for _, start, _ in MONTHS for page in ("1", "2")]
    got = spark.read.schema(rest.SCHEMA).json(str(tmp_path / "out"))
    assert got.count() == 168 and got.select("result").distinct().count() == 168


def test_keys_are_left_when_rejected_spent_or_near_their_quota():
    calls, waits = [], []

    def fetch(p, key):
        calls.append(key)
        if key == "bad":
            raise rest.Rejected()
        if key == "slow":
            raise OSError("busy")
        return {"remaining": 3 if key == "last" else None, "results": [p]}

    run = rest.with_retries(fetch, ["bad", "slow", "last", "good"], tries=3, pause=5, floor=4, wait=waits.append)
    assert run({"page": 1})["results"] == [{"page": 1}] and calls == ["bad", "slow", "slow", "slow", "last"] and waits == [5, 10, 15]
    run({"page": 2})
    assert calls[5:] == ["good"]
    with pytest.raises(RuntimeError):
        rest.with_retries(fetch, ["bad"])({"page": 3})


def test_a_failed_job_leaves_the_store_as_it_was(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "id long, text string"
    ids = lambda: sorted(r.id for r in store.read_store(spark, path, schema).collect())
    assert ids() == [] and store.progress(path) == {}
    rows = spark.range(6).select("id", F.concat(F.lit('é "\n'), F.col("id").cast("string")).alias("text")).repartition(3)
    store.write_store(rows, path, {"month": "2026-01", "page": 4})
    assert ids() == list(range(6)) and store.progress(path) == {"month": "2026-01", "page": 4}
    assert store.read_store(spark, path, schema).where("id = 3").first().text == 'é "\n3'
    broken = rows.select("id", F.when(F.col("id") == 5, F.raise_error(F.lit("broken"))).otherwise(F.col("text")).alias("text"))
    with pytest.raises(Exception, match="broken"):
        store.write_store(broken, path, {"month": "2026-09", "page": 1}, fresh=True)
    assert ids() == list(range(6)) and store.progress(path)["month"] == "2026-01"
    store.write_store(spark.range(7, 9).selectExpr("id", "'x' AS text"), path)
    assert ids() == [*range(6), 7, 8] and store.manifest(path)["rows"] == 8 and store.progress(path)["page"] == 4
    store.write_store(spark.range(0).selectExpr("id", "'x' AS text"), path, {"done": True}, fresh=True)
    assert ids() == [] and store.vacuum(path) >= 4 and not os.listdir(os.path.join(path, "data"))


def brute(rows, most):
    out = {}
    for key in {k for k, _, _ in rows}:
        fails = 0
        for at, ok in sorted((at, ok) for k, ok, at in rows if k == key):
            fails += not ok
            if ok or fails == most:
                out[key] = ("done" if ok else "given up", fails, pd.Timestamp(at))
                break
    return out


def test_attempts_count_across_batches_and_restarts(spark, tmp_path):
    AT.use_rocks(spark)
    r = random.Random(4)
    start = datetime(2026, 1, 1)
    days = [[(f"k{r.randrange(25)}", r.random() < 0.25, start + timedelta(minutes=1440 * day + r.randrange(1440))) for _ in range(60)] for day in range(3)]
    schema = "key string, ok boolean, at timestamp"
    for day in days:
        spark.createDataFrame([*day, (None, True, start), ("k0", None, start)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = AT.attempt_changes(S.read_stream(spark, str(tmp_path / "in"), schema), most=4, wait="6 hours")
        S.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema(AT.CHANGES).parquet(str(tmp_path / "out")).collect()
    rows = [x for day in days for x in day]
    over = {x.key: (x.status, x.fails, pd.Timestamp(x.at)) for x in got if x.status != "due"}
    assert over == brute(rows, 4) and len(over) == sum(x.status != "due" for x in got)
    for x in got:
        if x.status == "due":
            # Six hours after a failure of a key that wasn't over then.
            failed = pd.Timestamp(x.at) - pd.Timedelta("6h")
            assert any(k == x.key and not ok and pd.Timestamp(at) == failed for k, ok, at in rows)
            assert x.key not in over or over[x.key][2] > failed
    assert any(x.status == "due" for x in got)


def test_records_of_a_job_are_written_by_many_tasks(spark, tmp_path):
    spark.range(4000).selectExpr("id AS doc_id", "'text ' || id AS text").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    got = source_queries.committed_records(spark, str(tmp_path))
    files = {r.file for r in got.where("doc_id >= 0").select(F.input_file_name().alias("file")).distinct().collect()}
    assert len(files) > 2 and got.count() == 2667 and got.where("doc_id = -1").first().text == "files 2 progress 3"


def test_recorded_pages_take_few_files_however_many_pages(spark, tmp_path):
    pages = spark.range(900).selectExpr("id % 3 AS site", "id div 6 + 1 AS page", "IF(id = 7, NULL, 'é line ' || id) AS value")
    site = fixtures.Recorded.record(pages, str(tmp_path / "site"), "site", "page")
    assert sum(len(files) for _, _, files in os.walk(tmp_path / "site")) < 150
    assert sorted((site.page(1, "2") or "").splitlines()) == ["", "é line 10"] and sorted(site.page("2", 150).splitlines()) == ["é line 896", "é line 899"]
    assert site.page(1, 151) is None and site.page(5, 1) is None and site.count("0") == 150 and site.count(9) == 0


def test_a_task_of_a_stream_reads_pages_that_follow_one_another(spark, tmp_path):
    source = rest.rest_source("runs_test", Api(tmp_path / "log"), MONTHS, A.request_parameters, pages_of=lambda p: 7, batch_pages=100, task_pages=3)
    stream = source({}).streamReader(None)
    tasks = stream.partitions({"window": 0, "page": 2}, {"window": 1, "page": 5})
    assert [(t.value, t.page, t.last) for t in tasks] == [("2026-01", 2, 4), ("2026-01", 5, 7), ("2026-02", 1, 3), ("2026-02", 4, 4)]


def test_keys_that_share_a_bucket_share_calls_of_the_state_and_nothing_else(spark, tmp_path):
    AT.use_rocks(spark)
    start = datetime(2026, 1, 1)
    rows = [(f"k{i}", i % 5 == 0, start + timedelta(hours=i % 7)) for i in range(200)] + [("z", False, start + timedelta(days=2))]
    spark.createDataFrame(rows, "key string, ok boolean, at timestamp").write.parquet(str(tmp_path / "in"))
    changes = AT.attempt_changes(S.read_stream(spark, str(tmp_path / "in"), "key string, ok boolean, at timestamp"), wait="6 hours", buckets=2)
    S.run_available(changes, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.key, r.status, r.fails, r.at) for r in spark.read.schema(AT.CHANGES).parquet(str(tmp_path / "out")).collect()}
    assert got == {(k, "done", 0, at) if ok else (k, "due", 1, at + timedelta(hours=6)) for k, ok, at in rows[:-1]}
