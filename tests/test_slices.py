"""Weeks, frames, boards, chapters and displays against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parleynet.operators import validation as V
from parleynet.operators import network as N, timeline as T

START = dt.date(2025, 10, 6)
SCHEMA = "outlet string, source string, target string, polarity string, valence string, raw_verb string, event_date date, quote string, doc_id string"


def event(day, source="A", target="B", polarity="positive", verb="hosted", outlet="o", quote="q"):
    valence = {"positive": "coop", "negative": "conflict", "neutral": "neutral"}[polarity]
    return (outlet, source, target, polarity, valence, verb, START + dt.timedelta(day), quote, f"d{day}")


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(4)
    rows = [event(d) for d in (0, 6, 7, 27, 28)] + [event(r.randrange(0, 90), *r.sample("ABCD", 2), r.choice(["positive", "negative", "neutral"]), r.choice(["hosted", "said"]), r.choice("op")) for _ in range(200)]
    return T.with_week(spark.createDataFrame(rows, SCHEMA)).cache()


def test_weeks(events):
    days = {(r.event_date - START).days: r.week for r in events.collect()}
    assert all(w == d // 7 for d, w in days.items())
    assert [days[d] for d in (0, 6, 7, 27, 28)] == [0, 0, 1, 3, 4]


@pytest.mark.parametrize("mode", ["window", "cumulative"])
def test_frames_equal_a_date_filter(events, mode):
    cal = T.calendar(events)
    got = {(r.outlet, r.week, r.source, r.target): (r.coop, r.conf, r.neu, r.broker) for r in T.frames(T.weekly_arcs(events), cal, mode).collect() if r.coop + r.conf + r.neu}
    rows, expected = events.collect(), {}
    for week in range(cal.count()):
        end = START + dt.timedelta(7 * (week + 1))
        for e in rows:
            if e.event_date < end and (mode == "cumulative" or e.event_date >= end - dt.timedelta(28)):
                at = expected.setdefault((e.outlet, week, e.source, e.target), [0, 0, 0, 0])
                at[{"coop": 0, "conflict": 1, "neutral": 2}[e.valence]] += 1
                at[3] += e.valence == "coop" and e.raw_verb == "hosted"
    assert got == {k: tuple(v) for k, v in expected.items()}


def test_calendar_and_week_of(spark, events):
    cal = T.calendar(events)
    first = cal.orderBy("week").first()
    assert first.frame_date == START + dt.timedelta(6)
    asked = spark.createDataFrame([(START,), (START + dt.timedelta(6),), (START + dt.timedelta(7),), (START + dt.timedelta(9999),)], "day date")
    assert [r.week for r in T.week_of(asked, "day", cal).orderBy("day").collect()] == [0, 0, 1, cal.count() - 1]


def test_leaderboard_orders_names_backwards(spark):
    s = spark.createDataFrame([("o", 0, "A", 0.5), ("o", 0, "B", 0.50001), ("o", 0, "C", 0.7), ("o", 0, "D", 0.0)], "outlet string, week int, actor string, score double")
    assert [(r.actor, r.rank) for r in T.leaderboard(s).orderBy("rank").collect()] == [("C", 1), ("B", 2), ("A", 3)]


def test_third_parties_and_board(spark):
    order = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "actor string, ord int")
    s = spark.createDataFrame([("o", 0, "A", 0.9), ("o", 0, "B", 0.4), ("o", 0, "C", 0.4)], "outlet string, week int, actor string, score double")
    assert [r.actor for r in T.third_parties(s, ("A",), order, ("outlet", "week")).orderBy("rank").collect()] == ["B", "C"]
    b = T.board(s.withColumnRenamed("score", "broker_g"), ("A",)).orderBy("rank").collect()
    assert [(r.actor, r.percent) for r in b] == [("B", 100), ("C", 100)]


def test_chapter_at(spark):
    weeks = spark.createDataFrame([(w,) for w in range(5)], "week int")
    chapters = spark.createDataFrame([(1, 1), (2, 3)], "id int, start_week int")
    assert [r.id for r in T.chapter_at(weeks, chapters).orderBy("week").collect()] == [1, 1, 1, 2, 2]


def test_hero_prefers_brokering_at_the_focus(spark):
    good = "x" * 60
    rows = [event(1, "C", "D", quote=good), event(2, "P", "D", verb="said", quote=good), event(3, "P", "D", quote="short"), event(4, "P", "D", quote=good)]
    e = spark.createDataFrame(rows, SCHEMA).withColumn("date", F.col("event_date").cast("string"))
    assert T.hero(e, "P", ("outlet",)).first().doc_id == "d4"
    assert T.hero(e, "Z", ("outlet",)).first().doc_id == "d1"


def test_mediation_hero_and_fallback(spark):
    good = "x" * 60
    rows = [event(1, "C", "A", quote=good), event(2, "C", "D", quote=good), event(3, "A", "C", quote=good), event(15, "C", "D", verb="said", quote=good)]
    e = T.with_week(spark.createDataFrame(rows, SCHEMA)).withColumn("date", F.col("event_date"))
    assert T.mediation_hero(e, ("A",), ("outlet",)).first().doc_id == "d1"  # toward a principal, though d2 is later
    spot = {r.week: r.date for r in T.hero_or_last(e, T.calendar(e), ("A",)).collect()}
    assert set(spot) == {0, 1, 2} and set(spot.values()) == {START + dt.timedelta(1)}


def test_timeline_badge_and_sparkline(spark):
    h = spark.createDataFrame([("2026-01-02", "A strike"), ("2026-01-01", "Strike again"), ("2026-01-03", None)], "date string, headline string")
    marks = {(r.label, r.date) for r in T.timeline(h, {"strike": "War", "truce": "Truce"}, "2026-02-01", "Talks").collect()}
    assert marks == {("War", "2026-01-01"), ("Talks", "2026-02-01")}
    n = spark.createDataFrame([("o", 1, "P", 0.5)], "outlet string, week int, actor string, broker_g double")
    assert [r.value for r in T.sparkline(n, spark.range(3).selectExpr("int(id) week"), "P").orderBy("week").collect()] == [0.0, 0.5, 0.0]


def test_visible_edges_and_pins(spark):
    rows = [("o", 0, "A", chr(66 + i), i, "coop") for i in range(20)] + [("o", 0, "Z", chr(66 + i), 1, "neutral") for i in range(20)]
    e = spark.createDataFrame(rows, "outlet string, week int, source string, target string, w int, pol string")
    assert T.visible_edges(e).count() == 24
    assert T.visible_edges(e, always=("Z",)).count() >= 38
    assert T.visible_edges(e, polarity="coop").count() == 20
    assert e.where(T.pinned_dyad("B", "A")).count() == 1 and e.where(T.pinned_node("Z")).count() == 20


def test_layout_puts_the_primary_at_its_anchor(spark):
    a = spark.createDataFrame([("P", "x", 0), ("Q", "x", 1), ("R", "y", 2)], "actor string, bloc string, ord int")
    got = {r.actor: (r.x, r.y) for r in T.radial_layout(a, {"x": (0.3, 0.4)}, {"x": "P"}).collect()}
    assert got["P"] == (0.3, 0.4) and all(0.05 <= x <= 0.95 and 0.1 <= y <= 0.88 for x, y in got.values())


def test_empty_events(spark):
    e = T.with_week(spark.createDataFrame([], SCHEMA))
    assert T.frame_edges(T.frames(T.weekly_arcs(e), T.calendar(e))).count() == 0
    assert N.signed_network(e, ("outlet",)).count() == 0


def test_weeks_of_daily_arcs_equal_weeks_of_events(spark):
    rows = [("O", f"2026-01-{1 + i % 20:02d}", "ab"[i % 2], "cd"[i % 3 % 2], ("coop", "conflict", "neutral")[i % 3], ("hosted", "said")[i % 2]) for i in range(90)]
    e = spark.createDataFrame(rows, "outlet string, event_date string, source string, target string, valence string, raw_verb string").withColumn("event_date", F.col("event_date").cast("date"))
    days = T.daily_arcs(e)
    assert days.count() < 90 and sorted(map(tuple, T.weekly_of_days(days).collect())) == sorted(map(tuple, T.weekly_arcs(T.with_week(e)).collect()))


def test_a_stratum_is_cut_before_its_rows_meet(spark):
    e = spark.range(1000).selectExpr("id AS doc_id", "'O' AS outlet", "IF(id % 2 = 0, 'p', 'n') AS polarity")
    got = V.stratified(e, F.col("polarity"), {"p": 9, "n": 4}, ("doc_id",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 13 and plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit") and "Partial" in plan
