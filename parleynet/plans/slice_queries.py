"""Queries over time slices, chapters and displays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config
from ..functions.verbs import with_substance
from ..operators import measures as M, network as N, timeline as T
from ..sources import payload as P
from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BROKERS = " OR ".join(f"raw_verb LIKE '%{v}%'" for v in config.BROKERING)
MEDIATING = " OR ".join(f"raw_verb LIKE '%{v}%'" for v in config.MEDIATING)
E = f"WITH e0 AS ({X.EDGES_SQL}), e AS (SELECT *, date_diff('day', (SELECT min(event_date) FROM e0), event_date) // 7 AS week FROM e0), last AS (SELECT max(week) AS lw FROM e)"
WEEKLY = f"wk AS (SELECT outlet, week, source, target, count(*) FILTER (valence = 'coop') AS coop, count(*) FILTER (valence = 'conflict') AS conf, count(*) FILTER (valence = 'neutral') AS neu, count(*) FILTER (valence = 'coop' AND ({BROKERS})) AS broker FROM e GROUP BY ALL)"
SPAN = "cal AS (SELECT unnest(range(0, CAST((SELECT lw FROM last) AS BIGINT) + 1)) AS w), fr AS (SELECT outlet, w AS week, source, target, CAST(sum(coop) AS BIGINT) AS coop, CAST(sum(conf) AS BIGINT) AS conf, CAST(sum(neu) AS BIGINT) AS neu, CAST(sum(broker) AS BIGINT) AS broker FROM wk JOIN cal ON wk.week BETWEEN w - 3 AND w GROUP BY ALL)"
PRINCIPALS = "(SELECT n_name FROM nation WHERE n_nationkey < 5)"
FOCUS = "(SELECT n_name FROM nation WHERE n_nationkey = 3)"
TIE = ("doc_id", "quote", "ref")
CHAPTERS = [(1, "1995-01-02", "1996-06-01"), (2, "1996-06-01", "1998-06-01"), (3, "1998-06-01", "2000-01-01"), (4, "2000-01-01", "2002-01-01")]
CHAPTER_VALUES = ", ".join(f"({i}, '{a}', '{b}')" for i, a, b in CHAPTERS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return T.with_week(X.edges(spark, d))


def days(spark: SparkSession, d: str) -> DataFrame:
    """The arcs of each day, written once: the joins behind the edges run once, whatever reads them."""
    return X.written(T.daily_arcs(X.edges(spark, d)))


def framed(spark: SparkSession, d: str, mode: str = "window", of: DataFrame | None = None) -> DataFrame:
    of = days(spark, d) if of is None else of
    return T.frames(T.weekly_of_days(of), T.calendar(of), mode)


def chapters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHAPTERS, "id int, start string, end string")


def in_chapters(spark: SparkSession, d: str) -> DataFrame:
    e = X.edges(spark, d).withColumn("date", F.col("event_date").cast("string"))
    return T.in_chapters(e, chapters(spark))


@query(f"{E} SELECT min(event_date) AS first, max(event_date) AS last, CAST(date_diff('day', min(event_date), max(event_date)) // 7 + 1 AS INTEGER) AS weeks FROM e")
def date_range(spark, d):
    return T.date_range(X.edges(spark, d))


@query(f"{E}, cal AS (SELECT unnest(range(0, CAST((SELECT lw FROM last) AS BIGINT) + 1)) AS w) SELECT CAST(w AS INTEGER) AS week, CAST((SELECT min(event_date) FROM e) + CAST(w * 7 + 6 AS INTEGER) AS DATE) AS frame_date FROM cal")
def week_calendar(spark, d):
    return T.calendar(X.edges(spark, d))


@query(f"{E}, {WEEKLY}, {SPAN} SELECT outlet, CAST(week AS INTEGER) AS week, source, target, coop, conf, neu, coop + conf + neu AS w, CASE WHEN coop > conf THEN 'coop' WHEN conf > coop THEN 'conflict' ELSE 'neutral' END AS pol FROM fr")
def frame_edges(spark, d):
    return T.frame_edges(framed(spark, d))


@query(f"{E}, {WEEKLY}, arcs AS (SELECT outlet, week, source, target, coop, conf, neu FROM wk), ws AS (SELECT outlet, week, sum(coop) AS coop, sum(conf) AS conf, sum(neu) AS neu, 0 AS arcs FROM arcs GROUP BY ALL UNION ALL SELECT outlet, min(week), 0, 0, 0, 1 FROM arcs GROUP BY outlet, source, target), s AS (SELECT outlet, week, sum(coop) AS coop, sum(conf) AS conf, sum(neu) AS neu, sum(arcs) AS arcs FROM ws GROUP BY ALL), cal AS (SELECT unnest(range(0, CAST((SELECT lw FROM last) AS BIGINT) + 1)) AS w), g AS (SELECT outlet, w FROM (SELECT DISTINCT outlet FROM e), cal) SELECT g.outlet, CAST(g.w AS INTEGER) AS week, CAST(sum(s.coop) AS BIGINT) AS coop, CAST(sum(s.conf) AS BIGINT) AS conf, CAST(sum(s.neu) AS BIGINT) AS neu, CAST(sum(s.arcs) AS BIGINT) AS arcs FROM g JOIN s ON s.outlet = g.outlet AND s.week <= g.w GROUP BY ALL")
def cumulative_frames(spark, d):
    rows = framed(spark, d, "cumulative")
    return rows.groupBy("outlet", "week").agg(F.sum("coop").alias("coop"), F.sum("conf").alias("conf"), F.sum("neu").alias("neu"), F.count("*").alias("arcs"))


@query(f"{E}, {WEEKLY}, {SPAN} SELECT outlet, CAST(week AS INTEGER) AS week, actor, CAST(sum(w) AS BIGINT) AS size FROM (SELECT outlet, week, source AS actor, coop + conf + neu AS w FROM fr UNION ALL SELECT outlet, week, target, coop + conf + neu FROM fr) GROUP BY ALL")
def frame_sizes(spark, d):
    return N.engagement(framed(spark, d), ("outlet", "week"))


@query(f"{E}, {WEEKLY}, {SPAN}, s AS (SELECT outlet, week, source AS actor, CAST(sum(coop) AS DOUBLE) / 7.0 AS v FROM fr GROUP BY ALL), r AS (SELECT outlet, week, actor, round(v, 4) AS score, row_number() OVER (PARTITION BY outlet, week ORDER BY round(v, 4) DESC, actor DESC) AS rank FROM s WHERE v > 0) SELECT outlet, CAST(week AS INTEGER) AS week, actor, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def leaderboard(spark, d):
    """By a stand-in score, sevenths of outgoing cooperation, as SQL has no current flow."""
    scores = framed(spark, d).groupBy("outlet", "week", F.col("source").alias("actor")).agg((F.sum("coop").cast("double") / 7.0).alias("score"))
    return T.leaderboard(scores)


@query(f"{E}, {WEEKLY}, {SPAN}, r AS (SELECT *, coop + conf + neu AS w, row_number() OVER (PARTITION BY outlet, week ORDER BY coop + conf + neu DESC, source, target) AS k FROM fr) SELECT outlet, CAST(week AS INTEGER) AS week, source, target, coop, conf, neu, w, CASE WHEN coop > conf THEN 'coop' WHEN conf > coop THEN 'conflict' ELSE 'neutral' END AS pol FROM r WHERE k <= 24 OR source = {FOCUS} OR target = {FOCUS}")
def visible_edges(spark, d):
    return T.visible_edges(T.frame_edges(framed(spark, d)), always=(X.axis(spark, d).focus,))


@query(f"{E}, {WEEKLY}, {SPAN}, r AS (SELECT *, coop + conf + neu AS w, row_number() OVER (PARTITION BY outlet, week ORDER BY coop + conf + neu DESC, source, target) AS k FROM fr WHERE coop > conf) SELECT outlet, CAST(week AS INTEGER) AS week, source, target, coop, conf, neu, w, 'coop' AS pol FROM r WHERE k <= 24 OR source = {FOCUS} OR target = {FOCUS}")
def cooperative_edges(spark, d):
    """What stays visible with the polarity filter on cooperation."""
    return T.visible_edges(T.frame_edges(framed(spark, d)), always=(X.axis(spark, d).focus,), polarity="coop")


@query(f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY outlet ORDER BY event_date DESC, source, target, doc_id, ref) AS rank FROM e WHERE week BETWEEN 97 AND 100 AND least(source, target) = (SELECT min(n_name) FROM nation WHERE n_nationkey IN (0, 1)) AND greatest(source, target) = (SELECT max(n_name) FROM nation WHERE n_nationkey IN (0, 1))) SELECT outlet, CAST(week AS INTEGER) AS week, event_date, source, target, doc_id, ref, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 14")
def dyad_mentions(spark, d):
    rows = T.mentions(events(spark, d), 100, pin=T.pinned_dyad(*X.axis(spark, d).dyad), tie=("source", "target", "doc_id", "ref"))
    return rows.select("outlet", "week", "event_date", "source", "target", "doc_id", "ref", "rank")


@query(f"{E}, {WEEKLY}, {SPAN}, m AS (SELECT outlet, week, CAST(max(s) AS BIGINT) AS max_size FROM (SELECT outlet, week, source, sum(coop + conf + neu) AS s FROM fr GROUP BY ALL) GROUP BY ALL) SELECT outlet, greatest(max(max_size), 1) AS max_size FROM m GROUP BY outlet")
def frame_maxima(spark, d):
    sizes = framed(spark, d).groupBy("outlet", "week", "source").agg(F.sum(F.col("coop") + F.col("conf") + F.col("neu")).alias("s"))
    return sizes.groupBy("outlet").agg(F.greatest(F.max("s"), F.lit(1)).alias("max_size"))


CH = f"{E}, ch(id, start, fin) AS (VALUES {CHAPTER_VALUES}), ec AS (SELECT e.*, ch.id FROM e JOIN ch ON ch.start <= CAST(event_date AS VARCHAR) AND CAST(event_date AS VARCHAR) < ch.fin)"


@query(f"{CH} SELECT id, outlet, count(DISTINCT substr(quote, 1, 30)) AS articles, count(DISTINCT (source, target)) FILTER (valence = 'coop') AS ties FROM ec GROUP BY ALL")
def chapter_counts(spark, d):
    e = in_chapters(spark, d)
    ties = N.project(N.signed_network(e, ("id", "outlet")), "coop", ("id", "outlet")).groupBy("id", "outlet").agg(F.count("*").alias("ties"))
    return T.article_counts(e, ("id", "outlet")).join(ties, ["id", "outlet"])


@query(f"{CH}, a AS (SELECT id, outlet, source, target, count(*) AS n FROM ec WHERE valence = 'coop' GROUP BY ALL), r AS (SELECT a.*, row_number() OVER (PARTITION BY id, outlet ORDER BY n DESC, s.n_nationkey, t.n_nationkey) AS k FROM a JOIN nation s ON source = s.n_name JOIN nation t ON target = t.n_name) SELECT id, outlet, source, target, CAST(n AS DOUBLE) AS strength FROM r WHERE k = 1")
def busiest_dyad(spark, d):
    view = N.project(N.signed_network(in_chapters(spark, d), ("id", "outlet")), "coop", ("id", "outlet"))
    return T.busiest(view, X.actors(spark, d), ("id", "outlet"))


@query(f"{CH}, s AS (SELECT id, outlet, source AS actor, CAST(count(*) AS DOUBLE) AS score FROM ec WHERE valence = 'coop' GROUP BY ALL), r AS (SELECT s.*, row_number() OVER (PARTITION BY id, outlet ORDER BY score DESC, n_nationkey) AS rank FROM s JOIN nation ON actor = n_name WHERE actor NOT IN {PRINCIPALS}) SELECT id, outlet, actor, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def third_parties(spark, d):
    scores = in_chapters(spark, d).where("valence = 'coop'").groupBy("id", "outlet", F.col("source").alias("actor")).agg(F.count("*").cast("double").alias("score"))
    return T.third_parties(scores, X.axis(spark, d).principals, X.actors(spark, d), ("id", "outlet")).select("id", "outlet", "actor", "score", "rank")


HERO_TIER = f"CASE WHEN (source = {FOCUS} OR target = {FOCUS}) AND polarity = 'positive' AND ({BROKERS}) THEN 0 WHEN (source = {FOCUS} OR target = {FOCUS}) AND polarity = 'positive' THEN 1 ELSE 2 END"


@query(f"{CH}, r AS (SELECT *, row_number() OVER (PARTITION BY id, outlet ORDER BY {HERO_TIER}, CASE WHEN length(quote) BETWEEN 45 AND 200 THEN 0 ELSE 1 END, event_date, doc_id, quote, ref) AS k FROM ec) SELECT id, outlet, source, target, raw_verb, quote, CAST(event_date AS VARCHAR) AS date FROM r WHERE k = 1")
def hero_quotes(spark, d):
    e = in_chapters(spark, d).drop("event_date")
    return T.hero(e, X.axis(spark, d).focus, ("id", "outlet"), tie=TIE).select("id", "outlet", "source", "target", "raw_verb", "quote", "date")


@query(f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY outlet, week ORDER BY CASE WHEN target IN {PRINCIPALS} THEN 0 ELSE 1 END, CASE WHEN length(quote) BETWEEN 45 AND 220 THEN 0 ELSE 1 END, event_date DESC, doc_id, quote, ref) AS k FROM e WHERE source NOT IN {PRINCIPALS} AND polarity = 'positive' AND ({MEDIATING})) SELECT outlet, CAST(week AS INTEGER) AS week, source, target, raw_verb, quote, event_date FROM r WHERE k = 1")
def mediation_quotes(spark, d):
    return T.mediation_hero(events(spark, d), X.axis(spark, d).principals, ("outlet", "week"), tie=TIE).select("outlet", "week", "source", "target", "raw_verb", "quote", "event_date")


@query(f"{E}, a AS (SELECT *, CASE WHEN target IN {PRINCIPALS} THEN 0 ELSE 1 END AS far, CASE WHEN length(quote) BETWEEN 45 AND 220 THEN 0 ELSE 1 END AS outside FROM e WHERE source NOT IN {PRINCIPALS} AND polarity = 'positive' AND ({MEDIATING})), g AS (SELECT outlet, w FROM (SELECT DISTINCT outlet FROM e), (SELECT unnest(range(0, CAST((SELECT lw FROM last) AS BIGINT) + 1)) AS w)), r AS (SELECT g.outlet, w, source, target, raw_verb, quote, date, row_number() OVER (PARTITION BY g.outlet, w ORDER BY CASE WHEN week = w THEN 0 ELSE 1 END, far, outside, date DESC, doc_id, quote, ref, source, target, raw_verb) AS k FROM g JOIN a ON a.outlet = g.outlet AND a.week <= w) SELECT outlet, CAST(w AS INTEGER) AS week, source, target, raw_verb, quote, date FROM r WHERE k = 1")
def spotlight(spark, d):
    """Each week's quote, or the best so far where the week has none."""
    e = events(spark, d)
    return T.hero_or_last(e, T.calendar(e), X.axis(spark, d).principals, tie=TIE)


@query(f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY outlet ORDER BY event_date DESC, source, target, doc_id, ref) AS rank FROM e WHERE week BETWEEN 97 AND 100 AND (source = {FOCUS} OR target = {FOCUS})) SELECT outlet, CAST(week AS INTEGER) AS week, event_date, source, target, doc_id, ref, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 14")
def pinned_mentions(spark, d):
    rows = T.mentions(events(spark, d), 100, pin=T.pinned_node(X.axis(spark, d).focus), tie=("source", "target", "doc_id", "ref"))
    return rows.select("outlet", "week", "event_date", "source", "target", "doc_id", "ref", "rank")


@query(f"{E}, {WEEKLY}, {SPAN}, s AS (SELECT outlet, week, source AS actor, CAST(sum(coop) AS DOUBLE) AS g FROM fr GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY outlet, week ORDER BY g DESC, actor) AS rank FROM s WHERE g > 0 AND actor NOT IN {PRINCIPALS}) SELECT outlet, CAST(week AS INTEGER) AS week, actor, g AS score, CAST(rank AS INTEGER) AS rank, CAST(round(100 * g / max(g) OVER (PARTITION BY outlet, week)) AS INTEGER) AS percent FROM r WHERE rank <= 5")
def board(spark, d):
    nodes = framed(spark, d).groupBy("outlet", "week", F.col("source").alias("actor")).agg(F.sum("coop").cast("double").alias("broker_g"))
    return T.board(nodes, X.axis(spark, d).principals)


@query("WITH d AS (SELECT doc_id, text, lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS dd, lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS mm FROM documents), e AS (SELECT '2020-' || mm || '-' || dd AS date, lower(text) AS h FROM d) SELECT '2020-06-01' AS date, 'Boundary' AS label UNION ALL SELECT * FROM (SELECT min(date) FILTER (contains(h, 'license')) AS date, 'Licence' AS label FROM e UNION ALL SELECT min(date) FILTER (contains(h, '@')), 'Contact' FROM e UNION ALL SELECT min(date) FILTER (contains(h, 'zzzz')), 'Never' FROM e) WHERE date IS NOT NULL")
def timeline_marks(spark, d):
    date = F.concat(F.lit("2020-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    docs = X.table(spark, d, "documents").select(date.alias("date"), F.col("text").alias("headline"))
    return T.timeline(docs, {"license": "Licence", "@": "Contact", "zzzz": "Never"}, "2020-06-01", "Boundary")


@query(f"{E}, ch(id, start, fin) AS (VALUES {CHAPTER_VALUES}), cal AS (SELECT unnest(range(0, CAST((SELECT lw FROM last) AS BIGINT) + 1)) AS w), ends AS (SELECT w, (SELECT min(event_date) FROM e) + CAST(w * 7 + 7 AS INTEGER) AS fin FROM cal), starts AS (SELECT id, coalesce((SELECT min(w) FROM ends WHERE CAST(ends.fin AS DATE) > CAST(ch.start AS DATE)), (SELECT max(w) FROM cal)) AS start_week FROM ch) SELECT CAST(w AS INTEGER) AS week, coalesce((SELECT max_by(id, (start_week, id)) FROM starts WHERE start_week <= w), 1) AS id FROM cal")
def chapter_weeks(spark, d):
    cal = T.calendar(X.edges(spark, d))
    c = T.week_of(chapters(spark).withColumn("day", F.col("start").cast("date")), "day", cal).withColumnRenamed("week", "start_week")
    return T.chapter_at(cal, c)


@query(f"{E}, cal AS (SELECT unnest(range(0, CAST((SELECT lw FROM last) AS BIGINT) + 1)) AS w), f AS (SELECT w, CAST((SELECT min(event_date) FROM e) + CAST(w * 7 + 6 AS INTEGER) AS DATE) AS fd FROM cal) SELECT CAST(w AS INTEGER) AS week, CASE WHEN w IN (176, 177) THEN 'during' WHEN CAST(fd AS VARCHAR) < '{X.BOUNDARY}' THEN 'pre' ELSE 'post' END AS badge FROM f")
def phase_badges(spark, d):
    return T.calendar(X.edges(spark, d)).select("week", T.badge(F.col("week"), F.col("frame_date"), 177, X.BOUNDARY).alias("badge"))


@query(f"{E}, {WEEKLY}, {SPAN}, v AS (SELECT outlet, week, CAST(sum(coop) AS DOUBLE) AS value FROM fr WHERE source = {FOCUS} GROUP BY ALL) SELECT o.outlet, CAST(w AS INTEGER) AS week, coalesce(value, 0) AS value FROM (SELECT DISTINCT outlet FROM e) o CROSS JOIN cal LEFT JOIN v ON v.outlet = o.outlet AND v.week = cal.w")
def sparkline(spark, d):
    of = days(spark, d)
    nodes = framed(spark, d, of=of).groupBy("outlet", "week", F.col("source").alias("actor")).agg(F.sum("coop").cast("double").alias("broker_g"))
    return T.sparkline(nodes, T.calendar(of), X.axis(spark, d).focus)


@query("SELECT n_name AS actor, r_name AS bloc, CASE r_name WHEN 'ASIA' THEN '#e2864a' WHEN 'EUROPE' THEN '#9b59b6' ELSE '#8a93a3' END AS colour FROM nation JOIN region ON n_regionkey = r_regionkey")
def node_styles(spark, d):
    return T.node_style(X.actors(spark, d), X.COLOURS, "International", "#8a93a3")


@query("""WITH a AS (SELECT n_name AS actor, r_name AS bloc, n_nationkey AS ord, n_nationkey = 3 AS head FROM nation JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT bloc, 0.2 + 0.15 * (row_number() OVER (ORDER BY bloc) - 1)::DOUBLE AS ax, bool_or(head) AS led, count(*) FILTER (NOT head) AS n FROM a GROUP BY bloc),
i AS (SELECT a.*, ax, led, n, row_number() OVER (PARTITION BY a.bloc ORDER BY head, ord) - 1 AS i FROM a JOIN b ON a.bloc = b.bloc),
t AS (SELECT *, CASE WHEN led THEN (i + 1) * (2 * pi() / (n + 1)) ELSE i * (2 * pi() / greatest(1, n)) END - pi() / 2 AS turn, least(0.13, 0.055 + 0.012 * n)::DOUBLE AS radius FROM i)
SELECT actor, round(CASE WHEN head THEN ax ELSE greatest(0.05, least(0.95, ax + radius * cos(turn))) END, 6) AS x, round(CASE WHEN head THEN 0.5 ELSE greatest(0.10, least(0.88, 0.5 + radius * sin(turn) * 1.05)) END, 6) AS y FROM t""")
def node_layout(spark, d):
    a = X.axis(spark, d)
    blocs = sorted(set(a.blocs.values()))
    spots = T.radial_layout(X.actors(spark, d), {b: (0.2 + 0.15 * i, 0.5) for i, b in enumerate(blocs)}, {a.blocs[a.focus]: a.focus})
    return spots.select("actor", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


FRAME = ("outlet", "mode", "week")


def frame_views(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The arcs of days, the frames' arcs in window and cumulative mode, with summed substance; and (outlet, mode, week, actor, flat, graded, brokering), their three current flows."""
    substance = F.sum(F.when((F.col("polarity") == "positive") & (F.col("substance") > 0), F.col("substance")).otherwise(0.0)).alias("substance")
    of = X.written(T.daily_arcs(with_substance(X.edges(spark, d)), (substance,)))
    weekly = T.weekly_of_days(of, (*T.FIELDS, "substance"))
    modes = [T.frames(weekly, T.calendar(of), mode, fields=(*T.FIELDS, "substance")).withColumn("mode", F.lit(mode)) for mode in ("window", "cumulative")]
    # Sizes, edges and scores all come from these rows.
    arcs = X.written(modes[0].unionByName(modes[1]))
    kinds = F.explode(F.array(*(F.struct(F.lit(name).alias("view"), F.col(field).cast("double").alias("votes")) for name, field in (("flat", "coop"), ("graded", "substance"), ("brokering", "broker")))))
    keys = ("outlet", "mode", "view", "week")
    view = N.project(arcs.select(*FRAME, *T.ARC, kinds.alias("k")).select(*FRAME, *T.ARC, "k.*"), "votes", keys)
    scores = M.flow_series(view, X.axis(spark, d).order, keys)
    return of, arcs, scores.groupBy(*FRAME, "actor").agg(*(F.max(F.when(F.col("view") == name, F.col("score"))).alias(name) for name in ("flat", "graded", "brokering")))


@query()
def flow_leaderboard(spark, d):
    """The best eight of each weekly frame by the flow that carries cooperation, over the trailing 28 days."""
    scores = M.flow_series(N.project(framed(spark, d), "coop", ("outlet", "week")), X.axis(spark, d).order, ("outlet", "week"))
    return T.leaderboard(scores)


@query()
def flow_third_parties(spark, d):
    """The best third parties of each chapter by the flow that carries cooperation."""
    keys = ("id", "outlet")
    scores = M.flow_brokerage(N.project(N.signed_network(in_chapters(spark, d), keys), "coop", keys), X.axis(spark, d).order, keys)
    return T.third_parties(scores, X.axis(spark, d).principals, X.actors(spark, d), keys).select("id", "outlet", "actor", "score", "rank")


@query()
def frame_flow(spark, d):
    """Current flow of every frame's cooperation network: each outlet and week, over the trailing 28 days and over all weeks so far."""
    of = days(spark, d)
    n = framed(spark, d, "window", of).withColumn("mode", F.lit("window")).unionByName(framed(spark, d, "cumulative", of).withColumn("mode", F.lit("cumulative")))
    return M.flow_series(N.project(n, "coop", FRAME), X.axis(spark, d).order, FRAME)


def _frame_nodes(arcs: DataFrame, scores: DataFrame) -> DataFrame:
    return T.ranked_nodes(N.engagement(arcs, FRAME), scores, FRAME)


@query()
def export_frames(spark, d):
    """Every outlet's frames in both modes as JSON, one a week; a frame without votes is there and empty."""
    of, arcs, scores = frame_views(spark, d)
    grid = of.select("outlet").distinct().join(F.broadcast(T.calendar(of)), how="cross").withColumn("mode", F.explode(F.array(F.lit("window"), F.lit("cumulative"))))
    return T.export_frames(_frame_nodes(arcs, scores), T.frame_edges(arcs, FRAME), FRAME, X.axis(spark, d).focus, grid)


@query()
def frame_extremes(spark, d):
    """(max_size, max_score): the largest size (both ends, 1 at least) and broker score (0.001 at least) of any node of any frame."""
    return T.extremes(_frame_nodes(*frame_views(spark, d)[1:]))


PIECES = f"""WITH {E.removeprefix('WITH ')}, {WEEKLY}, {SPAN}, ch(id, start, fin) AS (VALUES {CHAPTER_VALUES}),
meta AS (SELECT '{{"first":"' || min(event_date) || '","weeks":' || CAST((SELECT lw FROM last) + 1 AS VARCHAR) || ',"focus":"' || {FOCUS} || '"}}' AS piece FROM e),
c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, '{{"id":' || id || ',"start":"' || start || '","end":"' || fin || '","events":' || (SELECT count(*) FROM e WHERE ch.start <= CAST(event_date AS VARCHAR) AND CAST(event_date AS VARCHAR) < ch.fin) || '}}' AS piece FROM ch),
v AS (SELECT row_number() OVER (ORDER BY event_date, source, target, doc_id, ref) - 1 AS i, '{{"date":"' || event_date || '","week":' || week || ',"outlet":"' || outlet || '","source":"' || source || '","target":"' || target || '","valence":"' || valence || '","quote":' || to_json(quote) || '}}' AS piece FROM e WHERE polarity <> 'neutral'),
f AS (SELECT row_number() OVER (ORDER BY outlet, week) - 1 AS i, '"' || outlet || '|window|' || week || '":[' || string_agg('{{"s":"' || source || '","t":"' || target || '","coop":' || coop || ',"conf":' || conf || ',"neu":' || neu || '}}', ',' ORDER BY source, target) || ']' AS piece FROM fr WHERE coop + conf + neu > 0 GROUP BY outlet, week),
n AS (SELECT (SELECT count(*) FROM c) AS c, (SELECT count(*) FROM v) AS v, (SELECT count(*) FROM f) AS f),
p AS (SELECT 0 AS piece_no, 'window.VIZ_DATA = {{"meta":' AS value UNION ALL SELECT 1, piece FROM meta UNION ALL SELECT 2, ',' UNION ALL SELECT 3, '"chapters":[' UNION ALL SELECT 4 + i, CASE WHEN i > 0 THEN ',' ELSE '' END || piece FROM c
  UNION ALL SELECT 4 + c, '],' FROM n UNION ALL SELECT 5 + c, '"events":[' FROM n UNION ALL SELECT 6 + n.c + i, CASE WHEN i > 0 THEN ',' ELSE '' END || piece FROM v, n
  UNION ALL SELECT 6 + c + v, '],' FROM n UNION ALL SELECT 7 + c + v, '"frames":{{' FROM n UNION ALL SELECT 8 + n.c + n.v + i, CASE WHEN i > 0 THEN ',' ELSE '' END || piece FROM f, n UNION ALL SELECT 8 + c + v + f, '}}}};' FROM n)
SELECT CAST(piece_no AS BIGINT) AS piece_no, value FROM p"""


@query(PIECES)
def display_pieces(spark, d):
    """The payload of a display, read back from its files: chapters, events and weekly frames in one assignment of ordered pieces."""
    votes = ("coop", "conf", "neu")
    of = X.written(T.daily_arcs(X.edges(spark, d)).select("outlet", "event_date", *T.ARC, *votes))
    json = lambda *fields: F.to_json(F.struct(*fields))
    first = T.date_range(of).select(json(F.col("first").cast("string").alias("first"), "weeks", F.lit(X.axis(spark, d).focus).alias("focus")).alias("piece"))
    told = T.in_chapters(of.withColumn("date", F.col("event_date").cast("string")), chapters(spark)).groupBy("id").agg(F.sum(F.col("coop") + F.col("conf") + F.col("neu")).alias("events"))
    told = chapters(spark).join(told, "id", "left").select("id", json("id", "start", "end", F.coalesce("events", F.lit(0)).alias("events")).alias("piece"))
    keys = ("event_date", "source", "target", "doc_id", "ref")
    # Written, so that the shuffles of the joins are gone when the rows are sorted.
    seen = X.written(X.edges(spark, d).where("polarity <> 'neutral'").select(*keys, "outlet", "valence", "quote"))
    event = json(F.col("event_date").cast("string").alias("date"), "week", "outlet", "source", "target", "valence", "quote")
    edges = T.frame_edges(T.frames(T.weekly_of_days(of, votes), T.calendar(of), fields=votes))
    arc = F.struct(F.col("source").alias("s"), F.col("target").alias("t"), "coop", "conf", "neu")
    frames = edges.groupBy("outlet", "week").agg(F.to_json(F.sort_array(F.collect_list(arc))).alias("arcs"))
    frames = frames.select("outlet", "week", F.concat(F.lit('"'), "outlet", F.lit("|window|"), "week", F.lit('":'), "arcs").alias("piece"))
    sections = [P.Section("meta", "value", first), P.Section("chapters", "list", told, ("id",)), P.Section("events", "list", T.with_week(seen, of=of), keys, event), P.Section("frames", "fields", frames, ("outlet", "week"))]
    return P.payload_pieces(spark, "VIZ_DATA", sections)


def _window_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The arcs of days, and (outlet, week, actor, size, broker, broker_g, broker_real, rank) of the trailing frames, by current flow."""
    of, arcs, scores = frame_views(spark, d)
    return of, _frame_nodes(arcs, scores).where("mode = 'window'").drop("mode")


@query()
def flow_board(spark, d):
    """Third parties of each weekly frame by the flow that substance carries."""
    return T.board(_window_nodes(spark, d)[1], X.axis(spark, d).principals)


@query()
def flow_sparkline(spark, d):
    """The focus actor's substance flow in each outlet's weeks, 0 where it has none."""
    of, nodes = _window_nodes(spark, d)
    return T.sparkline(nodes, T.calendar(of), X.axis(spark, d).focus)
