"""Time slices: weeks, trailing and cumulative frames, boards, chapters, quotes and displays over them.

An event's week is counted from the first day of all events. A trailing frame of 28 days
that ends with week w holds exactly the events of weeks w-3 to w, and a cumulative frame
those up to w, so frames are window sums over one aggregate by week and no event is read
once for each frame that it is in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config
from .network import is_brokering, polarity_label

ARC = ("source", "target")
#: Fixed values of displays: good lengths of a story's and a mediation's quote; ring radius (least, most, step an actor), stretch, and bounds of x and y.
STORY_QUOTE, MEDIATION_QUOTE = (45, 200), (45, 220)
RING, STRETCH, X_BOUNDS, Y_BOUNDS = (0.055, 0.13, 0.012), 1.05, (0.05, 0.95), (0.10, 0.88)
FIELDS = ("coop", "conf", "neu", "broker")


def date_range(events: DataFrame, date: str = "event_date") -> DataFrame:
    """One row (first, last, weeks)."""
    ends = events.agg(F.min(date).alias("first"), F.max(date).alias("last"))
    return ends.withColumn("weeks", F.floor(F.datediff("last", "first") / 7).cast("int") + 1)


def with_week(events: DataFrame, date: str = "event_date", of: DataFrame | None = None) -> DataFrame:
    """events with `week`, counted from the first day of all of them, or of the rows that they are a part of."""
    first = (events if of is None else of).agg(F.min(date).alias("_first"))
    return events.join(F.broadcast(first), how="cross").withColumn("week", F.floor(F.datediff(date, "_first") / 7).cast("int")).drop("_first")


def calendar(events: DataFrame, date: str = "event_date") -> DataFrame:
    """(week, frame_date): every week of the range, with the last day that its frames hold."""
    days = date_range(events, date).where("first IS NOT NULL").select("first", F.explode(F.sequence(F.lit(0), F.col("weeks") - 1)).alias("week"))
    return days.select("week", F.date_add("first", F.col("week") * 7 + 6).alias("frame_date"))


def weekly_arcs(events: DataFrame, extra: tuple[Column, ...] = ()) -> DataFrame:
    """(outlet, week, source, target, coop, conf, neu, broker) of events that have a week."""
    return _arcs(events, "week", extra)


def daily_arcs(events: DataFrame, extra: tuple[Column, ...] = (), date: str = "event_date") -> DataFrame:
    """The same by day: what weeks, the calendar and frames are made of, bounded by days, outlets and actors squared."""
    return _arcs(events, date, extra)


def weekly_of_days(days: DataFrame, fields: tuple[str, ...] = FIELDS, date: str = "event_date") -> DataFrame:
    """weekly_arcs() from daily_arcs(); weeks are counted from the first day of all of them."""
    return with_week(days, date).groupBy("outlet", "week", *ARC).agg(*(F.sum(f).alias(f) for f in fields))


def _arcs(events: DataFrame, at: str, extra: tuple[Column, ...]) -> DataFrame:
    coop = F.col("valence") == "coop"
    return events.groupBy("outlet", at, *ARC).agg(
        F.count_if(coop).alias("coop"), F.count_if(F.col("valence") == "conflict").alias("conf"), F.count_if(F.col("valence") == "neutral").alias("neu"), F.count_if(coop & is_brokering(F.col("raw_verb"))).alias("broker"), *extra
    )


def frames(weekly: DataFrame, weeks: DataFrame, mode: str = "window", span: int = 4, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """weekly sums turned into frame sums: the trailing `span` weeks, or (`cumulative`) all weeks so far.

    An arc has a row in a frame from its first week on, while the frame holds a vote of
    it; its weeks are filled in before the window sums, in its own group.
    """
    last = weeks.agg(F.max("week").alias("last_week"))
    reach = F.lit(span - 1) if mode == "window" else F.lit(1 << 30)
    # A vote of week v is in the frames v .. v + reach: its arc's rows, and no others, are made here.
    spread = weekly.join(F.broadcast(last), how="cross").withColumn("frame", F.explode(F.sequence(F.col("week"), F.least(F.col("week") + reach, F.col("last_week")))))
    if mode == "window":
        return spread.groupBy("outlet", F.col("frame").alias("week"), *ARC).agg(*(F.sum(f).alias(f) for f in fields))
    grid = weekly.groupBy("outlet", *ARC).agg(F.min("week").alias("begin")).join(F.broadcast(last), how="cross")
    grid = grid.select("outlet", *ARC, F.explode(F.sequence("begin", "last_week")).alias("week"))
    upto = Window.partitionBy("outlet", *ARC).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(weekly, ["outlet", *ARC, "week"], "left")
    return full.select("outlet", "week", *ARC, *(F.sum(F.coalesce(F.col(f), F.lit(0))).over(upto).alias(f) for f in fields))


def frame_edges(framed: DataFrame, keys: tuple[str, ...] = ("outlet", "week")) -> DataFrame:
    """(keys, source, target, coop, conf, neu, w, pol) of arcs with a vote."""
    total = F.col("coop") + F.col("conf") + F.col("neu")
    return framed.withColumn("w", total).where("w <> 0").select(*keys, *ARC, "coop", "conf", "neu", "w", polarity_label(F.col("coop"), F.col("conf")).alias("pol"))


def leaderboard(scores: DataFrame, keys: tuple[str, ...] = ("outlet", "week"), keep: int = 8) -> DataFrame:
    """(keys, actor, score, rank): positive scores rounded to four digits, higher first, equal ones by name from z to a; the first `keep`."""
    rows = scores.where("score > 0").select(*keys, "actor", F.bround("score", 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("actor")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= keep)


def third_parties(scores: DataFrame, principals: tuple[str, ...], order: DataFrame, keys: tuple[str, ...], keep: int = 3) -> DataFrame:
    """The best `keep` of actors with a positive score that are no principals; ties by the actors' order."""
    rows = scores.where(F.col("score") > 0).where(~F.col("actor").isin(*principals)) if principals else scores.where("score > 0")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ord"))
    return rows.join(F.broadcast(order.select("actor", "ord")), "actor").withColumn("rank", rank).where(F.col("rank") <= keep).drop("ord")


def board(nodes: DataFrame, principals: tuple[str, ...], keys: tuple[str, ...] = ("outlet", "week"), keep: int = 5) -> DataFrame:
    """Third parties by substance brokerage, with per cent of the best."""
    at = Window.partitionBy(*keys)
    rows = nodes.where((F.col("broker_g") > 0) & ~F.col("actor").isin(*principals)).withColumn("rank", F.row_number().over(at.orderBy(F.desc("broker_g"), "actor"))).where(F.col("rank") <= keep)
    return rows.withColumn("percent", F.round(100 * F.col("broker_g") / F.max("broker_g").over(at)).cast("int")).select(*keys, "actor", F.col("broker_g").alias("score"), "rank", "percent")


def busiest(view: DataFrame, order: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, source, target, strength) of the strongest arc; ties by the order of source, then of target."""
    o = F.broadcast(order.select("actor", "ord"))
    rows = view.join(o.withColumnsRenamed({"actor": "source", "ord": "o1"}), "source").join(o.withColumnsRenamed({"actor": "target", "ord": "o2"}), "target")
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*ARC, "strength"), F.struct((-F.col("strength")).alias("s"), "o1", "o2")).alias("b"))
    return best.select(*keys, "b.*")


def article_counts(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Distinct first 30 characters of quotes."""
    return events.groupBy(*keys).agg(F.count_distinct(F.substring(F.coalesce("quote", F.lit("")), 1, 30)).alias("articles"))


def week_of(dates: DataFrame, date: str, weeks: DataFrame) -> DataFrame:
    """dates with the first week that ends after the date, else the last week. weeks(week, frame_date) are few and sent along."""
    spine = weeks.agg(F.sort_array(F.collect_list(F.struct(F.date_add("frame_date", 1).alias("ends"), "week"))).alias("spine"))
    first = F.get(F.filter("spine", lambda x: x.ends > F.col(date)), 0)
    return dates.join(F.broadcast(spine), how="cross").withColumn("week", F.coalesce(first.week, F.element_at("spine", -1).week)).drop("spine")


def in_chapters(events: DataFrame, chapters: DataFrame, date: str = "date") -> DataFrame:
    """events once for each chapter(id, start, end) with start <= date < end, dates compared as ISO text; chapters are a small dimension."""
    c = F.broadcast(chapters)
    return events.join(c, (c["start"] <= events[date]) & (events[date] < c["end"]))


def chapter_at(weeks: DataFrame, chapters: DataFrame) -> DataFrame:
    """(week, id): the last chapter that has begun by the week, else the first."""
    c = F.broadcast(chapters.select("id", "start_week"))
    begun = weeks.join(c, c.start_week <= weeks.week, "left").groupBy("week").agg(F.max_by("id", F.struct("start_week", "id")).alias("id"))
    first = F.broadcast(chapters.agg(F.min_by("id", F.struct("start_week", "id")).alias("first_id")))
    return begun.join(first, how="cross").select("week", F.coalesce("id", "first_id").alias("id"))


def fits(quote: Column, low: int, high: int) -> Column:
    """0 for a quote of a good length, else 1."""
    return F.when(F.length(quote).between(low, high), 0).otherwise(1)


def hero(events: DataFrame, focus: str, keys: tuple[str, ...], date: str = "date", tie: tuple[str, ...] = ("doc_id", "quote")) -> DataFrame:
    """The one event a summary quotes: of brokering positive events at the focus, else positive ones, else any; good length first, then the earliest."""
    at_focus = ((F.col("source") == focus) | (F.col("target") == focus)) & (F.col("polarity") == "positive")
    tier = F.when(at_focus & is_brokering(F.col("raw_verb")), 0).when(at_focus, 1).otherwise(2)
    by = F.struct(tier.alias("tier"), fits(F.col("quote"), *STORY_QUOTE).alias("outside"), F.col(date), *(F.col(c) for c in tie))
    chosen = F.min_by(F.struct(*(c for c in events.columns if c not in keys)), by)
    return events.groupBy(*keys).agg(chosen.alias("e")).select(*keys, "e.*")


def is_mediation(principals: tuple[str, ...]) -> Column:
    """A third party's positive act with a mediating verb."""
    verb = F.lower(F.coalesce("raw_verb", F.lit("")))
    stems = reduce(lambda a, b: a | b, (verb.contains(s) for s in config.MEDIATING))
    return ~F.col("source").isin(*principals) & (F.col("polarity") == "positive") & stems


def mediation_hero(events: DataFrame, principals: tuple[str, ...], keys: tuple[str, ...], focus: Column | None = None, date: str = "date", tie: tuple[str, ...] = ("doc_id", "quote")) -> DataFrame:
    """Of acts of mediation: those toward a principal if any, of these those at the focus if any; good length first, then the latest."""
    pool = events.where(is_mediation(principals)).withColumn("_far", F.when(F.col("target").isin(*principals), 0).otherwise(1))
    near = F.when((F.col("source") == focus) | (F.col("target") == focus), 0).otherwise(1) if focus is not None else F.lit(0)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_far", F.coalesce(near, F.lit(1)), fits(F.col("quote"), *MEDIATION_QUOTE), F.desc(date), *tie))
    return pool.withColumn("_rank", rank).where("_rank = 1").drop("_far", "_rank")


def hero_or_last(events: DataFrame, weeks: DataFrame, principals: tuple[str, ...], focus: Column | None = None, tie: tuple[str, ...] = ("doc_id", "quote")) -> DataFrame:
    """(outlet, week, event): this week's mediation quote, else the best of all weeks so far in the same order of preference.

    The best so far is kept by a running minimum over the weeks' own best events.
    """
    acts = events.where(is_mediation(principals))
    near = F.when((F.col("source") == focus) | (F.col("target") == focus), 0).otherwise(1) if focus is not None else F.lit(0)
    late = (-F.unix_date(F.col("date").cast("date"))).alias("late")
    by = F.struct(F.when(F.col("target").isin(*principals), 0).otherwise(1).alias("far"), F.coalesce(near, F.lit(1)).alias("near"), fits(F.col("quote"), *MEDIATION_QUOTE).alias("outside"), late, *(F.col(c) for c in tie))
    own = acts.groupBy("outlet", "week").agg(F.min(F.struct(by.alias("by"), F.struct("source", "target", "raw_verb", "quote", "date").alias("e"))).alias("own"))
    grid = events.select("outlet").distinct().join(F.broadcast(weeks.select("week")), how="cross").join(own, ["outlet", "week"], "left")
    sofar = F.min("own").over(Window.partitionBy("outlet").orderBy("week").rowsBetween(Window.unboundedPreceding, 0))
    return grid.withColumn("e", F.coalesce("own", sofar).e).where("e IS NOT NULL").select("outlet", "week", "e.*")


def mentions(events: DataFrame, week: int, mode: str = "window", pin: Column | None = None, keep: int = 14, tie: tuple[str, ...] = ("source", "target", "doc_id")) -> DataFrame:
    """The latest `keep` events of each outlet in a frame, those that a pin selects if there is one."""
    rows = events.where((F.col("week") <= week) & (F.col("week") >= (max(0, week - 3) if mode == "window" else 0)))
    rows = rows.where(pin) if pin is not None else rows
    rank = F.row_number().over(Window.partitionBy("outlet").orderBy(F.desc("date"), *tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= keep)


def pinned_node(actor: str) -> Column:
    return (F.col("source") == actor) | (F.col("target") == actor)


def pinned_dyad(a: str, b: str) -> Column:
    return F.concat_ws("|", F.least(*ARC), F.greatest(*ARC)) == "|".join(sorted((a, b)))


def visible_edges(edges: DataFrame, always: tuple[str, ...] = (), polarity: str = "all", keep: int = 24, keys: tuple[str, ...] = ("outlet", "week")) -> DataFrame:
    """The heaviest `keep` arcs of a frame, and every arc at one of the actors that are always shown."""
    rows = edges if polarity == "all" else edges.where(F.col("pol") == polarity)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("w"), *ARC))
    touched = (F.col("source").isin(*always) | F.col("target").isin(*always)) if always else F.lit(False)
    return rows.withColumn("_rank", rank).where((F.col("_rank") <= keep) | touched).drop("_rank")


def timeline(events: DataFrame, keywords: dict[str, str], boundary: str, boundary_label: str, date: str = "date") -> DataFrame:
    """(date, label): the boundary, and for each keyword the first day that a headline holds it."""
    spark = events.sparkSession
    head = F.lower(F.coalesce("headline", F.lit("")))
    firsts = events.agg(*(F.min(F.when(head.contains(k), F.col(date))).alias(f"k{i}") for i, k in enumerate(keywords)))
    marks = firsts.select(F.explode(F.array(*(F.struct(F.col(f"k{i}").cast("string").alias("date"), F.lit(label).alias("label")) for i, label in enumerate(keywords.values())))).alias("m")).select("m.*").where("date IS NOT NULL")
    return spark.createDataFrame([(boundary, boundary_label)], "date string, label string").unionByName(marks)


def badge(week: Column, frame_date: Column, boundary_week: int, boundary: str) -> Column:
    return F.when(week.isin(boundary_week - 1, boundary_week), "during").when(frame_date.cast("string") < boundary, "pre").otherwise("post")


def sparkline(nodes: DataFrame, weeks: DataFrame, focus: str, field: str = "broker_g") -> DataFrame:
    """(outlet, week, value) of the focus for every week, 0 where it has no node."""
    grid = nodes.select("outlet").distinct().join(F.broadcast(weeks.select("week")), how="cross")
    values = nodes.where(F.col("actor") == focus).select("outlet", "week", F.col(field).alias("value"))
    return grid.join(values, ["outlet", "week"], "left").na.fill(0, ["value"])


def node_style(actors: DataFrame, colours: dict[str, str], default_bloc: str, default_colour: str) -> DataFrame:
    """(actor, bloc, colour), defaults where a bloc or colour isn't given."""
    table = F.create_map(*(F.lit(x) for kv in colours.items() for x in kv)) if colours else F.create_map().cast("map<string,string>")
    rows = actors.withColumn("bloc", F.coalesce("bloc", F.lit(default_bloc)))
    return rows.select("actor", "bloc", F.coalesce(F.try_element_at(table, F.col("bloc")), F.lit(default_colour)).alias("colour"))


def radial_layout(actors: DataFrame, anchors: dict[str, tuple[float, float]], primary: dict[str, str]) -> DataFrame:
    """(actor, x, y): a bloc's primary actor at its anchor, the others on a ring around it in order."""
    spots = F.create_map(*(x for b, (ax, ay) in anchors.items() for x in (F.lit(b), F.array(F.lit(ax), F.lit(ay)))))
    heads = F.create_map(*(F.lit(x) for kv in primary.items() for x in kv)) if primary else F.create_map().cast("map<string,string>")
    at = F.coalesce(F.try_element_at(spots, F.col("bloc")), F.array(F.lit(0.5), F.lit(0.5)))
    rows = actors.withColumn("head", F.coalesce(F.try_element_at(heads, F.col("bloc")) == F.col("actor"), F.lit(False)))
    bloc = Window.partitionBy("bloc")
    rows = rows.withColumn("led", F.max("head").over(bloc)).withColumn("n", F.count_if(~F.col("head")).over(bloc)).withColumn("i", F.row_number().over(bloc.orderBy("head", "ord")) - 1)
    turn = F.when(F.col("led"), (F.col("i") + 1) * (2 * F.pi() / (F.col("n") + 1))).otherwise(F.col("i") * (2 * F.pi() / F.greatest(F.lit(1), F.col("n")))) - F.pi() / 2
    radius = F.least(F.lit(RING[1]), RING[0] + RING[2] * F.col("n"))
    x, y = at[0] + radius * F.cos(turn), at[1] + radius * F.sin(turn) * STRETCH
    clamp = lambda v, low, high: F.greatest(F.lit(low), F.least(F.lit(high), v))
    return rows.select("actor", F.when(F.col("head"), at[0]).otherwise(clamp(x, *X_BOUNDS)).alias("x"), F.when(F.col("head"), at[1]).otherwise(clamp(y, *Y_BOUNDS)).alias("y"))


def ranked_nodes(sizes: DataFrame, scores: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, actor, size, broker, broker_g, broker_real, rank) from scores(keys, actor, flat, graded, brokering).

    Scores are rounded to four digits; the rank is that on the whole leaderboard, null
    without a positive score. Nodes that are zero in all of the first three are left out.
    """
    rows = sizes.join(scores, [*keys, "actor"], "full").na.fill(0, ["size", "flat", "graded", "brokering"])
    rows = rows.select(*keys, "actor", "size", (F.col("flat") > 0).alias("_on"), *(F.bround(c, 4).alias(name) for c, name in (("flat", "broker"), ("graded", "broker_g"), ("brokering", "broker_real"))))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_on"), F.desc("broker"), F.desc("actor")))
    return rows.withColumn("rank", F.when(F.col("_on"), rank)).drop("_on").where("size <> 0 OR broker <> 0 OR broker_g <> 0 OR rank IS NOT NULL")


def extremes(nodes: DataFrame) -> DataFrame:
    """One row (max_size, max_score) over all frames' nodes, 1 and 0.001 at least."""
    return nodes.agg(F.greatest(F.max("size"), F.lit(1)).alias("max_size"), F.greatest(F.max("broker"), F.lit(0.001)).alias("max_score"))


def export_frames(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...], focus: str, grid: DataFrame, keep: int = 8) -> DataFrame:
    """(keys, frame): each frame of grid(keys, frame_date) as one compact JSON text, for a display that indexes frames by key.

    nodes are ranked_nodes(): the first `keep` make the leaderboard, and the focus has its
    rank on the whole one, null where it has no positive score.
    """
    key = list(keys)
    shown = F.when(F.expr("size <> 0 OR broker <> 0 OR broker_g <> 0"), F.struct("actor", "size", "broker", "broker_g", "broker_real"))
    best = F.when(F.col("rank") <= keep, F.struct("rank", "actor", F.col("broker").alias("score")))
    n = nodes.groupBy(*key).agg(F.sort_array(F.collect_list(shown)).alias("nodes"), F.sort_array(F.collect_list(best)).alias("leaderboard"), F.max(F.when(F.col("actor") == focus, F.col("rank"))).alias("focus_rank"))
    e = edges.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*ARC, "coop", "conf", "neu", "w", "pol"))).alias("edges"))
    rows = grid.join(n, key, "left").join(e, key, "left")
    full = [F.coalesce(c, F.array()).alias(c) for c in ("nodes", "edges", "leaderboard")]
    return rows.select(*key, F.to_json(F.struct(F.col("frame_date").cast("string").alias("date"), *full, "focus_rank"), {"ignoreNullFields": "false"}).alias("frame"))
