"""Signed networks: vote aggregation, projections, engagement, and measures that are plain joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config
from ..functions.verbs import with_substance

KEYS = ("outlet", "phase")
ARC = ("source", "target")


def is_brokering(verb: Column) -> Column:
    """The verb holds a brokering substring; as substrings go, `host` is also in `hostile`."""
    return reduce(lambda a, b: a | b, (F.coalesce(verb, F.lit("")).contains(v) for v in config.BROKERING))


def signed_network(edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row for each arc and key: coop, conf, neu and broker votes, and signed = coop - conf. One shuffle, summed before it."""
    coop = F.col("valence") == "coop"
    votes = edges.groupBy(*keys, *ARC).agg(
        F.count_if(coop).alias("coop"), F.count_if(F.col("valence") == "conflict").alias("conf"), F.count_if(F.col("valence") == "neutral").alias("neu"), F.count_if(coop & is_brokering(F.col("raw_verb"))).alias("broker")
    )
    return votes.withColumn("signed", F.col("coop") - F.col("conf"))


def verb_histogram(edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, source, target, raw_verb, n)."""
    return edges.groupBy(*keys, *ARC, "raw_verb").agg(F.count("*").alias("n"))


def verb_maps(edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, source, target, verbs map)."""
    rows = verb_histogram(edges, keys)
    return rows.groupBy(*keys, *ARC).agg(F.map_from_entries(F.collect_list(F.struct("raw_verb", "n"))).alias("verbs"))


def project(network: DataFrame, field: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Arcs on which field is positive, with strength and distance = 1 / strength. Fields coop, conf, broker give the three views."""
    return network.where(F.col(field) > 0).select(*keys, *ARC, F.col(field).cast("double").alias("strength"), (F.lit(1.0) / F.col(field)).alias("distance"))


def total_contact(network: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return project(network.withColumn("total", F.col("coop") + F.col("conf") + F.col("neu")), "total", keys)


def substance_view(edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Cooperation arcs whose strength is the sum of the substance of positive edges; reporting verbs add nothing and drop out."""
    positive = with_substance(edges.where("polarity = 'positive'")).where("substance > 0")
    sums = positive.groupBy(*keys, *ARC).agg(F.sum("substance").alias("strength"))
    return sums.withColumn("distance", F.lit(1.0) / F.col("strength"))


def event_network(edges: DataFrame, valence: str | None = "coop", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Event-typed arcs: count and strength = summed |weight|, of one valence or of all."""
    rows = edges.where(F.col("valence") == valence) if valence else edges
    sums = rows.groupBy(*keys, *ARC).agg(F.count("*").alias("count"), F.sum(F.abs("weight")).alias("strength"))
    return sums.withColumn("distance", F.lit(1.0) / F.col("strength"))


def engagement(network: DataFrame, keys: tuple[str, ...] = KEYS, include_neutral: bool = True) -> DataFrame:
    """(keys, actor, size): votes on arcs at the actor, either end; only actors with arcs have a row."""
    weight = F.col("coop") + F.col("conf") + (F.col("neu") if include_neutral else F.lit(0))
    ends = network.select(*keys, F.explode(F.array("source", "target")).alias("actor"), weight.alias("w"))
    return ends.groupBy(*keys, "actor").agg(F.sum("w").alias("size"))


def influence_share(network: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, actor, size, share of the key's total)."""
    sizes = engagement(network, keys)
    total = F.sum("size").over(Window.partitionBy(*keys))
    return sizes.withColumn("share", F.col("size") / F.when(total == 0, 1).otherwise(total))


def with_all_actors(scores: DataFrame, actors: DataFrame, keys: tuple[str, ...], **zero) -> DataFrame:
    """A row for every key and actor: the dense grid of a small dimension, missing scores set."""
    grid = scores.select(*keys).distinct().join(F.broadcast(actors.select("actor", "ord")), how="cross")
    return grid.join(scores, [*keys, "actor"], "left").na.fill(zero)


def liaison(view: DataFrame, blocs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, broker, liaison): sum of the weaker tie over two-paths a -> broker -> b of three different blocs, for every broker at once.

    Arcs are at most actors squared a key, so the self-join is bounded by the vocabulary
    and not by the number of edges.
    """
    bloc = F.broadcast(blocs.select("actor", "bloc"))
    into = view.select(*keys, F.col("source").alias("a"), F.col("target").alias("broker"), F.col("strength").alias("s1"))
    out = view.select(*keys, F.col("source").alias("broker"), F.col("target").alias("b"), F.col("strength").alias("s2"))
    named = lambda df, c: df.join(bloc.select(F.col("actor").alias(c), F.col("bloc").alias(f"bloc_{c}")), c)
    paths = named(into, "a").join(named(named(out, "b"), "broker"), [*keys, "broker"])
    paths = paths.where("a <> b AND bloc_a <> bloc_broker AND bloc_b <> bloc_broker AND bloc_a <> bloc_b")
    return paths.groupBy(*keys, "broker").agg(F.sum(F.least("s1", "s2")).alias("liaison"))


def undirected(view: DataFrame, keys: tuple[str, ...] = KEYS, reciprocal: str = "sum", order: DataFrame | None = None) -> DataFrame:
    """(keys, a, b, weight), a < b by name: reciprocal arcs summed, or (`later_node`) the arc that leaves the later actor in order."""
    a, b = F.least(*ARC), F.greatest(*ARC)
    if reciprocal == "sum":
        return view.groupBy(*keys, a.alias("a"), b.alias("b")).agg(F.sum("strength").alias("weight"))
    ranked = view.join(F.broadcast(order.select(F.col("actor").alias("source"), "ord")), "source")
    return ranked.groupBy(*keys, a.alias("a"), b.alias("b")).agg(F.max_by("strength", "ord").alias("weight"))


def _mutual(view: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, u, v, m): the sum of both arcs, seen from either end."""
    both = view.select(*keys, F.explode(F.array(F.struct(F.col("source").alias("u"), F.col("target").alias("v")), F.struct(F.col("target").alias("u"), F.col("source").alias("v")))).alias("p"), "strength")
    return both.select(*keys, "p.u", "p.v", "strength").where("u <> v").groupBy(*keys, "u", "v").agg(F.sum("strength").alias("m"))


def constraint(view: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, actor, constraint): structural-hole constraint of the undirected, weighted ties; actors without ties have no row."""
    m = _mutual(view, keys)
    p = m.withColumn("p", F.col("m") / F.sum("m").over(Window.partitionBy(*keys, "u"))).select(*keys, "u", "v", "p")
    second = p.withColumnsRenamed({"v": "q", "p": "p1"}).join(p.withColumnsRenamed({"u": "q", "p": "p2"}), [*keys, "q"]).where("u <> v")
    around = second.groupBy(*keys, "u", "v").agg(F.sum(F.col("p1") * F.col("p2")).alias("indirect"))
    local = p.join(around, [*keys, "u", "v"], "left").withColumn("c", F.pow(F.col("p") + F.coalesce("indirect", F.lit(0.0)), 2))
    return local.groupBy(*keys, F.col("u").alias("actor")).agg(F.sum("c").alias("constraint"))


def effective_size(view: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, actor, effective_size): neighbours less their redundancy, weighted form."""
    m = _mutual(view, keys)
    at = Window.partitionBy(*keys, "u")
    p = m.withColumn("p", F.col("m") / F.sum("m").over(at)).withColumn("rel", F.col("m") / F.max("m").over(at))
    pairs = p.select(*keys, "u", F.col("v").alias("q"), "p").join(p.select(*keys, F.col("u").alias("v"), F.col("v").alias("q"), "rel"), [*keys, "q"]).where("u <> v")
    redundant = pairs.groupBy(*keys, "u", "v").agg(F.sum(F.col("p") * F.col("rel")).alias("r"))
    ties = p.select(*keys, "u", "v").join(redundant, [*keys, "u", "v"], "left")
    return ties.groupBy(*keys, F.col("u").alias("actor")).agg(F.sum(1 - F.coalesce("r", F.lit(0.0))).alias("effective_size"))


def ranked(scores: DataFrame, score: str, order: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """scores(keys, actor, …) with rank by falling score; ties by the actors' order. Zero scores are ranked."""
    by = Window.partitionBy(*keys).orderBy(F.desc(score), "ord")
    return scores.join(F.broadcast(order.select("actor", "ord")), "actor").withColumn("rank", F.row_number().over(by)).drop("ord")


def pivoted(scores: DataFrame, score: str, actors: list[str], keys: tuple[str, ...] = KEYS, digits: int = 3) -> DataFrame:
    """One column for each listed actor, missing ones 0, rounded half to even."""
    wide = scores.groupBy(*keys).pivot("actor", actors).agg(F.first(score)).na.fill(0.0)
    return wide.select(*keys, *(F.bround(F.col(f"`{a}`"), digits).alias(a) for a in actors))


def positive_counts(edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return edges.groupBy(*keys).agg(F.count_if(F.col("polarity") == "positive").alias("pos_edges"))


def polarity_label(coop: Column, conf: Column) -> Column:
    return F.when(coop > conf, "coop").when(conf > coop, "conflict").otherwise("neutral")
