"""Queries on signed networks and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config
from ..functions import verbs
from ..operators import gates, measures as M, network as N
from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BROKERS = " OR ".join(f"raw_verb LIKE '%{v}%'" for v in config.BROKERING)
E = f"WITH e AS ({X.EDGES_SQL}), net AS (SELECT outlet, phase, source, target, count(*) FILTER (valence = 'coop') AS coop, count(*) FILTER (valence = 'conflict') AS conf, count(*) FILTER (valence = 'neutral') AS neu, count(*) FILTER (valence = 'coop' AND ({BROKERS})) AS broker FROM e GROUP BY ALL)"
ACTORS = "actors AS (SELECT n_name AS actor, r_name AS bloc, n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def net(spark: SparkSession, d: str) -> DataFrame:
    return N.signed_network(X.edges(spark, d))


def coop(spark: SparkSession, d: str) -> DataFrame:
    return N.project(net(spark, d), "coop")


@query(f"{E} SELECT outlet, phase, source, target, coop, conf, neu, broker, coop - conf AS signed FROM net")
def signed_network(spark, d):
    return net(spark, d)


@query(f"{E}, {ACTORS} SELECT i.outlet, i.phase, i.target AS broker, sum(CAST(least(i.coop, o.coop) AS DOUBLE)) AS liaison FROM net i JOIN net o ON i.outlet = o.outlet AND i.phase = o.phase AND i.target = o.source JOIN actors a ON i.source = a.actor JOIN actors k ON i.target = k.actor JOIN actors b ON o.target = b.actor WHERE i.coop > 0 AND o.coop > 0 AND i.source <> o.target AND a.bloc <> k.bloc AND b.bloc <> k.bloc AND a.bloc <> b.bloc GROUP BY ALL")
def liaison(spark, d):
    return N.liaison(coop(spark, d), X.actors(spark, d))


@query(f"{E} SELECT outlet, phase, source, target, raw_verb, count(*) AS n FROM e GROUP BY ALL")
def verb_histogram(spark, d):
    return N.verb_histogram(X.edges(spark, d))


@query(f"{E} SELECT outlet, phase, source, target, CAST(sum(1) AS BIGINT) AS votes, count(DISTINCT raw_verb) AS verbs FROM e GROUP BY ALL")
def verb_maps(spark, d):
    m = N.verb_maps(X.edges(spark, d))
    return m.select("outlet", "phase", "source", "target", F.aggregate(F.map_values("verbs"), F.lit(0).cast("long"), lambda a, x: a + x).alias("votes"), F.size("verbs").cast("long").alias("verbs"))


for _field, _name in (("coop", "cooperation_view"), ("conf", "conflict_view"), ("broker", "brokering_view")):
    QUERIES[_name] = lambda spark, d, field=_field: N.project(net(spark, d), field)
    ORACLES[_name] = f"{E} SELECT outlet, phase, source, target, CAST({_field} AS DOUBLE) AS strength, 1.0::DOUBLE / {_field} AS distance FROM net WHERE {_field} > 0"


@query(f"{E} SELECT outlet, phase, source, target, CAST(coop + conf + neu AS DOUBLE) AS strength, 1.0::DOUBLE / (coop + conf + neu) AS distance FROM net")
def engagement_view(spark, d):
    return N.total_contact(net(spark, d))


SIZES = "sizes AS (SELECT outlet, phase, actor, CAST(sum(w) AS BIGINT) AS size FROM (SELECT outlet, phase, source AS actor, coop + conf + neu AS w FROM net UNION ALL SELECT outlet, phase, target, coop + conf + neu FROM net) GROUP BY ALL)"


@query(f"{E}, {ACTORS}, {SIZES} SELECT g.outlet, g.phase, a.actor, coalesce(size, 0) AS size FROM (SELECT DISTINCT outlet, phase FROM net) g CROSS JOIN actors a LEFT JOIN sizes s ON s.outlet = g.outlet AND s.phase = g.phase AND s.actor = a.actor")
def engagement(spark, d):
    return N.with_all_actors(N.engagement(net(spark, d)), X.actors(spark, d), N.KEYS, size=0).drop("ord")


@query(f"{E}, {SIZES} SELECT outlet, phase, actor, size, size / (sum(size) OVER (PARTITION BY outlet, phase))::DOUBLE AS share FROM sizes")
def influence_share(spark, d):
    return N.influence_share(net(spark, d))


@query(f"{E} SELECT outlet, phase, count(*) FILTER (polarity = 'positive') AS pos_edges FROM e GROUP BY ALL")
def positive_edges(spark, d):
    return N.positive_counts(X.edges(spark, d))


@query(f"{E} SELECT outlet, phase, source, target, CASE WHEN coop > conf THEN 'coop' WHEN conf > coop THEN 'conflict' ELSE 'neutral' END AS pol FROM net")
def polarity_labels(spark, d):
    return net(spark, d).select("outlet", "phase", "source", "target", N.polarity_label(F.col("coop"), F.col("conf")).alias("pol"))


def _tiers() -> str:
    rows = [(f, p, *v) for p, t in (("positive", verbs.POSITIVE_TIERS), ("negative", verbs.NEGATIVE_TIERS)) for f, v in verbs.tier_rows(t).items()]
    rows += [(f, p, 99, 0.0, "report_drop") for p in ("positive", "negative") for f in sorted({f for b in verbs.REPORTING for f in verbs.inflected(b)})]
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in verbs.IRREGULAR.items())
    particles = ", ".join(f"'{w}'" for w in verbs.PARTICLES)
    values = ", ".join(f"('{f}', '{p}', {k}, {w}::DOUBLE, '{label}')" for f, p, k, w, label in rows)
    return f"""tiers(form, pol, prio, weight, label) AS (VALUES {values}),
    said AS (SELECT DISTINCT raw_verb, polarity FROM e),
    words AS (SELECT raw_verb, polarity, CASE t {irregular} ELSE t END AS form FROM (SELECT raw_verb, polarity, unnest(regexp_extract_all(lower(raw_verb), '[a-z]+')) AS t FROM said) WHERE t NOT IN ({particles})),
    hits AS (SELECT raw_verb, polarity, min_by(weight, prio) AS weight, min_by(label, prio) AS label FROM words JOIN tiers ON words.form = tiers.form AND words.polarity = tiers.pol GROUP BY ALL),
    graded AS (SELECT s.raw_verb, s.polarity, CASE WHEN s.polarity = 'neutral' THEN 0.0 WHEN h.weight IS NOT NULL THEN h.weight WHEN s.polarity = 'positive' THEN 2.0 ELSE -3.0 END::DOUBLE AS substance,
      CASE WHEN s.polarity = 'neutral' THEN 'neutral' WHEN h.label IS NOT NULL THEN h.label WHEN s.polarity = 'positive' THEN 'other_positive' ELSE 'other_negative' END AS tier FROM said s LEFT JOIN hits h USING (raw_verb, polarity))"""


@query(f"{E}, {_tiers()} SELECT raw_verb, polarity, substance, tier FROM graded")
def verb_substance(spark, d):
    return verbs.with_substance(X.edges(spark, d).select("raw_verb", "polarity").distinct())


@query(f"{E}, {_tiers()} SELECT outlet, phase, source, target, sum(substance) AS strength, 1.0 / sum(substance) AS distance FROM e JOIN graded USING (raw_verb, polarity) WHERE polarity = 'positive' AND substance > 0 GROUP BY ALL")
def substance_view(spark, d):
    return N.substance_view(X.edges(spark, d))


RELATION = "CASE raw_verb WHEN 'hosted talks' THEN 'HOST_TALKS' WHEN 'urged restraint' THEN 'CONSULT' WHEN 'offered to mediate' THEN 'MEDIATE' WHEN 'said' THEN 'DISAPPROVE' WHEN 'praised' THEN 'SUPPORT' ELSE 'nothing' END"
WEIGHTS = ", ".join(f"('{r}', {w}::DOUBLE, '{v}')" for r, (w, v) in config.RELATIONS.items())


@query(f"{E}, w(relation, weight, val) AS (VALUES {WEIGHTS}), t AS (SELECT outlet, phase, source, target, {RELATION} AS relation FROM e) SELECT outlet, phase, source, target, count(*) AS count, sum(abs(weight)) AS strength, 1.0 / sum(abs(weight)) AS distance FROM t JOIN w USING (relation) WHERE val = 'coop' GROUP BY ALL")
def event_network(spark, d):
    e = X.edges(spark, d).withColumns({"relation": F.expr(RELATION), "text": F.col("raw_verb"), "quote_span": F.col("raw_verb"), "modality": F.lit("asserted"), "speaker": F.lit("official")})
    typed = gates.event_edges(e.select("source", "target", "relation", "text", "quote_span", "modality", "speaker", "doc_id", "phase", "outlet"), tuple(X.axis(spark, d).blocs))
    return N.event_network(typed)


@query(f"{E}, {ACTORS}, {SIZES} SELECT s.outlet, s.phase, s.actor, size, CAST(row_number() OVER (PARTITION BY s.outlet, s.phase ORDER BY size DESC, ord) AS INTEGER) AS rank FROM sizes s JOIN actors a USING (actor)")
def actor_ranks(spark, d):
    return N.ranked(N.engagement(net(spark, d)), "size", X.actors(spark, d))




@query()
def mediators_pivot(spark, d):
    names = list(X.axis(spark, d).mediators)
    scores = N.influence_share(net(spark, d)).select("outlet", "phase", "actor", F.col("share").alias("score"))
    wide = N.pivoted(scores, "score", names, digits=12)
    return wide.toDF("outlet", "phase", *(f"m{i}" for i in range(len(names))))


ORACLES["mediators_pivot"] = f"{E}, {ACTORS}, {SIZES}, s AS (SELECT outlet, phase, actor, ord, round(size / (sum(size) OVER (PARTITION BY outlet, phase))::DOUBLE, 12) AS share FROM sizes JOIN actors USING (actor)) SELECT outlet, phase, " + ", ".join(f"coalesce(max(share) FILTER (ord = {i + 5}), 0.0) AS m{i}" for i in range(5)) + " FROM s GROUP BY outlet, phase"

MUTUAL = "mut AS (SELECT outlet, phase, u, v, sum(s) AS m FROM (SELECT outlet, phase, source AS u, target AS v, coop AS s FROM net WHERE coop > 0 UNION ALL SELECT outlet, phase, target, source, coop FROM net WHERE coop > 0) WHERE u <> v GROUP BY ALL), pr AS (SELECT outlet, phase, u, v, m / (sum(m) OVER (PARTITION BY outlet, phase, u))::DOUBLE AS p, m / (max(m) OVER (PARTITION BY outlet, phase, u))::DOUBLE AS rel FROM mut)"


@query(f"{E}, {MUTUAL}, ind AS (SELECT a.outlet, a.phase, a.u, b.v, sum(a.p * b.p) AS i FROM pr a JOIN pr b ON a.outlet = b.outlet AND a.phase = b.phase AND a.v = b.u AND a.u <> b.v GROUP BY ALL) SELECT pr.outlet, pr.phase, pr.u AS actor, round(sum(pow(p + coalesce(i, 0), 2)), 6) AS constraint_6 FROM pr LEFT JOIN ind ON pr.outlet = ind.outlet AND pr.phase = ind.phase AND pr.u = ind.u AND pr.v = ind.v GROUP BY ALL")
def constraint(spark, d):
    return N.constraint(coop(spark, d)).select("outlet", "phase", "actor", F.round("constraint", 6).alias("constraint_6"))


@query(f"{E}, {MUTUAL}, red AS (SELECT a.outlet, a.phase, a.u, b.u AS v, sum(a.p * b.rel) AS r FROM pr a JOIN pr b ON a.outlet = b.outlet AND a.phase = b.phase AND a.v = b.v AND a.u <> b.u GROUP BY ALL) SELECT pr.outlet, pr.phase, pr.u AS actor, round(sum(1 - coalesce(r, 0)), 6) AS effective_size_6 FROM pr LEFT JOIN red ON pr.outlet = red.outlet AND pr.phase = red.phase AND pr.u = red.u AND pr.v = red.v GROUP BY ALL")
def effective_size(spark, d):
    return N.effective_size(coop(spark, d)).select("outlet", "phase", "actor", F.round("effective_size", 6).alias("effective_size_6"))


@query(f"{E}, {ACTORS} SELECT outlet, phase, least(source, target) AS a, greatest(source, target) AS b, CAST(max_by(coop, ord) AS DOUBLE) AS weight FROM net JOIN actors ON source = actor WHERE coop > 0 GROUP BY ALL")
def undirected_view(spark, d):
    return N.undirected(coop(spark, d), reciprocal="later_node", order=X.actors(spark, d))


@query()
def flow_brokerage(spark, d):
    return M.flow_brokerage(coop(spark, d), X.axis(spark, d).order)


@query()
def centralities(spark, d):
    return M.centralities(coop(spark, d), X.axis(spark, d).order)


@query()
def pairwise_brokerage(spark, d):
    a = X.axis(spark, d)
    return M.pairwise_brokerage(coop(spark, d), a.order, list(a.mediators), *a.dyad)


@query()
def results_table(spark, d):
    """Per outlet and phase: the focus actor's flow scores and ranks, liaison and influence share."""
    a, o = X.axis(spark, d), X.actors(spark, d)
    # The joins behind edges are made once, and so is the network behind four of the measures.
    e = X.written(X.edges(spark, d).select("outlet", "phase", "source", "target", "polarity", "valence", "raw_verb"))
    signed = X.written(N.signed_network(e))
    out = N.positive_counts(e)
    for name, view in (("flat", N.project(signed, "coop")), ("substance", N.substance_view(e)), ("brokering", N.project(signed, "broker"))):
        scores = N.ranked(M.flow_brokerage(view, a.order), "score", o).where(F.col("actor") == a.focus)
        out = out.join(scores.select("outlet", "phase", F.bround("score", 3).alias(f"flow_{name}"), F.col("rank").alias(f"rank_{name}")), ["outlet", "phase"], "left")
    out = out.join(N.liaison(N.project(signed, "coop"), o).where(F.col("broker") == a.focus).select("outlet", "phase", "liaison"), ["outlet", "phase"], "left")
    return out.join(N.influence_share(signed).where(F.col("actor") == a.focus).select("outlet", "phase", F.bround("share", 3).alias("share")), ["outlet", "phase"], "left")


@query()
def bootstrap_interval(spark, d):
    """The 95 % interval of the focus actor's share of paths on the dyad, over 500 resamples of exactly as many documents."""
    a = X.axis(spark, d)
    e = X.edges(spark, d).withColumn("weight", F.when(F.col("valence") == "coop", 1.0).otherwise(0.0))
    return M.exact_bootstrap(e, M.path_share(a.order, a.focus, *a.dyad))


@query()
def phase_comparison(spark, d):
    """Per outlet and phase: sizes, the focus actor's share of paths on the dyad, liaison, centralities and constraint."""
    a, view = X.axis(spark, d), X.written(coop(spark, d))
    key = ["outlet", "phase"]
    at = lambda df: df.where(F.col("actor") == a.focus).drop("actor")
    out = view.groupBy(*key).agg(F.count("*").alias("n_edges"))
    out = out.join(at(M.pairwise_brokerage(view, a.order, [a.focus], *a.dyad)), key, "left").join(at(M.centralities(view, a.order)), key, "left")
    out = out.join(at(N.constraint(view)), key, "left").join(at(N.effective_size(view)), key, "left")
    return out.join(N.liaison(view, X.actors(spark, d)).where(F.col("broker") == a.focus).drop("broker"), key, "left").withColumn("n_nodes", F.lit(len(a.order)))
