"""Mixing sources to target weights, in DataFrame operations only.

Documents hang in a tree of domain, language and source. A budget of tokens flows from
the root to the leaves by the nodes' weights. A node can't take more than its leaves
hold over the allowed epochs; what it can't take goes to its siblings by their weights,
and only what a whole subtree can't take goes up and over to the subtree's siblings.
Shares are whole tokens, by largest remainder. A leaf's budget is filled by whole epochs
and then by a prefix of one more epoch, in which its documents come in an order seeded
by the epoch; the last document of a prefix may be taken in part.

A leaf is never put into one task: its seeded order is cut by leading digits of the
order's hash, the cuts' sums find the one cut in which the prefix ends, and only the
documents of that cut are ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._run import saved

LEVELS = ("domain", "lang", "source")
#: About so many documents lie in the cut where a leaf's prefix ends.
CUT_DOCS = 1000
#: Leaf tables of this many rows (some 200 bytes each) go to every task; larger ones meet their documents in SALTS parts a leaf.
SENT_LEAVES, SALTS = 100_000, 64


def count_tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def weight(level: int, weights: dict[str, int]) -> Column:
    """The weight of the node at `level`: that of its path (as in `core/en/src1`), else of `*` for its own name (`*/en`), else 1."""
    path = F.concat_ws("/", *LEVELS[: level + 1])
    name = F.concat(F.lit("*/" * level), F.col(LEVELS[level]))
    known = {k: v for k, v in weights.items() if k.count("/") == level}
    if not known:
        return F.lit(1).cast("long")
    table = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, path), F.try_element_at(table, name), F.lit(1)).cast("long")


def shares(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes(parent..., name, weight, cap, available) with `budget`: how `available`, the parent's budget, is split.

    In order of cap / weight, a node is full while its cap is no more than its share of
    what the nodes before it have left; the rest split by weight.
    """
    wide = "decimal(38,0)"
    siblings = Window.partitionBy(*parent)
    order = siblings.orderBy("ratio", name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    n = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(-1.0)))
    n = n.withColumn("gone", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("heavy", F.sum("weight").over(after))
    n = n.withColumn("full", F.col("cap").cast("decimal(19,0)") * F.col("heavy").cast("decimal(19,0)") <= F.col("weight").cast("decimal(19,0)") * (F.col("available") - F.col("gone")).cast("decimal(19,0)"))
    n = n.withColumn("left", F.col("available") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(siblings))
    n = n.withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(siblings))
    n = n.withColumn("due", F.when(~F.col("full"), (F.col("weight").cast("decimal(19,0)") * F.col("left").cast("decimal(19,0)")).cast(wide)))
    n = n.withColumn("whole", F.expr("due div open")).withColumn("part", F.expr("due % open"))
    n = n.withColumn("spare", F.col("left") - F.coalesce(F.sum("whole").over(siblings), F.lit(0)))
    n = n.withColumn("turn", F.row_number().over(siblings.orderBy(F.col("full"), F.desc_nulls_last("part"), name)))
    return n.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.col("whole") + F.when(F.col("turn") <= F.col("spare"), 1).otherwise(0)).cast("long"))


def budgets(leaves: DataFrame, weights: dict[str, int], percent: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, docs, tokens, budget) of leaves(domain, lang, source, docs, tokens); percent of all tokens is given out."""
    node = leaves
    for k in range(3):
        node = node.withColumn(f"weight{k}", weight(k, weights))
    dead = reduce(lambda a, b: a | b, (F.col(f"weight{k}") <= 0 for k in range(3)))
    node = node.withColumn("cap2", F.when(dead, 0).otherwise(F.col("tokens") * max_epochs)).withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))
    up = node
    for k in (1, 0):
        up = up.withColumn(f"cap{k}", F.sum("cap2").over(Window.partitionBy(*LEVELS[: k + 1])))
    up = up.withColumn("total", F.sum("cap2").over(Window.partitionBy()))
    up = up.withColumn("root", F.least(F.expr(f"all_tokens * {int(percent)} div 100"), F.col("total")))
    first = up.select("domain", F.col("weight0").alias("weight"), F.col("cap0").alias("cap"), F.col("root").alias("available"), F.lit(0).alias("top")).distinct()
    first = shares(first, ["top"], "domain").select("domain", F.col("budget").alias("available"))
    second = up.select("domain", "lang", F.col("weight1").alias("weight"), F.col("cap1").alias("cap")).distinct().join(first, "domain")
    second = shares(second, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("available"))
    third = up.select("domain", "lang", "source", "docs", "tokens", F.col("weight2").alias("weight"), F.col("cap2").alias("cap")).join(second, ["domain", "lang"])
    return shares(third, ["domain", "lang"], "source").select(*LEVELS, "docs", "tokens", "budget")


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in an epoch's order: a hexadecimal digest of seed, epoch and id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def with_leaves(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """docs joined with one row for each leaf, without a leaf's documents meeting in one task."""
    if leaves.count() <= SENT_LEAVES:
        return docs.join(F.broadcast(leaves), list(LEVELS))
    salted = leaves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int")).join(salted, [*LEVELS, "salt"]).drop("salt")


def cutoffs(docs: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """leaves with `epochs` (whole ones), and `last_place`, `last_id`, `last_tokens`: where the prefix of the next epoch ends and how much of that document it takes."""
    leaves = leaves.where("budget > 0").withColumn("epochs", F.expr("budget div tokens").cast("int")).withColumn("rest", F.expr("budget % tokens"))
    # Leading digits of the place: as many as make about CUT_DOCS documents a cut.
    digits = F.greatest(F.lit(0), F.least(F.lit(12), F.ceil(F.log(F.col("docs") / CUT_DOCS) / F.log(F.lit(16.0))))).cast("int")
    partial = leaves.where("rest > 0").withColumn("digits", digits)
    rows = with_leaves(docs.where("n_tokens > 0"), partial.select(*LEVELS, "epochs", "digits"))
    rows = rows.withColumn("place", place(seed, F.col("epochs") + 1, F.col("doc_id"))).withColumn("cut", F.expr("substring(place, 1, digits)"))
    sums = rows.groupBy(*LEVELS, "cut").agg(F.sum("n_tokens").alias("held"))
    upto = F.sum("held").over(Window.partitionBy(*LEVELS).orderBy("cut"))
    ends = sums.withColumn("upto", upto).join(partial.select(*LEVELS, "rest"), list(LEVELS)).where("upto >= rest AND upto - held < rest")
    ends = saved(ends)
    # One cut of each leaf: most rows go before anything moves.
    inside = with_leaves(rows.withColumn("own_cut", F.col("cut")).drop("cut"), ends.select(*LEVELS, "cut", "rest", (F.col("upto") - F.col("held")).alias("before"))).where("own_cut = cut")
    running = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    last = inside.withColumn("running", running).where("running >= rest AND running - n_tokens < rest")
    last = last.select(*LEVELS, F.col("place").alias("last_place"), F.col("doc_id").alias("last_id"), (F.col("rest") - F.col("running") + F.col("n_tokens")).alias("last_tokens"))
    return leaves.join(last, list(LEVELS), "left")


def chosen(docs: DataFrame, ends: DataFrame, seed: int) -> DataFrame:
    """Rows of docs(domain, lang, source, doc_id, n_tokens, ...) with `epoch` and `tokens_taken`, one row for each epoch that takes the document."""
    rows = with_leaves(docs.where("n_tokens > 0"), ends.select(*LEVELS, "epochs", "last_place", "last_id", "last_tokens"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs") + 1)))
    rows = rows.withColumn("place", F.when(F.col("epoch") > F.col("epochs"), place(seed, F.col("epoch"), F.col("doc_id"))))
    at = (F.col("place") == F.col("last_place")) & F.col("doc_id").eqNullSafe(F.col("last_id"))
    taken = F.when(F.col("epoch") <= F.col("epochs"), F.col("n_tokens")).when(at, F.least("n_tokens", "last_tokens")).when(F.col("place") < F.col("last_place"), F.col("n_tokens"))
    return rows.withColumn("tokens_taken", taken).where("tokens_taken > 0").drop("epochs", "last_place", "last_id", "last_tokens", "place")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, percent: int = 80, max_epochs: int = 4, seed: int = 5) -> DataFrame:
    """(domain, lang, source, doc_id, n_tokens, epoch, tokens_taken): the mixture of docs(domain, lang, source, doc_id, n_tokens).

    `percent` of all tokens is given out. A null domain, lang or source is a node named
    `(none)`. Documents without tokens are in no mixture. Rows that repeat an id are
    documents of their own with one place in the order; where a prefix ends among them,
    each may be taken in part. An empty table gives an empty mixture.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in LEVELS), F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"))
    docs = saved(docs)
    leaves = docs.groupBy(*LEVELS).agg(F.sum(F.when(F.col("n_tokens") > 0, 1).otherwise(0)).alias("docs"), F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    ends = saved(cutoffs(docs, saved(budgets(saved(leaves), weights or {}, percent, max_epochs)), seed))
    return chosen(docs, ends, seed)


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, percent: int = 80, max_epochs: int = 1, seed: int = 5) -> DataFrame:
    """The rows of documents that the mixture takes, all columns as they are, once for each epoch that takes them.

    A document stays whole where its leaf's prefix ends in it. No text is moved: a row's
    leaf and place in the seeded order decide, against one small row of bounds a leaf.
    """
    kept = [F.col(f"whole_row.{c}").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("whole_row"), docs["doc_id"].cast("long").alias("doc_id"), "text", "lang", "source")
    rows = with_domain(rows).drop("text")
    for c in LEVELS:
        rows = rows.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("(none)")))
    counted = saved(rows.drop("whole_row"))
    leaves = counted.groupBy(*LEVELS).agg(F.sum(F.when(F.col("n_tokens") > 0, 1).otherwise(0)).alias("docs"), F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    ends = saved(cutoffs(counted, saved(budgets(saved(leaves), weights or {}, percent, max_epochs)), seed))
    return chosen(rows, ends, seed).select(*kept)


#: Weights of the registered query and the pipeline.
WEIGHTS = {"core": 3, "tail": 1, "*/en": 4, "*/fr": 2, "*/de": 2, "*/es": 1}


def with_domain(docs: DataFrame) -> DataFrame:
    """documents with the domain of their source (short source names are the core) and their token count."""
    return docs.withColumn("domain", F.when(F.length("source") <= 4, "core").when(F.col("source").isNotNull(), "tail")).withColumn("n_tokens", count_tokens(F.col("text")))


def op2_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(with_domain(docs), WEIGHTS).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "tokens_taken")


def _split(level: str, parent: str, order: str) -> str:
    """The SQL of shares() over a relation of the same columns."""
    return f"""
    SELECT *, CASE WHEN is_full THEN cap ELSE whole + CASE WHEN turn <= left_over - coalesce(sum(whole) OVER ({parent}), 0) THEN 1 ELSE 0 END END AS budget FROM (
      SELECT *, row_number() OVER ({parent} ORDER BY is_full, part DESC NULLS LAST, {order}) AS turn FROM (
        SELECT *, CASE WHEN NOT is_full THEN (weight * left_over) // open_weight END AS whole, CASE WHEN NOT is_full THEN (weight * left_over) % open_weight END AS part FROM (
          SELECT *, available - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({parent}) AS left_over, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({parent}) AS open_weight FROM (
            SELECT *, cap * sum(weight) OVER ({parent} ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= weight * (available - coalesce(sum(cap) OVER ({parent} ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
            FROM {level}))))"""


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN length(source) <= 4 THEN 'core' WHEN source IS NOT NULL THEN 'tail' ELSE '(none)' END AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
weighted AS (SELECT *, CASE domain WHEN 'core' THEN 3 ELSE 1 END::HUGEINT AS w0, CASE lang WHEN 'en' THEN 4 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END::HUGEINT AS w1, tokens * 4 AS cap2 FROM leaves),
root AS (SELECT least(sum(tokens) * 80 // 100, sum(cap2)) AS available FROM weighted),
top AS (SELECT domain, any_value(w0) AS weight, sum(cap2) AS cap, any_value(r.available) AS available FROM weighted, root r GROUP BY domain),
top_shares AS ({_split("top", "", "domain")}),
middle AS (SELECT w.domain, lang, any_value(w1) AS weight, sum(cap2) AS cap, any_value(t.budget) AS available FROM weighted w JOIN top_shares t USING (domain) GROUP BY w.domain, lang),
middle_shares AS ({_split("middle", "PARTITION BY domain", "lang")}),
bottom AS (SELECT w.domain, w.lang, source, tokens, 1::HUGEINT AS weight, cap2 AS cap, m.budget AS available FROM weighted w JOIN middle_shares m ON w.domain = m.domain AND w.lang = m.lang),
shares AS (SELECT domain, lang, source, tokens, budget, budget // tokens AS epochs, budget % tokens AS rest FROM ({_split("bottom", "PARTITION BY domain, lang", "source")}) WHERE budget > 0),
placed AS (SELECT d.*, epochs, rest, md5('5|' || CAST(epochs + 1 AS VARCHAR) || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place FROM d JOIN shares s ON d.domain = s.domain AND d.lang = s.lang AND d.source = s.source WHERE n_tokens > 0),
prefix AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS running FROM placed)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n_tokens, n_tokens AS tokens_taken FROM (SELECT *, unnest(range(1, CAST(epochs AS BIGINT) + 1)) AS epoch FROM placed)
UNION ALL
SELECT doc_id, domain, lang, source, CAST(epochs + 1 AS INTEGER), n_tokens, CAST(least(n_tokens, rest - running + n_tokens) AS BIGINT) FROM prefix WHERE running - n_tokens < rest
"""
