"""Closed frequent itemsets of baskets, and their rules.

The frontier is a table of closed sets with their occurrences: a row for each distinct rest
of the baskets that hold a set, cut to the items that still count beside it, with how many
baskets have that rest. A round takes the whole frontier. In a task, a batch of occurrences
is a sparse matrix in numpy, and its product with itself (prefix and one more item by basket,
times basket by item) gives the supports of every extension by a further item at once; the
products of all batches are summed by prefix and pair of items. Items whose column equals
an extension's own support close it. Items are ordered by support, then by id, and an
extension whose closure takes in an item before it belongs to another prefix, its owner,
where the same set is found once: no two prefixes report one set.

Occurrences go on to the next round only for closed sets that have a frequent extension left,
and rests that have become equal meet as one row. A prefix's rows are never gathered: they
are multiplied where they lie, and only sums travel. The number of frequent items is bounded
by the mean basket over the least share, whatever the number of baskets.

A rule's left side is a set that need not be closed; its support is that of its closure,
the most frequent closed set around it, found over the pair of its two rarest items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._run import forget, saved

#: Pairs of items that one product of a batch makes at a time, and sums that a task holds before it passes them on.
PRODUCT_CELLS, HELD_SUMS = 1 << 21, 1 << 20
SUMS = "prefix long, low long, high long, n long"


class Settings:
    """Least support: `count` baskets and one of `share` of all; rules: least confidence in percent, and lift over one."""

    def __init__(self, count: int = 12, share: int = 10_000, confidence: int = 30):
        self.count, self.share, self.confidence = count, share, confidence


def _gather(lists: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row's place among rows, value) of the lists of the rows."""
    n = at[rows + 1] - at[rows]
    place = np.repeat(np.arange(len(rows)), n)
    return place, lists[np.repeat(at[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]


def products(prefix: np.ndarray, core: np.ndarray, weight: np.ndarray, items: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(prefix, low, high, baskets) for pairs low <= high of items that occur together beside a prefix, high after its core; parts of the sums.

    The occurrences of a prefix and one more item are the entries of the lists; each is
    multiplied with its basket's items up to itself.
    """
    length = np.diff(at)
    row = np.repeat(np.arange(len(length)), length)
    entry = np.flatnonzero(items > core[row])
    # Lists ascend, so a basket's items up to an entry are those before it.
    width = entry - at[row[entry]] + 1
    i = 0
    ends = np.cumsum(width)
    while i < len(entry):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PRODUCT_CELLS, side="right")))
        e, w = entry[i:j], width[i:j]
        owner = np.repeat(np.arange(len(e)), w)
        low = items[np.repeat(at[row[e]] - np.concatenate([[0], np.cumsum(w)[:-1]]), w) + np.arange(int(w.sum()))]
        high, r = items[e][owner], row[e][owner]
        yield _summed(prefix[r], low, high, weight[r])
        i = j


def _summed(prefix: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(n):
        return prefix, low, high, n
    order = np.lexsort((high, low, prefix))
    prefix, low, high, n = prefix[order], low[order], high[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
    return prefix[first], low[first], high[first], np.add.reduceat(n, first)


def supports(frontier: DataFrame) -> DataFrame:
    """(prefix, low, high, n): the summed products of frontier(prefix, core, weight, items), items ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, core, weight = (batch.column(i).to_numpy() for i in range(3))
            at = batch.column(3).offsets.to_numpy().astype(np.int64)
            items = batch.column(3).values.to_numpy()[at[0] : at[-1]]
            for part in products(prefix, core, weight, items, at - at[0]):
                held.append(part)
                size += len(part[0])
                if size > HELD_SUMS:
                    sums = _summed(*map(np.concatenate, zip(*held)))
                    if len(sums[0]) > HELD_SUMS // 2:
                        yield _batch(sums)
                        sums = tuple(c[:0] for c in sums)
                    held, size = [sums], len(sums[0])
        if held:
            yield _batch(_summed(*map(np.concatenate, zip(*held))))

    return frontier.select("prefix", "core", "weight", "items").mapInArrow(run, SUMS).groupBy("prefix", "low", "high").agg(F.sum("n").alias("n"))


def _batch(sums: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in sums], ["prefix", "low", "high", "n"])


def extensions(sums: DataFrame, cores: DataFrame) -> DataFrame:
    """(prefix, item, support, closure, counting): the frequent extensions of prefixes that they own.

    sums(prefix, low, high, n) are frequent only; cores(prefix, core). closure: the items,
    `item` among them, in all its baskets; counting: those in fewer, from which sets go on;
    empty unless one comes after `item`.
    """
    known = sums.join(cores, "prefix")
    upper = known.select("prefix", F.col("high").alias("item"), F.col("low").alias("with"), "n")
    lower = known.where((F.col("low") < F.col("high")) & (F.col("low") > F.col("core"))).select("prefix", F.col("low").alias("item"), F.col("high").alias("with"), "n")
    sides = upper.unionByName(lower).groupBy("prefix", "item").agg(F.max(F.when(F.col("with") == F.col("item"), F.col("n"))).alias("support"), F.sort_array(F.collect_list(F.struct("with", "n"))).alias("sides"))
    of = lambda equal: F.transform(F.filter("sides", lambda x: (x["n"] == F.col("support")) == F.lit(equal)), lambda x: x["with"])
    out = sides.select("prefix", "item", "support", of(True).alias("closure"), of(False).alias("counting"))
    out = out.where(F.array_min("closure") == F.col("item"))
    return out.withColumn("counting", F.when(F.coalesce(F.array_max("counting"), F.lit(-1)) > F.col("item"), F.col("counting")).otherwise(F.array().cast("array<long>")))


def closed_itemsets(baskets: DataFrame, basket: str, item: str, settings: Settings | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(sets, items, baskets): (set, support, ranks) of every closed frequent itemset, (rank, item, support) of the frequent items, the number of baskets.

    baskets(basket, item) may repeat rows; rows with a null basket or item are left out.
    """
    s = settings or Settings()
    rows = baskets.select(F.col(basket).alias("basket"), F.col(item).cast("long").alias("item")).where("basket IS NOT NULL AND item IS NOT NULL")
    total = rows.select("basket").distinct().count()
    least = max(s.count, -(-total // s.share))
    counts = rows.distinct().groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= least)
    # Ascending in range partitions: ranks keep the order of (support, item).
    items = saved(counts.repartitionByRange("support", "item").sortWithinPartitions("support", "item").withColumn("rank", F.monotonically_increasing_id()))
    kept = rows.join(items.select("item", "rank", "support"), "item")
    lists = kept.groupBy("basket").agg(F.sort_array(F.collect_set("rank")).alias("items"))
    frontier = lists.groupBy("items").agg(F.count("*").alias("weight"))
    # Items of all baskets are the closure of the empty set, and of every set.
    always = items.where(F.col("support") == total).agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    frontier = frontier.join(F.broadcast(always), how="cross").select(F.lit(-1).cast("long").alias("prefix"), F.lit(-1).cast("long").alias("core"), "weight", F.array_except("items", "ranks").alias("items")).where(F.size("items") > 0)
    frontier = saved(frontier)
    sets = saved(always.select(F.lit(-1).cast("long").alias("set"), F.lit(-1).cast("long").alias("core"), F.lit(total).cast("long").alias("support"), "ranks"))
    found, level = sets.where(F.size("ranks") > 0), 0
    while True:
        sums = supports(frontier).where(F.col("n") >= least)
        own = extensions(sums, sets.select(F.col("set").alias("prefix"), "core"))
        # Set numbers of a round begin where no other round's do.
        number = F.monotonically_increasing_id() + F.lit(level << 50)
        grown = saved(own.join(sets.select(F.col("set").alias("prefix"), "ranks"), "prefix").select(number.alias("set"), "prefix", F.col("item").alias("core"), "support", F.array_sort(F.concat("ranks", "closure")).alias("ranks"), "counting"))
        found = found.unionByName(grown.select("set", "core", "support", "ranks"))
        open_ = grown.where(F.size("counting") > 0).select("prefix", F.col("core").alias("item"), "set", "counting")
        if not open_.limit(1).count():
            break
        # A list's last item extends to nothing further.
        branched = frontier.select("prefix", "weight", "items", F.explode(F.slice("items", 1, F.size("items") - 1)).alias("item"))
        rest = branched.join(open_, ["prefix", "item"]).select("set", F.col("item").alias("core"), "weight", F.array_intersect("items", "counting").alias("items"))
        rest = rest.where((F.size("items") > 0) & (F.array_max("items") > F.col("core")))
        after = saved(rest.groupBy(F.col("set").alias("prefix"), "core", "items").agg(F.sum("weight").alias("weight")).select("prefix", "core", "weight", "items"))
        forget(frontier)
        frontier, sets, level = after, grown.select("set", "core", "support", "ranks"), level + 1
    forget(frontier)
    return found, items, total


def _pairs(ranks: Column) -> Column:
    """All pairs of a list, in its order."""
    n = F.size(ranks)
    return F.flatten(F.transform(ranks, lambda x, i: F.transform(F.slice(ranks, i + 2, n), lambda y: F.struct(x.alias("one"), y.alias("two")))))


def rules(sets: DataFrame, items: DataFrame, total: int, confidence: int) -> DataFrame:
    """(set, rules): an array of (c, a, s) ascending by c for the sets with rules.

    Taking item c from a set leaves a rest of support a; s is the support of c.
    """
    several = sets.where(F.size("ranks") > 1)
    taken = several.select("set", "support", F.explode("ranks").alias("rank"), F.col("ranks").alias("all"))
    taken = taken.select("set", "support", "rank", F.array_except("all", F.array("rank")).alias("rest"))
    # A rest of one item has that item's support; of more, its closure's.
    one = taken.where(F.size("rest") == 1).join(items.select(F.col("rank").alias("only"), F.col("support").alias("a")), F.col("rest")[0] == F.col("only")).select("set", "support", "rank", "a")
    more = taken.where(F.size("rest") > 1).withColumn("one", F.col("rest")[0]).withColumn("two", F.col("rest")[1])
    around = several.select(F.col("support").alias("of"), F.col("ranks").alias("closed"), F.explode(_pairs(F.col("ranks"))).alias("p")).select("of", "closed", "p.one", "p.two")
    met = more.join(around, ["one", "two"]).where(F.size(F.array_except("rest", "closed")) == 0)
    more = met.groupBy("set", "support", "rank").agg(F.max("of").alias("a"))
    made = one.unionByName(more).join(items.select("rank", F.col("item").alias("c"), F.col("support").alias("s")), "rank")
    made = made.where((F.col("support") * 100 >= F.col("a") * confidence) & (F.col("support") * total > F.col("a") * F.col("s")))
    return made.groupBy("set").agg(F.array_sort(F.collect_list(F.struct("c", "a", "s"))).alias("rules"))


def itemsets_with_rules(baskets: DataFrame, basket: str = "basket", item: str = "item", settings: Settings | None = None) -> DataFrame:
    """(items, n_items, support, n_rules, best_item, rules_sha256) of every closed frequent itemset.

    baskets has one row for each item of a basket, in any number of copies; rows with a null
    basket or item are left out. items are ids in ascending order, joined by commas.
    best_item is the c of the set's rule with the smallest a, then the smallest c; null
    without rules. Other columns are not looked at. An empty table gives an empty result.
    """
    s = settings or Settings()
    sets, items, total = closed_itemsets(baskets, basket, item, s)
    found = rules(sets, items, total, s.confidence)
    named = sets.select("set", "support", F.explode("ranks").alias("rank")).join(items.select("rank", "item"), "rank").groupBy("set", "support").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    text = F.coalesce(F.concat_ws(";", F.transform("rules", lambda r: F.concat_ws(":", r["c"].cast("string"), r["a"].cast("string"), r["s"].cast("string")))), F.lit(""))
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"].alias("a"), r["c"].alias("c"))))["c"]
    out = named.join(found, "set", "left")
    return out.select(F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("items"), F.size("ids").cast("long").alias("n_items"), "support", F.coalesce(F.size("rules"), F.lit(0)).cast("long").alias("n_rules"), best.alias("best_item"), F.sha2(text.cast("binary"), 256).alias("rules_sha256"))


def sold(lines: DataFrame) -> DataFrame:
    """(basket, item) of sale lines with any flag but returned; a null flag isn't returned."""
    return lines.where("flag IS DISTINCT FROM 'returned'").select(F.col("sale_id").alias("basket"), F.col("item_id").alias("item"))


def op13_itemsets(spark, sf_dir: str) -> DataFrame:
    return itemsets_with_rules(sold(spark.read.parquet(f"{sf_dir}/sale_lines.parquet")))


#: Every frequent itemset by growing lists of baskets, those without an equally frequent superset, and the rules of each.
ORACLE = """
WITH RECURSIVE b AS (SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE flag IS DISTINCT FROM 'returned' AND sale_id IS NOT NULL AND item_id IS NOT NULL),
total AS (SELECT count(DISTINCT sale_id) AS n FROM b),
one AS (SELECT item_id, list(sale_id ORDER BY sale_id) AS sales, count(*) AS s FROM b GROUP BY item_id HAVING count(*) >= 12 AND count(*) * 10000 >= (SELECT n FROM total)),
two AS (SELECT x.item_id AS i, y.item_id AS j FROM b x JOIN b y ON x.sale_id = y.sale_id AND x.item_id < y.item_id
  WHERE x.item_id IN (SELECT item_id FROM one) AND y.item_id IN (SELECT item_id FROM one) GROUP BY ALL HAVING count(*) >= 12 AND count(*) * 10000 >= (SELECT n FROM total)),
sets AS (SELECT [item_id] AS items, sales, s FROM one
  UNION ALL SELECT * FROM (SELECT list_append(items, j) AS items, list_intersect(x.sales, o.sales) AS sales, CAST(len(list_intersect(x.sales, o.sales)) AS BIGINT) AS s
    FROM sets x JOIN two ON items[len(items)] = i JOIN one o ON o.item_id = j) WHERE s >= 12 AND s * 10000 >= (SELECT n FROM total)),
frequent AS (SELECT items, s FROM sets),
taken AS (SELECT items, s, c, list_filter(items, lambda x: x <> c) AS rest FROM (SELECT items, s, unnest(items) AS c FROM frequent WHERE len(items) > 1)),
closed AS (SELECT items, s FROM frequent f WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.rest = f.items AND t.s = f.s)),
made AS (SELECT t.items, t.c, f.s AS a, o.s AS s FROM taken t JOIN closed k ON t.items = k.items JOIN frequent f ON f.items = t.rest JOIN one o ON o.item_id = t.c
  WHERE 100 * t.s >= 30 * f.s AND t.s * (SELECT n FROM total) > f.s * o.s),
found AS (SELECT items, count(*) AS n, arg_min(c, a * 1000000000 + c) AS best, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS text FROM made GROUP BY items)
SELECT array_to_string(k.items, ',') AS items, CAST(len(k.items) AS BIGINT) AS n_items, k.s AS support, coalesce(n, 0) AS n_rules, best AS best_item, sha256(coalesce(text, '')) AS rules_sha256
FROM closed k LEFT JOIN found f ON k.items = f.items
"""
