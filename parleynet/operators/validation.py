"""Human validation: samples to label, and scores of what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import one_of, yes_no


def seeded(seed: int, *cols: str) -> Column:
    """An order that looks random and is the same in every run: a digest of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)).cast("binary"))


def sample(df: DataFrame, n: int, *cols: str, seed: int = 0) -> DataFrame:
    """n rows by seeded order, all rows if n is 0 or they are no more; a top-n, nothing is sorted whole."""
    return df if n == 0 else df.orderBy(seeded(seed, *cols), *cols).limit(n)


def stratified(edges: DataFrame, stratum: Column, quotas: dict[str, int], cols: tuple[str, ...], group: str = "outlet", seed: int = 0) -> DataFrame:
    """edges with `stratum`, each stratum cut to its quota: as evenly over groups as they allow, topped up from the rest.

    Only rows that could be chosen, the first `quota` of each (stratum, group), meet in a stratum.
    """
    rows = edges.withColumn("stratum", stratum).withColumn("_h", seeded(seed, *cols)).where(F.col("stratum").isin(*quotas))
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col("stratum")]
    within = Window.partitionBy("stratum", group).orderBy("_h", *cols)
    # By a fixed number first, as Spark then cuts each task's rows before they meet in a group.
    rows = rows.withColumn("_in", F.row_number().over(within)).where(F.col("_in") <= max(quotas.values())).where(F.col("_in") <= quota)
    groups = rows.groupBy("stratum").agg(F.count_distinct(group).alias("_groups"))
    rows = rows.join(F.broadcast(groups), "stratum")
    share = F.greatest(F.lit(1), F.floor(quota / F.col("_groups")))
    rows = rows.withColumn("_late", F.when(F.col("_in") <= share, 0).otherwise(1))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("stratum").orderBy("_late", "_h", *cols))).where(F.col("_k") <= quota)
    return rows.drop("_h", "_in", "_groups", "_late", "_k")


def numbered(rows: DataFrame, cols: tuple[str, ...], seed: int = 0) -> DataFrame:
    """Distinct rows by cols in seeded order, with ids E001, E002, … A sheet is small: it is what people label by hand."""
    one = rows.dropDuplicates(list(cols))
    return one.withColumn("id", F.format_string("E%03d", F.row_number().over(Window.orderBy(seeded(seed, *cols), *cols))))


def sheet(numbered_rows: DataFrame) -> DataFrame:
    """What an annotator sees: nothing of outlet, phase, polarity or verb, and empty label columns."""
    blank = [F.lit("").alias(c) for c in ("actors_ok", "direction_ok", "polarity", "real_event", "mediation", "notes")]
    return numbered_rows.select("id", "source", "target", "quote", "headline", "url", *blank)


def key(numbered_rows: DataFrame) -> DataFrame:
    return numbered_rows.select("id", "outlet", "phase", "source", "target", F.col("polarity").alias("llm_polarity"), F.col("raw_verb").alias("llm_verb"), "doc_id")


def labelled(key_rows: DataFrame, human: DataFrame) -> DataFrame:
    """key joined with a filled sheet, labels read: a_ok, d_ok, r_ok, h_pol, h_med, and `correct` where all four needed ones are there."""
    h = human.select("id", "actors_ok", "direction_ok", F.col("polarity").alias("said"), "real_event", "mediation")
    df = key_rows.join(h, "id")
    df = df.select(*key_rows.columns, yes_no(F.col("actors_ok")).alias("a_ok"), yes_no(F.col("direction_ok")).alias("d_ok"), yes_no(F.col("real_event")).alias("r_ok"), one_of(F.col("said"), "positive", "negative", "neutral").alias("h_pol"), one_of(F.col("mediation"), "mediation", "goodwill", "not").alias("h_med"))
    return df.withColumn("p_ok", F.col("h_pol") == F.col("llm_polarity")).withColumn("correct", F.col("a_ok") & F.col("d_ok") & F.col("p_ok") & F.col("r_ok"))


def complete(rows: DataFrame) -> DataFrame:
    return rows.dropna(subset=["a_ok", "d_ok", "r_ok", "h_pol"])


def precision(rows: DataFrame, group: str = "outlet") -> DataFrame:
    """(group, n, edge, actors, direction, polarity, real): overall (null group) and by group, in one pass."""
    rate = lambda c, name: F.avg(F.col(c).cast("int")).alias(name)
    rates = [rate("correct", "edge"), rate("a_ok", "actors"), rate("d_ok", "direction"), rate("p_ok", "polarity"), rate("r_ok", "real")]
    return complete(rows).groupingSets([[], [F.col(group)]], F.col(group)).agg(F.count("*").alias("n"), *rates)


def confusion(rows: DataFrame, truth: str = "llm_polarity", said: str = "h_pol", labels: tuple[str, ...] = ("positive", "negative", "neutral")) -> DataFrame:
    return rows.groupBy(truth).pivot(said, list(labels)).count().na.fill(0)


def mediation_share(rows: DataFrame, actors: tuple[str, ...]) -> DataFrame:
    """(n, share, mediation, goodwill, not) of human-positive edges at the actors that have a mediation label."""
    at = rows.where((F.col("source").isin(*actors) | F.col("target").isin(*actors)) & (F.col("h_pol") == "positive") & F.col("h_med").isNotNull())
    counts = [F.count_if(F.col("h_med") == k).alias(k) for k in ("mediation", "goodwill", "not")]
    return at.agg(F.count("*").alias("n"), F.avg((F.col("h_med") == "mediation").cast("int")).alias("share"), *counts)


def agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """(field, n, kappa) of two annotators' sheets, met on their ids: actors_ok, direction_ok, polarity and mediation, rows that either left out or unreadable not counted."""
    read = {"actors_ok": yes_no, "direction_ok": yes_no, "polarity": lambda c: one_of(c, "positive", "negative", "neutral"), "mediation": lambda c: one_of(c, "mediation", "goodwill", "not")}
    pairs = [F.struct(F.lit(f).alias("field"), r(one[f]).cast("string").alias("x"), r(two[f]).cast("string").alias("y")) for f, r in read.items()]
    met = one.join(two, one["id"] == two["id"]).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return kappa(met, "x", "y", ("field",))


def kappa(rows: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, kappa) of two label columns, rows with a null label left out: NaN without rows, 1 where chance alone agrees always.

    Agreement and margins come from one count by label pair, so data of any size are summed before they meet.
    """
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.count("*").alias("n"))
    total = pairs.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)), F.lit(0)).alias("same"))
    left = pairs.groupBy(*keys, F.col("x").alias("label")).agg(F.sum("n").alias("nx"))
    right = pairs.groupBy(*keys, F.col("y").alias("label")).agg(F.sum("n").alias("ny"))
    chance = left.join(right, [*keys, "label"]).groupBy(*keys).agg(F.sum(F.col("nx") * F.col("ny")).alias("both"))
    out = total.join(chance, list(keys), "left") if keys else total.join(chance, how="cross")
    po, pe = F.col("same") / F.col("total"), F.coalesce("both", F.lit(0)) / (F.col("total") * F.col("total"))
    value = F.when(F.col("total") == 0, F.lit(float("nan"))).when(F.coalesce("both", F.lit(0)) == F.col("total") * F.col("total"), 1.0).otherwise((po - pe) / (1 - pe))
    return out.select(*keys, F.col("total").alias("n"), value.alias("kappa"))
