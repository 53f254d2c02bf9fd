"""Article stores: CSV and JSON Lines in and out, merging, deduplication and order."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import schemas
from ..functions.text import utc_timestamp
from .shared import written


def read_articles_csv(spark: SparkSession, *paths: str, schema: str = schemas.ARTICLE) -> DataFrame:
    """Quoted CSV with line breaks inside fields."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(list(paths))


def with_article_row(articles: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """articles with `article_row` 0, 1, … in an explicit order.

    Rows are numbered by sorted partition and place inside it: a range sort and a small
    table of partition sizes, no window over all rows. The sorted rows are written once, as
    a second reading may get other partitions, with which the sizes would not agree.
    """
    ranked = articles.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    ranked = written(ranked.withColumn("_at", F.monotonically_increasing_id()))
    ranked = ranked.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    from_ = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(from_), F.lit(0)).alias("_before"))
    return ranked.join(sizes, "_part").withColumn("article_row", (F.col("_before") + F.col("_in")).cast("long")).drop("_at", "_part", "_in", "_before")


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.RECORD, strict: bool = True) -> DataFrame:
    """JSON Lines by a declared schema; blank lines are skipped, a corrupt line fails (or with strict off is left out)."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_done_ids(spark: SparkSession, path: str) -> DataFrame:
    """The doc_ids of a store, whatever else its lines hold: corrupt lines and lines without the key are left out."""
    return spark.read.text(path).select(F.get_json_object("value", "$.doc_id").alias("doc_id")).where("doc_id IS NOT NULL")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One url a line; blank lines and lines that begin with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' AND NOT startswith(url, '#')")


def parse_keys(*texts: str) -> list[str]:
    """Keys from texts in order of priority, split at commas and white space, each once."""
    return list(dict.fromkeys(k for t in texts for k in re.split(r"[,\s]+", t or "") if k))


def union_all(stores: Iterable[DataFrame]) -> DataFrame:
    """By name, columns that one store lacks are null there."""
    out = None
    for s in stores:
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def last_wins(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of each key with the greatest seq, null ones last; of equal ones any. One shuffle of the rows, cut to a row a key before it."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), seq).alias("r"))
    return best.select(key, "r.*")


def first_wins(rows: DataFrame, key: str, seq: str) -> DataFrame:
    best = rows.groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), seq).alias("r"))
    return best.select(key, "r.*")


def by_time(timestamp: Column, raw: bool = False) -> Column:
    """Order of merged articles: by UTC time with unreadable ones last, or (`raw`) by the text with blanks last."""
    if raw:
        return F.asc(F.coalesce(F.nullif(timestamp, F.lit("")), F.lit("9999")))
    return F.asc_nulls_last(utc_timestamp(timestamp))


def merged(stores: Iterable[DataFrame], key: str = "url", seq: str = "seq", raw_order: bool = False) -> DataFrame:
    """Stores put together, the last listing of each key, in order of time; equal times by the key's first listing."""
    rows = union_all(stores)
    best = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), seq).alias("r"), F.min(seq).alias("first_seq"))
    return best.select(key, "r.*", "first_seq").orderBy(by_time(F.col("timestamp"), raw_order), "first_seq").drop("first_seq")


def write_articles_csv(rows: DataFrame, path: str, columns: list[str] = schemas.ARTICLE_COLUMNS, one_file: bool = False) -> None:
    """A fixed list of columns, missing ones and nulls empty."""
    out = rows.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in columns))
    # White space at the ends of a body is part of it.
    writer = (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_jsonl(rows: DataFrame, path: str, fresh: bool = False) -> None:
    """Adds records to a store (fresh: replaces it); a job's files appear together when it commits."""
    rows.write.mode("overwrite" if fresh else "append").json(path)


def display_payload(frames: DataFrame, events: DataFrame, meta: DataFrame, variable: str = "VIZ_DATA") -> DataFrame:
    """One row of text that assigns a display's data: it is read by one page, so it is one value by nature."""
    f = frames.agg(F.sort_array(F.collect_list(F.struct("outlet", "week", "frame"))).alias("frames"))
    e = events.agg(F.sort_array(F.collect_list(F.struct(*events.columns))).alias("events"))
    m = meta.limit(1).select(F.struct(*meta.columns).alias("meta"))
    return f.join(e, how="cross").join(m, how="cross").select(F.concat(F.lit(f"window.{variable} = "), F.to_json(F.struct("meta", "frames", "events")), F.lit(";")).alias("value"))


def months(start: str, end: str) -> str:
    """SQL of (month_start, month_end): the months of a range, clamped to it."""
    return f"SELECT greatest(m, DATE '{start}') AS month_start, least(last_day(m), DATE '{end}') AS month_end FROM (SELECT explode(sequence(trunc(DATE '{start}', 'MM'), DATE '{end}', INTERVAL 1 MONTH)) AS m)"


def month_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.sql(months(start, end))


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS day")


def request_parameters(window_start: str, window_end: str, query: str = "", section: str = "", tag: str = "", page: int = 1, page_size: int = 200, kind: str = "") -> dict[str, str]:
    """Parameters of one page of a REST source, the filters pushed to it; empty ones are left out."""
    wanted = {"from-date": window_start, "to-date": window_end, "q": query, "section": section, "tag": tag, "type": kind, "page": str(page), "page-size": str(page_size), "order-by": "oldest", "show-fields": "headline,byline,bodyText"}
    return {k: v for k, v in wanted.items() if v}


def api_rows(results: DataFrame, pillar: str | None = None) -> DataFrame:
    """Articles of REST results(type, pillarId, sectionId, webPublicationDate, webUrl, webTitle, fields): articles (of a pillar) with a body."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ok = (F.col("type") == "article") & (F.length(text("fields.bodyText")) >= 1)
    rows = results.where(ok if pillar is None else ok & (F.col("pillarId") == pillar))
    return rows.select(
        text("sectionId").alias("section"), F.substring(text("webPublicationDate"), 1, 10).alias("date"), text("webPublicationDate").alias("timestamp"), text("fields.byline").alias("author"),
        F.coalesce("fields.headline", "webTitle", F.lit("")).alias("headline"), text("webUrl").alias("url"), text("fields.bodyText").alias("body"),
    )


def new_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links whose url isn't known yet, each once."""
    return links.dropDuplicates(["url"]).join(known.select("url"), "url", "left_anti")


def to_fetch(links: DataFrame, scraped: DataFrame, sections: list[str], fails: DataFrame | None = None, max_fails: int = 4) -> DataFrame:
    """Links still to fetch: not scraped, not given up, and with no hint of another section."""
    rows = links.where((F.coalesce("hint", F.lit("")) == "") | F.col("hint").isin(*sections)).join(scraped.select("url"), "url", "left_anti")
    return rows if fails is None else rows.join(fails.where(F.col("fails") >= max_fails).select("url"), "url", "left_anti")
