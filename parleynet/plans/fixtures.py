"""The engine's inputs as views of the driver's tables, in one SQL text for Spark and DuckDB."""

from __future__ import annotations

import re

import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Axis
from ..operators.vocabulary import Vocabulary
from ..sources.shared import shared_folder, written  # noqa: F401

BOUNDARY = "1998-06-01"
#: Bytes of a row group of recorded pages.
GROUP = 1 << 20
COLOURS = {"ASIA": "#e2864a", "EUROPE": "#9b59b6"}

EDGES = """
SELECT sn.n_name AS source, sr.r_name AS source_bloc, cn.n_name AS target, cr.r_name AS target_bloc,
       CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS polarity,
       CASE l_returnflag WHEN 'A' THEN 'coop' WHEN 'R' THEN 'conflict' ELSE 'neutral' END AS valence,
       CASE p_type WHEN 'PROMO' THEN 'hosted talks' WHEN 'ECONOMY' THEN 'urged restraint' WHEN 'LARGE' THEN 'offered to mediate' WHEN 'MEDIUM' THEN 'said' WHEN 'SMALL' THEN 'praised' ELSE 'visited' END AS raw_verb,
       CAST(l_shipdate AS DATE) AS event_date,
       CASE WHEN l_shipdate < TIMESTAMP '1998-06-01 00:00:00' THEN 'pre' ELSE 'post' END AS phase,
       o_orderstatus AS outlet, CAST(l_orderkey AS STRING) AS doc_id, CAST(l_shipdate AS DATE) AS date,
       p_name AS quote, CAST(l_extendedprice AS STRING) AS ref
FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey JOIN {customer} c ON o_custkey = c_custkey JOIN {supplier} s ON l_suppkey = s_suppkey JOIN {part} p ON l_partkey = p_partkey
JOIN {nation} cn ON c_nationkey = cn.n_nationkey JOIN {nation} sn ON s_nationkey = sn.n_nationkey JOIN {region} cr ON cn.n_regionkey = cr.r_regionkey JOIN {region} sr ON sn.n_regionkey = sr.r_regionkey
WHERE sn.n_name <> cn.n_name
"""
TABLES = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region")
EDGES_SQL = EDGES.format(**{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EDGES, **{t: table(spark, sf_dir, t) for t in TABLES})


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actor, bloc, ord): nations and their regions."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(n.n_name.alias("actor"), r.r_name.alias("bloc"), n.n_nationkey.alias("ord"))


def axis(spark: SparkSession, sf_dir: str) -> Axis:
    """The 25 nations as actors, collected in order: a dimension of fixed size."""
    rows = actors(spark, sf_dir).orderBy("ord").collect()
    names = [r.actor for r in rows]
    return Axis({r.actor: r.bloc for r in rows}, focal=tuple(names[:5]), dyad=tuple(names[:2]), focus=names[3], principals=tuple(names[:5]), mediators=tuple(names[5:10]), boundary=BOUNDARY, colours=COLOURS)


#: Frequent words of the documents stand in for actors where a query reads texts.
WORDS = Vocabulary(("The", "Of", "And", "To", "In"), {"The": "a", "Of": "a", "And": "b", "To": "b", "In": "c"}, {"The": ["the", "der", "la"], "Of": ["of", "von"], "And": ["and", "und", "et"], "To": ["to", "zu"], "In": ["in"]}, {"a": "an article"})


class Recorded:
    """Pages that Spark has written to a shared folder, a folder for each value of the first key, answering as a site would.

    Rows are sorted by page in files of small row groups, so that one page is found by the
    files' own bounds, however many pages there are.
    """

    def __init__(self, folder: str, *keys: str):
        self.folder, self.keys = folder, keys
        self._open: dict = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_open": {}}

    @classmethod
    def record(cls, pages: DataFrame, folder: str, site: str, page: str) -> Recorded:
        """pages(site, page, value): a text for each page, or its lines. How many pages each site has is written beside them."""
        rows = pages.select(F.col(site).cast("string").alias(site), F.col(page).cast("long").alias(page), "value").where(f"`{site}` IS NOT NULL AND `{page}` IS NOT NULL")
        rows.repartitionByRange(site, page).sortWithinPartitions(site, page).write.partitionBy(site).option("parquet.block.size", GROUP).parquet(f"{folder}/pages")
        rows.groupBy(site).agg(F.count_distinct(page).alias("n")).coalesce(1).write.parquet(f"{folder}/counts")
        return cls(folder, site, page)

    def _at(self, place: str):
        """The files of a folder, opened once; None where there is none."""
        if place not in self._open:
            path = f"{self.folder}/{place}"
            fs, root = pafs.FileSystem.from_uri(path if re.match("[a-z0-9]+:", path) else f"file://{path}")
            found = fs.get_file_info(root).type == pafs.FileType.Directory
            self._open[place] = ds.dataset(root, filesystem=fs, format="parquet", exclude_invalid_files=False) if found else None
        return self._open[place]

    def page(self, site, page) -> str | None:
        data = self._at(f"pages/{self.keys[0]}={site}")
        rows = [] if data is None else data.to_table(columns=["value"], filter=ds.field(self.keys[1]) == int(page), use_threads=False).column(0).to_pylist()
        return "".join(f"{x or ''}\n" for x in rows) if rows else None

    def count(self, site) -> int:
        counts = self._at("counts").to_table(filter=ds.field(self.keys[0]) == str(site)).column("n").to_pylist()
        return counts[0] if counts else 0
