"""Document fingerprints by MinHash.

A fingerprint is the MinHash signature of a text's distinct five-word shingles: `N`
universal hash permutations evaluated in numpy, 16 bits of each minimum, written as
hexadecimal. The likeness of two fingerprints is the share of equal positions, an
estimate of the shingle sets' Jaccard similarity. `similar_pairs` joins signature bands
in Spark and verifies the Jaccard similarity of each candidate on the whole texts; the
query gives each document the component that these links make.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from ._run import saved
from .near_duplicates import Settings, _numbers, linked, near_duplicates

#: The fingerprint's positions are those of the bands: 25 bands of 5 rows.
BANDED = Settings(seed=3)
N, SEED, WORDS = BANDED.bands * BANDED.rows, BANDED.seed, BANDED.words
ROWS_PER_BLOCK = 2048
MAX_BLOCKS = 1 << 16
LAST = (1 << 63) - 1


def signatures(column: pa.Array, words: int = WORDS, n: int = N, seed: int = SEED) -> np.ndarray:
    """16-bit MinHash signatures of the texts; texts without a word share one value."""
    sets, at = T.shingle_sets(column, words)
    return (T.mix(T.MinHash(n, seed).signatures(sets, at).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def written(rows: np.ndarray) -> list[str]:
    """Each signature as hexadecimal text, four digits a position."""
    width, text = rows.shape[1] * 4, rows.astype(">u2").tobytes().hex()
    return [text[i : i + width] for i in range(0, len(text), width)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row; a null text is the empty text, equal texts (and texts without a word) have equal fingerprints, an empty table gives none, and other columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(written(signatures(part.column(1))))], ["doc_id", "fingerprint"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fingerprint string")


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """(a, b): documents verified to be as similar as the settings ask (Jaccard 0.8 of five-word shingles unless changed).

    Signature bands are joined in Spark: each document of a band's bucket is compared with
    the bucket's pivot, and those that this leaves in different components are compared
    block against block; each candidate is verified on the whole texts. Of documents with
    equal shingle sets the smallest doc_id stands for all, and the others are linked to it.
    Links inside a component that are not needed to hold it together may be missing;
    components of the pairs are what near_duplicates() returns. A null id or a text without
    words is in no pair; other columns are not looked at; an empty table gives no pairs.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed, reps, links, _ = linked(docs, settings or Settings())
    copies = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").join(reps, ["key1", "key2", "n_shingles"]).where("doc_id <> rep")
    return links.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))).distinct()


def joined_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """(doc_id, component_id) of the documents that verified links lead to a smaller doc_id, the smallest of them."""
    found = near_duplicates(docs, id_col, text_col, settings).where("component_id < doc_id")
    return saved(found.groupBy("doc_id").agg(F.min("component_id").alias("component_id")))


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _blocks(docs: DataFrame, rows_per_block: int) -> list[int]:
    """Bounds that cut the doc_ids into blocks of about equal row counts, MAX_BLOCKS at most (eight bytes each on the driver)."""
    n = docs.count()
    blocks = min(MAX_BLOCKS, n // rows_per_block + 1)
    if blocks < 2:
        return []
    cuts = docs.agg(F.percentile_approx("k", [i / blocks for i in range(1, blocks)], max(10_000, 4 * blocks)).alias("c")).first().c
    return sorted(set(cuts))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = ROWS_PER_BLOCK, joined: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id) for each row.

    component_id is that of joined(doc_id, component_id), one row an id at most, else the
    doc_id; joined's rows travel to the documents, which are wider.

    The next document is the next by ascending doc_id (null ids come last, equal ids by a
    digest of their text), after the last the first; of one document alone it is that
    document. A null text is the empty text; other columns are not looked at; an empty
    table gives an empty result. Documents move once, compressed, into blocks of doc_ids
    in order; each block also gets the first document of the next block.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("k", F.coalesce("doc_id", F.lit(LAST)))
    cuts = np.array(_blocks(docs.select("k"), rows_per_block), dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in T.slices(batch, "text"):
                texts = [x.encode() for x in part.column(1).to_pylist()]
                tie = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in texts]
                block = np.searchsorted(cuts, _numbers(part, "k"), side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(block), pa.array(tie, type=pa.int64()), pa.array([pack.compress(x) for x in texts], type=pa.binary())], ["doc_id", "k", "block", "tie", "text"])

    columns = "doc_id long, k long, block int, tie long, text binary"
    dealt = docs.mapInArrow(deal, columns)
    # One row for each block: at most MAX_BLOCKS + 1.
    ids = docs.select("k").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, _numbers(b, "k"), side="left").astype(np.int32)), b.column(0)], ["block", "k"]) for b in batches), "block int, k long")
    firsts = sorted((r.block, r.first) for r in ids.groupBy("block").agg(F.min("k").alias("first")).collect())
    spark = docs.sparkSession
    if firsts:
        follow = [(block, firsts[(i + 1) % len(firsts)][1]) for i, (block, _) in enumerate(firsts)]
        follow = F.broadcast(spark.createDataFrame(follow, "target int, k long"))
        heads = docs.join(follow.select("k").distinct(), "k").select("doc_id", "text", "k").mapInArrow(deal, columns)
        heads = heads.groupBy("k").agg(F.min(F.struct("tie", "doc_id", "text")).alias("h")).join(follow, "k")
        heads = heads.select("h.doc_id", F.lit(LAST).alias("k"), F.col("target").alias("block"), "h.tie", "h.text", F.lit(1).alias("head"))
    else:
        heads = dealt.withColumn("head", F.lit(1))
    none = F.lit(None).cast("long")
    rows = dealt.withColumn("head", F.lit(0)).unionByName(heads).withColumn("component", none)
    if joined is not None:

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = np.searchsorted(cuts, batch.column(0).to_numpy(), side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(block), batch.column(1)], ["k", "block", "component"])

        named = joined.select("doc_id", "component_id").mapInArrow(place, "k long, block int, component long")
        rows = rows.unionByName(named.select(none.alias("doc_id"), "k", "block", none.alias("tie"), F.lit(None).cast("binary").alias("text"), F.lit(0).alias("head"), "component"))
    # A component's row comes before the documents of its id: its tie is null.
    rows = rows.repartition("block").sortWithinPartitions("block", "head", "k", F.col("tie").asc_nulls_first()).select("doc_id", "text", "block", "head", "component", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, waiting, of, name = zstandard.ZstdDecompressor(), None, None, None
        for batch in batches:
            for part in T.slices(batch, "text", 3):
                own = []
                for doc_id, k, component in zip(*(part.column(i).to_pylist() for i in (0, 5, 4))):
                    if component is not None:
                        of, name = k, component
                    own.append(name if k == of and doc_id is not None else doc_id)
                part = part.append_column("own", pa.array(own, type=pa.int64()))
                part = part.filter(part.column(1).is_valid())
                texts = pa.array([unpack.decompress(x) for x in part.column(1).to_pylist()], type=pa.binary()).cast(pa.string())
                part = pa.RecordBatch.from_arrays([part.column(0), texts, part.column(2), part.column(3), part.column(6)], ["doc_id", "text", "block", "head", "own"])
                if not part.num_rows:
                    continue
                if waiting is not None:
                    part = pa.Table.from_batches([waiting, part]).combine_chunks().to_batches()[0]
                block, head = _numbers(part, "block"), _numbers(part, "head")
                if part.num_rows > 1:
                    at = np.flatnonzero((block[1:] == block[:-1]) & (head[:-1] == 0))
                    if len(at):
                        yield finished(part, at)
                waiting = part.slice(part.num_rows - 1)

    def finished(part: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        texts = part.column(1).to_pylist()
        own = signatures(part.column(1))
        changed = [edited(texts[i], texts[i + 1]) for i in at.tolist()]
        other = signatures(pa.array(changed, type=pa.string()))
        return pa.RecordBatch.from_arrays(
            [
                part.column(0).take(pa.array(at)),
                pa.array([len(texts[i]) for i in at.tolist()], type=pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                pa.array(written(own[at])),
                pa.array(written(other)),
                pa.array((own[at] == other).mean(axis=1)),
                pa.array((own[at] == own[at + 1]).mean(axis=1)),
                part.column(4).take(pa.array(at)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"],
        )

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long")


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_next(docs, joined=joined_documents(docs, settings=BANDED))
