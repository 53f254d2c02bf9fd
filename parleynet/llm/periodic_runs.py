"""Periodic runs of words by the runs theorem.

A run is a longest stretch of words with smallest period q that holds `times` periods or
more. By the theorem, the Lyndon words that a run repeats are, under one of the two orders
of words, the longest Lyndon words at their places; those are read off the next smaller
values of the inverse suffix array. So each place names one root for each order, and a root
is extended to both sides by common extensions of the texts and of the reversed texts:
longest common prefixes of neighbours in the suffix order and range minima over them.

All texts of a slice are worked on at once; only texts with a root that reaches far enough to
the right are turned round for the extension to the left. Whole texts are read, and memory
grows with the words of a slice or of the longest text, times the logarithm of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from ._suffix import Extensions, Sequence, next_smaller

RUN = "array<struct<start:long,length:long,period:long>>"


class Settings:
    """A run has `times` periods (2 or more) and `least` words, or more."""

    def __init__(self, times: int = 4, least: int = 6):
        if times < 2:
            raise ValueError("a run has two periods at least")
        self.times, self.least = times, least


def runs(ids: np.ndarray, first: np.ndarray, s: Settings) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, ascending; ids are numbers of words, first each text's first word and the total."""
    none = np.zeros((0, 4), dtype=np.int64)
    if not len(ids):
        return none
    texts = Sequence(ids, first)
    forward, roots = None, []
    for backwards in (False, True):
        rank, again, step = texts.ranks(backwards)
        # A mark is smaller than every word, so no root leaves its text.
        after = next_smaller(rank)[texts.at]
        if forward is None:
            forward = Extensions(texts, rank, step)
        period = after - texts.at
        last = texts.ends[texts.texts]
        place = np.flatnonzero((after < last) & again[texts.at])
        place = place[ids[place] == ids[place + period[place]]]
        right = forward.common(texts.at[place], after[place].astype(np.int32))
        # A run's first root begins among its first words, one period of them: so far it reaches.
        far = right > (s.times - 2) * period[place]
        roots.append(np.stack([place[far], period[place[far]], right[far]], axis=1))
        del rank, again, after, period, last, place, right
    del forward
    place, period, right = np.concatenate(roots).T
    if not len(place):
        return none
    # Only texts with roots, backwards.
    text = texts.texts[place]
    chosen, of = np.unique(text, return_inverse=True)
    size = np.diff(first)[chosen]
    cuts = np.concatenate([[0], np.cumsum(size)])
    words = np.repeat(first[chosen] - cuts[:-1], size) + np.arange(cuts[-1])
    back = Sequence(ids[words], cuts).reversed()
    rank, _, step = back.ranks()
    left = np.zeros(len(place), dtype=np.int64)
    inner = place - first[text]
    # The word before the root, and the one a period on, from the end of the text.
    some = np.flatnonzero(inner > 0)
    turned = back.at[cuts[of[some]] + size[of[some]] - inner[some]]
    left[some] = Extensions(back, rank, step).common(turned, turned - period[some].astype(np.int32))
    length = left + period + right
    good = (length >= s.times * period) & (length >= s.least)
    found = np.stack([text, inner - left, length, period], axis=1)[good]
    return np.unique(found, axis=0) if len(found) else none


def _found(batch: pa.RecordBatch, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, first words, runs) of the texts in column 1."""
    data, at = T.flat(batch.column(1))
    start, end, first = T.words(data, at)
    return data, start, end, first, runs(T.numbered(data, start, end)[0], first, s)


def collapsed(words: int, found: np.ndarray) -> np.ndarray:
    """Which of a text's words stay: those in no run, or only in first periods of runs."""
    edge = np.zeros(words + 1, dtype=np.int64)
    np.add.at(edge, found[:, 1] + found[:, 3], 1)
    np.add.at(edge, found[:, 1] + found[:, 2], -1)
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs.

    Words are what stands between ASCII white space, compared by their bytes. runs holds
    (start, length, period) in words, by start, then period; collapsed is the text's words,
    joined by one space, without those that some run holds beyond its first period. A null
    or empty text has no words, no runs and the empty text. Rows that repeat are returned as
    often, a null id stays null. Other columns are not looked at. An empty table gives an
    empty result.
    """
    s = settings or Settings()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, start, end, first, found = _found(part, s)
                n = np.diff(first)
                low = np.searchsorted(found[:, 0], np.arange(len(n)))
                high = np.searchsorted(found[:, 0], np.arange(len(n)), side="right")
                structs = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([low, [len(found)]]), type=pa.int32()), structs).cast(kind)
                keep = np.ones(len(start), dtype=bool)
                for d in np.flatnonzero(high > low):
                    keep[first[d] : first[d + 1]] = collapsed(int(n[d]), found[low[d] : high[d]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), lists, _joined(data, start[keep], end[keep], np.concatenate([[0], np.cumsum(keep)])[first])], ["doc_id", "n_words", "runs", "collapsed"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each text's words, joined by one space."""
    spaced = np.append(data, np.uint8(0x20))
    edge = np.zeros(len(spaced) + 1, dtype=np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    # Words of a text, a space after each but the last.
    length = end - start
    full = np.flatnonzero(np.diff(first))
    gap = np.ones(len(start), dtype=np.int64)
    gap[first[1:][full] - 1] = 0
    to = np.concatenate([[0], np.cumsum(length + gap)])
    out = np.full(int(to[-1]), 0x20, dtype=np.uint8)
    target = np.repeat(to[:-1] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
    out[target] = spaced[inside]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(to[first].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def repeating(docs: DataFrame) -> DataFrame:
    """The query's (doc_id, text): of one document in ten, by its id's checksum, the words from a place on repeat its words from there with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    # A column of its own: inside the lambda below an expression would be worked out for each word again.
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0)))
    docs = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    docs = docs.select("doc_id", "text", "w", "n", (F.col("g") % F.col("n")).alias("a"), (F.lit(3) + F.col("g") % 8).alias("parts"))
    docs = docs.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / F.col("parts")))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return docs.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = repeating(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.when(F.size("runs") > 0, F.concat(F.concat_ws("\n", lines), F.lit("\n"))).otherwise("")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("r.minus")
    return found.select("doc_id", "n_runs", F.col("r.start").alias("start"), length.alias("length"), F.col("r.period").alias("period"), F.floor(1000 * length / F.col("r.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
