"""Quality rules with suffix-array repetition.

All documents of a batch are put into one sequence of word numbers, each document
closed by a symbol of its own and its words numbered apart from other documents', so
that only repetition inside a document counts. Prefix doubling sorts the suffixes, and
only suffixes that still tie take part in a round. The longest common prefix of
neighbours in the suffix array is found from the longest power of two down, by polynomials
modulo 2^61 - 1 of ranges of words from one array of prefix sums, so that no round has to be
kept. A suffix's longest repeat is
the larger of its two; the spans of all repeats of enough words are united, and limits
hold for the fraction of words they cover and for the longest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from ._suffix import Sequence

SYMBOLS = np.zeros(256, dtype=np.uint8)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


class Limits:
    """Parameters of the rules: base rules, and the limits on repeats of `repeat_words` words or more."""

    def __init__(self, min_words: int = 50, max_repeat_percent: int = 50, repeat_words: int = 12, max_covered_percent: int = 30, max_longest: int = 100):
        self.min_words, self.max_repeat_percent = min_words, max_repeat_percent
        self.repeat_words, self.max_covered_percent, self.max_longest = repeat_words, max_covered_percent, max_longest

    def base_failed(self, m: dict[str, np.ndarray]) -> np.ndarray:
        return (m["n_words"] < self.min_words) | (100 * m["n_repeat_words"] > self.max_repeat_percent * m["n_words"])

    def kept(self, m: dict[str, np.ndarray]) -> np.ndarray:
        repeated = (100 * m["n_covered_words"] > self.max_covered_percent * m["n_words"]) | (m["longest_repeat"] > self.max_longest)
        return ~self.base_failed(m) & ~repeated


def longest_repeats(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the most words from it on that occur elsewhere in its document too (occurrences may overlap).

    words: numbers of words, equal for equal words; first: each document's first word number, and the total.
    """
    if not len(words):
        return np.zeros(0, dtype=np.int32)
    texts = Sequence(words, first)
    rank, again, step = texts.ranks()
    suffixes = np.empty(texts.size, dtype=np.int32)
    suffixes[rank] = np.arange(texts.size, dtype=np.int32)
    del rank
    # Only words that occur again in their document can begin a repeat.
    near = np.flatnonzero(again[suffixes[:-1]] & again[suffixes[1:]]).astype(np.int32)
    a, b = suffixes[near], suffixes[near + 1]
    del near, suffixes, again
    common = texts.common(a, b, step)
    out = np.zeros(texts.size, dtype=np.int32)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out[texts.at]


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least `least` words (a repeat never leaves its document)."""
    # How far the repeats that began so far reach.
    reach = np.where(lengths >= least, lengths, 0) + np.arange(len(lengths), dtype=np.int64)
    return np.maximum.accumulate(reach) > np.arange(len(lengths))


def measures(column: pa.Array, repeat_words: int) -> dict[str, np.ndarray]:
    """MEASURES of each text of an Arrow string column."""
    data, at = T.flat(column)
    start, end, first = T.words(data, at)
    lengths = longest_repeats(T.numbered(data, start, end)[0], first)

    def per_doc(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        out, full = np.zeros(len(cuts) - 1, dtype=np.int64), np.flatnonzero(np.diff(cuts))
        if len(full):
            out[full] = np.add.reduceat(flags, cuts[:-1][full], dtype=np.int64)
        return out

    breaks = np.flatnonzero(data == 0x0A)
    low = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    high = np.sort(np.concatenate([at[1:], breaks]), kind="stable")
    full = np.searchsorted(start, high) > np.searchsorted(start, low)
    low, high = low[full], high[full]
    of = np.searchsorted(at, low, side="right") - 1
    lines, strings = T.numbered(data, low, high)
    _, kept = np.unique(of.astype(np.int64) * (len(strings) + 1) + lines, return_index=True)
    n = len(at) - 1
    filled = np.flatnonzero(np.diff(first))
    longest = np.zeros(n, dtype=np.int64)
    if len(filled):
        longest[filled] = np.maximum.reduceat(lengths, first[:-1][filled])
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": per_doc(~T.IS_SPACE[data] & ((data & 0xC0) != 0x80), at),
        "n_symbols": per_doc(SYMBOLS[data], at),
        "n_dup_lines": np.bincount(of, minlength=n) - np.bincount(of[kept], minlength=n),
        "n_repeat_words": per_doc(covered(lengths, 3), first),
        "n_covered_words": per_doc(covered(lengths, repeat_words), first),
        "longest_repeat": longest,
    }


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """(doc_id, MEASURES, base_failed, kept) for each row; a null or empty text has no words and fails the base rules, repeated rows are returned as often, an empty table gives none. Other columns are not looked at."""
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                m = measures(part.column(1), limits.repeat_words)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[k]) for k in MEASURES), pa.array(limits.base_failed(m)), pa.array(limits.kept(m))], ["doc_id", *MEASURES, "base_failed", "kept"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES) + ", base_failed boolean, kept boolean")


def clean(docs: DataFrame, text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, that the rules keep: none with a null or empty text; repeated rows are kept or not alike."""
    limits, place = limits or Limits(), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, text_col):
                yield part.filter(pa.array(limits.kept(measures(part.column(place), limits.repeat_words))))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("longest_repeat")


def _covered(k: int) -> str:
    """SQL of (doc_id, n): words in windows of k words that a text holds more than once."""
    return f"""(SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {k})) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM
      (SELECT doc_id, i, md5(array_to_string(w[i:i + {k - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 1))) AS i FROM d))) WHERE c > 1) GROUP BY doc_id)"""


def oracle(limits: Limits | None = None) -> str:
    s = limits or Limits()
    word = r"[^ \t\n\x0B\f\r]+"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d), dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{word}') GROUP BY doc_id),
c3 AS {_covered(3)}, cr AS {_covered(s.repeat_words)}, long AS {_covered(s.max_longest + 1)},
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words, coalesce(cr.n, 0) AS n_covered_words, coalesce(long.n, 0) AS too_long
  FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN c3 ON d.doc_id = c3.doc_id LEFT JOIN cr ON d.doc_id = cr.doc_id LEFT JOIN long ON d.doc_id = long.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, n_words < {s.min_words} OR 100 * n_repeat_words > {s.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {s.min_words} OR 100 * n_repeat_words > {s.max_repeat_percent} * n_words OR 100 * n_covered_words > {s.max_covered_percent} * n_words OR too_long > 0) AS kept FROM m
"""
