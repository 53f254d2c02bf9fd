"""Language identification by compression.

Each language has a raw-content dictionary for zstandard, made of labelled texts. A
text is encoded once with each dictionary, and the language whose dictionary gives the
smallest code is the answer. The margin by which it beats the next one is the score,
and a narrow margin means rejection.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from . import _text as T

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
#: ASCII that tells nothing of a language: digits, punctuation and controls other than white space.
DROPPED = bytes(b for b in range(128) if not (chr(b).isalpha() or chr(b) in " \t\n\r\v\f"))
#: A text is encoded in pieces of this size, so that the dictionary counts alike all along a long text.
PIECE_BYTES = 32 << 10


def normalised(text: str) -> bytes:
    return text.lower().encode("utf-8").translate(None, DROPPED)


def spread(data: bytes, size: int, pieces: int = 4) -> bytes:
    """size bytes of data: all of it if it isn't longer, else pieces of equal length from its start to its end."""
    if len(data) <= size:
        return data
    each = size // pieces
    starts = [(len(data) - each) * i // (pieces - 1) for i in range(pieces)] if pieces > 1 else [0]
    return b"\n".join(data[i : i + each] for i in starts)


class Dictionaries:
    """Raw-content dictionaries by language, encoders made on first use in a worker."""

    def __init__(self, contents: dict[str, bytes], level: int):
        self.languages, self.contents, self.level = sorted(contents), contents, level

    @lru_cache(maxsize=1)  # noqa: B019
    def _encoders(self) -> list:
        import zstandard

        out = []
        for language in self.languages:
            d = zstandard.ZstdCompressionDict(self.contents[language], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items()}

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); the score is the share by which the smallest code is below the next smallest."""
        if not text or not self.languages or not LETTER.search(text):
            return UNDETERMINED, 0.0
        data = normalised(text)
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        sizes = [sum(len(e.compress(data[i : i + PIECE_BYTES])) for i in range(0, len(data), PIECE_BYTES)) for e in self._encoders()]
        best, after = heapq.nsmallest(2, range(len(sizes)), key=lambda i: (sizes[i], i))
        return self.languages[best], min(1.0, max(0.0, 1 - sizes[best] / sizes[after])) if sizes[after] else 0.0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 64, doc_bytes: int = 2000, level: int = 9, seed: int = 11) -> Dictionaries:
    """Dictionaries from labelled rows (text and language not null).

    A language is fitted on `sample_docs` distinct texts at most, the first by a seeded
    hash, and `doc_bytes` bytes of each, spread over the whole text: a bound of 128 kB a
    language whatever the size of the table. Which rows are labelled for fitting is the
    caller's choice. Null texts and languages and texts without a letter are no labelled
    rows; without any, and of an empty table, the model has no languages and says `und` of
    every text, so that accepted() keeps none.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("h"))
    # Distinct places in the order, so that repeated rows don't thin the sample; one number for each language.
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return Dictionaries({}, level)
    # Four times the sample on average, so that fewer than the sample is all but impossible; the rest is never moved.
    limits = {lang: min(1.0, 4 * sample_docs / max(1, n)) for lang, n in counts.items()}
    limit = F.create_map(*(x for lang, share in limits.items() for x in (F.lit(lang), F.lit(int(share * (1 << 32))))))
    rows = rows.where(F.pmod(F.col("h"), F.lit(1 << 32)) <= limit[F.col("lang")])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            for lang, text, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not LETTER.search(text):
                    continue
                kept = best.setdefault(lang, {})
                data = spread(normalised(text), doc_bytes)
                kept[data] = min(h, kept.get(data, h))
                if len(kept) > 2 * sample_docs:
                    best[lang] = dict(heapq.nsmallest(sample_docs, kept.items(), key=lambda x: (x[1], x[0])))
        out = [(lang, data, h) for lang, kept in best.items() for data, h in heapq.nsmallest(sample_docs, kept.items(), key=lambda x: (x[1], x[0]))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.int64()))], ["lang", "data", "h"])

    few = rows.mapInArrow(first, "lang string, data binary, h long").groupBy("lang", "data").agg(F.min("h").alias("h"))
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "data"))).where(F.col("k") <= sample_docs)
    contents: dict[str, list[tuple[int, bytes]]] = {}
    for r in few.collect():
        contents.setdefault(r.lang, []).append((r.k, bytes(r.data)))
    return Dictionaries({lang: b"\n".join(data for _, data in sorted(parts, reverse=True)) for lang, parts in contents.items()}, level)


def identify(docs: DataFrame, model: Dictionaries, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.005) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row.

    A text that is null or has no letter is `und` with score 0 and rejected; a text whose
    margin is below min_margin keeps its most likely language and is rejected. Equal
    texts get equal answers; ties go to the language first by name. Repeated rows are
    returned as often, an empty table gives none, and other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                found = [model.predict(t) for t in part.column(1).to_pylist()]
                score = np.array([x[1] for x in found], dtype=np.float64)
                lang = pa.array([x[0] for x in found], type=pa.string())
                rejected = (score < min_margin) | np.array([x[0] == UNDETERMINED for x in found], dtype=bool)
                yield pa.RecordBatch.from_arrays([part.column(0), lang, pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Dictionaries, text_col: str = "text", min_margin: float = 0.005) -> DataFrame:
    """The rows of docs, all columns as they are, whose language isn't rejected: not those with a null text or one without a letter, and none at all if the model was fitted on no labelled row."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, text_col):
                found = [model.predict(t) for t in part.column(place).to_pylist()]
                yield part.filter(pa.array([lang != UNDETERMINED and score >= min_margin for lang, score in found], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows kept out of fitting: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).withColumn("held_out", held_out())
