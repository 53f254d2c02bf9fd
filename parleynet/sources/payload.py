"""A display's payload as ordered pieces: one assignment of JSON, written by many tasks and held whole by none."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import shared_folder, shuffles_removed

#: Brackets by form: a section is one value, a list of values, or fields whose pieces are `"name":value`.
BRACKETS = {"value": ("", ""), "list": ("[", "]"), "fields": ("{", "}")}
#: Pieces of a file, at most: a file is compressed as a whole, so one task reads it.
FILE_PIECES = 1 << 18


class Section(NamedTuple):
    """A field of the payload: rows in the order of keys, one JSON text each, `piece`; `value` has one row.

    piece can be worked out of the rows' other columns: this is done when they are sorted, so that texts aren't shuffled.
    """

    name: str
    form: str
    rows: DataFrame
    keys: tuple[str, ...] = ()
    piece: Column | str = "piece"


def payload_pieces(spark: SparkSession, variable: str, sections: list[Section]) -> DataFrame:
    """(piece_no, value): texts that, put together in the order of piece_no, assign an object of all sections to the variable.

    They are read back from files in the shared folder, which hold each piece once, compressed;
    of a section, no more than whether its one value is there comes to the driver. Rows with equal
    keys come in any order, so keys should tell all rows apart. A section without rows is an empty
    list or object, or null.
    """
    folder = shared_folder(spark)
    write_sections(spark, variable, sections, folder)
    return read_pieces(spark, folder)


def write_sections(spark: SparkSession, variable: str, sections: list[Section], path: str) -> None:
    """Writes the payload into a new folder as compressed text files that are the payload when put together by path, a piece a line.

    Each section is sorted once, into files that stay where they are: a folder for it and
    one before and behind it for what stands between sections.
    """
    between = f"window.{variable} = {{"
    for k, s in enumerate(sections):
        start, end = BRACKETS[s.form]
        rows = s.rows.repartitionByRange(*s.keys).sortWithinPartitions(*s.keys) if s.keys else s.rows.limit(1)
        missing = s.form == "value" and rows.isEmpty()
        opening = f'"{s.name}":{start}' + ("null" if missing else "")
        _write(_lines(spark, [between + opening] if not k else [between, opening]), f"{path}/{2 * k:05d}")
        # The first of all sorted rows, and no other, has the number 0.
        comma = F.when(F.monotonically_increasing_id() > 0, ",").otherwise("") if s.keys else F.lit("")
        _write(rows.select(F.concat(comma, s.piece).alias("value")), f"{path}/{2 * k + 1:05d}")
        between = end + ("};" if k == len(sections) - 1 else ",")
    _write(_lines(spark, [between]), f"{path}/{2 * len(sections):05d}")


def _lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, lines))).alias("value"))


def _write(lines: DataFrame, path: str) -> None:
    with shuffles_removed(lines.sparkSession):
        lines.write.option("compression", "gzip").option("maxRecordsPerFile", FILE_PIECES).text(path)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(piece_no, value) of a payload that write_sections() wrote, without a shuffle of the pieces.

    A piece's number is its place in its file behind all pieces of the files before. A
    compressed file is read by one task from its start to its end, so the place is counted there.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = lines.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_no"))
    return lines.join(F.broadcast(files), "file").select("first_no", "value").mapInArrow(_numbered, "piece_no long, value string")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (first_no, value), those of a file together and in order, to (piece_no, value); files differ in first_no."""
    file, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
        numbers = []
        for low, high in zip(cuts[:-1], cuts[1:]):
            if first[low] != file:
                file, n = first[low], 0
            numbers.append(np.arange(file + n, file + n + high - low))
            n += high - low
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), batch.column(1)], ["piece_no", "value"])


def write_payload(pieces: DataFrame, path: str) -> None:
    """Writes the pieces as text files whose concatenation by name is the payload, a piece a line."""
    pieces.repartitionByRange("piece_no").sortWithinPartitions("piece_no").select("value").write.mode("overwrite").text(path)
