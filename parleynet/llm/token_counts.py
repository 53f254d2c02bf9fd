"""Token counts without token ids.

Each task turns its documents into pre-token frequencies, packed by distinct
pre-token: one row (piece, first row of the block, [(row, frequency), ...]). The rows
meet by pre-token, so that a distinct pre-token's pieces are counted once; the count is
multiplied into its documents' frequencies and the products are summed by document.
A very common pre-token has one row for each block of documents, not one for each
occurrence or document, and sums go back packed by block as well. The blocks of TASKS_PER_PART
tasks make a part, and rows meet by pre-token and part: a pre-token that all documents
hold is merged once in each part, and no task gets more of it than a part's blocks hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from ._run import settled
from .bpe import load

BLOCK_PIECES = 4_000_000
BLOCK_DOCS = 1 << 20
HELD_SUMS = 2_000_000
ROW_BITS = 36
#: A document's number in its block and a frequency share 32 bits; a larger frequency is several entries.
COUNT_BITS = 12
MOST = (1 << COUNT_BITS) - 1
TASKS_PER_PART = 1024


def pack(row: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, entries of each pair) of (row, count) pairs."""
    n = -(-count // MOST)
    last = np.cumsum(n) - 1
    part = np.full(int(n.sum()), MOST, dtype=np.int64)
    part[last] = count - (n - 1) * MOST
    return ((np.repeat(row, n) << COUNT_BITS) | part).astype(np.uint32), n


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(counts * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


class _Block:
    def __init__(self, base: int):
        self.base, self.codes, self.rows, self.docs, self.sizes, self.n = base, {}, [], [], [], 0
        self.pieces: list[np.ndarray] = []

    def add(self, part: pa.RecordBatch, split) -> None:
        codes = self.codes
        for text in part.column(1).to_pylist():
            found = split(text) if text else []
            code = np.fromiter((codes.setdefault(p, len(codes)) for p in found), dtype=np.int64, count=len(found))
            seen, count = np.unique(code, return_counts=True)
            self.pieces.append(np.stack([seen, np.full(len(seen), len(self.sizes)), count]))
            self.sizes.append(len(text.encode()) if text else 0)
            self.n += len(found)
        self.docs.append(part.column(0))

    def batches(self) -> Iterator[pa.RecordBatch]:
        docs = pa.concat_arrays(self.docs)
        header = pa.table({"doc_id": docs, "n_bytes": pa.array(self.sizes, type=pa.int64())})
        yield _row([None], [self.base], pa.array([_ipc(header)], type=pa.binary()))
        code, row, count = np.concatenate(self.pieces, axis=1) if self.pieces else np.zeros((3, 0), np.int64)
        order = np.argsort(code, kind="stable")
        entries, n = pack(row[order], count[order])
        each = np.bincount(code[order], weights=n, minlength=len(self.codes)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(each)])
        names = list(self.codes)
        for low in range(0, len(names), 20_000):
            high = min(low + 20_000, len(names))
            yield _row(names[low:high], [self.base] * (high - low), _packed(entries[ends[low] : ends[high]], each[low:high]))


def _row(names: list, bases: list[int], payload: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array(bases, type=pa.int64()), payload], ["piece", "base", "payload"])


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def piece_frequencies(docs: DataFrame, path: str | None) -> DataFrame:
    """(piece, base, payload) of docs(doc_id, text); a row with a null piece lists a block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = load(path).pieces
        base = TaskContext.get().partitionId() << ROW_BITS
        block = _Block(base)
        for batch in batches:
            for part in T.slices(batch, "text"):
                block.add(part, split)
                if block.n >= BLOCK_PIECES or len(block.sizes) >= BLOCK_DOCS // 2:
                    yield from block.batches()
                    block = _Block(block.base + len(block.sizes))
        if block.sizes:
            yield from block.batches()

    return docs.mapInArrow(run, "piece string, base long, payload binary")


def counted(frequencies: DataFrame, path: str | None) -> DataFrame:
    """(base, header, payload): each block's documents, and parts of its sums as (row, sum) pairs; the input is sorted by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        last, pieces = None, 0
        rows, sums, held, bases = [], [], 0, set()
        for batch in batches:
            names, base = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            payload = batch.column(2)
            each = np.zeros(len(names), dtype=np.int64)
            for i, name in enumerate(names):
                if name is not None and name != last:
                    last = name
                    pieces = 1 if name in bpe.special else len(bpe.merge(name.encode()))
                each[i] = pieces if name is not None else 0
            if len(heads := np.flatnonzero(each == 0)):
                yield _sums(base[heads], payload.take(pa.array(heads)), None)
                keep = np.flatnonzero(each)
                payload, base, each = payload.take(pa.array(keep)), base[keep], each[keep]
            if len(each):
                _, offsets, data = payload.buffers()
                at = np.frombuffer(offsets, dtype=np.int32)[payload.offset : payload.offset + len(payload) + 1]
                entry = np.frombuffer(data, dtype=np.uint32, count=(at[-1] - at[0]) // 4, offset=int(at[0]))
                n = np.diff(at) // 4
                rows.append(np.repeat(base, n) + (entry >> COUNT_BITS))
                sums.append(np.repeat(each, n) * (entry & MOST))
                held += len(entry)
                bases.update(np.unique(base).tolist())
            if held > HELD_SUMS:
                row, total = _summed(rows, sums)
                rows, sums, held = [row], [total], len(row)
                if held > HELD_SUMS // 2:
                    yield _by_block(row, total, bases)
                    rows, sums, held, bases = [], [], 0, set()
        if held:
            yield _by_block(*_summed(rows, sums), bases)

    return frequencies.mapInArrow(run, "base long, header binary, payload binary")


def _summed(rows: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    row, total = np.concatenate(rows), np.concatenate(sums)
    order = np.argsort(row, kind="stable")
    row, total = row[order], total[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return row[first], np.add.reduceat(total, first)


def _by_block(row: np.ndarray, total: np.ndarray, bases: set[int]) -> pa.RecordBatch:
    base = np.array(sorted(bases), dtype=np.int64)
    cut = np.append(np.searchsorted(row, base), len(row))
    n = np.diff(cut)
    pairs = np.stack([row - np.repeat(base, n), total], axis=1).astype(np.uint32)
    return _sums(base, None, _packed(pairs.ravel(), n * 2))


def _sums(base: np.ndarray, header: pa.Array | None, payload: pa.Array | None) -> pa.RecordBatch:
    none = pa.nulls(len(base), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(base), none if header is None else header, none if payload is None else payload], ["base", "header", "payload"])


def by_document(parts: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each document, from parts sorted by block with its header first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, total = None, None
        for batch in batches:
            for header, payload in zip(batch.column(1), batch.column(2)):
                if header.is_valid:
                    if docs is not None:
                        yield done(docs, total)
                    docs = pa.ipc.open_stream(header.as_buffer()).read_all()
                    total = np.zeros(docs.num_rows, dtype=np.int64)
                else:
                    pair = np.frombuffer(payload.as_buffer(), dtype=np.uint32).reshape(-1, 2)
                    total[pair[:, 0]] += pair[:, 1]
        if docs is not None:
            yield done(docs, total)

    def done(docs: pa.Table, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([docs.column("doc_id").combine_chunks(), docs.column("n_bytes").combine_chunks(), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    return parts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row's whole text.

    A null text is the empty text (0 bytes, 0 tokens); a null or repeated doc_id is
    returned once for each row. Special strings of the vocabulary count as one token.
    Other columns are not looked at; an empty table gives an empty result. Documents are
    named by task and place, so docs that come out of a shuffle are saved first.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Headers have no piece and are spread by their block.
    part = F.floor(F.shiftright("base", ROW_BITS) / TASKS_PER_PART)
    met = piece_frequencies(settled(docs), path).repartition(shuffles, F.coalesce("piece", F.col("base").cast("string")), part).sortWithinPartitions("piece", "base")
    parts = counted(met, path).repartition(shuffles, "base").sortWithinPartitions("base", F.col("header").isNull())
    return by_document(parts)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
