"""Byte-level BPE encoding and decoding.

A text is cut at the vocabulary's special strings, then into pre-tokens by the
byte-level pattern. A pre-token's bytes are a doubly linked list of symbols and a
priority queue holds the merges that neighbours allow, lowest rank first and leftmost
first among equals. A merge may have gone stale since it was pushed: an entry counts
only if the two symbols at its place still are the pair of its rank. Decoding
concatenates the vocabulary's strings. Encoded ids are kept as little-endian unsigned
32-bit integers in a binary column, the layout that training shards use.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import _text as T

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pre-token pattern of byte-level vocabularies.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Numbers that Unicode 16 and later added and that the library's tables don't have yet.
LATER_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
PRE_TOKEN_ASTRAL = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?[\p{{N}}--[{LATER_NUMBERS}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{LATER_NUMBERS}]]+|\s+(?!\S)|\s+")
#: Bounds of the cache: pieces, and the characters of a piece that is worth keeping (at most some 300 bytes an entry).
CACHED_PIECES, CACHED_CHARS = 200_000, 24


def pre_tokens(text: str) -> list[str]:
    """The pattern's matches; only texts with characters beyond the basic plane need its slower form."""
    plain = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
    return (PRE_TOKEN if plain else PRE_TOKEN_ASTRAL).findall(text)


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Where the installed public vocabulary file lies on this machine (asked on each worker)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Vocabulary, merges and a bounded cache of encoded pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.byte_ids = [vocab[c] for c in letters]
        self.pairs: list[tuple[int, int, int]] = []
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.append((vocab[left], vocab[right], vocab[left + right]))
        self.ranks = {(left, right): rank for rank, (left, right, _) in enumerate(self.pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*vocab.values(), *self.special.values()) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.packed = _Packed(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(piece)
        ids = [self.byte_ids[b] for b in piece]
        if n == 1:
            return ids
        ranks, pairs = self.ranks, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r * n + i for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapify(queue)
        while queue:
            rank, i = divmod(heappop(queue), n)
            left, right, new = pairs[rank]
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: a neighbour was merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((new, ids[k]))) is not None:
                    heappush(queue, r * n + i)
            if (h := before[i]) >= 0 and (r := ranks.get((ids[h], new))) is not None:
                heappush(queue, r * n + h)
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special string is one of them."""
        if self.splitter is None or not any(s in text for s in self.special):
            return pre_tokens(text)
        out: list[str] = []
        for k, part in enumerate(self.splitter.split(text)):
            out += [part] if k % 2 else pre_tokens(part)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


class _Packed(dict):
    """Short pre-tokens to packed ids; emptied when full, so that memory stays bounded by CACHED_PIECES times some hundred bytes."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = [self.bpe.special[piece]] if piece in self.bpe.special else self.bpe.merge(piece.encode("utf-8"))
        out = np.array(ids, dtype="<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=4)
def load(path: str | None) -> Bpe:
    return Bpe(path or vocabulary_path())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) for each row; a null text is the empty text, which has no ids; repeated rows are returned as often, an empty table gives none. Other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in T.slices(batch, "text"):
                ids = [bpe.encode(text) if text else b"" for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, type=pa.binary())], ["doc_id", "ids"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) for each row of packed ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            step = max(1, batch.num_rows * T.SLICE_BYTES // max(1, batch.nbytes))
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                texts = [bpe.decode(ids) if ids else "" for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, type=pa.string())], ["doc_id", "ids", "text"])

    encoded = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return encoded.mapInArrow(run, "doc_id long, ids binary, text string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    back = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return back.select(
        "doc_id",
        F.coalesce(F.octet_length("ids") / 4, F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
