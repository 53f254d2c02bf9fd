"""Byte-level text kernels shared by the text operators.

Every kernel takes the flat UTF-8 buffer of an Arrow string column and works on
all documents of a batch at once: words and shingles come from numpy passes over bytes,
never from a Python loop over words. A word's hash is a polynomial of its bytes modulo
2^61 - 1 with a drawn base; where words must be told apart exactly, they are numbered by
their bytes. A word is a run of bytes
other than space and ``\\t \\n \\v \\f \\r`` (all ASCII, so no multi-byte character is
ever cut). Work is done on slices of at most ``SLICE_BYTES`` of text, so that one very long
document costs a few bytes of memory per byte of text and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

U64 = np.uint64
_rng = np.random.default_rng(20240229)
POSITION_CODES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column if pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = at[0] if len(at) else 0
    return data[first : at[-1]] if len(at) else data, at - first


def slices(batch: pa.RecordBatch, text: str, growth: int = 1) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch holding about SLICE_BYTES of text each, one row at least; `growth` is how many times longer a compressed text is."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    at = growth * flat(column if growth == 1 else column.cast(pa.large_binary()))[1]
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(at, at[row] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of the words, and each document's first word number (one more than documents)."""
    solid = ~IS_SPACE[data]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    edges = at[:-1][at[:-1] < at[1:]]
    before[edges] = False
    start = np.flatnonzero(solid & ~before)
    after = np.zeros_like(solid)
    after[:-1] = solid[1:] & before[1:]
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(start, at)


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each range, distinct byte strings by number) of byte ranges (ascending, not overlapping); equal bytes, and only those, have equal numbers."""
    length = end - start
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    offsets = np.concatenate([[0], np.cumsum(length)])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


PRIME = (1 << 61) - 1
_P, _LOW32, _LOW29 = U64(PRIME), U64(0xFFFFFFFF), U64((1 << 29) - 1)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, of numbers below it."""
    ah, al, bh, bl = a >> U64(32), a & _LOW32, b >> U64(32), b & _LOW32
    middle, low = ah * bl + al * bh, al * bl
    return reduced(((ah * bh) << U64(3)) + (middle >> U64(29)) + ((middle & _LOW29) << U64(32)) + (low >> U64(61)) + (low & _P))


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def running_sums(terms: np.ndarray, before: int = 0) -> np.ndarray:
    """Sums modulo 2^61 - 1 of the terms up to each, beginning with `before`; at most 2^32 terms."""
    high, low = np.cumsum(terms >> U64(32)), np.cumsum(terms & _LOW32)
    return reduced(reduced(times(reduced(high), _SHIFT) + reduced(low)) + U64(before))


def powers_of(base: int, n: int) -> np.ndarray:
    """The first n powers of the base modulo 2^61 - 1."""
    out = np.ones(n, dtype=np.uint64)
    have, scale = 1, base
    while have < n:
        more = min(have, n - have)
        for low in range(0, more, 1 << 15):
            part = slice(low, min(low + (1 << 15), more))
            out[have + part.start : have + part.stop] = times(out[part], np.full(1, scale, dtype=np.uint64))
        have, scale = 2 * have, scale * scale % PRIME
    return out


_SHIFT = np.full(1, 1 << 32, dtype=np.uint64)
#: Drawn once: the hashes' base and a code for each byte.
BASE = int(_rng.integers(1 << 40, PRIME - 1))
BYTE_CODES = _rng.integers(1, PRIME, 256, dtype=np.uint64)
BLOCK_BYTES = 1 << 15
_POWERS, _INVERSES = powers_of(BASE, BLOCK_BYTES + 1), powers_of(pow(BASE, -1, PRIME), BLOCK_BYTES + 1)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges (ascending, not overlapping): polynomials of their bytes' codes modulo 2^61 - 1.

    Ranges of a block come from its prefix sums; a range longer than a block is summed block
    by block. Powers of two as moduli won't do: for them some strings collide at any base.
    """
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + BLOCK_BYTES, side="right"))
        if j <= i:
            out[i] = _long_hash(data[start[i] : end[i]])
            i += 1
            continue
        low, high = int(start[i]), int(end[j - 1])
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        sums[1:] = running_sums(times(BYTE_CODES[data[low:high]], _POWERS[: high - low]))
        a, b = start[i:j] - low, end[i:j] - low
        out[i:j] = times(reduced(sums[b] + _P - sums[a]), _INVERSES[a])
        i = j
    return mix(out ^ mix((end - start).astype(np.uint64)))


def _long_hash(data: np.ndarray) -> np.uint64:
    total, scale, step = 0, 1, pow(BASE, BLOCK_BYTES, PRIME)
    for low in range(0, len(data), BLOCK_BYTES):
        part = data[low : low + BLOCK_BYTES]
        total += int(running_sums(times(BYTE_CODES[part], _POWERS[: len(part)]))[-1]) * scale
        scale = scale * step % PRIME
    return U64(total % PRIME)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offsets): every document's runs of `size` words; a shorter document is one run of all its words."""
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(offsets[-1]), dtype=np.uint64)
    if len(hashes) >= size:
        runs = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
        for k in range(size):
            runs += hashes[k : len(runs) + k] * POSITION_CODES[k]
        full = count >= size
        index = np.arange(int(n[full].sum())) + np.repeat(first[:-1][full] - np.concatenate([[0], np.cumsum(n[full])])[:-1], n[full])
        target = np.repeat(full, n)
        out[target] = mix(runs[index])
    for d in np.flatnonzero((count > 0) & (count < size)):
        w = hashes[first[d] : first[d + 1]]
        out[offsets[d]] = mix((w * POSITION_CODES[: len(w)]).sum(dtype=np.uint64, keepdims=True) ^ U64(len(w)))[0]
    return out, offsets


def shingle_sets(column: pa.Array, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offsets): each document's distinct shingle hashes, ascending."""
    data, at = flat(column)
    if lower:
        data = LOWER[data]
    start, end, first = words(data, at)
    runs, offsets = shingles(range_hashes(data, start, end), first, size)
    parts = [np.unique(runs[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    sizes = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    return (np.concatenate(parts) if parts else runs), np.concatenate([[0], np.cumsum(sizes)])


class MinHash:
    """`n` universal hash permutations x -> a*x + b of 32-bit values, a odd."""

    def __init__(self, n: int, seed: int):
        r = np.random.default_rng(seed)
        self.n = n
        self.a = (r.integers(0, 1 << 31, n, dtype=np.uint64) * U64(2) + U64(1)).astype(np.uint32)
        self.b = r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)

    def signatures(self, sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of n minima for each set; an empty set gets the largest value everywhere."""
        count = np.diff(offsets)
        out = np.full((len(count), self.n), 0xFFFFFFFF, dtype=np.uint32)
        full = np.flatnonzero(count)
        # Blocks keep the working set in cache.
        i = 0
        while i < len(full):
            j = max(int(np.searchsorted(offsets[full], offsets[full[i]] + 65536)), i + 1)
            low, high = offsets[full[i]], offsets[full[j - 1] + 1]
            x = (sets[low:high] >> U64(32)).astype(np.uint32)
            cuts = offsets[full[i:j]] - low
            y = np.empty_like(x)
            for k in range(self.n):
                np.multiply(x, self.a[k], out=y)
                np.add(y, self.b[k], out=y)
                out[full[i:j], k] = np.minimum.reduceat(y, cuts)
            i = j
        return out


def set_keys(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set: equal sets have equal keys."""
    count, keys = np.diff(offsets), []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ U64(salt)))])
        keys.append(mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ mix(count.astype(np.uint64))).view(np.int64))
    return keys[0], keys[1]


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of `rows` signature positions; the band's number is part of it."""
    n = signatures.shape[1] // rows
    out = np.empty((len(signatures), n), dtype=np.uint64)
    for b in range(n):
        h = np.full(len(signatures), b + 1, dtype=np.uint64)
        for k in range(rows):
            h = mix(h ^ (signatures[:, b * rows + k].astype(np.uint64) + U64(0x9E3779B97F4A7C15)))
        out[:, b] = h
    return out.view(np.int64)
