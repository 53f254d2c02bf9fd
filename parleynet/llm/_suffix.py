"""Suffix orders of many texts at once, common prefixes, and range minima.

The words of a batch of texts lie in one sequence, each text closed by a mark of its own:
word i of text d is at i + d. Marks are smaller than all words, and words of different texts
are different symbols, so that nothing compares equal across texts.
"""

from __future__ import annotations

import numpy as np

from . import _text as T

U64 = np.uint64
BLOCK = 1 << 15


class Sequence:
    """Symbols of texts' words: ids (equal for equal words, from 0 on) and each text's first word number, with the total."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        self.n_texts, self.first = len(first) - 1, first
        self.size = len(ids) + self.n_texts
        self.ids = ids.astype(np.int32, copy=False)
        self.texts = np.repeat(np.arange(self.n_texts, dtype=np.int32), np.diff(first))
        self.at = np.arange(len(ids), dtype=np.int32) + self.texts
        self.ends = (first[1:] + np.arange(self.n_texts)).astype(np.int32)
        self.span = int(ids.max()) + 2 if len(ids) else 2

    def reversed(self) -> Sequence:
        """Each text backwards; word k of a text of n words is at place n - 1 - k of the text."""
        back = np.repeat(self.first[:-1] + self.first[1:] - 1, np.diff(self.first)) - np.arange(len(self.ids))
        return Sequence(self.ids[back], self.first)

    def ranks(self, backwards: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
        """(rank, repeated, step): the place of every suffix in their order, whether its first word occurs elsewhere in its text, and a power of two beyond every common prefix.

        Words compare by id, backwards from the largest; a mark comes first in either order.
        Prefix doubling: in a round only suffixes that still tie are sorted again.
        """
        rank = np.empty(self.size, dtype=np.int32)
        rank[self.ends] = np.arange(self.n_texts, dtype=np.int32)
        repeated = np.zeros(self.size, dtype=bool)
        n = len(self.ids)
        if not n:
            return rank, repeated, 1
        own = self.texts.astype(np.int64)
        own *= self.span
        own += self.span - 1 - self.ids if backwards else self.ids
        order = np.argsort(own, kind="stable").astype(np.int32)
        new = np.empty(n, dtype=bool)
        new[0] = True
        np.not_equal(own[order[1:]], own[order[:-1]], out=new[1:])
        del own
        lone = np.empty(n, dtype=bool)
        lone[-1], lone[:-1] = new[-1], new[:-1] & new[1:]
        rank[self.at[order]] = self.n_texts + np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
        tied = self.at[order[~lone]]
        repeated[tied] = True
        del order, new, lone
        step = 1
        while len(tied):
            pair = (rank[tied].astype(np.int64) << 32) | rank[tied + step]
            by = np.argsort(pair, kind="stable")
            tied, pair = tied[by], pair[by]
            del by
            group = np.concatenate([[True], (pair[1:] >> 32) != (pair[:-1] >> 32)])
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            index = np.arange(len(tied), dtype=np.int32)
            offset = np.maximum.accumulate(np.where(new, index, np.int32(0))) - np.maximum.accumulate(np.where(group, index, np.int32(0)))
            rank[tied] = (pair >> 32).astype(np.int32) + offset
            del pair, index, offset, group
            tied = tied[~(new & np.concatenate([new[1:], [True]]))]
            step *= 2
        return rank, repeated, step

    def common(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """Symbols that the suffixes at a and at b (a < b is not needed) have in common, below 2 * step.

        Ranges compare by polynomials modulo 2^61 - 1 from one array of prefix sums.
        """
        sums, powers = self._sums()
        out = np.zeros(len(a), dtype=np.int32)
        for low in range(0, len(a), BLOCK):
            x, y = np.minimum(a[low : low + BLOCK], b[low : low + BLOCK]).astype(np.int64), np.maximum(a[low : low + BLOCK], b[low : low + BLOCK]).astype(np.int64)
            shift, span = powers[y - x], step
            found = np.zeros(len(x), dtype=np.int64)
            while span:
                u, v = x + found, y + found
                fits = np.flatnonzero(v + span <= self.size)
                u, v = u[fits], v[fits]
                left = T.times(T.reduced(sums[u + span] + U64(T.PRIME) - sums[u]), shift[fits])
                found[fits[left == T.reduced(sums[v + span] + U64(T.PRIME) - sums[v])]] += span
                span //= 2
            out[low : low + BLOCK] = found
        return out

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        # Symbols first, made sums in place block by block.
        sums = np.zeros(self.size + 1, dtype=np.uint64)
        for low in range(0, len(self.ids), BLOCK):
            part = slice(low, low + BLOCK)
            sums[self.at[part] + 1] = (self.texts[part].astype(np.int64) * self.span + self.ids[part] + 1).astype(np.uint64)
        sums[self.ends + 1] = (np.arange(self.n_texts, dtype=np.int64) * self.span).astype(np.uint64)
        powers = T.powers_of(T.BASE, self.size + 1)
        carry = 0
        for low in range(0, self.size, BLOCK):
            symbols = sums[low + 1 : low + 1 + BLOCK]
            term = T.times(T.reduced(T.mix(symbols) >> U64(3)), powers[low : low + len(symbols)])
            sums[low + 1 : low + 1 + len(term)] = T.running_sums(term, carry)
            carry = int(sums[low + len(term)])
        return sums, powers


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value; the length where there is none.

    Pointers jump along pointers: what lies between a place and its pointer is never smaller.
    The few that are left then are followed from the right, each pointer passed once.
    """
    n = len(values)
    v = np.append(values, values.min() - 1 if n else 0)
    after = np.arange(1, n + 1)
    open_ = np.flatnonzero(v[after] > v[:n])
    rounds = 0
    while len(open_) > 1024 and rounds < 64:
        after[open_] = after[after[open_]]
        open_ = open_[v[after[open_]] > v[open_]]
        rounds += 1
    if len(open_):
        jump, of = after.tolist(), v.tolist()
        for i in reversed(open_.tolist()):
            j = jump[i]
            while of[j] > of[i]:
                j = jump[j]
            jump[i] = j
        after = np.array(jump)
    return after


class RangeMinimum:
    """Minima of ranges by a sparse table: of every stretch of a power of two places."""

    def __init__(self, values: np.ndarray):
        self.table = [values]
        while 2 << (len(self.table) - 1) <= len(values):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def minimum(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of values[low:high], low < high."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=self.table[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out


class Extensions:
    """Longest common extensions of pairs of suffixes: common prefixes of neighbours in their order, and range minima over them."""

    def __init__(self, sequence: Sequence, rank: np.ndarray, step: int):
        suffixes = np.empty(len(rank), dtype=np.int32)
        suffixes[rank] = np.arange(len(rank), dtype=np.int32)
        self.rank = rank
        self.minima = RangeMinimum(sequence.common(suffixes[:-1], suffixes[1:], step))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the different suffixes at a and at b have in common."""
        x, y = self.rank[a], self.rank[b]
        return self.minima.minimum(np.minimum(x, y), np.maximum(x, y)) if len(a) else np.zeros(0, dtype=np.int32)
