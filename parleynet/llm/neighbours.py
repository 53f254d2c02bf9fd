"""Approximate nearest neighbours by a forest of random-projection trees.

A tree cuts space by hyperplanes: a node's normal is the difference of two sampled vectors
and its cut the median projection of the node's sample. The forest is fitted on a bounded
sample (Settings.sample vectors, those of the smallest digests), while every vector is
indexed: each lands in one leaf of each tree.

A query is searched in all trees through one priority queue. An entry is a node with the
chance that a neighbour of the query lies below it; the chance at a node follows from the
query's distance to the hyperplane against the distance of its nearest sampled vectors, by a
normal law whose spread is fitted on neighbours inside the sample. The likeliest node of
any tree is opened next, and the search ends when the chance that a neighbour is in no
opened leaf of any tree is below `miss`. So a query in a dense cluster opens few leaves, and
one in a cloud without structure opens as many as it needs: there is no cap on candidates.

Leaves are dealt into blocks of bounded size. Queries meet the blocks of their leaves, where
candidates are ranked by exact distances; the nearest of all blocks are the answer.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_MEMBERS, BLOCK_QUERIES = 65_536, 262_144
FOUND = "query_id long, vec_id long, score double"
SEATS = "dim int, tree int, leaf int, part int, turn int, asks boolean, vec_id long, vector binary"


class Settings:
    """k neighbours; trees of at most `leaves` leaves, each with `least` sampled vectors or more; `miss` as above."""

    def __init__(self, k: int = 10, trees: int = 3, leaves: int = 128, least: int = 32, sample: int = 8192, probes: int = 256, miss: float = 0.05, seed: int = 5):
        self.k, self.trees, self.leaves, self.least, self.sample, self.probes, self.miss, self.seed = k, trees, leaves, least, sample, probes, miss, seed


class Forest:
    """Trees of one dimension, fitted on sampled vectors out of `total`; without a sample, one tree of one leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, total: int, s: Settings):
        self.s, self.ids, self.sample = s, ids, vectors
        n = len(vectors)
        self.depth = max(0, int(math.log2(min(s.leaves, max(1, n // s.least)))))
        self.trees, self.leaves = (s.trees if self.depth else 1), 1 << self.depth
        rng = np.random.default_rng(s.seed)
        self.normals = np.zeros((self.trees, self.leaves, vectors.shape[1]))
        self.cuts = np.zeros((self.trees, self.leaves))
        for t in range(self.trees):
            inside = {1: np.arange(n)}
            for v in range(1, self.leaves):
                at = inside.pop(v)
                a, b = vectors[rng.choice(at, 2, replace=False)]
                normal = a - b if (a != b).any() else rng.standard_normal(vectors.shape[1])
                self.normals[t, v] = normal / np.linalg.norm(normal)
                along = vectors[at] @ self.normals[t, v]
                # Halves of the sample, also where projections tie.
                order = np.argsort(along, kind="stable")
                self.cuts[t, v] = along[order[len(at) // 2]]
                right = along >= self.cuts[t, v]
                if right.all():
                    right = along > self.cuts[t, v]
                    self.cuts[t, v] = along[right].min() if right.any() else np.nextafter(self.cuts[t, v], np.inf)
                if right.sum() < 2 or (~right).sum() < 2:
                    right = np.zeros(len(at), dtype=bool)
                    right[order[len(at) // 2 :]] = True
                inside[2 * v], inside[2 * v + 1] = at[~right], at[right]
        self.held = np.zeros((self.trees, self.leaves), dtype=np.int64)
        if n:
            for t, leaf in enumerate(self.leaf(vectors)):
                np.add.at(self.held[t], leaf, 1)
        # Which of a query's nearest sampled vectors stands for its k-th neighbour.
        self.nearest = min(max(n - 1, 0), math.ceil(s.k * n / max(total, 1)) + 1)
        self.shrink, self.spread, self.visits = 0.0, 1.0, float(self.trees * self.leaves)
        if self.depth:
            self._fit(rng)

    def _fit(self, rng: np.random.Generator) -> None:
        """Spread and shrinkage of neighbours' projections, and the mean number of leaves that a query opens, from probes of the sample."""
        at = rng.choice(len(self.sample), min(self.s.probes, len(self.sample)), replace=False)
        x = self.sample[at]
        near, radius = self._near(x, self.ids[at])
        sides, steps, turns = [], [], []
        for t in range(self.trees):
            v = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.normals[t, v]) - self.cuts[t, v]
                for j in range(near.shape[1]):
                    y = self.sample[near[:, j]]
                    sides.append(side)
                    steps.append(np.einsum("ij,ij->i", y, self.normals[t, v]) - self.cuts[t, v] - side)
                    turns.append(radius)
                v = 2 * v + (side >= 0)
        side, step, radius = map(np.concatenate, (sides, steps, turns))
        pull = side * radius**2
        if (pull * pull).sum() > 0:
            self.shrink = max(0.0, float(-(step * pull).sum() / (pull * pull).sum()))
        off = step + np.minimum(self.shrink * radius**2, 1.0) * side
        if (radius > 0).any():
            self.spread = float(np.sqrt(np.mean((off[radius > 0] / radius[radius > 0]) ** 2)))
        self.visits = len(self.search(x, self.ids[at])[0]) / len(x)

    def _near(self, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest sampled vectors of other ids (up to self.nearest), and the distance of the last."""
        k = max(1, self.nearest)
        near, radius = np.empty((len(x), k), dtype=np.int64), np.empty(len(x))
        squares = np.einsum("ij,ij->i", self.sample, self.sample)
        for low in range(0, len(x), 256):
            part = x[low : low + 256]
            d = squares - 2 * (part @ self.sample.T)
            d[ids[low : low + 256, None] == self.ids[None, :]] = np.inf
            best = np.argpartition(d, k - 1, axis=1)[:, :k]
            near[low : low + 256] = best
            radius[low : low + 256] = np.sqrt(((part[:, None, :] - self.sample[best]) ** 2).sum(axis=2)).max(axis=1)
        return near, radius

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.ones((self.trees, len(x)), dtype=np.int64)
        for t in range(self.trees):
            for _ in range(self.depth):
                v = out[t]
                for low in range(0, len(x), 4096):
                    u = v[low : low + 4096]
                    v[low : low + 4096] = 2 * u + (np.einsum("ij,ij->i", x[low : low + 4096], self.normals[t, u]) >= self.cuts[t, u])
        return out - self.leaves

    def search(self, x: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """(row, tree, leaf) of the leaves that each query opens."""
        rows: list[int] = []
        trees: list[int] = []
        leaves: list[int] = []
        if not self.depth:
            return list(range(len(x))), [0] * len(x), [0] * len(x)
        _, radius = self._near(x, ids)
        # With fewer sampled vectors than are asked for, all leaves are opened.
        wanted = self.s.k + 1 if len(np.unique(self.ids)) > self.s.k + 1 else np.inf
        for i in range(len(x)):
            side = (self.normals @ x[i] - self.cuts) * (1 - min(self.shrink * radius[i] ** 2, 1.0))
            scale = max(self.spread * radius[i], 1e-12) * math.sqrt(2)
            queue = [(-1.0, t, 1) for t in range(self.trees)]
            missed, seen = [1.0] * self.trees, [0] * self.trees
            while queue and (math.prod(missed) > self.s.miss or max(seen) < wanted):
                chance, t, v = heapq.heappop(queue)
                if v >= self.leaves:
                    rows.append(i)
                    trees.append(t)
                    leaves.append(v - self.leaves)
                    missed[t] = max(0.0, missed[t] + chance)
                    seen[t] += int(self.held[t, v - self.leaves])
                    continue
                right = 0.5 * (1 + math.erf(side[t, v] / scale))
                heapq.heappush(queue, (chance * right, t, 2 * v + 1))
                heapq.heappush(queue, (chance * (1 - right), t, 2 * v))
        return rows, trees, leaves


def _sound(vector: Column) -> Column:
    """Whether a vector takes part: some component isn't zero and all are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lists(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)[at[0] : at[-1]], at - at[0]


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], type=pa.binary())


def fewest(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest ids of each distinct vector: no other copy can be among anyone's k nearest."""
    key = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    _, of = np.unique(key, return_inverse=True)
    order = np.lexsort((ids, of))
    again = np.concatenate([[False], (of[order[1:]] == of[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]])])
    order = order[~again]
    of = of[order]
    first = np.concatenate([[True], of[1:] != of[:-1]])
    place = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    return order[place < k]


def seats(rows: DataFrame, forests: dict[int, Forest], parts: dict[int, tuple[int, int]], s: Settings, kind: str) -> DataFrame:
    """SEATS: each vector in its leaf of each tree and each query in the leaves that it opens, by block.

    rows(vec_id, vector, asks). A leaf of dimension d has parts[d][0] parts of members and
    parts[d][1] turns of queries; a member sits in its part at each turn, a query in each
    part at its turn. Copies of a vector are cut to the k + 1 smallest ids of a batch.
    """
    none = {d: Forest(np.zeros(0, np.int64), np.zeros((0, d)), 0, s) for d in ()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            values, at = _lists(batch.column(1), np.dtype(kind))
            for dim in np.unique(np.diff(at)).tolist():
                rows_of = np.flatnonzero(np.diff(at) == dim)
                x = values[at[rows_of][:, None] + np.arange(dim)]
                forest = forests.get(dim) or none.setdefault(dim, Forest(np.zeros(0, np.int64), np.zeros((0, dim)), 0, s))
                n_parts, n_turns = parts.get(dim, parts[0])
                own = ids[rows_of]
                keep = fewest(own, x, s.k + 1)
                deal = (own[keep].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                packed = _bytes(x[keep])
                for t, leaf in enumerate(forest.leaf(x[keep].astype(np.float64))):
                    for turn in range(n_turns):
                        yield _seated(dim, np.full(len(keep), t), leaf, deal % n_parts, np.full(len(keep), turn), False, own[keep], packed)
                q = rows_of[asks[rows_of]]
                for low in range(0, len(q), 512):
                    place = q[low : low + 512]
                    x = values[at[place][:, None] + np.arange(dim)]
                    found = (np.array(c, dtype=np.int64) for c in forest.search(x.astype(np.float64), ids[place]))
                    row, tree, leaf = (np.repeat(c, n_parts) for c in found)
                    part = np.tile(np.arange(n_parts), len(row) // n_parts)
                    turn = (ids[place][row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n_turns
                    yield _seated(dim, tree, leaf, part, turn, True, ids[place][row], _bytes(x).take(pa.array(row)))

    return rows.mapInArrow(run, SEATS)


def _seated(dim: int, tree: np.ndarray, leaf: np.ndarray, part: np.ndarray, turn: np.ndarray, asks: bool, ids: np.ndarray, vectors: pa.Array) -> pa.RecordBatch:
    numbers = [np.full(len(ids), dim), tree, leaf, part, turn]
    columns = [pa.array(c, type=pa.int32()) for c in numbers] + [pa.array(np.full(len(ids), asks)), pa.array(ids, type=pa.int64()), vectors]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SEATS.split(", ")])


def ranked(x: np.ndarray, q_ids: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance): for each query the k nearest of y by exact distance, ties to smaller ids, without its own id; an id counts once."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    squares, step = np.einsum("ij,ij->i", y, y), max(1, (1 << 22) // max(1, len(y)))
    repeats = len(np.unique(ids)) < len(ids)
    for low in range(0, len(x), step):
        part, own = x[low : low + step], q_ids[low : low + step]
        near = np.einsum("ij,ij->i", part, part)[:, None] + squares - 2 * (part @ y.T)
        slack = 1e-12 * (near.shape[1] and (np.abs(squares).max() + np.einsum("ij,ij->i", part, part)))
        near[own[:, None] == ids[None, :]] = np.inf
        if len(y) > k and not repeats:
            edge = np.partition(near, k - 1, axis=1)[:, k - 1]
        else:
            edge = np.full(len(part), np.inf)
        for i in range(len(part)):
            # A product's rounding can't hide one of the k nearest; where it overflows, all are measured.
            all_ = not np.isfinite(edge[i]) or not np.isfinite(slack[i])
            at = np.flatnonzero(ids != own[i]) if all_ else np.flatnonzero(near[i] <= edge[i] + 64 * slack[i])
            exact = np.sqrt(((y[at] - part[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[at], exact))
            at, exact = at[order], exact[order]
            if repeats:
                _, first = np.unique(ids[at], return_index=True)
                first.sort()
                at, exact = at[first], exact[first]
            at, exact = at[:k], exact[:k]
            out.append((np.full(len(at), own[i]), ids[at], exact))
    return tuple(map(np.concatenate, zip(*out)))


def met(seated: DataFrame, s: Settings, kind: str) -> DataFrame:
    """FOUND of the queries of each block; members come first and are held, queries pass by."""
    keys = ("dim", "tree", "leaf", "part", "turn")
    dealt = seated.repartition(*keys).sortWithinPartitions(*keys, "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            change = np.any([c[1:] != c[:-1] for c in numbers[:6]], axis=0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:]):
                at = tuple(int(c[low]) for c in numbers[:5])
                if at != key:
                    key, held, block = at, [], None
                vectors = np.frombuffer(b"".join(batch.column(7).slice(low, high - low).to_pylist()), dtype=kind).reshape(high - low, at[0])
                if not numbers[5][low]:
                    held.append((numbers[6][low:high].copy(), vectors))
                    continue
                if block is None:
                    if not held:
                        continue
                    block = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]).astype(np.float64)
                    held = []
                query, found, score = ranked(vectors.astype(np.float64), numbers[6][low:high], block[1], block[0], s.k)
                yield pa.RecordBatch.from_arrays([pa.array(query, type=pa.int64()), pa.array(found, type=pa.int64()), pa.array(score)], ["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, FOUND)


def nearest(rows: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `asks` holds its k nearest rows found, by Euclidean distance in double precision.

    Ties go to the smaller id; a query with fewer candidates gets all. Rows with a null id
    and vectors that are null, empty, all zero or hold a null or non-finite component take
    no part; vectors are compared with those of their own length. Rows that repeat an id are
    one candidate, its nearest vector counts, and a query of such an id is answered once,
    from the nearest of its vectors. Other columns are not looked at. An empty table, or one
    without queries or candidates, gives an empty result.
    """
    s = settings or Settings()
    kind = "f4" if rows.schema[vector_col].dataType.elementType.typeName() == "float" else "f8"
    vector = F.col(vector_col) if kind == "f4" else F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & _sound(F.col("vector")))
    # One row a dimension; the sample has at most Settings.sample rows.
    totals = {r.dim: (r.n, r.q) for r in rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).orderBy(F.desc("n")).limit(1024).collect()}
    sample: dict[int, dict[int, list]] = {}
    for r in rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.sample).collect():
        sample.setdefault(len(r.vector), {})[r.vec_id] = r.vector
    forests = {d: Forest(np.array(list(x)), np.array(list(x.values()), dtype=np.float64), totals.get(d, (len(x), 0))[0], s) for d, x in sample.items()}
    largest = max((n for n, _ in totals.values()), default=1)
    parts = {0: (max(1, math.ceil(largest / BLOCK_MEMBERS)), 1)}
    for d, (n, q) in totals.items():
        f = forests.get(d)
        leaves, visits = (f.leaves, f.visits / f.trees) if f else (1, 1.0)
        # Twice the mean leaf, as the sample's medians are not quite those of all.
        parts[d] = max(1, math.ceil(2 * n / leaves / BLOCK_MEMBERS)), max(1, math.ceil(2 * q * visits / leaves / BLOCK_QUERIES))
    found = met(seats(rows, forests, parts, s, kind), s, kind)
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
