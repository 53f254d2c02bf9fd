"""Measures that need a whole small graph, one graph a group: numpy kernels under applyInPandas.

A graph has at most actors squared arcs whatever the number of edges behind them, and
graphs are independent of one another, so the work spreads over (outlet, phase, week, ...)
and a group's size is bounded by the vocabulary.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import written
from . import kernels
from .network import KEYS

#: Resamples of a key that one call works on.
BLOCK = 50

#: Rows whose draws are made at once, and arcs whose sums a task holds.
ROWS, HELD = 2048, 4096
#: Graphs of a series that one call works on.
SERIES = 32
#: Documents of a leaf of the tree down which draws are split, about.
LEAF_DOCS = 1024


def _schema(view: DataFrame, keys: tuple[str, ...], rest: str) -> str:
    return ", ".join(f"{k} {view.schema[k].dataType.simpleString()}" for k in keys) + ", " + rest


def _arrays(frame: pd.DataFrame, order: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return frame["source"].map(order).to_numpy(np.int64), frame["target"].map(order).to_numpy(np.int64), frame["strength"].to_numpy(np.float64)


def flow_brokerage(view: DataFrame, order: dict[str, int], keys: tuple[str, ...] = KEYS, reciprocal: str = "later_node") -> DataFrame:
    """(keys, actor, score): current-flow betweenness of each graph's largest component. Graphs of fewer than three linked actors give no rows."""
    names = list(order)

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        scores = kernels.current_flow(kernels.collapse(len(names), *_arrays(frame, order), reciprocal))
        return pd.DataFrame([(*key, names[v], x) for v, x in scores.items()], columns=[*keys, "actor", "score"])

    rows = view.where(F.col("source").isin(names) & F.col("target").isin(names)).select(*keys, "source", "target", "strength")
    return rows.groupBy(*keys).applyInPandas(one, _schema(view, keys, "actor string, score double"))


def flow_series(view: DataFrame, order: dict[str, int], keys: tuple[str, ...], step: str = "week", reciprocal: str = "later_node") -> DataFrame:
    """(keys, actor, score): flow_brokerage() of graphs whose last key `step` counts them, SERIES steps of the other keys at a time.

    A group holds that many graphs of actors squared arcs each at most; one graph's
    pseudo-inverse is carried on to the next.
    """
    names, others = list(order), [k for k in keys if k != step]

    def series(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(step, kind="stable")
        at, source, target, strength = frame[step].to_numpy(), *_arrays(frame, order)
        kernel, out = kernels.FlowSeries(), []
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for low, high in zip(cuts[:-1], cuts[1:]):
            w = kernels.collapse(len(names), source[low:high], target[low:high], strength[low:high], reciprocal)
            out += [(*key[:-1], at[low], names[v], x) for v, x in kernel.step(w).items()]
        return pd.DataFrame(out, columns=[*others, step, "actor", "score"])[[*keys, "actor", "score"]]

    rows = view.where(F.col("source").isin(names) & F.col("target").isin(names)).select(*keys, "source", "target", "strength")
    rows = rows.withColumn("block", F.floor(F.col(step) / SERIES))
    return rows.groupBy(*others, "block").applyInPandas(series, _schema(view, keys, "actor string, score double"))


def centralities(view: DataFrame, order: dict[str, int], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, actor, betweenness, pagerank) of every actor; a PageRank that doesn't settle is 0."""
    names = list(order)

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        s, t, w = _arrays(frame, order)
        between = kernels.betweenness(len(names), s, t, frame["distance"].to_numpy(np.float64))
        rank = kernels.pagerank(len(names), s, t, w)
        rank = np.zeros(len(names)) if rank is None else rank
        return pd.DataFrame([(*key, a, float(x), float(y)) for a, x, y in zip(names, between, rank)], columns=[*keys, "actor", "betweenness", "pagerank"])

    rows = view.select(*keys, "source", "target", "strength", "distance")
    return rows.groupBy(*keys).applyInPandas(one, _schema(view, keys, "actor string, betweenness double, pagerank double"))


def pairwise_brokerage(view: DataFrame, order: dict[str, int], brokers: list[str], a: str, b: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, actor, share): how much of the shortest paths between a and b goes through each broker."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        s, t, _ = _arrays(frame, order)
        d = frame["distance"].to_numpy(np.float64)
        return pd.DataFrame([(*key, x, kernels.path_share(len(order), s, t, d, order[x], order[a], order[b])) for x in brokers], columns=[*keys, "actor", "share"])

    rows = view.select(*keys, "source", "target", "strength", "distance")
    return rows.groupBy(*keys).applyInPandas(one, _schema(view, keys, "actor string, share double"))


def path_share(order: dict[str, int], broker: str, a: str, b: str) -> Callable[[pd.DataFrame], float]:
    """A statistic for bootstrap(): how much of the shortest paths between a and b goes through the broker."""

    def share(frame: pd.DataFrame) -> float:
        s, t, _ = _arrays(frame, order)
        return kernels.path_share(len(order), s, t, frame["distance"].to_numpy(np.float64), order[broker], order[a], order[b])

    return share


def multiplicities(documents: np.ndarray, n: int) -> np.ndarray:
    """Row i, column r: how often resample r draws the document of hash documents[i], by a Poisson law of mean 1."""
    with np.errstate(over="ignore"):
        x = documents.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    cuts = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(18)])
    return np.searchsorted(cuts, u, side="right")


def _drawn(width: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (arc of `width` columns, w, document) to (arc, sum of w over each resample), added up over a task's rows; sums of HELD arcs at most are in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        names, types = None, None

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, type=t) for c, t in zip(zip(*sums), types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), type=pa.list_(pa.float64()))], [*names, "drawn"])

        for batch in batches:
            names, types = batch.schema.names[:width], batch.schema.types[:width]
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                at: dict[tuple, int] = {}
                codes = np.array([at.setdefault(a, len(at)) for a in zip(*(part.column(i).to_pylist() for i in range(width)))])
                order = np.argsort(codes, kind="stable")
                weighed = multiplicities(part.column(width + 1).to_numpy(zero_copy_only=False), n) * part.column(width).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
                added = np.add.reduceat(weighed[order], np.searchsorted(codes[order], np.arange(len(at))), axis=0)
                for a, i in at.items():
                    sums[a] = sums[a] + added[i] if a in sums else added[i]
                if len(sums) >= HELD:
                    yield out()
                    sums = {}
        if sums:
            yield out()

    return run


def bootstrap(edges: DataFrame, statistic: Callable[[pd.DataFrame], float], n: int = 500, seed: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, mean, low, high): the statistic over n resamples of documents with replacement, with its 2.5 and 97.5 percentiles.

    edges(keys, doc_id, source, target, weight). A document's multiplicity in a resample
    is drawn from a Poisson law of mean 1 by a hash of document, resample and seed, the
    usual distributed form of drawing with replacement: documents are never gathered, and
    a task adds up its documents' draws, so that it sends on a row for each arc
    it met, however many documents it read. BLOCK resamples of a key, arcs each, are one
    group of the statistic. It gets a frame (source, target, strength, distance); a resample
    without an arc of positive strength counts with the statistic of the empty frame.
    """
    per_doc = edges.groupBy(*keys, "doc_id", "source", "target").agg(F.sum(F.abs("weight")).alias("w")).where("w > 0")
    arc = [*keys, "source", "target"]
    rows = per_doc.select(*arc, "w", F.xxhash64(*keys, "doc_id", F.lit(seed)).alias("document"))
    parts = rows.mapInArrow(_drawn(len(arc), n), ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in arc) + ", drawn array<double>")
    return _interval(edges.select(*keys), parts, statistic, n, keys)


def leaf_draws(key: tuple, sizes: list[int], leaf: int, n: int, seed: int, met: dict | None = None) -> np.ndarray:
    """How many documents each of n resamples draws from a leaf of the key's tree of documents.

    sizes: documents of the nodes from the root down to the leaf. A node's draws are split
    between its halves by a binomial law, from a generator of the node's own, so that all
    leaves below it see the same split and each resample has as many draws as there are documents.
    met: the nodes above the leaf before, kept between calls, as leaves that follow one another share most of them.
    """
    depth = len(sizes) - 1
    draws = np.full(n, sizes[0], dtype=np.int64)
    for level in range(depth):
        node = leaf >> (depth - level)
        bit = (leaf >> (depth - level - 1)) & 1
        if met is None or level not in met or met[level][0] != (key, node):
            left = sizes[level + 1] if not bit else sizes[level] - sizes[level + 1]
            taken = _generator(key, level, node, seed).binomial(draws, left / sizes[level])
            if met is not None:
                met[level] = (key, node), taken
        else:
            taken = met[level][1]
        draws = draws - taken if bit else taken
    return draws


def _generator(*of) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(of).encode(), digest_size=16).digest(), "little"))


def leaf_multiplicities(key: tuple, sizes: list[int], leaf: int, n: int, seed: int, met: dict | None = None) -> np.ndarray:
    """Row i, column r: how often resample r draws the leaf's document i; a draw takes each of them with the same chance."""
    draws, k = leaf_draws(key, sizes, leaf, n, seed, met), sizes[-1]
    which = _generator(key, "leaf", leaf, seed).integers(0, k, int(draws.sum()))
    which *= n
    which += np.repeat(np.arange(n), draws)
    return np.bincount(which, minlength=k * n).reshape(k, n)


def _leaf_sums(width: int, n: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (key of `width` columns, leaf, doc, sizes, source, target, w) to (key, source, target, sums of w over each resample), added up over a task's leaves.

    A leaf's rows are together: first the one with its sizes, then its documents in order,
    each a row without a weight and then its arcs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        held: list[pa.RecordBatch] = []
        met: dict = {}
        names: list[str] = []
        types: list[pa.DataType] = []

        def add() -> None:
            rows = pa.Table.from_batches(held)
            *key, leaf, _, sizes, _, _, _ = rows.slice(0, 1).to_pylist()[0].values()
            is_arc = rows.column(width + 5).slice(1).combine_chunks().is_valid()
            if is_arc.true_count:
                found = rows.slice(1).filter(is_arc).combine_chunks()
                # Arcs of the leaf by number; nulls are a name as others.
                ends = [found.column(width + i).combine_chunks().dictionary_encode(null_encoding="encode") for i in (3, 4)]
                source, target = (e.dictionary.to_pylist() for e in ends)
                codes = ends[0].indices.to_numpy().astype(np.int64) * len(target) + ends[1].indices.to_numpy()
                order = np.argsort(codes, kind="stable")
                known, firsts = np.unique(codes[order], return_index=True)
                is_arc = is_arc.to_numpy(zero_copy_only=False)
                doc = (np.cumsum(~is_arc) - 1)[is_arc]
                weighed = leaf_multiplicities(tuple(key), sizes, leaf, n, seed, met)[doc[order]]
                weights = found.column(width + 5).to_numpy()[order]
                weighed = weighed if (weights == 1).all() else weighed * weights[:, None]
                for code, added in zip(known.tolist(), np.add.reduceat(weighed, firsts, axis=0)):
                    arc = (*key, source[code // len(target)], target[code % len(target)])
                    sums[arc] = sums[arc] + added if arc in sums else added.copy()
            held.clear()

        for batch in batches:
            names, types = [*batch.schema.names[:width], "source", "target"], [*batch.schema.types[:width], pa.string(), pa.string()]
            cuts = [0, *np.flatnonzero(batch.column(width + 2).is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]
            for i, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
                if i and held:
                    add()
                    if len(sums) >= HELD:
                        yield _sums_batch(sums, names, types)
                        sums.clear()
                if high > low:
                    held.append(batch.slice(low, high - low))
        if held:
            add()
        if sums:
            yield _sums_batch(sums, names, types)

    return run


def _sums_batch(sums: dict[tuple, np.ndarray], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(c, type=t) for c, t in zip(zip(*sums), types)]
    drawn = np.stack(list(sums.values())).astype(np.float64, copy=False)
    starts = pa.array(np.arange(len(drawn) + 1, dtype=np.int32) * drawn.shape[1], type=pa.int32())
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(starts, pa.array(drawn.ravel()))], [*names, "drawn"])


def _added_up(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (arc of `width` columns, drawn), an arc's together, to one row an arc with the sum of its arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        names, types = None, None
        for batch in batches:
            names, types = batch.schema.names[:width], batch.schema.types[:width]
            arcs, drawn = zip(*(batch.column(i).to_pylist() for i in range(width))), batch.column(width)
            rows = drawn.flatten().to_numpy().reshape(batch.num_rows, -1)
            for arc, row in zip(arcs, rows):
                if arc not in sums and len(sums) >= HELD:
                    yield _sums_batch(sums, names, types)
                    sums = {}
                sums[arc] = sums[arc] + row if arc in sums else row.copy()
        if sums:
            yield _sums_batch(sums, names, types)

    return run


def _joined(left: DataFrame, right: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """left's rows with right's other columns, by equal columns; nulls are equal."""
    right = right.withColumnsRenamed({c: f"right_{c}" for c in columns})
    met = [left[c].eqNullSafe(F.col(f"right_{c}")) for c in columns]
    return left.join(right, met).drop(*(f"right_{c}" for c in columns))


def exact_bootstrap(edges: DataFrame, statistic: Callable[[pd.DataFrame], float], n: int = 500, seed: int = 0, keys: tuple[str, ...] = KEYS, leaf_docs: int = LEAF_DOCS) -> DataFrame:
    """bootstrap() whose resamples hold exactly as many documents as there are.

    The documents of a key are the leaves' contents of a binary tree by their hash, some
    leaf_docs a leaf; a resample's draws are split down the tree. A task works on whole
    leaves that follow one another, so that it meets the arcs of few keys, and adds up
    their draws; what it needs of the tree is the sizes of the nodes above a leaf.
    Documents without a positive weight are drawn too and add nothing.
    """
    rows = edges.select(*keys, F.col("doc_id").cast("string").alias("doc"), "source", "target", F.abs("weight").cast("double").alias("w")).repartition(*keys, "doc")
    # Once for the document itself, and once for an arc that weighs something.
    rows = rows.withColumn("is_arc", F.explode(F.when(F.col("w") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    ends = [F.when(F.col("is_arc"), F.col(c)).alias(c) for c in ("source", "target")]
    # Read several times below, so the edges and their documents are worked out once.
    docs = written(rows.groupBy(*keys, "doc", "is_arc", *ends).agg(F.sum(F.when(F.col("is_arc"), F.col("w"))).alias("w")))
    # One number: the most documents of any key.
    most = docs.where("NOT is_arc").groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(most, 1) / leaf_docs)))
    docs = docs.withColumn("leaf", F.shiftrightunsigned(F.xxhash64(*keys, "doc", F.lit(seed)), 64 - depth) if depth else F.lit(0).cast("long"))
    leaves = docs.where("NOT is_arc").groupBy(*keys, "leaf").agg(F.count("*").alias("n"))
    above = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("node", F.expr(f"shiftrightunsigned(leaf, {depth} - level)"))
    nodes = above.groupBy(*keys, "level", "node").agg(F.sum("n").alias("size"))
    paths = _joined(above, nodes, (*keys, "level", "node")).groupBy(*keys, "leaf").agg(F.sort_array(F.collect_list(F.struct("level", "size"))).alias("p"))
    paths = written(paths.select(*keys, "leaf", F.transform("p", lambda x: x["size"]).alias("sizes")))
    rows = docs.select(*keys, "leaf", "doc", F.lit(None).cast("array<bigint>").alias("sizes"), "source", "target", "w").unionByName(paths, allowMissingColumns=True)
    rows = rows.repartitionByRange(*keys, "leaf").sortWithinPartitions(*keys, "leaf", F.col("sizes").isNull(), "doc", F.col("w").isNotNull())
    parts = rows.mapInArrow(_leaf_sums(len(keys), n, seed), _schema(edges, (*keys, "source", "target"), "drawn array<double>"))
    return _interval(docs.where("NOT is_arc").select(*keys), parts, statistic, n, keys)


def _interval(keyed: DataFrame, parts: DataFrame, statistic: Callable[[pd.DataFrame], float], n: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, mean, low, high) of the statistic for every key of keyed, from parts(keys, source, target, drawn), partial sums of each resample.

    Parts are added up as arrays: there is one for each task and arc, and taken apart they
    would be as many rows again as there are resamples.
    """
    empty = float(statistic(pd.DataFrame({"source": pd.Series(dtype=str), "target": pd.Series(dtype=str), "strength": pd.Series(dtype=float), "distance": pd.Series(dtype=float)})))
    arc = [*keys, "source", "target"]
    together = parts.repartition(*arc).sortWithinPartitions(*arc)
    arcs = together.mapInArrow(_added_up(len(arc)), _schema(parts, tuple(arc), "drawn array<double>"))
    width = len(keys)

    def block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame, rows = frame.sort_values(["source", "target"]), []
        for i, strength in enumerate(np.stack(frame["drawn"].to_list()).T):
            f = frame[["source", "target"]].assign(strength=strength)[strength > 0]
            if len(f):
                rows.append((*key[:width], int(key[width]) * BLOCK + i, float(statistic(f.assign(distance=1.0 / f["strength"])))))
        return pd.DataFrame(rows, columns=[*keys, "resample", "value"])

    slices = F.transform(F.sequence(F.lit(0), F.lit(n - 1), F.lit(BLOCK)), lambda i: F.slice("drawn", i + 1, F.lit(BLOCK)))
    blocks = arcs.select(*arc, F.posexplode(slices).alias("block", "drawn"))
    values = blocks.groupBy(*keys, "block").applyInPandas(block, _schema(parts, keys, "resample int, value double"))
    grid = keyed.distinct().withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = [grid[k].eqNullSafe(values[k]) for k in (*keys, "resample")]
    values = grid.join(values, met, "left").select(*(grid[k] for k in keys), F.coalesce(values["value"], F.lit(empty)).alias("value"))
    bounds = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return values.groupBy(*keys).agg(F.avg("value").alias("mean"), bounds.alias("p")).select(*keys, "mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
