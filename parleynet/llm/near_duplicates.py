"""Near-duplicate detection by MinHash bands with sequential Bayesian verification.

Documents are sets of distinct word shingles. Documents with equal sets form one
class; a class is signed by MinHash and its bands name candidate pairs. A candidate
pair's signatures are compared a batch of positions at a time, and the pair is dropped
as soon as the posterior probability (uniform prior) that its similarity reaches the
threshold is below the chosen miss probability. What survives is verified exactly on
the full shingle sets of the whole texts, and verified links are closed to components.
Members of buckets that the pivots don't settle get further positions, so that the same
bounds are drawn closer there: in a group that shares a long passage most pairs are just
short of the threshold, and few may go on to the texts.

No bucket is ever expanded into all its pairs. Every bucket first compares its members
with one pivot, the member that shares the most buckets with others (the original of a
group of near copies shares more with each copy than the copies with one another).
Links that this finds are closed to components, and only in buckets that still hold
members of different components are those outside the pivot's compared further, block
against block inside a task; a link inside a component would change nothing.

No key has its rows in one task however many they are: a pivot's members are dealt into
parts, each part gets the pivot once, and seats of blocks hold signatures only. Texts are
read for pairs that signatures leave, compressed on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from ._run import components, forget, saved

SIGNED = "doc_id long, n_shingles long, key1 long, key2 long, signature binary"
#: Members of a bucket or pivot that one task takes; (id, part) rows sent to every task instead of shuffling texts to them.
PART_ROWS, SENT_ROWS = 4096, 500_000
FURTHER_BATCH = 64


def least_matches(compared: int, threshold: float, miss: float) -> int:
    """The fewest equal positions among `compared` for which P(similarity >= threshold) is at least `miss`.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at
    t is the probability of at most m successes in n + 1 trials of chance t.
    """
    tail, n = 0.0, compared + 1
    for m in range(compared + 1):
        tail += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if tail >= miss:
            return m
    return compared + 1


class Settings:
    """Parameters of one run; `numerator / denominator` is the similarity threshold."""

    def __init__(self, words: int = 5, numerator: int = 80, denominator: int = 100, bands: int = 25, rows: int = 5, batch: int = 25, miss: float = 1e-7, seed: int = 7, block: int = 512, further: int = 512):
        self.words, self.numerator, self.denominator = words, numerator, denominator
        self.bands, self.rows, self.seed, self.block = bands, rows, seed, block
        threshold = numerator / denominator
        self.steps = [(n, least_matches(n, threshold, miss)) for n in range(batch, bands * rows + 1, batch)]
        # Further positions, for members of open buckets only: a byte each, in batches after the signature's.
        self.further = further
        self.further_steps = [(n, least_matches(bands * rows + n, threshold, miss)) for n in range(FURTHER_BATCH, further + 1, FURTHER_BATCH)]

    def survives(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Which of the signature pairs pass every batch; set sizes too far apart can't reach the threshold."""
        alive = np.flatnonzero(np.minimum(n_a, n_b) * self.denominator >= np.maximum(n_a, n_b) * self.numerator)
        matches, done = np.zeros(len(alive), dtype=np.int64), 0
        for upto, least in self.steps:
            matches += (a[alive, done:upto] == b[alive, done:upto]).sum(axis=1)
            keep = matches >= least
            alive, matches, done = alive[keep], matches[keep], upto
        return alive

    def survives_further(self, matches: np.ndarray, a: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which of the pairs a[p], a[q] of further positions pass every batch, with `matches` equal positions of their signatures before."""
        alive, matches, done = np.arange(len(p)), matches.astype(np.int64), 0
        for upto, least in self.further_steps:
            matches = matches + (a[p[alive], done:upto] == a[q[alive], done:upto]).sum(axis=1)
            keep = matches >= least
            alive, matches, done = alive[keep], matches[keep], upto
        return alive


def sign(docs: DataFrame, s: Settings) -> DataFrame:
    """Set size, set keys and 16-bit MinHash signature of each (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = T.MinHash(s.bands * s.rows, s.seed)
        for batch in batches:
            for part in T.slices(batch, "text"):
                sets, at = T.shingle_sets(part.column(1), s.words)
                key1, key2 = T.set_keys(sets, at)
                short = (T.mix(family.signatures(sets, at).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(key1), pa.array(key2), _binary(short)], ["doc_id", "n_shingles", "key1", "key2", "signature"])

    return docs.mapInArrow(run, SIGNED)


def sign_further(docs: DataFrame, ids: DataFrame, s: Settings) -> DataFrame:
    """(cls, rep, further): the further positions of the texts of the ids, named as classes are.

    Up to SENT_ROWS ids go to the texts and those alone are signed; beyond, all texts are
    signed, since positions are narrower to move than texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = T.MinHash(s.further, s.seed + 1)
        for batch in batches:
            for part in T.slices(batch, "text"):
                sets, at = T.shingle_sets(part.column(1), s.words)
                key1, _ = T.set_keys(sets, at)
                short = (T.mix(family.signatures(sets, at).astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(key1), part.column(0), _binary(short)], ["cls", "rep", "further"])

    docs = docs.select("doc_id", "text")
    if ids.count() <= SENT_ROWS:
        docs = docs.join(F.broadcast(ids.withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi")
    return docs.mapInArrow(run, "cls long, rep long, further binary").dropDuplicates(["cls", "rep"])


def _binary(rows: np.ndarray) -> pa.Array:
    width, n = rows.shape[1] * rows.itemsize, len(rows)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _signatures(column: pa.Array, width: int, kind: type = np.uint16) -> np.ndarray:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset]
    return np.frombuffer(data, dtype=kind, count=len(column) * width, offset=int(at)).reshape(len(column), width)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def band_rows(classes: DataFrame, s: Settings) -> DataFrame:
    """(bucket, cls): a row for each band of each class(cls, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes = T.band_hashes(_signatures(batch.column(1), s.bands * s.rows), s.rows)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.ravel()), pa.array(np.repeat(_numbers(batch, "cls"), s.bands))], ["bucket", "cls"])

    return classes.select("cls", "signature").mapInArrow(run, "bucket long, cls long")


def pivot_candidates(rows: DataFrame, pivots: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Distinct (a, b, part): members whose signature doesn't rule out a link with their bucket's pivot b, both as ids, in the part that they are dealt into.

    rows(bucket, cls), pivots(bucket, pivot, size, parts), classes(cls, rep, n, signature).
    """
    salts = F.ceil(F.col("size") / PART_ROWS).cast("int")
    salted = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    members = rows.withColumn("salt", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / PART_ROWS)).cast("int")).drop("size")
    pairs = members.join(salted, ["bucket", "salt"]).where("cls <> pivot")
    pairs = pairs.select("cls", "pivot", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part")).distinct()
    heads = pivots.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).distinct().withColumn("cls", F.col("pivot"))
    seats = pairs.withColumn("head", F.lit(False)).unionByName(heads.withColumn("head", F.lit(True)))
    seats = seats.join(classes, "cls").select("pivot", "part", "head", "rep", "n", "signature")
    seats = seats.repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.desc("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, held = s.bands * s.rows, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, rep, n, part, head = _signatures(batch.column(5), width), *(_numbers(batch, c) for c in ("rep", "n", "part", "head"))
            of = np.cumsum(head) - 1  # the row's pivot among this batch's; -1: the one before
            firsts = np.flatnonzero(head)
            held = held if held is not None else (sig[:1], rep[:1], n[:1])
            p_sig, p_rep, p_n = (np.concatenate([x, y[firsts]]) for x, y in zip(held, (sig, rep, n)))
            at = np.flatnonzero(~head)
            other = of[at] + 1
            alive = s.survives(sig[at], p_sig[other], n[at], p_n[other])
            yield pa.RecordBatch.from_arrays([pa.array(rep[at[alive]]), pa.array(p_rep[other[alive]]), pa.array(part[at[alive]])], ["a", "b", "part"])
            held = p_sig[-1:].copy(), p_rep[-1:].copy(), p_n[-1:].copy()

    return seats.mapInArrow(run, "a long, b long, part int")


def block_seats(rows: DataFrame, s: Settings) -> DataFrame:
    """The seats of open buckets' members: (bucket, down, across, left, right, cls, rep, n, pivot_cls, other, signature, further).

    rows(bucket, cls, rep, label, n, pivot_cls, pivot_label, members, outside, signature, further).
    Members of the pivot's component need no comparison with one another, so only the
    `outside` others are compared with all: blocks of the others against blocks of all,
    each dealt by the member's hash. While the others fill one block, a member travels
    once for itself and others travel along with every block of members.
    """
    wide, tall = (F.ceil(F.col(c) / s.block).cast("int") for c in ("members", "outside"))
    rows = rows.withColumn("other", F.col("label") != F.col("pivot_label")).withColumn("wide", wide).withColumn("tall", tall)
    rows = rows.withColumn("across", F.pmod(F.xxhash64("cls"), F.col("wide")).cast("int")).withColumn("down", F.pmod(F.xxhash64("cls"), F.col("tall")).cast("int"))

    def seat(down, across, left, right):
        return F.struct(down.alias("down"), across.alias("across"), left.alias("left"), right.alias("right"))

    right = F.transform(F.sequence(F.lit(0), F.col("tall") - 1), lambda d: seat(d, F.col("across"), F.col("other") & (d == F.col("down")), F.lit(True)))
    left = F.filter(F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda a: seat(F.col("down"), a, F.lit(True), F.lit(False))), lambda x: F.col("other") & (x.across != F.col("across")))
    dealt = rows.withColumn("seat", F.explode(F.concat(right, left)))
    return dealt.select("bucket", "seat.down", "seat.across", "seat.left", "seat.right", "cls", "rep", "n", "pivot_cls", "other", "signature", "further")


MARK = ("bucket", "down", "across", "mark", "mark_order")


def block_candidates(seats: DataFrame, labels: DataFrame, marks: DataFrame | None, round_: int, s: Settings) -> DataFrame:
    """(a, b, part) of different labels in a bucket that pass on signatures, and the blocks' marks (a null).

    A pair is handled in the first bucket that it shares, the likeliest pairs come first.
    A block gives 16 pairs a member, four times as many each round, and a mark of how far
    it came if pairs are left: once these pairs are verified and their labels joined, most
    of the rest are inside one component. marks are those of the round before; blocks
    without one are done.
    """
    seats = seats.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    if marks is not None:
        seats = seats.join(marks.select(*MARK), ["bucket", "down", "across"])
    else:
        seats = seats.withColumn("mark", F.lit(None).cast("long")).withColumn("mark_order", F.lit(None).cast("long"))
    names = ["bucket", "down", "across", "left", "right", "cls", "rep", "label", "n", "pivot_cls", "other", "signature", "further", "mark", "mark_order"]
    dealt = seats.select(*names).repartition("bucket", "down", "across").sortWithinPartitions("bucket", "down", "across")
    factor = 16 * 4**round_

    def compare(group: pa.RecordBatch) -> pa.RecordBatch | None:
        sig, further = _signatures(group.column(11), s.bands * s.rows), _signatures(group.column(12), s.further, np.uint8)
        cls, label, n, pivot, other, left, right, rep = (_numbers(group, x) for x in ("cls", "label", "n", "pivot_cls", "other", "left", "right", "rep"))
        here = int((T.band_hashes(sig[:1], s.rows)[0] == _numbers(group, "bucket")[0]).argmax())
        found = [np.zeros((4, 0), dtype=np.int64)]
        left, right = (np.flatnonzero(x & (cls != pivot)) for x in (left, right))
        step = max(1, (1 << 20) // max(1, len(right)))
        for i in range(0, len(left), step):
            a, b = left[i : i + step, None], right[None, :]
            # Of two others, the pair is the one's with the smaller number.
            ok = (label[a] != label[b]) & (~other[b] | (cls[a] < cls[b]))
            x, y = np.nonzero(ok)
            for k in range(0, len(x), 1 << 16):
                p, q = a[x[k : k + (1 << 16)], 0], right[y[k : k + (1 << 16)]]
                at = s.survives(sig[p], sig[q], n[p], n[q])
                same = sig[p[at]] == sig[q[at]]
                first = same.reshape(len(at), s.bands, s.rows).all(axis=2).argmax(axis=1) == here
                at, same = at[first], same[first]
                on = s.survives_further(same.sum(axis=1), further, p[at], q[at])
                at, same = at[on], same[on]
                place = T.mix(cls[p[at]].astype(np.uint64) ^ T.mix(cls[q[at]].astype(np.uint64))).view(np.int64)
                found.append(np.stack([p[at], q[at], -same.sum(axis=1), place]))
        pairs = np.concatenate(found, axis=1)
        pairs = pairs[:, np.lexsort((pairs[3], pairs[2]))]
        if group.column(13)[0].is_valid:
            mark, place = group.column(13)[0].as_py(), group.column(14)[0].as_py()
            pairs = pairs[:, (pairs[2] > mark) | ((pairs[2] == mark) & (pairs[3] > place))]
        if not pairs.shape[1]:
            return None
        more = pairs.shape[1] > factor * group.num_rows
        pairs = pairs[:, : factor * group.num_rows]
        rows = [(int(rep[i]), int(rep[j]), None, None, None, None, None) for i, j in pairs[:2].T.tolist()]
        if more:
            rows.append((None, None, *(_numbers(group, c)[0].item() for c in MARK[:3]), int(pairs[2, -1]), int(pairs[3, -1])))
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), kinds)], ["a", "b", *MARK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("bucket", "down", "across")):
            if (found := compare(group)) is not None:
                yield found

    return dealt.mapInArrow(run, "a long, b long, bucket long, down int, across int, mark long, mark_order long")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys, put together across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [_numbers(batch, k) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
            key = tuple(c[low] for c in columns)
            if held and key != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def verified(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The (a, b) of pairs(a, b, part) whose whole texts' shingle sets reach the threshold exactly.

    The pairs of one b and part meet in one group, with b's text once. Texts travel
    compressed; those of no pair don't. An id with several texts stands for each of them.
    """
    roles = pairs.select(F.col("a").alias("doc_id"), "b", "part", F.lit(False).alias("head")).unionByName(pairs.select(F.col("b").alias("doc_id"), "b", "part", F.lit(True).alias("head")).distinct())
    roles = saved(roles)
    # Eight bytes an id, and three numbers more: SENT_ROWS rows are some 20 MB.
    few = roles.count() <= SENT_ROWS
    if few:
        seats = docs.join(F.broadcast(roles), "doc_id").select("b", "part", "head", "doc_id", "text")
        seats = seats.mapInArrow(_compressed(4), "b long, part int, head boolean, doc_id long, text binary")
    else:
        seats = docs.mapInArrow(_compressed(1), "doc_id long, text binary").join(roles, "doc_id").select("b", "part", "head", "doc_id", "text")
    seats = seats.repartition("b", "part").sortWithinPartitions("b", "part", F.desc("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        key, heads = None, []
        for batch in batches:
            for part in T.slices(batch, "text", 3):
                texts = pa.array([unzip.decompress(x) for x in part.column(4).to_pylist()], type=pa.binary()).cast(pa.string())
                sets, at = T.shingle_sets(texts, s.words)
                a, b = [], []
                rows = zip(*(part.column(i).to_pylist() for i in range(4)))
                for i, (of, number, head, doc_id) in enumerate(rows):
                    own = sets[at[i] : at[i + 1]]
                    if (of, number) != key:
                        key, heads = (of, number), []
                    if head:
                        heads.append(own.copy())
                    elif any(_linked(own, other, s) for other in heads):
                        a.append(doc_id)
                        b.append(of)
                yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], ["a", "b"])

    out = saved(seats.mapInArrow(run, "a long, b long").distinct())
    forget(roles)
    return out


def _dealt(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with the part of b that each is dealt into, so that no task gets all partners of a b; b's text goes to each of its parts."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    return pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))


def _linked(u: np.ndarray, v: np.ndarray, s: Settings) -> bool:
    if min(len(u), len(v)) * s.denominator < max(len(u), len(v)) * s.numerator:
        return False
    both = len(np.intersect1d(u, v, assume_unique=True))
    return both > 0 and s.denominator * both >= s.numerator * (len(u) + len(v) - both)


def _compressed(place: int):
    """Batches with the text column at `place`, the last one, compressed row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in T.slices(batch, "text"):
                texts = pa.array([zip_.compress((x or "").encode()) for x in part.column(place).to_pylist()], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:place], texts], part.schema.names)

    return run


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, label) with the components that links(a, b) join."""
    moved = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b", "left")
    upper = components(moved.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    labels = labels.unionByName(upper.join(labels.select("node"), "node", "left_anti"))
    top = upper.select(F.col("node").alias("label"), F.col("label").alias("top"))
    out = saved(labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
    forget(upper)
    return out


def linked(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(signed, reps, links, labels) of docs(doc_id, text).

    reps names each class of equal sets by its smallest doc_id, links(a, b) holds every
    verified link between classes, and labels(node, label) their components.
    """
    signed = saved(sign(docs, s))
    linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = saved(linked.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    members = linked.join(reps, ["key1", "key2", "n_shingles"])
    # A class is named by its first set key; an id whose rows have several texts stands for several classes.
    classes = members.where("doc_id = rep").select(F.col("key1").alias("cls"), "rep", F.col("n_shingles").alias("n"), "signature").dropDuplicates(["cls"])
    classes = saved(classes)

    bands = band_rows(classes, s)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    rows = saved(bands.join(shared, "bucket"))
    scores = rows.groupBy("cls").agg(F.sum("size").alias("score"))
    best = rows.join(scores, "cls").groupBy("bucket").agg(F.max(F.struct("score", "cls")).alias("p"), F.max("size").alias("size")).select("bucket", F.col("p.cls").alias("pivot"), "size")
    # A class has a bucket for each band at most, and so has a pivot.
    largest = best.groupBy("pivot").agg(F.ceil(F.max("size") / PART_ROWS).cast("int").alias("parts"))
    pivots = saved(best.join(largest, "pivot"))
    links = verified(pivot_candidates(rows, pivots, classes, s), docs, s)

    twice = members.select("doc_id", "rep").distinct()
    first = twice.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b < last")
    same = twice.join(first, "doc_id").select(F.col("rep").alias("a"), "b")

    labels = components(links.unionByName(same))
    of_class = saved(classes.select("cls", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("label", "rep").alias("label")))
    named = rows.join(of_class, "cls").select("bucket", "cls", "label")
    open_ = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).where("low < high AND m > 2").select("bucket")
    heads = pivots.join(of_class.withColumnsRenamed({"cls": "pivot", "label": "pivot_label"}), "pivot").select("bucket", F.col("pivot").alias("pivot_cls"), "pivot_label")
    left = named.join(saved(open_.join(heads, "bucket")), "bucket")
    counts = left.groupBy("bucket").agg(F.count("*").alias("members"), F.count_if(F.col("label") != F.col("pivot_label")).alias("outside"))
    counts = saved(counts)
    left = saved(left.join(counts, "bucket").join(classes, "cls"))
    longer = saved(sign_further(docs, left.select("rep").distinct(), s))
    seats = block_seats(left.join(longer, ["cls", "rep"]), s)
    marks, round_, before = None, 0, None
    while True:
        found = saved(block_candidates(seats, labels, marks, round_, s))
        pairs = found.where("a IS NOT NULL").select("a", "b").distinct()
        if not pairs.limit(1).count():
            break
        more = verified(_dealt(pairs), docs, s)
        if more.limit(1).count():
            links, labels = links.unionByName(more), _merged(labels, more)
        marks, round_ = found.where("a IS NULL"), round_ + 1
        if not marks.limit(1).count():
            break
        if before is not None:
            forget(before)
        before = found
    forget(rows, pivots, classes, of_class, counts, left, longer, found)
    return signed, reps, links, labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Text is lower-cased in A-Z and cut into words at ASCII white space. A text with
    fewer words than a shingle is one shingle of all its words; a null text or one
    without words has none, links with nothing and is its own component. Rows that
    repeat a doc_id are one node of the graph and each is returned, with its own
    set size; a row with a null doc_id is returned with a null component and kept.
    Other columns of docs are not looked at. An empty table gives an empty result.
    """
    s = settings or Settings()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed, reps, _, labels = linked(docs, s)
    out = signed.select("doc_id", "n_shingles", "key1", "key2").join(reps, ["key1", "key2", "n_shingles"], "left")
    out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep", "doc_id").alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, without those that near_duplicates() doesn't keep.

    Of rows that repeat a kept doc_id one stays, that of the least text by digest (null texts
    first), then any of those with that text; rows with a null doc_id all stay.
    """
    gone = near_duplicates(docs, id_col, text_col, settings).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    rest = docs.join(gone, docs[id_col].cast("long") == gone.gone_id, "left_anti")
    repeated = rest.groupBy(F.col(id_col).alias("repeated_id")).agg(F.count("*").alias("rows_of_id")).where("rows_of_id > 1 AND repeated_id IS NOT NULL").select("repeated_id")
    if not repeated.limit(1).count():
        return rest
    single = rest.join(repeated, rest[id_col] == repeated.repeated_id, "left_anti")
    several = rest.join(repeated, rest[id_col] == repeated.repeated_id, "left_semi")
    # The same text whichever task runs again; its rows differ at most in other columns.
    digest = F.coalesce(F.sha2(F.col(text_col).cast("string").cast("binary"), 256), F.lit(""))
    least = several.groupBy(F.col(id_col).alias("least_id")).agg(F.min(digest).alias("least_digest"))
    several = several.join(least, (several[id_col] == least.least_id) & (digest == least.least_digest), "left_semi")
    return single.unionByName(several.dropDuplicates([id_col]))


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), settings=Settings(numerator=85))


#: Brute force in SQL: shared shingles of all pairs, links, and what can be reached over them.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 2) END)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN lowest ON d.doc_id = a
"""
