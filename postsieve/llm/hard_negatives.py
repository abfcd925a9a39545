"""Hard negatives by inner product, from a multiway hyperplane tree with distance ranges between siblings (GNAT).

The root's split points are far-apart rows of a bounded sample; every row goes to the nearest one, which cuts space along
hyperplanes. The rows of a split point are sorted by their distance to it and cut into blocks, so that a frequent vector
fills many blocks, each a task's work. Each split point stores the range of distances to every sibling's rows and to every
block. Inside a block the tree goes on down to leaves, whose rows are scored exactly.

A window of scores is an annulus of distances around the anchor, as |a - x|^2 = |a|^2 + |x|^2 - 2 a.x and a subtree's
norms are known; a subtree is left out if for some split point its range of distances can't meet the annulus. Anchors
first look into their own block, which bounds the scores of their positives; then anchors travel in batches to the blocks
that may hold more, never blocks to anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postsieve.llm.common import materialise, table

#: Scores stay below this.
FAR = 1 << 62


@dataclass(frozen=True)
class HardNegatives:
    """positives of an anchor, negatives of each positive, with scores from low to high percent of the positive's.

    Anchors: rows whose vec_id anchor_every divides. split_points of the root, chosen in a sample of that many rows;
    arity and leaf: of the tree in a block of at most block_rows; batch: anchors that travel together.
    """

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    anchor_every: int = 50
    split_points: int = 64
    sample: int = 1024
    block_rows: int = 8192
    arity: int = 16
    leaf: int = 128
    batch: int = 256


@dataclass(frozen=True)
class Numbers:
    """How vectors are kept: their dimensions, the packed type, the type whose products are exact, slack for distances."""

    dims: int
    packed: str
    exact: str
    slack: float

    def unpack(self, b: bytes) -> np.ndarray:
        return np.frombuffer(b, self.packed).reshape(-1, self.dims).astype(self.exact)


def numbers(dims: int, largest: float, norm2: float) -> Numbers:
    if norm2 >= 2**56:
        raise ValueError("scores of these vectors can pass 64 bits")
    return Numbers(dims, "<i4" if largest < 2**31 else "<i8", "f4" if norm2 < 2**24 else "f8" if norm2 < 2**53 else "i8", 1e-6 * (1 + norm2**0.5))


def norms(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.einsum("ij,ij->i", x, x)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(norms(x)[:, None] + norms(points) - 2 * (x @ points.T).astype(np.float64), 0))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n distinct rows of x, each the farthest from those before it."""
    at, nearest = [0], distances(x, x[:1])[:, 0]
    while len(at) < n and nearest.max() > 0:
        at.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(x, x[at[-1:]])[:, 0])
    return x[at]


def ranges(d: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest of each column of d (rows, split points) among the rows of each of n groups: (split points, groups)."""
    low, high = np.full((n, d.shape[1]), np.inf), np.full((n, d.shape[1]), -np.inf)
    np.minimum.at(low, of, d)
    np.maximum.at(high, of, d)
    return low.T, high.T


class Queries:
    """Anchors with windows of scores; tags name the windows. An empty window has low above high."""

    FIELDS = (("rows", "<i8"), ("labels", "<i4"), ("vecs", None), ("lows", "<i8"), ("highs", "<i8"), ("tags", "<i8"))
    SCHEMA = "rows binary, labels binary, vecs binary, lows binary, highs binary, tags binary"

    def __init__(self, rows, labels, vecs, lows, highs, tags):
        self.rows, self.labels, self.vecs, self.lows, self.highs, self.tags = rows, labels, vecs, lows, highs, tags
        self.norms = norms(vecs)

    def __len__(self) -> int:
        return len(self.rows)

    def take(self, at: np.ndarray) -> Queries:
        return Queries(*(getattr(self, n)[at] for n, _ in self.FIELDS))

    def pack(self, k: Numbers) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, n), t or k.packed).tobytes() for n, t in self.FIELDS]

    @classmethod
    def unpack(cls, packed: list[bytes], k: Numbers) -> Queries:
        rows = np.frombuffer(packed[0], "<i8")
        return cls(rows, np.frombuffer(packed[1], "<i4"), k.unpack(packed[2]), *(np.frombuffer(b, "<i8").reshape(len(rows), -1).copy() for b in packed[3:]))

    def reach(self, d: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, slack: float) -> np.ndarray:
        """Which (anchor, subtree) may meet a window: d (anchors, split points), their ranges (split points, subtrees), squared norms."""
        near = np.maximum(d[:, :, None] - high, low - d[:, :, None]).max(axis=1)
        far = (d[:, :, None] + high).min(axis=1)
        out = np.zeros(near.shape, bool)
        for w in range(self.lows.shape[1]):
            lo, hi = self.lows[:, w : w + 1].astype(np.float64), self.highs[:, w : w + 1].astype(np.float64)
            inner = np.sqrt(np.maximum(self.norms[:, None] + least - 2 * hi, 0))
            outer2 = self.norms[:, None] + most - 2 * lo
            outer = np.sqrt(np.maximum(outer2, 0))
            out |= (lo <= hi) & (outer2 >= -slack) & (near <= outer + slack) & (far >= inner - slack)
        return out


class Tree:
    """The tree in a block: nodes (split points, ranges, children), leaves (rows)."""

    def __init__(self, vecs: np.ndarray, p: HardNegatives, k: Numbers):
        self.vecs, self.norms, self.p, self.k = vecs, norms(vecs), p, k
        self.root = self._grow(np.arange(len(vecs)))

    def _grow(self, at: np.ndarray):
        if len(at) <= self.p.leaf:
            return at
        x = self.vecs[at]
        points = far_apart(x[:: max(1, len(at) // 512)], self.p.arity)
        d = distances(x, points)
        of = d.argmin(axis=1)
        if len(points) < 2 or np.bincount(of).max() == len(at):
            return at
        n = len(points)
        low, high = ranges(d, of, n)
        least, most = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(least, of, self.norms[at])
        np.maximum.at(most, of, self.norms[at])
        filled = np.flatnonzero(np.bincount(of, minlength=n))
        return points, low[:, filled], high[:, filled], least[filled], most[filled], [self._grow(at[of == j]) for j in filled.tolist()]

    def search(self, q: Queries, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, first: int) -> tuple[np.ndarray, ...]:
        """(anchor, window, row, score) of the first rows of each anchor's windows in this block; q.lows rise meanwhile."""
        found = [np.empty(0, np.int64)] * 4
        held: list[tuple[np.ndarray, ...]] = []

        def settle() -> None:
            nonlocal found
            a, w, r, s = (np.concatenate([f, *(h[i] for h in held)]) for i, f in enumerate(found))
            held.clear()
            order = np.lexsort((rows[r], ids[r], -s, w, a))
            a, w, r, s = a[order], w[order], r[order], s[order]
            new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]))) if len(a) else np.empty(0, np.int64)
            place = np.arange(len(a)) - np.repeat(new, np.diff(np.append(new, len(a))))
            on = place < first
            found = [a[on], w[on], r[on], s[on]]
            last = place == first - 1
            q.lows[a[last], w[last]] = np.maximum(q.lows[a[last], w[last]], s[last])

        def visit(node, at: np.ndarray) -> None:
            if isinstance(node, np.ndarray):
                s = (q.vecs[at] @ self.vecs[node].T).astype(np.int64)
                fits = ((q.labels[at][:, None] == labels[node]) == same) & (q.rows[at][:, None] != rows[node])
                for w in range(q.lows.shape[1]):
                    i, j = np.nonzero(fits & (s >= q.lows[at, w][:, None]) & (s <= q.highs[at, w][:, None]))
                    if len(i):
                        held.append((at[i], np.full(len(i), w), node[j], s[i, j]))
                if sum(len(h[0]) for h in held) > 4 * first * len(q):
                    settle()
                return
            points, low, high, least, most, children = node
            d = distances(q.vecs[at], points)
            for j in np.argsort(d.min(axis=0)[: len(children)]).tolist():
                on = at[q.take(at).reach(d, low[:, j : j + 1], high[:, j : j + 1], least[j : j + 1], most[j : j + 1], self.k.slack)[:, 0]]
                if len(on):
                    visit(children[j], on)

        visit(self.root, np.arange(len(q)))
        settle()
        return tuple(found)


class Block:
    """A row of the table of blocks."""

    FIELDS = ("rows", "ids", "labels", "vecs")

    def __init__(self, packed: list[bytes], p: HardNegatives, k: Numbers):
        self.rows, self.ids, self.labels = np.frombuffer(packed[0], "<i8"), np.frombuffer(packed[1], "<i8"), np.frombuffer(packed[2], "<i4")
        self.vecs = k.unpack(packed[3])
        self.tree = Tree(self.vecs, p, k)

    def search(self, q: Queries, same: bool, first: int):
        return self.tree.search(q, self.rows, self.ids, self.labels, same, first)


def mine(vectors: DataFrame, p: HardNegatives = HardNegatives()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    Components count as floor(256 x); scores are inner products, higher ones first, ties by smaller vec_id. Rows with a null
    vec_id or label, a null vector or a null or non-finite component take no part. A shorter vector counts as filled up
    with zeros. Rows that repeat a vec_id are rows of their own, each anchor of its own. A positive of negative score has no
    window. An empty table gives none; other columns are left out. Scores that may pass 64 bits raise an error.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("int"), F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = whole.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    scaled = F.transform("embedding", lambda x: F.floor(x * 256).cast("double"))
    size = whole.select(F.size("embedding").alias("dims"), F.array_max(F.transform(scaled, F.abs)).alias("largest"), F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x).alias("norm2"))
    dims, largest, norm2, n = size.agg(F.max("dims"), F.max("largest"), F.max("norm2"), F.count("*")).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n or not dims:
        # vectors without components all score 0: no tree to build
        dims = 1
    k = numbers(dims, largest or 0, norm2 or 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(2)
            size = np.diff(vecs.offsets.to_numpy())
            x = np.zeros((batch.num_rows, k.dims), k.packed)
            x[np.arange(k.dims) < size[:, None]] = np.floor(vecs.flatten().to_numpy(zero_copy_only=False) * 256)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "label", "vec"])

    rows = materialise(whole.mapInArrow(pack, "vec_id bigint, label int, vec binary").withColumn("row", F.monotonically_increasing_id()), "vectors", "zstd")
    if not n:
        return spark.createDataFrame([], schema)
    sample = materialise(rows.orderBy(F.xxhash64("vec_id", "row")).limit(p.sample).select("vec"), "sample").collect()  # each task's first rows meet in a task, the driver gets those of the parameter
    points = far_apart(k.unpack(b"".join(r.vec for r in sample)), p.split_points)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(k.unpack(b"".join(batch.column(2).to_pylist())), points) if batch.num_rows else np.empty((0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1)), *batch.columns], names=["cell", "near", "vec_id", "label", "vec", "row"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, [[], [], [], []]

        def one() -> pa.RecordBatch:
            vecs = k.unpack(b"".join(held[3]))
            d, n2 = distances(vecs, points), norms(vecs)
            out = [[cell], *([np.array(h, t).tobytes()] for h, t in zip(held[:3], ("<i8", "<i8", "<i4"), strict=True)), [b"".join(held[3])], [d.min(axis=0).tolist()], [d.max(axis=0).tolist()], [n2.min()], [n2.max()]]
            for h in held:
                h.clear()
            kinds = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["cell", *Block.FIELDS, "low", "high", "least", "most"])

        for batch in batches:
            for c, row, vec_id, label, vec in zip(*(batch.column(i).to_pylist() for i in (0, 5, 2, 3, 4)), strict=True):
                if held[0] and (c != cell or len(held[0]) == p.block_rows):
                    yield one()
                cell = c
                for h, v in zip(held, (row, vec_id, label, vec), strict=True):
                    h.append(v)
        if held[0]:
            yield one()

    dealt = rows.mapInArrow(deal, "cell int, near double, vec_id bigint, label int, vec binary, row bigint")
    order = ("cell", "near", "row")  # the row's number splits what lies equally far
    dealt = dealt.repartitionByRange(-(-n // p.block_rows), *order).sortWithinPartitions(*order)
    blocks = dealt.mapInArrow(block, "cell int, rows binary, ids binary, labels binary, vecs binary, low array<double>, high array<double>, least double, most double")
    blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks", "zstd")
    # The root's ranges: a row for each split point and sibling.
    span = blocks.select("cell", "least", "most", F.posexplode(F.arrays_zip("low", "high")).alias("i", "r")).groupBy("cell", "i")
    span = span.agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
    m = len(points)
    low, high, least, most = np.full((m, m), np.inf), np.full((m, m), -np.inf), np.full(m, np.inf), np.full(m, -np.inf)
    for r in span:
        low[r.i, r.cell], high[r.i, r.cell], least[r.cell], most[r.cell] = r.low, r.high, r.least, r.most
    cells = np.flatnonzero(least <= most)
    low, high, least, most = low[:, cells], high[:, cells], least[cells], most[cells]

    query_names = [n for n, _ in Queries.FIELDS]
    batch_of = lambda head, packed: pa.RecordBatch.from_arrays([pa.array([h]) for h in head] + [pa.array([b], pa.binary()) for b in packed], names=["to", *query_names])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of each block, bounded by the positives in it."""
        for batch in batches:
            for packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = Block(list(packed), p, k)
                on = np.flatnonzero(at.ids % p.anchor_every == 0)
                for a in range(0, len(on), p.batch):
                    i = on[a : a + p.batch]
                    one = np.zeros((len(i), 1), np.int64)
                    q = Queries(at.rows[i], at.labels[i], at.vecs[i], one - FAR, one + FAR, one.copy())
                    at.search(q, True, p.positives)  # raises q.lows
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in q.pack(k)], names=query_names)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = Queries.unpack(list(packed), k)
                met = q.reach(distances(q.vecs, points), low, high, least, most, k.slack)
                for j in np.flatnonzero(met.any(axis=0)).tolist():
                    yield batch_of([int(cells[j])], q.take(np.flatnonzero(met[:, j])).pack(k))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for to, lo, hi, n_lo, n_hi, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = Queries.unpack(packed, k)
                met = np.flatnonzero(q.reach(distances(q.vecs, points), np.array(lo)[:, None], np.array(hi)[:, None], np.array([n_lo]), np.array([n_hi]), k.slack)[:, 0])
                if len(met):
                    yield batch_of([to], q.take(met).pack(k))

    def search(queries: DataFrame, same: bool, first: int) -> DataFrame:
        """(row, tag, other, other_id, score): the first rows in each window of each anchor, place from 1."""

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = b = None
            for batch in batches:
                packed = [c.to_pylist() for c in batch.columns[1:]]
                for i, to in enumerate(batch.column(0).to_pylist()):
                    if to != at:
                        at, b = to, Block([packed[j][i] for j in range(4)], p, k)
                    q = Queries.unpack([packed[j][i] for j in range(4, 10)], k)
                    a, w, r, s = b.search(q, same, first)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q.rows[a], q.tags[a, w], b.rows[r], b.ids[r], s)], names=["row", "tag", "other", "other_id", "score"])

        sent = queries.select(*query_names).mapInArrow(route, f"to bigint, {Queries.SCHEMA}")
        places = blocks.select("cell", "block", "low", "high", "least", "most")
        # Spark takes what comes out of route and narrow for no larger than the anchors, which go to many cells and blocks, so sides are named as ones to shuffle.
        sent = sent.hint("merge").join(places, sent["to"] == places["cell"]).select("block", "low", "high", "least", "most", *query_names).mapInArrow(narrow, f"to bigint, {Queries.SCHEMA}")
        renamed = [F.col(c).alias(f"b_{c}") for c in Block.FIELDS]
        met = sent.hint("merge").join(blocks.select("block", *renamed), F.col("to") == F.col("block")).select("block", *[f"b_{c}" for c in Block.FIELDS], *query_names)
        found = met.mapInArrow(score, "row bigint, tag bigint, other bigint, other_id bigint, score bigint")
        place = F.row_number().over(Window.partitionBy("row", "tag").orderBy(F.desc("score"), "other_id", "other"))
        return found.withColumn("place", place).filter(F.col("place") <= first)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors (row, label, vec, scores of positives) in batches, with a window for each score."""
        for batch in batches:
            for a in range(0, batch.num_rows, p.batch):
                part = batch.slice(a, p.batch)
                scores = part.column(3).to_pylist()
                tags = np.array([s + [-1] * (p.positives - len(s)) for s in scores], np.int64).reshape(len(scores), -1)
                lows, highs = np.where(tags < 0, FAR, -(-p.low * tags // 100)), np.where(tags < 0, -FAR, p.high * tags // 100)
                q = Queries(part.column(0).to_numpy(), part.column(1).to_numpy(), k.unpack(b"".join(part.column(2).to_pylist())), lows, highs, tags)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in q.pack(k)], names=query_names)

    anchors = materialise(blocks.select(*Block.FIELDS).mapInArrow(own, Queries.SCHEMA), "anchors")
    positives = materialise(search(anchors, True, p.positives).select("row", "other_id", "score", "place"), "positives")
    scores = positives.filter("score >= 0").groupBy("row").agg(F.collect_set("score").alias("scores"))  # few each
    asking = rows.filter(F.col("vec_id") % p.anchor_every == 0)
    asked = asking.hint("merge").join(scores, "row").select("row", "label", "vec", "scores").mapInArrow(windows, Queries.SCHEMA)
    negatives = search(materialise(asked, "windows"), False, p.negatives).select("row", F.col("tag").alias("score"), F.col("place").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = positives.hint("merge").join(negatives, ["row", "score"]).hint("merge").join(asking.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mine(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
