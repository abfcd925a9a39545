"""MinHash near-duplicate groups with odd sketches.

Documents of equal shingle sets form a class; the rest works on classes. MinHash bands bring classes together, odd
sketches (parity bitmaps of the MinHash samples) estimate a pair's similarity by an XOR population count and turn away
pairs far below the threshold, and the pairs that stay are confirmed on their full sets. In a bucket all members are
held first against its smallest, then against that with the most links. The members of buckets that are not yet of one
component are held against each other where a prefix of their rarest shingles leaves the threshold possible, which loses
no pair: components are compared with others, never within, and many copies cost a number of pairs in proportion to
their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import materialise, row_key, small, sparse_join, table


@dataclass(frozen=True)
class Shingling:
    """words a shingle, link at percent or more of the union, bands of rows; sketch_bits: of the odd sketch."""

    words: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 6
    sketch_bits: int = 1024
    #: Pairs are turned away where the sketches' estimate is under the threshold by this much (over 6 standard deviations).
    slack: float = 0.2

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_odd_bits(self) -> int:
        """Bits that differ, expected at the threshold less the slack: n/2 (1 - (1 - 2/n)^d), d the samples that differ."""
        apart = 2 * self.samples * (1 - (self.percent / 100 - self.slack))
        return int(self.sketch_bits / 2 * (1 - (1 - 2 / self.sketch_bits) ** apart))


class Shingles:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, words: int, max_entries: int = 500_000):
        self.words, self.max_entries, self.seen = words, max_entries, {}
        self.odd = np.random.default_rng(7).integers(1, 2**63, size=words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _hash(self, word: bytes) -> int:
        h = self.seen[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        if len(self.seen) > self.max_entries:
            self.seen.clear()
        words = (text or b"").lower().split()  # of bytes: A-Z alone are lowered, \x20 and \x09-\x0D separate
        get, make = self.seen.get, self._hash
        h = np.fromiter((get(w) or make(w) for w in words), np.uint64, len(words))
        if not len(h):
            return h
        k = min(self.words, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = (out ^ h[i : i + len(out)]) * self.odd[i]
            out ^= out >> np.uint64(29)
        return np.unique(out * self.odd[0] + np.uint64(k))


class Sketcher:
    def __init__(self, p: Shingling):
        self.p = p
        rng = np.random.default_rng(11)
        self.a = rng.integers(1, 2**63, size=p.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, size=p.samples, dtype=np.uint64)
        self.c = rng.integers(1, 2**63, size=p.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(self.p.samples, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 128):  # the block stays in cache
            np.minimum(out, (hashes[at : at + 128, None] * self.a + self.b).min(axis=0), out=out)
        return out

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band hashes, odd sketch as 64-bit words)."""
        low = self.samples(hashes)
        mixed = (low ^ (low >> np.uint64(31))) * self.c
        mixed ^= mixed >> np.uint64(33)
        bands = np.bitwise_xor.reduce((mixed * self.a).reshape(self.p.bands, self.p.rows), axis=1)
        bits = np.bincount((mixed >> np.uint64(7)) % np.uint64(self.p.sketch_bits), minlength=self.p.sketch_bits) & 1
        return bands.view(np.int64), np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, p: Shingling) -> DataFrame:
    """(doc_id, text, n_shingles, fingerprint, bands, odd) of rows in order of docs; the last three null for empty sets."""
    schema = "doc_id bigint, text string, n_shingles bigint, fingerprint binary, bands array<bigint>, odd array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sketcher = Shingles(p.words), Sketcher(p)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for t in part.column(1).cast(pa.binary()).to_pylist():
                    h = shingles.of(t)
                    rows.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), *sketcher.of(h)) if len(h) else (0, None, None, None))
                n, prints, bands, odd = zip(*rows, strict=True)
                arrays = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "n_shingles", "fingerprint", "bands", "odd"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes; few other texts are shuffled."""
    return sparse_join(rows.select(F.col("row").alias("node"), "text"), wanted, "node", "left_semi")


def confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, p: Shingling) -> DataFrame:
    """Those pairs (a, b) of nodes whose sketches are near and whose full sets reach the threshold."""
    odd = nodes.select("node", "odd")
    apart = F.aggregate(F.zip_with("_oa", "_ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = pairs.join(odd.select(F.col("node").alias("a"), F.col("odd").alias("_oa")), "a").join(odd.select(F.col("node").alias("b"), F.col("odd").alias("_ob")), "b")
    near = materialise(near.filter(apart <= p.most_odd_bits).select("a", "b"), "near_pairs")
    ids = materialise(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near_nodes")
    texts = _texts(rows, ids)
    both = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last = Shingles(p.words), (None, None)
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            for x, ta, tb in zip(a.to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                if last[0] != x:
                    last = (x, shingles.of(ta))
                other = shingles.of(tb)
                shared = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(100 * shared >= p.percent * (len(last[1]) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint"), "links")


def close_pairs(members: DataFrame, rows: DataFrame, p: Shingling) -> DataFrame:
    """Pairs (a, b) of members (node, component) of different components that can reach the threshold: a superset of those that do.

    Shingles are ordered by how many members hold them. Two sets that reach the threshold share one of their first
    shingles, and from the place of their first common one on enough must be left in both (prefix and position
    filters). Within a shingle, members outside the largest component meet all others.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(p.words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles.of(t) for t in part.column(2).cast(pa.binary()).to_pylist()]
                size = np.array([len(h) for h in sets])
                spread = lambda c: pa.array(np.repeat(part.column(c).to_numpy(), size))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([spread(0), spread(1), pa.array(np.repeat(size, size)), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "component", "n", "shingle"])

    members = materialise(members, "members")
    texts = _texts(rows, members.select("node")).join(members, "node").select("node", "component", "text")
    rows = materialise(texts.mapInArrow(explode, "node bigint, component bigint, n bigint, shingle bigint"), "member_shingles")
    held = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    per = rows.join(held, "shingle").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    first = per.select("node", "component", "n", (F.col("n") - F.size("s")).alias("own"), F.posexplode("s").alias("k", "s"))
    first = first.select("node", "component", "n", (F.col("own") + F.col("k")).alias("at"), F.col("s.shingle").alias("shingle")).filter(100 * (F.col("n") - F.col("at")) >= p.percent * F.col("n"))
    first = materialise(first, "prefixes")
    sizes = first.groupBy("shingle", "component").agg(F.count("*").alias("m")).groupBy("shingle").agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    both = materialise(first.join(sizes.drop("parts"), "shingle"), "open_prefixes")
    x = both.filter("component <> largest").select("shingle", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    y = both.select("shingle", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("at").alias("ay"), (F.col("component") == F.col("largest")).alias("big"))
    left = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))
    possible = (F.col("cx") != F.col("cy")) & (F.col("big") | (F.col("x") < F.col("y"))) & ((100 + p.percent) * left >= p.percent * (F.col("nx") + F.col("ny")))
    pairs = x.join(y, (x["shingle"] == y["shingle"]) & possible)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, of all nodes in links (a, b).

    Alternating large-star and small-star steps, each a shuffle by node with a partial minimum; the links of a round
    are written to the shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    links = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "components")
    before = None
    while True:
        both = links.union(links.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        links = materialise(small_star.filter("a <> b"), "components")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if tuple(now) == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = tuple(now)


def group(docs: DataFrame, p: Shingling = Shingling(), keyed: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, and if keyed key = row_key(doc_id, text).

    component_id is the smallest doc_id of the rows reachable over links; kept is doc_id = component_id. Null, empty and
    blank texts have empty sets, form components of their own and are kept. Rows that repeat a doc_id with equal sets
    are all kept if theirs is the smallest; a null doc_id counts only where its component has no other, and is then
    kept with a null component_id. Texts of fewer words than a shingle are one shingle. An empty table gives none.
    """
    rows = materialise(sketches(docs, p).withColumn("row", F.monotonically_increasing_id()), "sketches")
    full = rows.filter("n_shingles > 0")
    classes = full.groupBy("fingerprint").agg(F.min("row").alias("node"), F.min("doc_id").alias("smallest"), F.count("*").alias("members"))
    classes = materialise(classes, "classes")
    copied = classes.select("fingerprint", "node", "members")
    again = full.select("row", "fingerprint").join(small(materialise(copied.filter("members > 1"), "copied")), "fingerprint").filter("row <> node").select("row")
    nodes = full.join(small(materialise(again, "copies")), "row", "left_anti").withColumnRenamed("row", "node")  # fewer than the firsts
    banded = materialise(nodes.select("node", F.posexplode("bands").alias("band", "key")), "bands")
    buckets = banded.groupBy("band", "key").agg(F.min("node").alias("head"), F.count("*").alias("members")).filter("members > 1")
    shared = materialise(banded.join(materialise(buckets, "buckets"), ["band", "key"]).filter("node <> head"), "shared")
    links = confirmed(shared.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), nodes, rows, p)
    found = materialise(components(links), "found")
    of = lambda d: d.join(small(found), "node", "left").withColumn("component", F.coalesce("component", "node"))

    def unresolved() -> DataFrame:
        """(band, key, node, component) of buckets whose members, but for the head, are of several components."""
        rest = of(shared.filter("members > 2").select("band", "key", "node"))
        open_ = rest.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band", "key")
        return materialise(rest.join(open_, ["band", "key"]), "unresolved")

    rest = unresolved()
    if not rest.isEmpty():
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
        ranked = rest.join(small(materialise(degree, "degrees")), "node", "left")
        centre = ranked.groupBy("band", "key").agg(F.max_by(F.struct("node", "component"), F.struct(F.coalesce("links", F.lit(0)), "node")).alias("c"))
        tried = rest.join(centre, ["band", "key"]).filter("component <> c.component").select(F.least("c.node", "node").alias("a"), F.greatest("c.node", "node").alias("b")).distinct()
        links = materialise(links.union(confirmed(tried, nodes, rows, p)), "links")
        found = materialise(components(links), "found")
        rest = unresolved()
    if not rest.isEmpty():
        more = confirmed(close_pairs(rest.select("node", "component").distinct(), rows, p), nodes, rows, p)
        if not more.isEmpty():
            found = materialise(components(links.union(more)), "found")
    by_class = of(classes.select("node", "smallest", "fingerprint"))
    ids = by_class.groupBy("component").agg(F.min("smallest").alias("component_id"))
    by_class = materialise(by_class.join(ids, "component").select(F.col("fingerprint").alias("_print"), "component_id", F.lit(True).alias("_in")), "memberships")
    key = [row_key("doc_id", "text").alias("key")] * keyed
    out = rows.select("doc_id", "n_shingles", "fingerprint", *key).join(small(by_class), F.col("fingerprint") == F.col("_print"), "left")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *["key"] * keyed)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"), Shingling(words=3, percent=85))
