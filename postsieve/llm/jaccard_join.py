"""Exact n-gram Jaccard join of whole documents: a size-aware split into light and heavy sets.

Documents of equal shingle sets form a class, and classes are joined. Sets of up to a boundary size are light: every
subset of the size that a partner would have to share is enumerated, and all sets under one subset are linked with its
first ones, as they are all linked with each other. Larger sets scan inverted lists: of each set, those of its rarest
shingles, which loses no pair. The boundary is the size for which the subsets and the scanned pairs cost least.

Before that, two passes over the postings leave out what can't link: a set reaches the threshold only if enough of its
shingles occur in another set. The first pass looks at the shingles of a slice of the hash space, the second at all
shingles of the sets that stay, and orders these by how many sets hold them. Postings travel as packed arrays, dealt by
shingle; a shingle that a task holds more than once goes out once in the first pass, and the second streams.

In a list all members are held first against its first one; then, where it still has members of several components,
against the one with the most links; then members of different components against each other. Members of one component
are never compared, so that many near copies cost pairs in proportion to their number, and no link is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import materialise, new_path, small, table
from postsieve.llm.near_dup import Shingles, components
from postsieve.llm.sentencepieces import part_files

#: A row number is its partition, shifted by this, and its place.
SHIFT = 33
MANY = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class JaccardJoin:
    """words a shingle; link at percent or more of the union.

    slice: share of the hash space in the first pass. bucket: postings that a bucket of shingles should have; chunk: those
    that a task sorts at a time. max_light: largest boundary tried; pair_cost: what a scanned pair costs, in subsets.
    """

    words: int = 5
    percent: int = 80
    slice: float = 0.3
    bucket: int = 1 << 20
    chunk: int = 1 << 21
    max_light: int = 64
    pair_cost: int = 16

    def overlap(self, a: int, b: int) -> int:
        """Shared shingles that sets of these sizes need."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def partners(self, n: int) -> range:
        """Sizes that a set of n can link with."""
        return range(-(-self.percent * n // 100), 100 * n // self.percent + 1)

    def alone(self, n: np.ndarray) -> np.ndarray:
        """A set of n with so many shingles of its own has no partner."""
        return n + (-self.percent * n // 100) + 1

    def kinds(self, n: int, most: int) -> list[tuple[int, int, int]]:
        """(smaller size, larger size, size of their subsets) that a set of n is enumerated for; equal sets are one class."""
        pairs = [(min(n, m), max(n, m)) for m in self.partners(n) if m <= most]
        return [(a, b, self.overlap(a, b)) for a, b in pairs if self.overlap(a, b) <= a and (a < b or self.overlap(a, b) < a)]


def _subsets(n: int, k: int) -> int:
    out = 1
    for i in range(min(k, n - k)):
        out = out * (n - i) // (i + 1)
    return out


def boundary(sizes: dict[int, tuple[int, int]], p: JaccardJoin) -> int:
    """The size up to which sets are light. sizes: of each size, how many sets and how long the lists are that they scan."""
    light, heavy = 0, sum(scan for _, scan in sizes.values()) * p.pair_cost
    best, at = heavy, 0
    for n in range(1, p.max_light + 1):
        many, scan = sizes.get(n, (0, 0))
        if many:  # a set meets its larger partners at their turn: their subsets of both sides count there
            light += many * sum(_subsets(n, k) for _, _, k in p.kinds(n, 100 * n // p.percent))
            heavy -= scan * p.pair_cost
        if light + heavy < best:
            best, at = light + heavy, n
    return at


class RowMarks:
    """Row numbers that a table lists, written by partition of the rows, so that the rows stay where they are."""

    def __init__(self, folder: str):
        self.folder, self.part, self.rows = folder, None, np.empty(0, np.int64)

    def has(self, rows: np.ndarray) -> np.ndarray:
        out, parts = np.zeros(len(rows), bool), rows >> SHIFT
        for part in np.unique(parts).tolist():
            if part != self.part:
                self.part, self.rows = part, np.concatenate([np.empty(0, np.int64), *(t["row"].to_numpy() for t in part_files(self.folder, part))])
            on = parts == part
            out[on] = np.isin(rows[on], self.rows)
        return out


def write_marks(rows: DataFrame, name: str) -> str:
    """Write rows (row) for RowMarks; gives the folder."""
    folder = new_path(rows.sparkSession, name)
    rows.select(F.shiftright("row", SHIFT).alias("part"), "row").repartition("part").write.partitionBy("part").parquet(folder)
    return folder


def read_sets(docs: DataFrame, p: JaccardJoin) -> DataFrame:
    """(doc_id, text, n, fingerprint, low) of rows: low holds the shingles in the slice of the hash space, sorted."""
    below = np.uint64(int(p.slice * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(p.words)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles.of(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                prints = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
                low = [h[: np.searchsorted(h, below)].tobytes() for h in sets]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.binary()), pa.array(low, pa.binary())], names=["doc_id", "text", "n", "fingerprint", "low"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, text string, n bigint, fingerprint binary, low binary")


def _chunks(batches: Iterator[pa.RecordBatch], keep, chunk: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(partition, shingles, their rows' places) of (row, shingles) in pieces of some size; keep tells which rows count."""
    held, size, at = [], 0, None
    for batch in batches:
        rows, packed = batch.column(0).to_numpy(), batch.column(1)
        on = np.flatnonzero(keep(rows))
        for k, row in zip(on.tolist(), rows[on].tolist(), strict=True):
            if held and (size >= chunk or row >> SHIFT != at):
                yield at, np.concatenate([h for h, _ in held]), np.repeat(np.array([r for _, r in held], np.uint32), [len(h) for h, _ in held])
                held, size = [], 0
            h = np.frombuffer(packed[k].as_py(), np.uint64)
            held.append((h, row & ((1 << SHIFT) - 1)))
            size, at = size + len(h), row >> SHIFT
    if held:
        yield at, np.concatenate([h for h, _ in held]), np.repeat(np.array([r for _, r in held], np.uint32), [len(h) for h, _ in held])


def _bits(postings: int, p: JaccardJoin) -> int:
    """Buckets are named by so many leading bits; the 32 bits that follow tell the shingles of a bucket apart."""
    return min(24, max(4, (postings // p.bucket).bit_length() + 1))


def _slices(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Sorted keys of bucket and 32 bits, cut by bucket: (bucket, keys in it, columns as bytes)."""
    if len(keys):
        buckets = (keys >> np.uint64(32)).astype(np.int64)
        ends = np.append(np.flatnonzero(np.diff(buckets)) + 1, len(keys)).tolist()
        for a, b in zip([0, *ends], ends, strict=False):
            yield int(buckets[a]), keys[a:b].astype(np.uint32).tobytes(), *(c[a:b].tobytes() for c in columns)


def _by_key(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, keys[0]).sortWithinPartitions(*keys)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_PART = pa.schema([("part", pa.int64()), ("places", pa.binary()), ("values", pa.binary()), ("keys", pa.binary())])
_PART_SQL = "part bigint, places binary, values binary, keys binary"


def _sizes(rows: DataFrame, keep) -> DataFrame:
    """Sizes of rows (row, n) that count, packed by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = keep()
        for batch in batches:
            row, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            on = counts(row)
            for part in np.unique(row[on] >> SHIFT).tolist():
                of = on & (row >> SHIFT == part)
                yield _table([(part, (row[of] & ((1 << SHIFT) - 1)).astype(np.uint32).tobytes(), n[of].astype(np.uint32).tobytes(), None)], _PART)

    return rows.select("row", "n").mapInArrow(run, _PART_SQL)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows of batches that are sorted by their first column, by its value."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != at:
                yield at, rows
                rows = []
            at = row[0]
            rows.append(row[1:])
    if rows:
        yield at, rows


def _numbers(packed: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind)


def not_alone(rows: DataFrame, copies: str, p: JaccardJoin) -> DataFrame:
    """(row) of first copies whose shingles in the slice leave a partner possible."""
    bits = _bits(int(rows.agg(F.sum(F.length("low")) / 8).first()[0] or 0), p)
    schema = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("places", pa.binary())])

    def first_copies():
        marks = RowMarks(copies)
        return lambda r: ~marks.has(r)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, places in _chunks(batches, first_copies(), p.chunk):
            keys = h >> np.uint64(32 - bits)
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], places[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
            one = np.where(np.diff(np.append(first, len(keys))) == 1, places[first], MANY)
            if out := [(b, part, k, v) for b, k, v in _slices(keys[first], one)]:
                yield _table(out, schema)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows_ in _groups(batches):
            keys, places = _numbers([k for _, k, _ in rows_], np.uint32), _numbers([v for _, _, v in rows_], np.uint32)
            parts = np.repeat(np.array([q for q, _, _ in rows_]), [len(k) // 4 for _, k, _ in rows_])
            order = np.argsort(keys, kind="stable")
            keys, places, parts = keys[order], places[order], parts[order]
            new = np.append(True, keys[1:] != keys[:-1])
            alone = new & np.append(new[1:], True) & (places != MANY)
            parts, places = parts[alone], places[alone]
            order = np.lexsort((places, parts))
            parts, places = parts[order], places[order]
            ends = np.append(np.flatnonzero(np.diff(parts)) + 1, len(parts)).tolist() if len(parts) else []
            if out := [(int(parts[a]), places[a:b].tobytes(), None, None) for a, b in zip([0, *ends], ends, strict=False)]:
                yield _table(out, _PART)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows_ in _groups(batches):
            places, n = _numbers([a for a, v, _ in rows_ if v is not None], np.uint32), _numbers([v for _, v, _ in rows_ if v is not None], np.uint32).astype(np.int64)
            own = np.zeros(int(places.max()) + 1 if len(places) else 0, np.int64)
            for a, v, _ in rows_:
                if v is None:
                    np.add.at(own, np.frombuffer(a, np.uint32), 1)
            stays = places[own[places] < p.alone(n)]
            yield pa.RecordBatch.from_arrays([pa.array((part << SHIFT) + stays.astype(np.int64))], names=["row"])

    full = rows.filter("n > 0")
    posted = full.select("row", "low").mapInArrow(post, "bucket bigint, part bigint, keys binary, places binary")
    own = _by_key(posted, 1 << bits, "bucket").mapInArrow(single, _PART_SQL)
    return own.unionByName(_sizes(full, first_copies)).repartition("part").sortWithinPartitions("part").mapInArrow(decide, "row bigint")


def prefixes(sets: DataFrame, p: JaccardJoin) -> DataFrame:
    """(shingle, row, n, at, df) of sets (row, n, shingles): those of the rarest shingles that hold a partner for sure.

    Shingles that no other set has come first and are left out; at is the place in the order, df how many sets have it.
    """
    bits = _bits(int(sets.agg(F.sum("n")).first()[0] or 0), p)
    schema = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])

    def every():
        return lambda r: np.ones(len(r), bool)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, places in _chunks(batches, every(), p.chunk):
            keys = h >> np.uint64(32 - bits)
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], places[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            count = np.diff(np.append(first, len(keys))).astype(np.uint32)
            out = [(b, 0, part, k, v) for b, k, v in _slices(keys[first], count)] + [(b, 1, part, k, v) for b, k, v in _slices(keys, places)]
            yield _table(out, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, known, df = None, [], None, None
        for batch in batches:
            for bucket, kind, part, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    at, parts, known = bucket, [], None
                if kind == 0:
                    parts.append((k, v))
                    continue
                if known is None:  # the counts of a bucket come before its postings
                    known, of = np.unique(_numbers([a for a, _ in parts], np.uint32), return_inverse=True)
                    df = np.bincount(of, weights=_numbers([b for _, b in parts], np.uint32)).astype(np.uint32)
                    parts = []
                keys, places = np.frombuffer(k, np.uint32), np.frombuffer(v, np.uint32)
                held = df[np.searchsorted(known, keys)]
                on = held > 1
                if on.any():
                    yield _table([(part, places[on].tobytes(), held[on].tobytes(), ((np.int64(bucket) << 32) + keys[on].astype(np.int64)).tobytes())], _PART)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows_ in _groups(batches):
            places, n = _numbers([a for a, _, k in rows_ if k is None], np.uint32), _numbers([v for _, v, k in rows_ if k is None], np.uint32).astype(np.int64)
            sizes = np.zeros(int(places.max()) + 1, np.int64)
            sizes[places] = n
            place, df, key = (_numbers([r[i] for r in rows_ if r[2] is not None], t) for i, t in ((0, np.uint32), (1, np.uint32), (2, np.int64)))
            order = np.lexsort((key, df, place))
            place, df, key = place[order], df[order], key[order]
            first = np.append(True, place[1:] != place[:-1]) if len(place) else np.empty(0, bool)
            start = np.flatnonzero(first)
            many = np.diff(np.append(start, len(place)))
            at = sizes[place] - np.repeat(many, many) + np.arange(len(place)) - np.repeat(start, many)
            on = at < p.alone(sizes[place])
            for a in range(0, int(on.sum()), 1 << 18):
                k = np.flatnonzero(on)[a : a + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array((part << SHIFT) + place[k].astype(np.int64)), pa.array(sizes[place[k]]), pa.array(at[k]), pa.array(df[k].astype(np.int64))], names=["shingle", "row", "n", "at", "df"])

    posted = sets.select("row", "shingles").mapInArrow(post, "bucket bigint, kind int, part bigint, keys binary, values binary")
    held = _by_key(posted, 1 << bits, "bucket", "kind").mapInArrow(count, _PART_SQL)
    return held.unionByName(_sizes(sets, every)).repartition("part").sortWithinPartitions("part").mapInArrow(cut, "shingle bigint, row bigint, n bigint, at bigint, df bigint")


def light_links(sets: DataFrame, most: int, p: JaccardJoin) -> DataFrame:
    """Links (a, b) of sets of up to most shingles: all that share a subset with its first set of the other size.

    A subset is known by two sums of mixed hashes, the whole set's less those that are left out.
    """

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
        for batch in batches:
            out = [[] for _ in range(5)]
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(packed, np.uint64)
                mixed = (h[:, None] ^ (h[:, None] >> np.uint64(29))) * odd
                mixed ^= mixed >> np.uint64(32)
                whole = mixed.sum(axis=0)
                for a, b, k in p.kinds(len(h), most):
                    gone = np.array(list(combinations(range(len(h)), len(h) - k)), np.int64).reshape(_subsets(len(h), k), len(h) - k)
                    keys = (whole - mixed[gone].sum(axis=1)).view(np.int64)
                    for c, v in zip(out, (keys[:, 0], keys[:, 1], np.full(len(keys), a * 4096 + b), np.full(len(keys), len(h) == a), np.full(len(keys), row)), strict=True):
                        c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["k1", "k2", "sizes", "smaller", "row"])

    parts = sets.filter(F.col("n") <= most).select("row", "shingles").mapInArrow(enumerate_, "k1 bigint, k2 bigint, sizes bigint, smaller boolean, row bigint")
    parts = materialise(parts, "subsets", "zstd")
    low = lambda side: F.min(F.when(side, F.col("row")))
    heads = parts.groupBy("k1", "k2", "sizes").agg(low(F.col("smaller")).alias("first"), low(~F.col("smaller")).alias("second"), F.count("*").alias("many")).filter("many > 1").drop("many")
    same = F.col("sizes") % 4096 == F.floor(F.col("sizes") / 4096)
    other = F.when(same | ~F.col("smaller"), F.col("first")).otherwise(F.col("second"))
    both = parts.join(materialise(heads, "subset_heads"), ["k1", "k2", "sizes"]).select("row", other.alias("other")).filter("other IS NOT NULL AND other <> row")
    return both.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, p: JaccardJoin) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the threshold."""
    side = lambda r, s: sets.select(F.col("row").alias(r), F.col("shingles").alias(s))
    both = materialise(pairs, "pairs").join(side("b", "y"), "b").join(side("a", "x"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * shared >= p.percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "links")


def heavy_links(lists: DataFrame, sets: DataFrame, light: int, links: DataFrame, p: JaccardJoin) -> DataFrame:
    """links, and further ones that connect all sets which reach the threshold, where one is larger than light."""
    lists = materialise(lists.filter(F.col("n") >= -(-p.percent * (light + 1) // 100)), "lists")
    left = F.least(F.col("n") - F.col("at"), F.col("hn") - F.col("hat"))
    possible = (F.greatest("n", "hn") > light) & (100 * F.least("n", "hn") >= p.percent * F.greatest("n", "hn")) & ((100 + p.percent) * left >= p.percent * (F.col("n") + F.col("hn")))
    ordered = lambda d: d.select(F.least("row", "head").alias("a"), F.greatest("row", "head").alias("b")).distinct()

    def against(members: DataFrame, first) -> DataFrame:
        heads = members.groupBy("shingle").agg(first.alias("h"), F.count("*").alias("many")).filter("many > 1").select("shingle", F.col("h.row").alias("head"), F.col("h.n").alias("hn"), F.col("h.at").alias("hat"))
        return members.join(materialise(heads, "list_heads"), "shingle").filter("row <> head").filter(possible)

    member = F.struct("row", "n", "at")
    links = links.union(confirmed(ordered(against(lists, F.min(member))), sets, p))
    for last in (False, True):
        links = materialise(links, "links")
        found = materialise(components(links), "found").withColumnRenamed("node", "row")
        of = lists.join(found, "row", "left").withColumn("component", F.coalesce("component", "row"))
        parted = of.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("shingle")
        open_ = materialise(of.join(materialise(parted, "parted"), "shingle"), "open_lists")
        if open_.isEmpty():
            return links
        if not last:
            degree = links.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").agg(F.count("*").alias("links"))
            ranked = open_.join(materialise(degree, "degrees"), "row", "left").withColumn("links", F.coalesce("links", F.lit(0)))
            most = F.max_by(F.struct("row", "n", "at", "component"), F.struct("links", "row"))
            centre = ranked.groupBy("shingle").agg(most.alias("h")).select("shingle", F.col("h.row").alias("head"), F.col("h.n").alias("hn"), F.col("h.at").alias("hat"), F.col("h.component").alias("hc"))
            tried = open_.join(materialise(centre, "centres"), "shingle").filter("component <> hc").filter(possible)
            links = links.union(confirmed(ordered(tried), sets, p))
    # Members outside a list's largest component meet all others, as pairs of different components.
    sizes = open_.groupBy("shingle", "component").agg(F.count("*").alias("m")).groupBy("shingle").agg(F.max_by("component", F.struct("m", "component")).alias("largest"))
    both = materialise(open_.join(sizes, "shingle"), "open_lists")
    x = both.filter("component <> largest").select("shingle", "row", "n", "at", "component")
    y = both.select("shingle", F.col("row").alias("head"), F.col("n").alias("hn"), F.col("at").alias("hat"), F.col("component").alias("hc"), (F.col("component") == F.col("largest")).alias("big"))
    met = x.join(y, "shingle").filter((F.col("component") != F.col("hc")) & (F.col("big") | (F.col("row") < F.col("head")))).filter(possible)
    return links.union(confirmed(ordered(met), sets, p))


def join(docs: DataFrame, p: JaccardJoin = JaccardJoin()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included).

    Null, empty and blank texts have empty sets and link with nothing; texts of fewer words than a shingle are one. Rows
    that repeat a text are linked; a null doc_id counts only where its component has no other. Very long texts are sets
    like others. An empty table gives none. Other columns of docs are left out, whatever their names.
    """
    rows = materialise(read_sets(docs, p).withColumn("row", F.monotonically_increasing_id()), "texts", "zstd")
    classes = rows.filter("n > 0").groupBy("fingerprint").agg(F.min("row").alias("node"), F.min("doc_id").alias("smallest"), F.count("*").alias("members"))
    classes = materialise(classes, "classes")
    again = rows.filter("n > 0").select("row", "fingerprint").join(classes.filter("members > 1").select("fingerprint", "node"), "fingerprint").filter("row <> node")
    copies = write_marks(again, "copies")
    met = write_marks(not_alone(rows, copies, p), "met")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, marks = Shingles(p.words), RowMarks(met)
        for batch in batches:
            batch = batch.filter(pa.array(marks.has(batch.column(0).to_numpy())))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles.of(t).tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(h) // 8 for h in sets], pa.int64()), pa.array(sets, pa.binary())], names=["row", "n", "shingles"])

    sets = materialise(rows.filter("n > 0").select("row", "text").mapInArrow(whole, "row bigint, n bigint, shingles binary"), "sets")
    lists = materialise(prefixes(sets, p), "prefixes")
    counted = sets.filter(F.col("n") <= p.max_light).groupBy("n").agg(F.count("*").alias("sets")).join(lists.filter(F.col("n") <= p.max_light).groupBy("n").agg(F.sum("df").alias("scan")), "n", "left")
    light = boundary({r.n: (r.sets, r.scan or 0) for r in counted.collect()}, p)  # a row a size, max_light at most
    links = heavy_links(lists, sets, light, light_links(sets, light, p), p)
    found = components(links)
    by_class = classes.select("node", "smallest", "fingerprint").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_class = materialise(by_class, "components")
    ids = by_class.groupBy("component").agg(F.min("smallest").alias("component_id"))
    by_class = materialise(by_class.join(ids, "component").select(F.col("fingerprint").alias("_print"), "component_id", F.lit(True).alias("_in")), "memberships")
    out = rows.select("doc_id", "n", "fingerprint").join(small(by_class), F.col("fingerprint") == F.col("_print"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), JaccardJoin(words=4, percent=85))
