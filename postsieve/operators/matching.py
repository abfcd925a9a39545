"""Joins of short texts by what they have in common: dictionary terms in them, or most of their characters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.operators.tables import materialise


def _grams(text: Column, n: int) -> Column:
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, F.lit(n)))


def dictionary_matches(haystacks: DataFrame, terms: DataFrame) -> DataFrame:
    """(hay, term) for each distinct haystack (hay) and each distinct term (term) that lies in it; blank and null ones have none.

    An equi-join on short grams: a term is sought by the rarest of its grams of three characters, or by itself if it is
    shorter, in the postings of the haystacks, and found ones are verified. Neither side has a bound.
    """
    hays = haystacks.select("hay").filter("hay <> ''").distinct().withColumn("id", F.monotonically_increasing_id())
    hays = materialise(hays, "haystacks")
    hay, term = F.col("hay"), F.col("term")
    own = F.when(F.length(term) < 3, F.array(term)).otherwise(_grams(term, 3))
    wanted = materialise(terms.select("term").filter("term <> ''").distinct().select("term", F.explode(F.array_distinct(own)).alias("gram")), "term_grams")
    postings = hays.select("id", F.explode(F.array_distinct(F.concat(*(_grams(hay, n) for n in (1, 2, 3))))).alias("gram"))
    postings = materialise(postings.join(wanted.select("gram").distinct(), "gram", "left_semi"), "postings")
    counts = wanted.join(postings.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").select("term", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    anchors = counts.groupBy("term").agg(F.min(F.struct("n", "gram")).alias("a")).filter("a.n > 0").select("term", F.col("a.gram").alias("gram"))
    return postings.join(anchors, "gram").join(hays, "id").filter(F.contains(hay, term)).select("hay", "term")


def _needed(total: np.ndarray, ratio: float) -> np.ndarray:
    """Matched characters that titles of together so many characters need for a ratio above ratio."""
    return np.floor(ratio * total / 2 - 1e-9).astype(np.int64) + 1


def _counts(codes: np.ndarray, row: np.ndarray, rows: int, most: int) -> np.ndarray:
    """How often each code occurs in each row (codes by rows): the most frequent codes have a line each, all others one together."""
    names, which, n = np.unique(codes, return_inverse=True, return_counts=True)
    line = np.full(len(names), most, np.int64)
    often = np.argsort(-n, kind="stable")[:most]
    line[often] = np.arange(len(often))
    flat = np.bincount(line[which] * rows + row, minlength=(most + 1) * rows)
    return flat.reshape(most + 1, rows).astype(np.uint8 if flat.max(initial=0) < 256 else np.uint32)


def _common(counts: np.ndarray, i: int, start: int) -> np.ndarray:
    """How many codes row i shares with each row from start on."""
    one = counts[:, i]
    got = np.zeros(counts.shape[1] - start, counts.dtype if one.sum() < 255 else np.uint32)
    for line in np.flatnonzero(one):
        got += np.minimum(counts[line, start:], one[line])
    return got


def _tile(titles: list[str], left: int, ratio: float, lines: int = 48) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, whether they can be near): pairs of titles, i of the first left ones and j of the rest, or of all, j above i, where there is no rest.

    m matched characters lie in order in both titles, in total - 2 m + 1 blocks at most, and a block holds its length less
    one of pairs of neighbours. So near titles share that many characters, that many pairs of neighbours, and a subsequence of that length.
    """
    size = np.array([len(t) for t in titles], np.int64)
    row = np.repeat(np.arange(len(titles)), size)
    codes = np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32).astype(np.int64)
    inner = np.flatnonzero(row[:-1] == row[1:])
    chars, grams = _counts(codes, row, len(titles), lines), _counts(codes[inner] << 21 | codes[inner + 1], row[inner], len(titles), 8 * lines)
    grams = np.ascontiguousarray(grams.T)
    last, found = None, []
    for i in np.argsort(size[:left], kind="stable").tolist():
        if size[i] != last:
            last = size[i]
            need = _needed(last + size, ratio)
            least = np.where(need <= np.minimum(last, size), need, np.iinfo(np.int32).max)
            least = np.minimum(least, np.iinfo(chars.dtype).max).astype(chars.dtype)
        start = i + 1 if left == len(titles) else left
        on = start + np.flatnonzero(_common(chars, i, start) >= least[start:])
        if len(on):
            lines = np.flatnonzero(grams[i])
            on = on[np.minimum(grams[np.ix_(on, lines)], grams[i, lines]).sum(axis=1, dtype=np.int64) >= 3 * need[on] - last - size[on] - 1]
            found.append(np.stack([np.full(len(on), i), on]))
    found = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    ends = np.cumsum(size)
    for at in range(0, found.shape[1], 4096):
        x, y = found[:, at : at + 4096]
        yield x, y, _in_order(codes, ends - size, size, *np.where(size[x] <= size[y], (x, y), (y, x))) >= _needed(size[x] + size[y], ratio)


def _in_order(codes: np.ndarray, first: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of titles x and y, by a bit a character of x; no less than 64 is told of longer x."""
    width, height = min(64, int(size[x].max())), int(size[y].max())
    of = lambda t, n, none: np.where(np.arange(n) < size[t][:, None], codes[np.minimum(first[t][:, None] + np.arange(n), len(codes) - 1)], none)
    left = np.zeros((len(x), 64), np.int64)
    left[:, :width] = of(x, width, -1)
    left[:, width:] = -1
    v = np.full(len(x), np.iinfo(np.uint64).max, np.uint64)
    for column in of(y, height, -2).T:
        u = v & np.packbits(left == column[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        v = (v + u) | (v - u)
    return np.where(size[x] > 64, size[x], np.bitwise_count(~v))


def candidate_titles(titles: DataFrame, ratio: float = 0.85, block: int = 8192) -> DataFrame:
    """(x, y), x < y: distinct titles (title) whose Ratcliff-Obershelp ratio can be above ratio, in either order.

    Loses no pair. Titles of a class of lengths are dealt into blocks of about so many; each two blocks of a class or of
    neighbouring ones, beyond which lengths differ too much, are compared in a task by counts of characters and of pairs of
    neighbours, a title with a whole block at a time, and what is left by common subsequences. The comparisons grow with the square of the distinct titles; a task
    holds two blocks.
    """
    spark = titles.sparkSession
    named = titles.select("title").filter("title <> ''").distinct()
    step = (2 - ratio) / ratio
    named = named.withColumn("class", F.floor(F.log(F.length("title").cast("double")) / math.log(step) + 1e-9).cast("int"))  # near lengths differ by a class at most
    named = materialise(named, "named_titles")
    blocks = {r["class"]: -(-r["n"] // block) for r in named.groupBy("class").agg(F.count("*").alias("n")).collect()}  # a row a class of lengths
    if not blocks:
        return named.select(F.col("title").alias("x"), F.col("title").alias("y"))
    above = F.create_map(*[F.lit(v) for c, n in blocks.items() for v in (c, n)])
    own, up, down = (F.coalesce(above[F.col("class") + k], F.lit(0)) for k in (0, 1, -1))
    tile = lambda c, i, d, j: F.struct(*(v.cast("int").alias(n) for v, n in ((c, "c"), (i, "i"), (d, "d"), (j, "j"))))
    first = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    c, b = F.col("class"), F.col("block")
    dealt = named.withColumn("block", F.pmod(F.xxhash64("title"), own).cast("int"))
    within = F.transform(first(own), lambda k: tile(c, F.least(b, k), c, F.greatest(b, k)))
    across = F.concat(F.transform(first(up), lambda k: tile(c, b, c + 1, k)), F.transform(first(down), lambda k: tile(c - 1, k, c, b)))
    dealt = dealt.select("title", c, b, F.explode(F.concat(within, across)).alias("tile"))
    tiles = sum(n * (n + 1) // 2 + n * blocks.get(k + 1, 0) for k, n in blocks.items())
    spread = max(1, min(tiles, 32 * spark.sparkContext.defaultParallelism))

    def compare(group: pa.Table) -> pa.Table:
        t = group.column("tile")[0].as_py()
        at = list(zip(group.column("class").to_pylist(), group.column("block").to_pylist(), group.column("title").to_pylist(), strict=True))
        one = [s for k, n, s in at if (k, n) == (t["c"], t["i"])]
        named = one + [s for k, n, s in at if (k, n) != (t["c"], t["i"])]
        # A tile of a block with itself has no other titles; one whose other block is empty has no pairs.
        found = _tile(named, len(one), ratio) if (t["c"], t["i"]) == (t["d"], t["j"]) or len(one) < len(named) else ()
        pairs = [sorted((named[i], named[j]), key=str.encode) for x, y, near in found for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True)]
        return pa.table({"x": pa.array([p[0] for p in pairs], pa.string()), "y": pa.array([p[1] for p in pairs], pa.string())})

    return dealt.repartition(spread, "tile").groupBy("tile").applyInArrow(compare, "x string, y string")


def near_titles(titles: DataFrame, ratio: float = 0.85) -> DataFrame:
    """(kept, new): distinct titles (title) for which the ratio of new against kept is above ratio; it isn't the same the other way round."""

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for p in parts:
            m, out = SequenceMatcher(), []
            for x, y in zip(p["x"], p["y"], strict=True):
                for kept, new in ((x, y), (y, x)):
                    m.set_seqs(new, kept)
                    if m.real_quick_ratio() > ratio and m.quick_ratio() > ratio and m.ratio() > ratio:  # upper bounds first
                        out.append((kept, new))
            yield pd.DataFrame(out, columns=["kept", "new"], dtype="string")

    return candidate_titles(titles, ratio).repartition("x", "y").mapInPandas(score, "kept string, new string")
