"""Phrases of two to five words that occur together more often than their parts make likely, per language.

Phrases are counted level by level, pairs, then triples, then all longer ones: a phrase can be frequent only if all shorter
phrases in it are, so a level counts the windows whose shorter phrases passed the level before. What passed is sent to the
tasks as a bitmap of fixed size, which lets some too many through and none too few.

A task counts in a HAT-trie: a shallow trie over word ids (64-bit hashes of language and word, checked for clashes) with
hash containers of word sequences under it; a container that grows too large bursts into one for each next word. When the
trie holds too many entries, its largest subtrees are spilled as sorted runs, cut by prefix partition; the runs of a
prefix partition are merged by the task it is dealt to.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postsieve.llm.common import filesystem, materialise, new_path, small, table

#: Ends a piece; no byte of UTF-8.
BREAK = b"\xff"
_SEPARATORS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d", b"\n" * 9)


@dataclass(frozen=True)
class Collocations:
    """Phrases of up to longest words, at least often times; the first top of each language.

    filter_bits: size of a level's bitmap, as a power of two. entries: of a task's trie before it spills; burst: of a container.
    tokens: windows that a task sorts at a time. partition_words: words of the corpus for each prefix partition.
    """

    longest: int = 5
    often: int = 100
    top: int = 2000
    filter_bits: int = 26
    entries: int = 300_000
    burst: int = 4096
    tokens: int = 1 << 19
    partition_words: int = 2_000_000


def pieces(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text, BREAK after each piece."""
    return (text or b"").lower().translate(_SEPARATORS).replace(b"\n", b" \xff ").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def fold(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each sequence, given by its words' columns."""
    out = words[0]
    for w in words[1:]:
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + w)
    return out


class HatTrie:
    """Counts of word sequences of one length. Under a word's id lies a container (rest of the sequence: count) or, once
    that has burst, containers under the next word's ids."""

    def __init__(self, length: int, p: Collocations):
        self.length, self.p, self.root, self.entries = length, p, {}, 0

    def add(self, words: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct sequences, rows of words, those of a first word together."""
        ends = np.append(np.flatnonzero(words[1:, 0] != words[:-1, 0]) + 1, len(words)).tolist()
        rest = words[:, 1] if self.length == 2 else np.ascontiguousarray(words[:, 1:]).view(f"V{8 * (self.length - 1)}")[:, 0]
        heads, rest, counts, start = words[:, 0].tolist(), rest.tolist(), counts.tolist(), 0
        for end in ends:
            node = self.root.get(heads[start])
            if node is None:
                node = self.root[heads[start]] = {}
            if type(node) is Burst:
                self.entries += node.add(rest[start:end], counts[start:end])
            else:
                before, get = len(node), node.get
                for r, c in zip(rest[start:end], counts[start:end], strict=True):
                    node[r] = get(r, 0) + c
                self.entries += len(node) - before
                if len(node) > self.p.burst and self.length > 2:
                    self.root[heads[start]] = burst = Burst()
                    burst.add(list(node), list(node.values()))
            start = end

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Take out the largest subtrees until keep entries are left: (sequences, counts), sorted."""
        heads, rests, counts = [], [], []
        for head in sorted(self.root, key=lambda w: -len(self.root[w])):
            if self.entries <= keep:
                break
            node = self.root.pop(head)
            for part in node.containers() if type(node) is Burst else [node]:
                heads.append((head, len(part)))
                rests += part
                counts += part.values()
            self.entries -= len(node)
        if not counts:
            return None
        words = np.empty((len(counts), self.length), np.uint64)
        words[:, 0] = np.repeat(np.array([h for h, _ in heads], np.uint64), [n for _, n in heads])
        words[:, 1:] = np.array(rests, np.uint64)[:, None] if self.length == 2 else np.frombuffer(b"".join(rests), np.uint64).reshape(-1, self.length - 1)
        order = np.lexsort(words.T[::-1])
        return words[order], np.array(counts, np.int64)[order]


class Burst:
    """What a container of longer sequences becomes: containers by the next word's bytes; keys stay whole."""

    def __init__(self):
        self.under, self.size = {}, 0

    def __len__(self) -> int:
        return self.size

    def add(self, rest: list[bytes], counts: list[int]) -> int:
        before, under = self.size, self.under
        for r, c in zip(rest, counts, strict=True):
            node = under.get(r[:8])
            if node is None:
                node = under[r[:8]] = {}
            if r in node:
                node[r] += c
            else:
                node[r] = c
                self.size += 1
        return self.size - before

    def containers(self):
        return self.under.values()


def distinct(words: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, those of a first word together, with the sums of their counts."""
    key = fold(list(words.T))
    order = np.argsort(key)
    key, sorted_ = key[order], words[order]
    new = np.append(True, key[1:] != key[:-1])
    if (new[1:] == (sorted_[1:] == sorted_[:-1]).all(axis=1)).any():  # two sequences of one hash
        order = np.lexsort(words.T[::-1])
        sorted_ = words[order]
        new = np.append(True, (sorted_[1:] != sorted_[:-1]).any(axis=1))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)
    words = sorted_[first]
    order = np.argsort(words[:, 0])
    return words[order], n[order]


class Passed:
    """The bitmap of a level: which sequences may be frequent."""

    def __init__(self, folder: str, p: Collocations):
        self.shift = np.uint64(64 - p.filter_bits)
        self.bits = np.zeros(1 << p.filter_bits - 3, np.uint8)
        where, local = filesystem(folder)
        for f in where.get_file_info(fs.FileSelector(local)):
            if f.path.endswith(".parquet"):
                with where.open_input_file(f.path) as source:
                    for block, bits in zip(*pq.ParquetFile(source).read(["block", "bits"]).to_pydict().values(), strict=True):
                        part = np.frombuffer(bits, np.uint8)
                        self.bits[block * len(part) : (block + 1) * len(part)] = part

        self.view = memoryview(self.bits)

    def has_word(self, word: int) -> bool:
        x = (word ^ word >> 29) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        at = (x ^ x >> 32) >> int(self.shift)
        return bool(self.view[at >> 3] >> (at & 7) & 1)

    def has(self, folded: np.ndarray) -> np.ndarray:
        at = _mix(folded) >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(sequences: DataFrame, name: str, p: Collocations) -> str:
    """Write the bitmap of sequences (words: packed ids) in blocks; gives the folder. Its size doesn't depend on their number."""
    block = max(p.filter_bits - 9, 3)  # 512 blocks at most

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = batch.column(0).to_pylist()
            at = fold(list(np.frombuffer(b"".join(packed), np.uint64).reshape(len(packed), -1).T))
            at = np.unique(_mix(at) >> np.uint64(64 - p.filter_bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> block), pa.array(at & ((1 << block) - 1))], names=["block", "slot"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = None, None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()])], names=["block", "bits"])
        for batch in batches:
            blocks, slot = (c.to_numpy() for c in batch.columns)
            for b in np.unique(blocks).tolist():
                if b != at:
                    if at is not None:
                        yield one()
                    at, bits = b, np.zeros(1 << block, np.uint8)
                bits[slot[blocks == b]] = 1
        if at is not None:
            yield one()

    found = sequences.select("words").mapInArrow(slots, "block bigint, slot bigint").distinct()
    folder = new_path(sequences.sparkSession, name)
    found.repartition("block").sortWithinPartitions("block").mapInArrow(pack, "block bigint, bits binary").write.parquet(folder)
    return folder


class Ids(dict):
    """Ids of the words of texts in one language; 0 for words that aren't frequent. Kept by place, as small numbers are fast to look up."""

    def __init__(self, lang: bytes, seed: int, passed: Passed, most: int = 150_000):
        self.lang, self.seed, self.passed, self.most = lang, seed, passed, most
        self.known = np.zeros(1024, np.uint64)
        self.n = 1

    def __missing__(self, word: bytes) -> int:
        h = word_id(self.lang, word, self.seed) if word != BREAK else 0
        at = 0
        if h and self.passed.has_word(h):
            if self.n == len(self.known):
                self.known = np.append(self.known, np.zeros_like(self.known))
            self.known[self.n], at = h, self.n
            self.n += 1
        self[word] = at
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.n = 1
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.known[at]


@functools.lru_cache(1)
def ids_of(folder: str, seed: int, p: Collocations) -> tuple[Passed, dict[bytes, Ids]]:
    """The bitmap of words and the ids by language; a Python worker keeps them from task to task."""
    return Passed(folder, p), {}


def word_id(lang: bytes, word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(lang + b"\0" + word, seed) or 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")


def count_words(docs: DataFrame, p: Collocations, seed: int) -> DataFrame:
    """(id, lang, word, n) with every word of each language; clash tells whether another word has this id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                words.pop(BREAK, None)
                names = list(words)
                ids = np.array([word_id(lang, w, seed) for w in names], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([lang] * len(names), pa.binary()).cast(pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64())], names=["id", "lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns), strict=True):
                held.setdefault(lang, Counter()).update(pieces(text))
            if sum(map(len, held.values())) > p.entries:
                yield from rows()
        yield from rows()

    found = _texts(docs).mapInArrow(run, "id bigint, lang string, word string, n bigint")
    one = F.struct("lang", "word")
    d = found.groupBy("id").agg(F.min(one).alias("w"), F.max(one).alias("v"), F.sum("n").alias("n"))
    return d.select("id", "w.lang", "w.word", "n", (F.col("w") != F.col("v")).alias("clash"))


def count_phrases(docs: DataFrame, lengths: tuple[int, ...], words: str, shorter: str, known_length: int, partitions: int, p: Collocations, seed: int) -> DataFrame:
    """(words, f): frequent phrases of some lengths as packed ids. words, shorter: folders of bitmaps, of words and of phrases of known_length."""
    schema = pa.schema([("part", pa.int64()), ("length", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])

    def runs(length: int, spilled: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        if spilled is None:
            return
        w, n = spilled
        part = (fold(list(w.T[:3])) % np.uint64(partitions)).astype(np.int64)
        order = np.argsort(part, kind="stable")  # in each, the run stays sorted
        w, n, part = w[order], n[order], part[order]
        ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part)).tolist()
        rows = [(int(part[a]), length, np.ascontiguousarray(w[a:b].T).tobytes(), n[a:b].astype(np.uint32).tobytes() if n[a:b].max() < 2**32 else n[a:b].tobytes()) for a, b in zip([0, *ends], ends, strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, ids), passed = ids_of(words, seed, p), Passed(shorter, p)
        tries, held, size = [HatTrie(n, p) for n in lengths], [], 0

        def insert() -> None:
            x = np.concatenate(held)
            held.clear()
            least = lengths[0]
            if len(x) < least:
                return
            may = np.flatnonzero(np.logical_and.reduce([x[i : len(x) - least + 1 + i] != 0 for i in range(least)]))
            for trie in tries:
                if trie.length > least:  # of the shorter ones, those that go on
                    may = may[may + trie.length <= len(x)]
                    may = may[x[may + trie.length - 1] != 0]
                first = 0 if trie.length == least else trie.length - known_length
                for i in range(first, trie.length - known_length + 1) if known_length > 1 else ():
                    may = may[passed.has(fold([x[may + i + j] for j in range(known_length)]))]
                if len(may):
                    trie.add(*distinct(np.stack([x[may + i] for i in range(trie.length)], axis=1)))

        gap = np.zeros(1, np.uint64)
        for batch in batches:
            for lang, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns), strict=True):
                if lang not in ids:
                    ids[lang] = Ids(lang, seed, known)
                w = pieces(text)
                held += [ids[lang].of(w), gap]
                size += len(w) + 1
                if size >= p.tokens:
                    insert()
                    size = 0
                    for trie in tries:
                        if trie.entries > p.entries // len(tries):
                            yield from runs(trie.length, trie.spill(trie.entries // 2))
        if held:
            insert()
        for trie in tries:
            yield from runs(trie.length, trie.spill(0))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, []

        def frequent() -> pa.RecordBatch:
            w, n = distinct(np.concatenate([w for w, _ in found]), np.concatenate([n for _, n in found]))
            w, n = w[n >= p.often], n[n >= p.often]
            return pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in w], pa.binary()), pa.array(n)], names=["words", "f"])

        for batch in batches:
            for part, length, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, length) != at and found:
                    yield frequent()
                    found = []
                at, w = (part, length), np.frombuffer(w, np.uint64).reshape(length, -1).T
                found.append((w, np.frombuffer(n, np.uint32 if len(n) == 4 * len(w) else np.int64).astype(np.int64)))
        if found:
            yield frequent()

    spilled = _texts(docs).mapInArrow(count, "part bigint, length int, words binary, counts binary")
    return spilled.repartition(partitions, "part").sortWithinPartitions("part", "length").mapInArrow(merge, "words binary, f bigint")


def phrases(docs: DataFrame, p: Collocations = Collocations()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, f) of the frequent phrases of each length, words as packed ids; (id, lang, word) of their words; (lang, n)."""
    for seed in itertools.count():
        counted = materialise(count_words(docs, p, seed), "words")
        if counted.filter("clash").isEmpty():
            break
    totals = materialise(counted.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(totals.agg(F.sum("n")).first()[0] or 0) // p.partition_words)
    names = counted.filter(F.col("n") >= p.often)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in batch.column(0).to_numpy()], pa.binary()), batch.column(1)], names=["words", "f"])

    found = [materialise(names.select("id", F.col("n").alias("f")).mapInArrow(pack, "words binary, f bigint"), "phrases-1")]
    known = shorter = bitmap(found[0], "bitmap-1", p)
    for before, lengths in enumerate(((2,), (3,), tuple(range(4, p.longest + 1))), 1):
        lengths = tuple(n for n in lengths if n <= p.longest)
        if not lengths or found[-1].isEmpty():
            break
        found.append(materialise(count_phrases(docs, lengths, known, shorter, before, partitions, p, seed), f"phrases-{lengths[0]}"))
        if before < 3:
            shorter = bitmap(found[-1], f"bitmap-{lengths[0]}", p)
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out, names.select("id", "lang", "word"), totals


def collocations(docs: DataFrame, p: Collocations = Collocations()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first phrases of each language by score, a, then phrase.

    a: occurrences; l, r: those of the parts at the cut of lowest score, the earliest of several; n: words of the language;
    score: floor(1000 a n / (l r)), exact. Phrases that lie in a longer one with as many occurrences are left out. Null
    and empty texts have no words; a null lang is und; very long texts are counted whole; repeated rows count each. An
    empty table gives none. Only text and lang are read.
    """
    all_, names, totals = phrases(docs, p)
    length = F.length("words") / 8
    # A longer phrase with as many occurrences has one of a word more among its parts that has as many, too.
    longer = all_.filter(length >= 3).select("f", F.explode(F.array(F.expr("substring(words, 1, length(words) - 8)"), F.expr("substring(words, 9)"))).alias("words"))
    longer = longer.groupBy("words").agg(F.max("f").alias("most"))
    kept = all_.filter(length >= 2).join(longer, "words", "left").filter("most IS NULL OR most < f").select("words", F.col("f").alias("a"))
    kept = materialise(kept, "candidates")
    cuts = kept.select("words", "a", F.explode(F.sequence(F.lit(1), (length - 1).cast("int"))).alias("k"))
    cuts = cuts.select("words", "a", "k", F.expr("substring(words, 1, 8 * k)").alias("left"), F.expr("substring(words, 8 * k + 1)").alias("right"), F.expr("substring(words, 1, 8)").alias("head"))
    part = lambda name, f: all_.select(F.col("words").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array([x], np.int64).tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *batch.columns[1:]], names=["head", "lang", "word"])

    words = materialise(names.mapInArrow(ids, "head binary, lang string, word string"), "frequent_words")
    exact = lambda c: F.col(c).cast("decimal(17,0)")  # noqa: E731  37 digits for 1000 a n
    cuts = cuts.join(words.select("head", "lang"), "head").join(small(totals), "lang")
    cuts = cuts.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n")), "under": exact("l") * exact("r")})
    best = cuts.select("*", F.expr("over div under").alias("score")).groupBy("words").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first(F.struct("lang", "a", "n")).alias("of"))
    best = materialise(best.select("words", "of.lang", "of.a", "cut.l", "cut.r", "of.n", "cut.score"), "scored")
    order = [F.desc("score"), F.desc("a")]
    # The score and count of a language's last row: its shares' first rows are sought in groups of phrases before.
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("words"), F.lit(32))).orderBy(*order)
    first = best.select("lang", "score", "a", F.row_number().over(salted).alias("_n"), "words").filter(F.col("_n") <= p.top)
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_n") == p.top)
    last = materialise(first.select("lang", F.struct("score", "a").alias("last")), "last_rows")
    near = best.join(small(last), "lang", "left").filter(F.col("last").isNull() | (F.struct("score", "a") >= F.col("last"))).drop("last")
    spelled = near.select("words", F.explode(F.sequence(F.lit(1), length.cast("int"))).alias("k")).select("words", "k", F.expr("substring(words, 8 * k - 7, 8)").alias("head"))
    spelled = spelled.join(words.select("head", "word"), "head").groupBy("words").agg(F.sort_array(F.collect_list(F.struct("k", "word"))).alias("s"))  # of five words at most
    out = near.join(spelled.select("words", F.array_join("s.word", " ").alias("phrase")), "words")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("bigint")).filter(F.col("rank") <= p.top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
