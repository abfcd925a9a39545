"""SentencePiece encoding and decoding through a table of distinct marked words.

The model escapes spaces to a marker and no piece holds a marker behind another character, so merges never cross
from one marked word into the next and a text's ids are its marked words' ids in order. The distinct marked words of
each input partition are dealt by hash into buckets; a bucket's task segments each distinct word once and sends the
ids back to the partitions that hold the word, as one small file a partition in the shared folder. The partitions are
then read again, and the ids (and decoded forms) are joined back by position. A word that a partition's file lacks,
because the input came in other partitions the second time, is segmented on the spot, so results never depend on it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import filesystem, new_path, table

MARKER = "▁"
MODEL = "piece_bpe_32k.model"
#: Buckets that distinct words are dealt into; a bucket's words are held in one task's memory.
BUCKETS = 4096
OTHER_INPUT = "the input gave other partitions when it was read again: write it as a table first"
#: Words are segmented so many a call, to bound what a call's lists of ids take.
CALL_WORDS = 100_000
#: A partition's distinct words are sent off at this many, to bound memory; a word met again later is sent again.
PARTITION_WORDS = 500_000
_MARKED = re.compile(f"[ {MARKER}]+[^ {MARKER}]*")


def model_path(name: str = MODEL) -> str:
    return public_tokenizers.path(name)


def marked_words(text: str) -> list[str]:
    """The marked words of a text in order, each without its first marker."""
    return [m[1:] for m in _MARKED.findall(" " + text)] if text else []


def in_order(codes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words numbered by codes, their ends from 0 on), given those of all words in a row and how many each has."""
    size = n[codes].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    kind = np.int32 if max(ends[-1], len(ids)) < 1 << 31 else np.int64
    at = np.repeat(((np.cumsum(n) - n)[codes] - ends[:-1]).astype(kind), size)
    at += np.arange(ends[-1], dtype=kind)
    return ids[at], ends


@dataclass
class Split:
    """The marked words of a column of texts: distinct ones, the number of each word in order, and each text's range of words."""

    words: pa.Array
    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: Texts whose words are not just the text between single spaces.
    odd: np.ndarray

    @cached_property
    def distinct(self) -> list[str]:
        return self.words.to_pylist()

    def join(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words in order, first and end of each text's), given those of the distinct words in a row and how many each has."""
        ids, ends = in_order(self.codes, ids, n)
        return ids, ends[self.start], ends[self.end]


def split(texts: pa.Array) -> Split:
    """Words of the odd texts (empty ones, and those with spaces in front or in a row or with the marker) lie behind the others'."""
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")), pc.or_(pc.match_substring(texts, MARKER), pc.equal(pc.binary_length(texts), 0)))
    odd = odd.to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    words, size = parts.flatten(), np.zeros(len(texts), np.int64)
    size[~odd] = parts.value_lengths().to_numpy()
    end = np.zeros(len(texts), np.int64)
    end[~odd] = np.cumsum(size[~odd])
    if odd.any():
        lists = [marked_words(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        size[odd] = [len(x) for x in lists]
        end[odd] = len(words) + np.cumsum(size[odd])
        words = pa.concat_arrays([words, pa.array([w for x in lists for w in x], words.type)])
    coded = words.dictionary_encode()
    return Split(coded.dictionary, coded.indices.to_numpy(), end - size, end, odd)


def by_bytes(texts: pa.Array, rows: int = 2048, size: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive texts of some megabytes, one at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        n = min(rows, max(1, int(np.searchsorted(ends, base + size, side="right")) - at), len(texts) - at)
        yield at, n
        at += n


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(partition, number in it, rows) of slices of some bytes of text; texts are the second column, the partition the last one."""
    number = 0
    for batch in batches:
        for at, n in by_bytes(batch.column(1), 8192, size):
            yield batch.columns[-1][0].as_py(), number, batch.slice(at, n)
            number += 1


def mark(words: pa.Array) -> int:
    """Tells lists of words apart."""
    if not len(words):
        return 0
    words = words.cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return zlib.crc32(memoryview(words.buffers()[2])[ends[0] : ends[-1]], zlib.crc32(np.diff(ends)))


class Model:
    """The library's model, and what joining words' ids asks of it."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.lib.get_piece_size()
        pieces = (self.lib.id_to_piece(i) for i in range(self.size))
        if any(MARKER in p.lstrip(MARKER) for p in pieces):
            raise ValueError("a piece of this model crosses a marker: words can't be segmented on their own")
        self.bos, self.eos = struct.pack("<I", self.lib.bos_id()), struct.pack("<I", self.lib.eos_id())

    def segment(self, words: list[str]) -> list[list[int]]:
        ids = self.lib.encode(words, num_threads=1)
        if "" in words:
            ids[words.index("")] = [self.lib.piece_to_id(MARKER)]
        return ids

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each has)."""
        ids, n = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for at in range(0, len(words), CALL_WORDS):
            made = self.segment(words[at : at + CALL_WORDS])
            n.append(np.fromiter(map(len, made), np.int64, len(made)))
            ids.append(np.fromiter(chain.from_iterable(made), "<u4", int(n[-1].sum())))
        return np.concatenate(ids), np.concatenate(n)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode(ids, num_threads=1)


class Kept:
    """Segments of distinct words, those of the first `most` words kept for the lists of words that follow."""

    def __init__(self, model: Model, most: int = PARTITION_WORDS):
        self.model, self.most = model, most
        self.words, self.ids, self.n = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64)

    def flat(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each has)."""
        found = pc.index_in(words, value_set=self.words)
        new = words.filter(found.is_null())
        ids, n = self.model.flat(new.to_pylist())
        at = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        at[found.is_null().to_numpy(zero_copy_only=False)] = len(self.n) + np.arange(len(n))
        all_ids, all_n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
        if len(all_n) <= self.most:
            self.words, self.ids, self.n = pa.concat_arrays([self.words, new]), all_ids, all_n
        return in_order(at, all_ids, all_n)[0], all_n[at]


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """This Python worker's model."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers in one, two, four or eight bytes each, as the largest needs; the first byte says how many."""
    size = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4 if x.max() < 1 << 32 else 8
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def pack(words: list[str]) -> tuple[bytes, bytes]:
    raw = [w.encode() for w in words]
    return b"".join(raw), pack_numbers(np.array([len(r) for r in raw]))


def unpack(data: bytes, sizes: bytes) -> list[str]:
    ends = np.cumsum(numbers(sizes), dtype=np.int64).tolist()
    return [data[s:e].decode() for s, e in zip([0, *ends], ends)]


def word_table(docs: DataFrame, path: str, decode: bool = False) -> str:
    """Write the segments of the distinct marked words of docs (text) by partition; gives their folder."""
    folder = new_path(docs.sparkSession, "words")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = None, {}

        def out() -> pa.RecordBatch:
            by: dict[int, list[str]] = {}
            for w in seen:
                by.setdefault(zlib.crc32(w.encode()) % BUCKETS, []).append(w)
            cols = list(zip(*map(pack, by.values()), strict=True)) or [[]] * 2
            return pa.RecordBatch.from_arrays([pa.array([part] * len(by), pa.int32()), pa.array(list(by), pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names=["part", "bucket", "words", "sizes"])

        for batch in batches:
            part, texts = batch.column(0)[0].as_py() if batch.num_rows else part, batch.column(1)
            for at, n in by_bytes(texts):
                seen.update(dict.fromkeys(split(texts.slice(at, n)).distinct))
                if len(seen) > PARTITION_WORDS:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, bucket, known = model(path), None, {}
        for batch in batches:
            parts, buckets, data, sizes = (c.to_pylist() for c in batch.columns[:4])
            out, at = [], 0
            while at < len(parts):
                end = at + 1
                while end < len(parts) and buckets[end] == buckets[at]:
                    end += 1
                if buckets[at] != bucket:
                    bucket, known = buckets[at], {}
                rows = [unpack(d, s) for d, s in zip(data[at:end], sizes[at:end], strict=True)]
                new = list(dict.fromkeys(w for ws in rows for w in ws if w not in known))
                if new:
                    ids = sp.segment(new)
                    back = sp.decode(ids) if decode else new
                    for w, i, b in zip(new, ids, back, strict=True):
                        known[w] = (i, None if b == w else b)
                for ws in rows:
                    found = [known[w] for w in ws]
                    other = [(p, b) for p, (_, b) in enumerate(found) if b is not None]
                    out.append((pack_numbers(np.array([x for i, _ in found for x in i])), pack_numbers(np.array([len(i) for i, _ in found])), [p for p, _ in other], [b for _, b in other]))
                at = end
            cols = list(zip(*out, strict=True)) or [[]] * 4
            made = [pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string())], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *made], names=["part", "words", "sizes", "ids", "n_ids", "other", "decoded"])

    rows = docs.select(F.spark_partition_id().alias("part"), "text")
    rows = rows.mapInArrow(distinct, "part int, bucket int, words binary, sizes binary")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    rows = rows.mapInArrow(segment, "part int, words binary, sizes binary, ids binary, n_ids binary, other array<int>, decoded array<string>")
    rows.repartition("part").write.partitionBy("part").parquet(folder, compression="zstd")
    return folder


def part_files(folder: str, part: int) -> Iterator[pa.Table]:
    """A partition's files of a table that was written by partition, none if it has none."""
    where, local = filesystem(folder)
    for f in where.get_file_info(fs.FileSelector(f"{local}/part={part}", allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with where.open_input_file(f.path) as source:
                yield pq.ParquetFile(source).read()


class Encoder:
    """Joins the segments of words back by position, from a partition's file of word_table()."""

    def __init__(self, path: str, folder: str | None = None, part: int | None = None):
        self.model = model(path)
        self.at: dict[str, int] = {}
        flat, sizes, self.other = [np.empty(0, "<u4")], [np.empty(0, np.int64)], {}
        for t in part_files(folder, part) if folder else ():
            for words, size, ids, n_ids, other, decoded in zip(*(t[c].to_pylist() for c in ("words", "sizes", "ids", "n_ids", "other", "decoded")), strict=True):
                names, first = unpack(words, size), len(self.at)
                if any(w in self.at for w in names):  # sent twice, by a partition of very many words
                    first = None
                for k, (p, b) in enumerate(zip(other, decoded, strict=True)):
                    self.other[names[p]] = b
                n, i = numbers(n_ids).astype(np.int64), numbers(ids).astype("<u4")
                if first is None:
                    ends = np.cumsum(n)
                    new = [k for k, w in enumerate(names) if w not in self.at]
                    i = np.concatenate([np.empty(0, "<u4"), *[i[ends[k] - n[k] : ends[k]] for k in new]])
                    n, names, first = n[new], [names[k] for k in new], len(self.at)
                self.at.update(zip(names, range(first, first + len(names))))
                flat.append(i)
                sizes.append(n)
        self.flat, self.size = np.concatenate(flat), np.concatenate(sizes)
        self.first = np.cumsum(self.size) - self.size

    def entries(self, words: list[str], decode: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[str, str]]:
        """(entry of each word; ids, first and size of the entries; decoded forms of those words that change)."""
        found = [*map(self.at.get, words)]
        if None not in found:
            return np.array(found, np.int64), self.flat, self.first, self.size, self.other
        new = [w for w, f in zip(words, found, strict=True) if f is None]
        ids = self.model.segment(new)
        more = iter(range(len(self.size), len(self.size) + len(new)))
        size = np.concatenate([self.size, np.array([len(i) for i in ids], np.int64)])
        other = dict(self.other)
        if decode:
            other.update((w, b) for w, b in zip(new, self.model.decode(ids), strict=True) if w != b)
        flat = np.concatenate([self.flat, *[np.array(i, "<u4") for i in ids]])
        return np.array([next(more) if f is None else f for f in found], np.int64), flat, np.cumsum(size) - size, size, other

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has between its begin and end ids."""
        s = split(texts)
        e, _, _, size, _ = self.entries(s.distinct, False)
        ends = np.concatenate([[0], np.cumsum(size[e][s.codes])])
        return ends[s.end] - ends[s.start]

    def encode(self, texts: pa.Array, s: Split | None = None, decode: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, str]]:
        """(ids of all words, first and end of each text's, decoded forms of words that change)."""
        s = s or split(texts)
        e, flat, first, size, other = self.entries(s.distinct, decode)
        n = size[e][s.codes]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[e][s.codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate([[0], ends])
        return ids, ends[s.start], ends[s.end], other

    def texts(self, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """Of each text its ids from begin to end as little-endian unsigned 32-bit integers, and what they decode to in UTF-8."""
        s = split(texts)
        ids, first, end, other = self.encode(texts, s, decode=True)
        changed = np.array([w in other for w in s.distinct], bool)[s.codes] if other else np.zeros(len(s.codes), bool)
        touched = np.concatenate([[0], np.cumsum(changed)])
        redo = s.odd | (touched[s.end] > touched[s.start])
        raw = texts.cast(pa.binary()).to_pylist()
        for k in range(len(texts)):
            text = raw[k] or b""
            if redo[k]:
                words = (s.distinct[c] for c in s.codes[s.start[k] : s.end[k]])
                text = " ".join([other.get(w, w) for w in words]).encode()
            yield b"".join([self.model.bos, ids[first[k] : end[k]].tobytes(), self.model.eos]), text


def encode_decode(docs: DataFrame, path: str | None = None, ids: bool = True, decoded: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, and ids (array) and decoded (string) where asked for, with their digests.

    Null and empty texts give the begin and the end id and decode to an empty text. Repeated rows give repeated rows,
    null doc_ids stay null, an empty table gives an empty result; other columns of docs are left out. A very long text is
    one slice of its task, a very long word one entry of the table.
    """
    path = path or model_path()
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    folder = word_table(docs, path, decode=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if encoder is None and batch.num_rows:
                encoder = Encoder(path, folder, batch.column(2)[0].as_py())
            for at, n in by_bytes(batch.column(1)):
                part = batch.slice(at, n)
                pairs = list(encoder.texts(part.column(1)))
                cols = [part.column(0), pa.array([len(i) // 4 for i, _ in pairs], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in pairs]), pa.array([hashlib.sha256(d).hexdigest() for _, d in pairs])]
                if ids:
                    cols.append(pa.array([np.frombuffer(i, "<i4") for i, _ in pairs], pa.list_(pa.int32())))
                if decoded:
                    cols.append(pa.array([d.decode() for _, d in pairs], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return docs.withColumn("_part", F.spark_partition_id()).mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), ids=False, decoded=False)
