"""Training-order materialisation: every sequence of token ids gets a global slot, shards hold them in slot order.

The ids of the documents of a partition, each ended by the end id, form one stream that is cut into sequences. A keyed
Feistel permutation of [0, number of sequences), made so by cycle-walking, maps a sequence's number to its slot; the
shard of a slot is its range. Shards are plain files of records of one length, so training reads them front to back
and resumes at any slot by arithmetic. Sequences are numbered by partition, as RDD.zipWithIndex does: one pass counts
the tokens of each partition (one row each reaches the driver), another makes the sequences and fails if it meets other
words. The first segments the distinct words of each slice of a partition and keeps their ids, without the words, for the second.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import filesystem, materialise, new_path, table
from postsieve.llm.sentencepieces import OTHER_INPUT, mark, model, model_path, numbers, pack_numbers, part_files, slices, split


#: Bytes of text whose words are segmented at once.
SLICE = 16 << 20


class Permutation:
    """A keyed bijection of [0, n): a balanced Feistel network on the next even number of bits, walked until it is below n."""

    ROUNDS = 6

    def __init__(self, n: int, key: int):
        self.n, self.half = n, np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.keys = np.random.default_rng(key).integers(0, 2**63, size=self.ROUNDS, dtype=np.uint64)
        self.mask = np.uint64((1 << int(self.half)) - 1)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return (left << self.half) | right

    def __call__(self, index: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._once(np.asarray(index, np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    length: int = 256
    shard_records: int = 32_768
    key: int = 20240131
    pad: int = 0
    dtype: str = "<u2"

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.dtype).itemsize


class Kept:
    """What the first pass kept of a partition's slices."""

    def __init__(self, folder: str, part: int):
        self.rows = {r["slice"]: r for t in part_files(folder, part) for r in t.to_pylist()}

    def of(self, number: int, words: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words of a slice in a row, how many each has)."""
        kept = self.rows.pop(number, None)
        if kept is None or kept["mark"] != mark(words):
            raise RuntimeError(OTHER_INPUT)
        return np.frombuffer(kept["ids"], dtype), numbers(kept["n"]).astype(np.int64)


def sequences(docs: DataFrame, layout: Layout = Layout(), path: str | None = None) -> tuple[DataFrame, int]:
    """(slot, doc_ids, n_tokens, ids as bytes) of all sequences, and their number.

    docs must give the same partitions each time it is read, as tables do; a partition that gives other words the second
    time raises an error. doc_ids are those whose tokens the sequence holds, in order; the last sequence of a partition is
    padded. Null and empty texts are a single end id; a very long text fills sequence after sequence. Null doc_ids are
    listed as null.
    """
    path = path or model_path()
    if layout.dtype == "<u2" and model(path).size > 1 << 16:
        raise ValueError("ids of this model need four bytes")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.spark_partition_id().alias("part"))

    folder, names = new_path(docs.sparkSession, "segments"), ["part", "slice", "tokens", "mark", "ids", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, number, texts in slices(batches, SLICE):
            s = split(texts.column(1))
            ids, size = model(path).flat(s.distinct)
            row = (part, number, int(size[s.codes].sum()) + len(texts), mark(s.words), ids.astype(layout.dtype).tobytes(), pack_numbers(size))  # and the end ids
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    schema = "part int, slice int, tokens bigint, mark bigint, ids binary, n binary"
    rows.mapInArrow(count, schema).write.partitionBy("part").parquet(folder, compression="zstd")
    counted = docs.sparkSession.read.schema("tokens bigint, part int").parquet(folder)
    tokens = {r.part: r.tokens for r in counted.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()}
    first, n = {}, 0
    for p in sorted(tokens):
        first[p], n = n, n + -(-tokens[p] // layout.length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, kept, part, seen = Permutation(n, layout.key), None, None, 0
        number, rest, owners = None, np.empty(0, layout.dtype), []  # owners: (doc_id, tokens) of rest
        end_id = np.frombuffer(model(path).eos, "<u4").astype(layout.dtype)

        def rows_of(stream: np.ndarray, owners: list) -> pa.RecordBatch:
            nonlocal number
            k = -(-len(stream) // layout.length)
            ends = np.cumsum([c for _, c in owners])
            lows = np.searchsorted(ends, np.arange(k) * layout.length, side="right")
            highs = np.searchsorted(ends, np.minimum((np.arange(k) + 1) * layout.length, len(stream)) - 1, side="right")
            full = np.full(k * layout.length, layout.pad, layout.dtype)
            full[: len(stream)] = stream
            at = slots(np.arange(number, number + k))
            number += k
            tokens = np.full(k, layout.length)
            tokens[-1] = len(stream) - (k - 1) * layout.length
            ids = [full[i * layout.length : (i + 1) * layout.length].tobytes() for i in range(k)]
            names = [d for d, _ in owners]
            held = [names[a : b + 1] if b - a < 1 else list(dict.fromkeys(names[a : b + 1])) for a, b in zip(lows.tolist(), highs.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held, pa.list_(pa.int64())), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary())], names=["slot", "doc_ids", "n_tokens", "ids"])

        def streams() -> Iterator[tuple[list, list[np.ndarray]]]:
            nonlocal part, kept
            for part, k, texts in slices(batches, SLICE):
                kept = kept or Kept(folder, part)
                s = split(texts.column(1))
                ids, low, high = s.join(*kept.of(k, s.words, layout.dtype))
                yield texts.column(0).to_pylist(), [np.concatenate([ids[a:b], end_id]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]

        for names, ids in streams():
            number = first[part] if number is None else number
            stream = np.concatenate([rest, *ids])
            seen += len(stream) - len(rest)
            owners += [(d, len(i)) for d, i in zip(names, ids, strict=True)]
            whole = len(stream) // layout.length * layout.length
            if whole:
                yield rows_of(stream[:whole], owners)
                left = len(stream) - whole
                keep = []
                for d, c in reversed(owners):  # the documents that the rest belongs to
                    if left <= 0:
                        break
                    keep.append((d, min(c, left)))
                    left -= c
                owners = keep[::-1]
            rest = stream[whole:]
        if len(rest):
            yield rows_of(rest, owners)
        if part is not None and seen != tokens[part]:
            raise RuntimeError(OTHER_INPUT)

    return rows.mapInArrow(cut, "slot bigint, doc_ids array<bigint>, n_tokens bigint, ids binary"), n


def write_shards(docs: DataFrame, folder: str, layout: Layout = Layout(), path: str | None = None) -> DataFrame:
    """Write all sequences in slot order; gives (slot, doc_ids, n_tokens, shard, byte_offset, crc32, path) of each record.

    A shard is one file, named by its task's attempt; the table names those of finished tasks. An empty table gives no
    shard; repeated rows are sequences of their own; other columns of docs are left out, whatever their names.
    """
    rows, n = sequences(docs, layout, path)
    shards = max(1, -(-n // layout.shard_records))
    rows = rows.withColumn("shard", F.floor(F.col("slot") / layout.shard_records).cast("int"))
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, name = None, None, None
        try:
            for batch in batches:
                ids = batch.column(3).to_pylist()
                where = []
                for s, x in zip(batch.column(4).to_pylist(), ids, strict=True):
                    if s != shard:
                        if out:
                            out.close()
                        shard, name = s, f"{folder}/shard-{s:06d}-{uuid.uuid4().hex}.bin"
                        place, local = filesystem(name)
                        place.create_dir(local.rsplit("/", 1)[0])
                        out = place.open_output_stream(local)
                    out.write(x)
                    where.append(name)
                slot = batch.column(0).to_numpy()
                offset = (slot % layout.shard_records) * layout.stride
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(offset, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(where)], names=["slot", "doc_ids", "n_tokens", "shard", "byte_offset", "crc32", "path"])
        finally:
            if out:
                out.close()

    return materialise(rows.mapInArrow(run, "slot bigint, doc_ids array<bigint>, n_tokens bigint, shard int, byte_offset bigint, crc32 bigint, path string"), "records")


def shards(records: DataFrame) -> DataFrame:
    """(shard, path, n_records): the manifest of write_shards(). Files that it doesn't name are of attempts that were lost."""
    return records.groupBy("shard", "path").agg(F.count("*").alias("n_records")).orderBy("shard")


def read_shard(path: str, layout: Layout = Layout(), first: int = 0) -> Iterator[np.ndarray]:
    """The records of a shard in order, from the given one on."""
    where, local = filesystem(path)
    with where.open_input_file(local) as source:
        source.seek(first * layout.stride)
        while raw := source.read(layout.stride):
            yield np.frombuffer(raw, layout.dtype)


def read_from(paths: list[str], layout: Layout = Layout(), slot: int = 0) -> Iterator[np.ndarray]:
    """The records of the shards (their paths in order) from a global slot on, to begin or resume training."""
    for k in range(slot // layout.shard_records, len(paths)):
        yield from read_shard(paths[k], layout, max(0, slot - k * layout.shard_records))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return write_shards(docs, new_path(spark, "shards")).drop("path")
