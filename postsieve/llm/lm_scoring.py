"""Language-model scores of texts: a smoothed word unigram, and a causal self-attention model trained in numpy.

The attention model reads subword ids and predicts the next id's frequency class (ids in order of their counts, cut
into classes of equal mass); within its class an id has its smoothed share of the corpus counts. Word and subword counts
cover all training documents. The attention weights are trained in rounds, each over all training documents in shares:
in a share, every task trains a copy on the windows of its documents and the copies are averaged. Texts are scored in
overlapping windows: each token once, with at least window - stride tokens before it. Words are counted by slices of the
texts: a slice's distinct words are dealt into buckets, whose tasks send their counts in the corpus back. Each text is segmented
once, its ids being kept for training and scoring. A task holds the words of one slice, or of one bucket, as Arrow columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import materialise, new_path, table
from postsieve.llm.sentencepieces import OTHER_INPUT, Kept, by_bytes, mark, model, model_path, numbers, pack_numbers, part_files, slices, split


@dataclass(frozen=True)
class Model:
    window: int = 32
    stride: int = 24
    width: int = 16
    classes: int = 64
    rate: float = 0.01
    batch: int = 128
    #: Copies are averaged so many times in a round: after the documents of each crc32 remainder.
    shares: int = 2
    #: Passes over all training documents.
    rounds: int = 1

    def start(self, vocabulary: int) -> dict[str, np.ndarray]:
        rng, d = np.random.default_rng(5), self.width
        make = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return {"E": make(vocabulary, d), "P": make(self.window, d), "W": make(d, 3 * d), "O": make(d, d), "C": make(d, self.classes), "b": np.zeros(self.classes, np.float32)}


def logits(w: dict[str, np.ndarray], x: np.ndarray, skip: int = 0) -> tuple[np.ndarray, tuple]:
    """Class logits (classes, windows x positions) of the positions from skip on, and what backward() needs.

    Keys and classes lie on leading axes, so that sums over them run along whole rows of queries and positions. Attention
    weights stay unnormalised: what they sum is divided, which has fewer numbers than they are.
    """
    (n, t), d = x.shape, w["O"].shape[0]
    h = w["E"][x]
    h += w["P"]
    to_qkv = w["W"].copy()
    to_qkv[:, :d] *= np.asarray(d**-0.5, to_qkv.dtype)  # queries come scaled
    if skip:
        k, v = np.split((h.reshape(-1, d) @ to_qkv[:, d:]).reshape(n, t, 2 * d), 2, axis=-1)
        h = np.ascontiguousarray(h[:, skip:])
        q = (h.reshape(-1, d) @ to_qkv[:, :d]).reshape(n, t - skip, d)
    else:
        q, k, v = np.split((h.reshape(-1, d) @ to_qkv).reshape(n, t, 3 * d), 3, axis=-1)
    s = np.matmul(k, q.transpose(0, 2, 1))  # windows, keys, queries
    np.clip(s, -40, 40, out=s)
    np.exp(s, out=s)
    s *= np.triu(np.ones((t, t), s.dtype))[:, skip:]  # a key serves the queries from its own place on
    r = 1 / s.sum(axis=1)[:, :, None]
    o = np.matmul(s.transpose(0, 2, 1), v)
    o *= r
    z = o.reshape(-1, d) @ w["O"]
    z += h.reshape(-1, d)
    p = w["C"].T @ z.T
    p += w["b"][:, None]
    np.clip(p, -60, 60, out=p)
    return p, (h, to_qkv, q, k, v, s, r, o, z)


def forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Class probabilities (classes, windows x positions), and what backward() needs."""
    p, kept = logits(w, x)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    return p, kept


def log_probabilities(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, skip: int) -> np.ndarray:
    """Of classes y at the positions of windows x from skip on."""
    p, _ = logits(w, x, skip)
    one = p[y[:, skip:].ravel(), np.arange(p.shape[1])]
    np.exp(p, out=p)
    return (one - np.log(p.sum(axis=0))).reshape(len(x), -1)


def backward(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of classes y where use holds, and its gradients; that of E as (rows, their gradients)."""
    p, (h, to_qkv, q, k, v, s, r, o, z) = logits(w, x)
    (b, t), d, n = x.shape, w["O"].shape[0], max(1, int(use.sum()))
    at, one, on = np.arange(b * t), y.ravel(), use.ravel()
    np.exp(p, out=p)
    total = p.sum(axis=0)
    loss = -float(np.log(p[one, at][on] / total[on] + 1e-9).sum()) / n
    share = on / np.asarray(n, p.dtype)
    g = p
    g *= share / total
    g[one, at] -= share
    out = {"C": z.T @ g.T, "b": g.sum(1)}
    dz = g.T @ w["C"].T
    flat = lambda m: m.reshape(-1, m.shape[-1])
    out["O"] = flat(o).T @ dz
    do = (dz @ w["O"].T).reshape(b, t, d)
    do *= r  # of the sums before they are divided
    ds = np.matmul(v, do.transpose(0, 2, 1))
    ds -= np.einsum("btd,btd->bt", do, o)[:, None, :]
    ds *= s
    dqkv = np.empty((b, t, 3 * d), p.dtype)
    np.matmul(ds.transpose(0, 2, 1), k, out=dqkv[:, :, :d])
    np.matmul(ds, q, out=dqkv[:, :, d : 2 * d])
    np.matmul(s, do, out=dqkv[:, :, 2 * d :])
    out["W"] = flat(h).T @ flat(dqkv)
    out["W"][:, :d] *= np.asarray(d**-0.5, p.dtype)
    dh = dz
    dh += flat(dqkv) @ to_qkv.T
    out["P"] = dh.reshape(b, t, d).sum(0)
    ids = x.ravel().astype(np.uint16 if len(w["E"]) <= 1 << 16 else x.dtype)  # numbers of two bytes are sorted by radix
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    out["E"] = (ids[first].astype(np.int64), np.add.reduceat(dh[order], first))
    return loss, out


class Adam:
    """Rows of a matrix that a step gives no gradient for stay as they are, moments included."""

    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = w, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = np.float32(self.rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (..., g)
            m = self.m[k][at]
            m += np.float32(0.1) * (g - m)
            v = self.v[k][at]
            v += np.float32(0.001) * (g * g - v)
            self.m[k][at], self.v[k][at] = m, v
            self.w[k][at] -= scale * m / (np.sqrt(v) + np.float32(1e-8))


def windows(ids: list[np.ndarray], m: Model, stride: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, which targets count, text number) of the windows of texts, given their ids from begin to end."""
    n, stride = np.array([len(i) - 1 for i in ids]), stride or m.stride
    per = 1 + np.maximum(0, -(-(n - m.window) // stride))
    text = np.repeat(np.arange(len(ids)), per)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * stride
    flat = np.concatenate([*ids, np.zeros(m.window + 1, np.int64)])
    base = np.cumsum([0, *[len(i) for i in ids[:-1]]])[text] + start
    at = np.arange(m.window)
    places = np.minimum(base[:, None] + at, len(flat) - 2)
    use = (start[:, None] + at < n[text][:, None]) & ((start == 0)[:, None] | (at >= m.window - stride))
    return flat[places], flat[places + 1], use, text


def classes(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, log of its smoothed share of the class): ids by count, cut into n parts of equal mass."""
    order = np.argsort(-counts, kind="stable")
    smooth = counts + 1.0
    mass = np.cumsum(smooth[order]) - smooth[order] / 2
    cls = np.empty(len(counts), np.int64)
    cls[order] = np.minimum(n - 1, (mass / smooth.sum() * n).astype(np.int64))
    return cls, np.log(smooth / np.bincount(cls, smooth, n)[cls])


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w.values()])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([x.size for x in like.values()])
    return {k: part.reshape(x.shape).astype(np.float32) for (k, x), part in zip(like.items(), np.split(flat, ends[:-1]), strict=True)}


CHUNK = 1 << 16


def stored_ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4").astype(np.int64) for x in column.to_pylist()]


def train_round(docs: DataFrame, w: dict[str, np.ndarray], cls: np.ndarray, m: Model) -> dict[str, np.ndarray]:
    """One round over docs (ids): the mean of the tasks' copies, weighted by windows; w as it is if there are none.

    Each id is a target once: windows lie end to end.
    """
    send = docs.sparkSession.sparkContext.broadcast((w, cls))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cls = send.value
        w = {k: v.copy() for k, v in w.items()}
        adam, seen, rng = Adam(w, m.rate), 0, np.random.default_rng(9)
        for batch in batches:
            for at, n in by_bytes(batch.column(0), 512, 2 << 20):
                x, y, use, _ = windows(stored_ids(batch.column(0).slice(at, n)), m, m.window)
                order = rng.permutation(len(x))
                for i in range(0, len(x), m.batch):
                    pick = order[i : i + m.batch]
                    adam.step(backward(w, x[pick], cls[y[pick]], use[pick])[1])
                seen += len(x)
        if seen:
            flat = _flat(w).astype(np.float64) * seen
            parts = [flat[i : i + CHUNK].tobytes() for i in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["chunk", "seen", "part"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p) for p in group["part"])
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "seen": [group["seen"].sum()], "salt": [0], "part": [total.tobytes()]})

    schema = "chunk int, seen bigint, salt int, part binary"
    copies = docs.mapInArrow(run, "chunk int, seen bigint, part binary").withColumn("salt", (F.spark_partition_id() / 64).cast("int"))
    total = copies.groupBy("chunk", "salt").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema)
    rows = sorted(total.collect(), key=lambda r: r.chunk)  # as many as the model has chunks
    send.unpersist()
    return _shaped(np.concatenate([np.frombuffer(r.part) / r.seen for r in rows]), w) if rows else w


#: Bytes of text whose words are held at once; distinct words are dealt into so many buckets.
SLICE, BUCKET_BITS = 8 << 20, 11


def base_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word in order, each text's number of words): A-Z lower-cased, split at \\x20 and \\x09-\\x0D."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = parts.flatten(), parts.value_lengths().to_numpy()
    held = pc.binary_length(words).to_numpy() > 0  # nothing lies before white space that a text begins with
    if not held.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[held], minlength=len(sizes))
        words = words.filter(pa.array(held))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), sizes


def dealt(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words by bucket, the number of each among words, each one's bucket)."""
    if not len(words):
        return words.cast(pa.binary()), np.empty(0, np.int64), np.empty(0, np.int64)
    raw = pa.concat_arrays([words.cast(pa.binary())])
    ends, data = np.frombuffer(raw.buffers()[1], np.int32)[: len(raw) + 1], np.frombuffer(raw.buffers()[2], np.uint8)
    place = (np.arange(ends[-1], dtype=np.int32) - np.repeat(ends[:-1], np.diff(ends))) % 64
    odd = np.random.default_rng(17).integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sums = np.add.reduceat(odd[place] * (data[: ends[-1]] + np.uint64(1)), ends[:-1])
    sums ^= sums >> np.uint64(32)
    bucket = (sums * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return raw.take(pa.array(order)), order, bucket[order]


def word_counts(docs: DataFrame) -> str:
    """Write how often each slice's distinct words occur in the training texts of docs (text, train), by partition; gives the folder.

    Rows: part, slice, bucket, mark of the slice's words, counts of those in the bucket in the order of dealt(); in one row of
    each bucket total and known are the sum of its words' counts and the number of those that have one, else 0.
    """
    folder = new_path(docs.sparkSession, "word_counts")
    fields = {"part": "int", "slice": "int", "bucket": "int", "mark": "bigint", "words": "binary", "sizes": "binary", "n": "binary"}
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, number, rows in slices(batches, SLICE):
            words, codes, sizes = base_words(rows.column(1))
            train = rows.column(0).to_numpy(zero_copy_only=False).astype(float)
            n = np.bincount(codes, np.repeat(train, sizes), len(words)).astype(np.int64)
            raw, order, bucket = dealt(words)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)]).tolist()
            spans, long, n = list(zip(cut, [*cut[1:], len(raw)])), pc.binary_length(raw).to_numpy(), n[order]
            ends, data = np.concatenate([[0], np.cumsum(long)]), b"".join(raw.to_pylist())
            cols = [[part] * len(cut), [number] * len(cut), bucket[cut], [mark(words)] * len(cut), [data[ends[a] : ends[b]] for a, b in spans], *([pack_numbers(x[a:b]) for a, b in spans] for x in (long, n))]
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(cols, fields.values(), strict=True)], names=list(fields))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket."""

        def out(held: list[tuple]) -> pa.RecordBatch:
            *own, words, sizes, n = zip(*held, strict=True)
            n = [numbers(x) for x in n]
            ends = np.concatenate([[0], np.cumsum(np.concatenate([numbers(x) for x in sizes]), dtype=np.int64)])
            all_words = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(words))])
            codes = all_words.dictionary_encode().indices.to_numpy()
            c = np.bincount(codes, np.concatenate(n)).astype(np.int64)
            each = [pack_numbers(x) for x in np.split(c[codes], np.cumsum([len(x) for x in n])[:-1])]
            once = [[x] + [0] * (len(held) - 1) for x in (c.sum(), np.count_nonzero(c))]
            return pa.RecordBatch.from_arrays([*(pa.array(x, types[t]) for x, t in zip(own, fields.values())), pa.array(each, pa.binary()), *(pa.array(x, pa.int64()) for x in once)], names=["part", "slice", "bucket", "mark", "c", "total", "known"])

        held: list[tuple] = []
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][2] != x[2]:
                    yield out(held)
                    held = []
                held.append(x)
        if held:
            yield out(held)

    rows = docs.select("train", "text", F.spark_partition_id()).mapInArrow(deal, ", ".join(map(" ".join, fields.items())))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    rows = rows.mapInArrow(add, "part int, slice int, bucket int, mark bigint, c binary, total bigint, known bigint")
    rows.repartition("part").write.partitionBy("part").parquet(folder, compression="zstd")
    return folder


class WordCounts:
    """The counts of the words of a partition's slices, from the file of word_counts()."""

    def __init__(self, folder: str, part: int):
        self.rows: dict[int, list[tuple]] = {}
        for t in part_files(folder, part):
            for number, *row in zip(*(t[c].to_pylist() for c in ("slice", "bucket", "mark", "c")), strict=True):
                self.rows.setdefault(number, []).append(row)

    def of(self, number: int, words: pa.Array) -> np.ndarray:
        rows = sorted(self.rows.pop(number, ()))
        found = np.concatenate([np.empty(0, np.int64), *(numbers(c) for _, _, c in rows)])
        if len(found) != len(words) or any(m != mark(words) for m in {m for _, m, _ in rows}):
            raise RuntimeError(OTHER_INPUT)
        out = np.empty(len(words))
        out[dealt(words)[1]] = found
        return out


def id_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the column ids, the ids that texts begin with left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            for at, k in by_bytes(batch.column(0)):
                ids = batch.column(0).slice(at, k).to_pylist()
                n += np.bincount(np.frombuffer(b"".join(x[4:] for x in ids), "<u4"), minlength=size)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used])], names=["id", "c"])

    counts = np.zeros(size)
    for r in texts.select("ids").mapInArrow(run, "id int, c bigint").groupBy("id").agg(F.sum("c").alias("c")).collect():  # as many as the vocabulary has ids
        counts[r.id] = r.c
    return counts


def encoded(docs: DataFrame, path: str) -> tuple[DataFrame, int, np.ndarray]:
    """(doc_id, held_out, share, n_tokens, n_known, base_score, ids) of docs, the number of training words, and counts by id."""
    spark, begin, end = docs.sparkSession, model(path).bos, model(path).eos
    folder = word_counts(docs)
    ends = docs.filter("train").count()
    n, v = (x or 0 for x in spark.read.schema("total bigint, known bigint, part int").parquet(folder).agg(F.sum("total"), F.sum("known")).first())
    n, v = n + ends, v + (ends > 0)  # the end of a text counts as a word of its own
    floor = math.log10(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kept = None, Kept(model(path))
        for part, number, rows in slices(batches, SLICE):
            counts = counts or WordCounts(folder, part)
            words, codes, sizes = base_words(rows.column(1))
            c = counts.of(number, words)
            text = np.repeat(np.arange(len(sizes)), sizes)
            known = np.bincount(text, (c > 0)[codes], len(sizes)) + (ends > 0)
            base = np.bincount(text, (np.log10(c + 1) - floor)[codes], len(sizes)) + math.log10(ends + 1) - floor
            del words, codes, text
            s = split(rows.column(1))
            ids, low, high = s.join(*kept.flat(s.words))
            held = pa.array([b"".join([begin, ids[a:b].tobytes(), end]) for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array(sizes + 1, pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), held], names=["doc_id", "held_out", "share", "n_tokens", "n_known", "base_score", "ids"])

    rows = docs.select("doc_id", "text", ~F.col("train"), "share", F.spark_partition_id()).mapInArrow(run, "doc_id bigint, held_out boolean, share int, n_tokens bigint, n_known bigint, base_score double, ids binary")
    texts = materialise(rows, "encoded")
    return texts, n, id_counts(texts.filter("NOT held_out"), model(path).size)


def score(docs: DataFrame, m: Model = Model(), path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents train unless crc32(doc_id) mod 7 is 2; a null doc_id trains. A null or empty text is its end alone. Repeated
    rows count and are scored each. A very long text is cut into as many windows as it takes. An empty table gives an
    empty result; other columns of docs are left out.
    """
    path = path or model_path()
    spark = docs.sparkSession
    crc = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), (~F.coalesce(crc % 7 == 2, F.lit(False))).alias("train"), F.coalesce(F.floor(crc / 7) % m.shares, F.lit(0)).cast("int").alias("share"))
    texts, n, counts = encoded(rows, path)
    cls, within = classes(counts, m.classes)
    w = m.start(len(counts))
    for k in range(m.rounds * m.shares):
        w = train_round(texts.filter(~F.col("held_out") & (F.col("share") == k % m.shares)).select("ids"), w, cls, m)
    send = spark.sparkContext.broadcast((w, cls, within))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cls, within = send.value
        for batch in batches:
            for at, n in by_bytes(batch.column(5), 512, 2 << 20):
                part = batch.slice(at, n)
                x, y, use, text = windows(stored_ids(part.column(5)), m)
                logs, later = np.zeros(n), np.concatenate([[False], text[1:] == text[:-1]])
                for skip, of in ((0, np.flatnonzero(~later)), (m.window - m.stride, np.flatnonzero(later))):  # in later windows the first places are context alone
                    for i in range(0, len(of), m.batch):
                        k = of[i : i + m.batch]
                        one = log_probabilities(w, x[k], cls[y[k]], skip) + within[y[k, skip:]]
                        logs += np.bincount(text[k], (one * use[k, skip:]).sum(1), n)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(logs / math.log(10))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = texts.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids").mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
