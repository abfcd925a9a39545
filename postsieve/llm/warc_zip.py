"""WARC archives packaged in ZIP files, written and read in parallel.

A package holds stored (uncompressed) members: archive/data.warc.gz, one gzip member a record, and
indexes/index.cdxj, a line a record with its offset and length in that member. The reader parses the end record,
the ZIP64 records and the central directory, locates both members and range-reads the records; nothing is extracted.
Packages lie in a folder that driver and executors share, under names that no other attempt of a task takes; only
those named by a finished task are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import filesystem, materialise, new_path, sparse_join, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed at this many bytes of records; a read takes up to so many at once.
PACKAGE_BYTES, READ_BYTES = 32 << 20, 4 << 20
DATE = "2024-01-31T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of one gzip member."""
    fields = lambda raw: dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])
    head, rest = zlib.decompress(member, 31).split(b"\r\n\r\n", 1)
    warc = fields(head)
    http, payload = rest[: int(warc["Content-Length"])].split(b"\r\n\r\n", 1)
    return warc, fields(http), payload


def write_package(folder: str, records: list[tuple[str, bytes]]) -> str:
    """Write (record id, gzip member) pairs as one package; gives its path."""
    path = f"{folder}/{uuid.uuid4().hex}.wacz"
    lines, at = [], 0
    for name, member in records:
        lines.append(f"{name} {json.dumps({'offset': at, 'length': len(member)})}")
        at += len(member)
    where, local = filesystem(path)
    where.create_dir(local.rsplit("/", 1)[0])
    with where.open_output_stream(local) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in ((DATA, [m for _, m in records]), (INDEX, ["\n".join(lines).encode()])):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                for x in body:
                    member.write(x)
    return path


class Package:
    """A ZIP file read by ranges."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        self.members = self._directory()

    def read(self, at: int, length: int) -> bytes:
        return self.source.read_at(length, at)

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """Name -> (method, stored size, place of the local header)."""
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end record: not a ZIP file")
        count, size, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
            (at,) = struct.unpack("<Q", tail[end - 12 : end - 4])
            end64 = self.read(at, 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            count, size, start = struct.unpack("<QQQ", end64[32:56])
        raw, at, out = self.read(start, size), 0, {}
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, full, n, m, k, local = struct.unpack("<10xH8xIIHHH8xI", raw[at : at + 46])
            name, extra = raw[at + 46 : at + 46 + n].decode(), raw[at + 46 + n : at + 46 + n + m]
            while len(extra) >= 4:
                kind, length = struct.unpack("<HH", extra[:4])
                if kind == 1:  # holds those of full, packed, local that are all ones, in this order
                    wide = list(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    local = wide.pop(0) if local == 0xFFFFFFFF else local
                extra = extra[4 + length :]
            out[name] = (method, packed, local)
            at += 46 + n + m + k
        return out

    def stored(self, name: str) -> tuple[int, int]:
        """(place of the first byte, length) of a stored member."""
        method, size, local = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed: its records can't be read by range")
        n, m = struct.unpack("<HH", self.read(local + 26, 4))
        return local + 30 + n + m, size

    def index(self) -> list[tuple[str, int, int]]:
        """(record id, place in the file, length) of each record."""
        base, _ = self.stored(DATA)
        rows = (line.split(" ", 1) for line in self.read(*self.stored(INDEX)).decode().splitlines())
        return [(name, base + x["offset"], x["length"]) for name, x in ((n, json.loads(j)) for n, j in rows)]


def _open(path: str):
    where, local = filesystem(path)
    source = where.open_input_file(local)
    return source, source.size()


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as packages; gives the written paths (path, records).

    Of pages of equal payloads of min_bytes or more, those with the largest page_id become responses, the others revisit
    it; rows that repeat the largest page_id are all responses, as are pages whose equals have no page_id. A null html is
    an empty payload.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("bigint"), url.alias("url"), html.alias("html"), F.sha1(html).alias("sha"), F.octet_length(html).alias("bytes"))
    firsts = rows.filter(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = sparse_join(rows, materialise(firsts.select("sha", "first"), "payloads"), "sha").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, done = [], 0, []
        for batch in batches:
            for page, url, payload, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                member = record(page, url, payload, first, first is not None and page != first)
                out.append((f"urn:page:{'' if page is None else page}", member))
                size += len(member)
                if size >= PACKAGE_BYTES:
                    done.append((write_package(folder, out), len(out)))
                    out, size = [], 0
        if out:
            done.append((write_package(folder, out), len(out)))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return materialise(rows.mapInArrow(run, "path string, records bigint"), "packages")


def ranges(packages: DataFrame) -> DataFrame:
    """(path, at, lengths): stretches of neighbouring records, from the packages' indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, size = _open(path)
                with source:
                    found: list[tuple[int, list[int]]] = []
                    for _, at, length in sorted(Package(source, size).index(), key=lambda x: x[1]):
                        if not found or found[-1][0] + sum(found[-1][1]) != at or sum(found[-1][1]) + length > READ_BYTES:
                            found.append((at, []))
                        found[-1][1].append(length)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["path", "at", "lengths"])

    return packages.select("path").mapInArrow(run, "path string, at bigint, lengths array<bigint>")


def read(packages: DataFrame, payload: bool = True) -> DataFrame:
    """The records of packages (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, and html if asked for."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", html string" * payload
    number = lambda urn: int(x) if (x := urn.strip("<>").rpartition(":")[2]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                source, _ = _open(path)
                with source:
                    raw = io.BytesIO(source.read_at(sum(lengths), at))
                rows = []
                for n in lengths:
                    warc, http, body = parse(raw.read(n))
                    kind, named = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http["Content-Length"])
                    if kind == "response" and (len(body) != size or digest(body) != named):
                        raise ValueError(f"{path}: a payload differs from its header")
                    row = (number(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], size, named, kind, number(warc["WARC-Refers-To"]) if kind == "revisit" else None)
                    rows.append(row + (body.decode() if kind == "response" else None,) * payload)
                fields = [c.split() for c in schema.split(", ")]
                types = {"bigint": pa.int64(), "string": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    parts = max(packages.sparkSession.sparkContext.defaultParallelism, 8)
    return ranges(packages).repartition(parts).mapInArrow(run, schema)


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write(table(spark, sf_dir, "pages"), new_path(spark, "archives"))
    return read(packages, payload=False).drop("url")
