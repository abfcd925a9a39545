"""What the corpus operators share: tables, shared-folder materialisation, text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: \x20 and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: A side of a join may be broadcast up to this many rows, in files of so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, with a local master, an own one where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        where = _own_dir[0]
    return where.rstrip("/")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path of the shared folder, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table in the shared folder and read it back; cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """In here a write's shuffle files are deleted when it ends; else they stay until the driver's garbage happens to be collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        where, local = filesystem(folder)
        where.delete_dir(local)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised table with a broadcast hint if its counted rows and the bytes of its files are within bounds, else without."""
    if df.count() > rows:
        return df
    size = 0
    for f in df.inputFiles():
        where, local = filesystem(f)
        size += where.get_file_info(unquote(local)).size or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


#: A filter of keys has at most so many bits, 128 MB.
MOST_FILTER_BITS = 1 << 30
_BITMAP = 8 * 4096  # bits of one of Spark's bitmaps


def sparse_join(df: DataFrame, few: DataFrame, on: str, how: str = "left") -> DataFrame:
    """df joined with a materialised table few on their column on; how is left, left_semi or left_anti, and nulls meet nulls.

    For long rows of which few have a partner: only rows that pass a filter of the hashed keys are shuffled, the others stay
    where they are. The filter is a set of bitmaps sent to all tasks: 16 bits a key or more, up to MOST_FILTER_BITS, so up to
    6 % of the others pass as well; with more keys more of them do, and the result is the same. df is read twice.
    """
    bits, name = 1 << min(MOST_FILTER_BITS.bit_length() - 1, max(_BITMAP.bit_length() - 1, (16 * few.count()).bit_length())), uuid.uuid4().hex
    part, held, key = f"_p{name}", f"_b{name}", f"_k{name}"
    hashed = F.pmod(F.xxhash64(F.col(on)), F.lit(bits))
    sent = few.select(F.shiftright(hashed, 15).alias(part), F.pmod(hashed, F.lit(_BITMAP)).alias(held)).repartition(part).groupBy(part).agg(F.bitmap_construct_agg(F.col(held)).alias(held))
    at = F.pmod(hashed, F.lit(_BITMAP))
    byte = F.conv(F.hex(F.substring(F.col(held), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    passes = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")), F.lit(0)) == 1
    seen = df.join(F.broadcast(sent), F.shiftright(hashed, 15) == F.col(part), "left")
    rest = seen.filter(~passes).select(*df.columns)
    met = seen.filter(passes).select(*df.columns).join(few.withColumnRenamed(on, key), F.col(on).eqNullSafe(F.col(key)), how).drop(key)
    if how == "left_semi":
        return met
    return met.unionByName(rest if how == "left_anti" else rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema if f.name != on]))


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's values; null differs from blank, and a value from its neighbour's."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws(";", *map(part, columns))))


def carried(docs: DataFrame, own: list[str], made: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(rows, back): rows have the columns named own, and all others in one column of a name that can't clash.

    back(d, *new) gives the columns of docs from d in their order, but for those named as made (in either case), and new ones.
    """
    box, stay = f"_{uuid.uuid4().hex}", [c for c in docs.columns if c.lower() not in made]
    rest = [c for c in stay if c not in own]
    rows = docs.select(*own, *[F.struct(*[F.col(f"`{c}`") for c in rest]).alias(box)] * bool(rest))
    return rows, lambda d, *new: d.select(*[F.col(box).getField(c).alias(c) if c in rest else F.col(c) for c in stay], *new)


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words_by(text: Column, separators: str) -> Column:
    """The runs between separators, a regex of one or more characters to split at."""
    return F.array_remove(F.split(text, separators, -1), "")


def space_words(text: Column) -> Column:
    return words_by(text, SPACE_CLASS + "+")
