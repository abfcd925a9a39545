"""Structured Streaming forms of incremental publishing and bounded deduplication."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postsieve.operators.dedup import append_only_new
from postsieve.operators.tables import materialise


def dedup_stream(posts: DataFrame, time: str = "posted_ts", key: str = "url", days: int = 15) -> DataFrame:
    """The first row of each key within the retention; state is dropped as the watermark passes."""
    return posts.withWatermark(time, f"{days} days").dropDuplicatesWithinWatermark([key])


def _read(spark: SparkSession, base: str, path: str, schema: str | None = None) -> DataFrame | None:
    """A Parquet table or a part of it, with the columns of its folders from base on; None if there is no such file."""
    reader = spark.read.option("basePath", base)
    try:
        return (reader.schema(schema) if schema else reader).parquet(path)
    except AnalysisException as e:
        if (e.getCondition() or "").split(".")[0] not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


class KeyIndex:
    """The keys of a published table, by hash buckets and batches, and the list of batches whose keys are complete.

    It lies beside the table (path_keys, path_batches). A lookup opens the buckets of the keys asked for only, and reads keys, never
    rows. A batch is entered last in the list of batches, so that one broken off before is found and its keys are written anew.
    """

    #: Part of the layout: tables written with another number don't fit.
    BUCKETS = 64
    SCHEMA, BATCHES = "key string, bucket int, run string, batch_id bigint", "keys bigint, run string, batch_id bigint"

    def __init__(self, spark: SparkSession, path: str, keys: str):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.folder, self.batches = f"{self.path}_keys", f"{self.path}_batches"

    def _of(self, rows: DataFrame, *keep: str) -> DataFrame:
        key = F.explode(self.keys).alias("key")
        return rows.select(key, *keep).filter("key IS NOT NULL").distinct().withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.BUCKETS)).cast("int"))

    def stored(self, buckets: list[int]) -> DataFrame | None:
        return _read(self.spark, self.folder, f"{self.folder}/bucket={{{','.join(map(str, buckets))}}}", self.SCHEMA) if buckets else None

    def seen(self, batch: DataFrame, run: str, batch_id: int) -> DataFrame:
        """(key): keys of batch that other batches published. What is shuffled or broadcast are keys of the batch, and those found."""
        asked = materialise(self._of(batch), "asked")
        stored = self.stored([r.bucket for r in asked.select("bucket").distinct().collect()])  # at most BUCKETS numbers
        if stored is None:
            return asked.select("key").limit(0)
        return stored.filter((F.col("run") != run) | (F.col("batch_id") != batch_id)).join(asked, ["bucket", "key"], "left_semi").select("key").distinct()

    def add(self, rows: DataFrame) -> None:
        """Write the keys of published rows (with run and batch_id), then enter their batches as complete. Repeating it changes nothing."""
        found = materialise(self._of(rows, "run", "batch_id"), "new_keys")
        write = lambda d, path, *by: d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        write(found.repartition("bucket"), self.folder, "bucket", "run", "batch_id")
        counts = rows.groupBy("run", "batch_id").agg(F.sum(F.size(self.keys)).cast("bigint").alias("keys"))
        write(counts.coalesce(1), self.batches, "run", "batch_id")

    def complete(self) -> None:
        """Add the keys of batches that were broken off, or published before there was an index."""
        table = _read(self.spark, self.path, self.path)
        if table is None:
            return
        known = _read(self.spark, self.batches, self.batches, self.BATCHES)
        named = table.select("run", "batch_id").distinct()
        lost = named if known is None else named.join(known, ["run", "batch_id"], "left_anti")
        lost = materialise(lost, "incomplete")
        if not lost.isEmpty():
            self.add(table.join(lost, ["run", "batch_id"], "left_semi"))


def publish_stream(posts: DataFrame, path: str, checkpoint: str, keys: str = "keys", order: str = "post_id") -> StreamingQuery:
    """Publish the new rows of each micro-batch: keys of earlier batches are anti-joined, then those of the batch.

    A batch overwrites its own partition, named by the checkpoint's query and the batch, so a batch that is delivered again
    changes nothing, and one of a new checkpoint only adds to what older ones published. Published keys are looked up in an
    index (KeyIndex), so a batch reads no published row; the index is completed once when the stream starts.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        index = KeyIndex(spark, path, keys)
        new = append_only_new(batch, keys, order, index.seen(batch, run, batch_id)).withColumn("run", F.lit(run)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch_id").parquet(path)
        written = _read(spark, path, f"{path.rstrip('/')}/run={run}/batch_id={batch_id}")
        if written is not None:
            index.add(written.withColumn("run", F.lit(run)).withColumn("batch_id", F.lit(batch_id).cast("bigint")))

    KeyIndex(posts.sparkSession, path, keys).complete()
    return posts.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
