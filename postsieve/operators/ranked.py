"""Publishing that a repeated run doesn't change: rows of each run, ranks of all rows, both committed by a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.operators.rank import rank_continue
from postsieve.operators.tables import materialise


def publish_key(url: str = "post_url", company: str = "hiring_organization", title: str = "title") -> Column:
    """The URL, or where it is missing a hash of company and title."""
    named = F.md5(F.concat_ws("\n", *[F.coalesce(F.trim(F.col(c)), F.lit("")) for c in (company, title)]))
    return F.coalesce(F.concat(F.lit("u:"), F.nullif(F.trim(F.col(url)), F.lit(""))), F.concat(F.lit("h:"), named))


class RankedTable:
    """A published table under a path: rows are appended once by key, and each run ranks all rows by their score at that time.

    rows/version=N has the new rows of a run, ranks/version=N (key, added, score, rank) of all rows, manifests/version=N the run
    that made them. The manifest is written last: without it a version doesn't exist, and the next run writes over what is left
    of it. Only ranks, a few numbers a row, are written anew by every run. One publisher at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: Column | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), publish_key() if key is None else key
        spark.createDataFrame([("",)], "run string").coalesce(1).write.mode("ignore").parquet(f"{self.path}/manifests/version=0")

    def _ranks(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ranks/version={version}")

    def runs(self) -> dict[str, int]:
        """The version that each run made; a row a run."""
        return {r.run: r.version for r in self.spark.read.schema("run string, version int").parquet(f"{self.path}/manifests").collect()}

    def publish(self, new: DataFrame, run: str, score: Column, order: list[str]) -> int:
        """Append the rows of new whose key isn't published, the first of each key by order, and rank all rows; gives the version.

        Rank 1 is the highest score, ties go by order. A run that is committed changes nothing, and neither does an empty new.
        """
        runs = self.runs()
        last = max(runs.values())
        if run in runs or new.isEmpty():
            return runs.get(run, last)
        version, columns = last + 1, new.columns
        # Partial minima before the shuffle, so that no key is one task's.
        fresh = new.withColumn("_key", self.key).groupBy("_key").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")).select("_key", "_row.*")
        fresh = fresh.join(self._ranks(last).select("_key"), "_key", "left_anti") if last else fresh
        fresh.write.mode("overwrite").parquet(f"{self.path}/rows/version={version}")
        rows = self.spark.read.schema(fresh.schema).parquet(f"{self.path}/rows/version={version}").withColumn("_added", F.lit(version))
        if last:
            rows = rows.unionByName(self._rows(last), allowMissingColumns=True)
        scored = materialise(rows.select("_key", "_added", score.alias("_score"), *order), "scored")
        ranked = rank_continue(scored, [F.desc_nulls_last("_score"), *order], 0)
        ranked.select("_key", "_added", "_score", "rank").write.mode("overwrite").parquet(f"{self.path}/ranks/version={version}")
        self.spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/version={version}")
        return version

    def _rows(self, version: int) -> DataFrame:
        """Rows of the versions that have a manifest, columns by name; what a run that was broken off left isn't looked at."""
        paths = [f"{self.path}/rows/version={v}" for v in range(1, version + 1)]
        rows = self.spark.read.option("basePath", f"{self.path}/rows").option("mergeSchema", True).parquet(*paths)
        return rows.withColumnRenamed("version", "_added")

    def read(self) -> DataFrame:
        """The published rows with score and rank as the last run left them; no run yet is an error."""
        last = max(self.runs().values())
        if not last:
            raise ValueError(f"nothing is published in {self.path}")
        ranks = self._ranks(last).withColumnsRenamed({"_score": "ranked_score"})
        return self._rows(last).join(ranks, ["_key", "_added"]).drop("_key", "_added")
