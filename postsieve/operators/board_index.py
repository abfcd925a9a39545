"""A stored trigram index over the text that board searches look in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.operators.matching import _grams
from postsieve.operators.serve import haystack, listings_view
from postsieve.operators.tables import materialise

GRAM = 3
#: What the text of a listing is made of.
TEXT = ("title", "hiring_organization", "tags", "location")
#: More texts than this are not sent to every task.
MAX_TEXTS = 200_000


class BoardIndex:
    """Published rows, and postings (gram, text, row_no) of what a kind of search looks in (serve.haystack), under a path.

    Rows of equal title, organisation, tags and location have one text, a hash of these, so that a text is cut into grams once
    for all its rows; row_no is the first of them in that add(). Texts of one hash count as one text: a search meets more rows,
    none less. Rows lie in shares by the hash of their text, postings in buckets by the hash of the gram and sorted in their
    files, so that a search reads the buckets and row groups of its grams, and then the shares of the texts that have all of
    them. The text of a listing doesn't depend on the time of the search, so the serving columns are computed at that time, from
    the rows found.

    add() indexes rows of a new row_no; one that is there stays as it was, and rows without a row_no are left out. Postings are
    written before rows: what an add() that was broken off left behind names no row, or is written again and counts once.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "board", buckets: int = 64, shares: int = 64):
        self.spark, self.path, self.kind, self.buckets, self.shares = spark, path.rstrip("/"), kind, buckets, shares

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/{name}")

    def add(self, published: DataFrame) -> None:
        """Index the rows of published that are not there yet; the work is that of the new rows, but for a look at the known row numbers."""
        text = F.xxhash64(*TEXT)
        new = published.filter("row_no IS NOT NULL").withColumn("text", text).withColumn("share", self._share(F.col("text")))
        if self.holds_rows():
            new = new.join(self._read("rows").select("row_no"), "row_no", "left_anti")
        # A text that many rows have is spread over the tasks of its share.
        new = new.withColumn("_spread", F.pmod(F.xxhash64("row_no"), F.lit(8))).repartition("share", "_spread").sortWithinPartitions("share", "text", "row_no").drop("_spread")
        new = materialise(new, "new_rows")
        texts = materialise(new.groupBy(*TEXT).agg(F.min("row_no").alias("row_no")), "new_texts")
        blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in (*TEXT, "row_no") else F.col(f.name) for f in published.schema]
        # Written, as the text would be made again for each of its grams.
        hays = materialise(listings_view(texts.select(*blank)).select("row_no", F.lower(haystack(self.kind)).alias("hay")), "hays")
        postings = hays.join(texts.select("row_no", text.alias("text")), "row_no").select("row_no", "text", F.explode(F.array_distinct(_grams(F.col("hay"), GRAM))).alias("gram"))
        postings = postings.withColumn("bucket", self._bucket(F.col("gram"))).withColumn("_spread", F.pmod(F.col("text"), F.lit(8)))
        # A gram that most texts have is spread over the tasks of its bucket.
        postings = postings.repartition("bucket", "_spread").sortWithinPartitions("bucket", "gram", "text").drop("_spread")
        postings.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        new.write.mode("append").partitionBy("share").parquet(f"{self.path}/rows")

    def _share(self, text: Column) -> Column:
        return F.pmod(text, F.lit(self.shares)).cast("int")

    def holds_rows(self) -> bool:
        from pyspark.errors import AnalysisException

        try:
            return not self._read("rows").isEmpty()
        except AnalysisException as e:
            if (e.getCondition() or "").split(".")[0] not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return False

    def candidates(self, query: str) -> DataFrame | None:
        """(text, share) of the texts that hold all grams of the query, which need not follow each other; None if it is too short for one."""
        q = query.strip().lower()
        grams = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
        if not grams:
            return None
        found = self._read("postings", "text bigint, gram string, bucket int").filter(F.col("bucket").isin(*[self._bucket(F.lit(g)) for g in grams]) & F.col("gram").isin(grams))
        met = found.groupBy("text").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams))
        return met.select("text", self._share(F.col("text")).alias("share"))

    def rows(self, query: str = "") -> DataFrame:
        """Published rows among which all hits of the query are, by the index; all rows for a query of fewer than three characters.

        The searches of serve, on listings_view() of these, verify the hits and give the rows that they give on the whole table.
        """
        found, rows = self.candidates(query), self._read("rows")
        if found is not None:
            found = materialise(found, "texts_found")
            rows = rows.join(F.broadcast(found) if found.count() <= MAX_TEXTS else found, ["text", "share"], "left_semi")
        return rows.drop("text", "share")
