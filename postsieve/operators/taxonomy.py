"""Related terms of titles from a taxonomy table: (place, keywords, subchips, similar_fields), the first row that matches wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.functions.banks import TAXONOMY
from postsieve.operators.matching import dictionary_matches

SCHEMA = "place int, keywords array<string>, subchips array<string>, similar_fields array<string>"


def own_taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(TAXONOMY)], SCHEMA)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """A taxonomy kept as JSON lines with the four columns."""
    return spark.read.schema(SCHEMA).json(path)


def related_terms(df: DataFrame, taxonomy: DataFrame, title: str = "title") -> DataFrame:
    """df with subchips and similar_fields (comma-joined, blank where nothing matches) in place of any it has.

    Each keyword is sought once in the distinct titles; neither the taxonomy nor the titles have a bound.
    """
    df = df.drop("subchips", "similar_fields")
    words = taxonomy.select("place", F.explode("keywords").alias("term"), F.array_join("subchips", ", ").alias("subchips"), F.array_join("similar_fields", ", ").alias("similar_fields"))
    hits = dictionary_matches(df.select(F.lower(title).alias("hay")), words.select("term")).join(words, "term")
    first = hits.groupBy("hay").agg(F.min_by(F.struct("subchips", "similar_fields"), "place").alias("_terms"))
    d = df.join(first, F.lower(title) == F.col("hay"), "left")
    return d.select(*df.columns, *[F.coalesce(f"_terms.{c}", F.lit("")).alias(c) for c in ("subchips", "similar_fields")])


def backfill(published: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """published with both columns set anew for rows with a title; other rows are left out."""
    return related_terms(published.filter("trim(title) <> ''"), taxonomy)


def coverage(backfilled: DataFrame) -> DataFrame:
    """One row: titles, those matched, and how many distinct titles aren't."""
    return backfilled.agg(F.count("*").alias("titles"), F.count_if(F.col("subchips") != "").alias("matched"), F.count_distinct(F.when(F.col("subchips") == "", F.col("title"))).alias("unmatched_titles"))
