"""Deduplication by keys, where the order of rows matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.operators.matching import near_titles
from postsieve.operators.selection import ordered_selection
from postsieve.operators.tables import materialise


def dedup_first(df: DataFrame, key: str | Column, order: list) -> DataFrame:
    """The first row of each key in the given order, which ends in a unique column; null and blank keys go."""
    d = df.withColumn("_key", F.col(key) if isinstance(key, str) else key).filter("_key IS NOT NULL AND _key <> ''")
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).filter("_n = 1").drop("_key", "_n")


def anti_seen(df: DataFrame, key: str | Column, seen: DataFrame) -> DataFrame:
    """Rows whose key isn't among seen (key); rows without a key stay."""
    d = df.withColumn("_key", F.col(key) if isinstance(key, str) else key)
    return d.join(seen.select(F.col("key").alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def dedup_author(df: DataFrame, author: str, order: list, exempt: tuple[str, ...] = ("", "Unknown")) -> DataFrame:
    """The first row of each author; rows of an exempt name all stay."""
    free = F.coalesce(F.col(author).isin(*exempt), F.lit(True))
    n = F.row_number().over(Window.partitionBy(author).orderBy(*order))
    return df.filter(free).unionByName(df.filter(~free).withColumn("_n", n).filter("_n = 1").drop("_n"))


def ordered_multi_key_dedup(df: DataFrame, keys: str, order: str, seen: DataFrame | None = None) -> DataFrame:
    """Rows in order are kept unless one of their keys (array) belongs to a row kept before; rejected rows add no keys.

    order must be unique. A parallel greedy independent set: in each round the undecided rows that come first on all
    their keys are kept and those that share a key with them rejected, which gives the sequential answer. seen (key)
    rejects at once. Null keys count as none, and rows without keys are all kept. Each round is a few shuffles of the (key, order) pairs still open and
    decides one row of each chain of dependent rows at least, so the rounds end; in usual data they are few.
    """
    spark = df.sparkSession
    edges = df.select(F.col(order).alias("_o"), F.explode(F.array_distinct(F.array_compact(F.col(keys)))).alias("_k"))
    lost = None
    if seen is not None:
        hit = edges.join(seen.select(F.col("key").alias("_k")).distinct(), "_k", "left_semi").select("_o").distinct()
        lost = materialise(hit, "rejected")
        edges = edges.join(lost, "_o", "left_anti")
    edges = materialise(edges, "edges")
    kept = spark.createDataFrame([], df.select(F.col(order).alias("_o")).schema)
    while not edges.isEmpty():
        first = edges.groupBy("_k").agg(F.min("_o").alias("_m"))
        now = edges.join(first, "_k").groupBy("_o").agg(F.bool_and(F.col("_o") == F.col("_m")).alias("_first")).filter("_first").select("_o")
        now = materialise(now, "kept")
        taken = edges.join(now, "_o", "left_semi").select("_k").distinct()
        out = edges.join(taken, "_k", "left_semi").select("_o").distinct()
        edges = materialise(edges.join(materialise(out, "decided"), "_o", "left_anti"), "edges")
        kept = kept.unionByName(now)
    alone = df.filter(F.coalesce(F.size(F.array_compact(F.col(keys))), F.lit(0)) <= 0).select(F.col(order).alias("_o"))
    return df.join(kept.unionByName(alone).withColumnRenamed("_o", order), order, "left_semi")


def dedup_cross_query(df: DataFrame, query: str, url: str, text_key: str, order: list) -> DataFrame:
    """Within a query the first row of each URL; URLs and texts of kept rows block later queries.

    Rows without a URL are blocked by all texts kept so far, those of their own query included; rows without either are
    kept. Queries go in their order, a null one first; all are worked on at once (ordered_selection).
    """
    at = [(F.col(c) if isinstance(c, str) else c).alias(f"c{k}") for k, c in enumerate(order)]
    place = lambda inside: F.struct(F.col(query).alias("q"), F.lit(inside).alias("inside"), *at)
    d = materialise(df.withColumn("_o", place(1)).withColumn("_begin", place(0)), "posts")
    key = lambda kind, c: F.concat(F.lit(kind), F.nullif(F.col(c), F.lit("")))
    u, t = key("u:", url), key("t:", text_key)
    check = lambda token, bound: F.when(token.isNotNull(), F.struct(token.alias("token"), bound.alias("bound")))
    marks = d.select(F.col("_o").alias("o"), F.explode(F.array_compact(F.array(u, t))).alias("token"))
    own = check(t, F.when(u.isNull(), F.col("_o")).otherwise(F.col("_begin")))
    checks = d.select(F.col("_o").alias("o"), F.explode(F.array_compact(F.array(check(u, F.col("_o")), own))).alias("c")).select("o", "c.token", "c.bound")
    taken = ordered_selection(d.select(F.col("_o").alias("o")), marks, checks)
    return d.join(taken.withColumnRenamed("o", "_o"), "_o", "left_semi").select(*df.columns)


def fuzzy_title_dedup(df: DataFrame, title: str, order: str, ratio: float = 0.85, exempt: tuple[str, ...] = ("", "internship")) -> DataFrame:
    """Rows in order are kept unless their title is near that of a row kept before; exempt titles are all kept.

    An exempt title that isn't blank still counts for the titles behind it. Equal titles go first, so that near ones are
    sought among distinct titles only (near_titles, loss-free).
    """
    free = F.coalesce(F.col(title).isin(*exempt), F.lit(True))
    rest = dedup_first(df.filter(~free), title, [order]).select(F.col(order).alias("o"), F.col(title).alias("token"), F.lit(True).alias("checked"))
    known = df.filter(free & (F.col(title) != "")).groupBy(F.col(title).alias("token")).agg(F.min(order).alias("o"), F.lit(False).alias("checked"))
    rows = materialise(rest.unionByName(known), "titles")
    near = near_titles(rows.select(F.col("token").alias("title")), ratio)
    checks = rows.filter("checked").select("o", F.col("token").alias("new")).join(near, "new").select("o", F.col("kept").alias("token"), F.col("o").alias("bound"))
    taken = ordered_selection(rows.select("o"), rows.select("o", "token"), checks)
    return df.filter(free).unionByName(df.filter(~free).join(taken.withColumnRenamed("o", order), order, "left_semi").select(*df.columns))


def append_only_new(candidates: DataFrame, keys: str, order: str, published_keys: DataFrame) -> DataFrame:
    """Candidates none of whose keys is published, deduplicated in order among themselves."""
    return ordered_multi_key_dedup(candidates, keys, order, seen=published_keys)


def union_sources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
