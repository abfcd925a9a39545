"""Scores, quotas, counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions.banks import SOURCE_POINTS
from postsieve.functions.dialect import AS_OF, SPARK
from postsieve.operators.matching import near_titles
from postsieve.operators.selection import ordered_selection
from postsieve.operators.tables import materialise


def source_distribution(df: DataFrame, by: str = "source") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def per_query_cap(df: DataFrame, query: str, order: list, target: int, queries: int) -> DataFrame:
    """At most 3 (target // queries + 1) rows a query, in order."""
    cap = 3 * (target // queries + 1)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")


def run_funnel(scanned: DataFrame, verified: DataFrame, added: DataFrame) -> DataFrame:
    """One row: scanned, verified, rejected (not below 0), added."""
    n = lambda d, name: d.agg(F.count("*").alias(name))
    d = n(scanned, "scanned").crossJoin(n(verified, "verified")).crossJoin(n(added, "added"))  # of one row each
    return d.withColumn("rejected", F.greatest(F.lit(0), F.col("scanned") - F.col("verified")).cast("bigint")).select("scanned", "verified", "rejected", "added")


def quota_select(df: DataFrame, sources: list[tuple[str, int]], target: int, keys: str = "keys", order: str = "pos", title: str | None = None, ratio: float = 0.85, exempt: str = "internship") -> DataFrame:
    """Per source, in the given order and by score, rows that are new, up to the quota; then the best of the rest up to target.

    sources: (name, quota); rows of others take no part. A row is new unless a row selected before has one of its keys.
    Rows without keys are compared by title, if one is named: a title whose ratio against that of such a row selected
    before is above ratio isn't new; the exempt title always is. Sorted by score, ties as selected, trimmed to target.
    order is unique.

    Rows are tied by the keys they share and by near titles; all sources are decided at once, in rounds (ordered_selection).
    """
    place = F.coalesce(*[F.when(F.col("source") == name, F.lit(k)) for k, (name, _) in enumerate(sources)])
    items = df.withColumn("_place", place).filter("_place IS NOT NULL")
    items = items.withColumn("_by_source", F.struct("_place", (-F.col("score")).alias("by_score"), F.col(order).alias("at")))
    items = items.withColumn("_by_score", F.struct((-F.col("score")).alias("by_score"), "_place", F.col(order).alias("at")))
    bare = F.coalesce(F.size(keys), F.lit(0)) <= 0
    items = materialise(items.withColumn("_title", F.when(bare & (F.col(title) != ""), F.col(title)) if title else F.lit(None).cast("string")), "items")
    titles = items.select(F.col("_title").alias("title")).filter("title IS NOT NULL").distinct()
    blocks = titles.select(F.col("title").alias("kept"), F.col("title").alias("new"))
    if title:
        blocks = materialise(blocks.unionByName(near_titles(titles, ratio)), "near_titles")

    def marks(d: DataFrame, o: str) -> DataFrame:
        own = d.select(F.col(o).alias("o"), F.explode(keys).alias("key")).select("o", F.concat(F.lit("k:"), "key").alias("token"))
        return own.unionByName(d.filter("_title IS NOT NULL").select(F.col(o).alias("o"), F.concat(F.lit("t:"), "_title").alias("token")))

    def checks(d: DataFrame, o: str) -> DataFrame:
        own = d.select(F.col(o).alias("o"), F.explode(keys).alias("key")).select("o", F.concat(F.lit("k:"), "key").alias("token"))
        near = d.filter(F.col("_title") != exempt).select(F.col(o).alias("o"), F.col("_title").alias("new")).join(blocks, "new")
        return own.unionByName(near.select("o", F.concat(F.lit("t:"), "kept").alias("token"))).withColumn("bound", F.col("o"))

    rows = items.select(F.col("_by_source").alias("o"), "source")
    taken = ordered_selection(rows, marks(items, "_by_source"), checks(items, "_by_source"), dict(sources))
    chosen = materialise(items.join(taken.withColumnRenamed("o", "_by_source"), "_by_source", "left_semi"), "chosen")
    need = target - chosen.count()
    out = chosen.withColumn("_round", F.lit(0))
    if need > 0:
        seen = marks(chosen, "_by_source").select("token").distinct()
        old = checks(items, "_by_source").join(seen, "token", "left_semi").select(F.col("o").alias("_by_source")).unionByName(chosen.select("_by_source"))
        pool = materialise(items.join(old.distinct(), "_by_source", "left_anti"), "pool")
        more = ordered_selection(pool.select(F.col("_by_score").alias("o"), F.lit("pool").alias("source")), marks(pool, "_by_score"), checks(pool, "_by_score"), {"pool": need})
        out = out.unionByName(pool.join(more.withColumnRenamed("o", "_by_score"), "_by_score", "left_semi").withColumn("_round", F.lit(1)))
    return out.orderBy(F.desc("score"), "_round", "_place", order).limit(target).select(*df.columns)


def evaluate_classifier(df: DataFrame, kept: str, expected: str, at_least: float = 0.85) -> DataFrame:
    """One row: tp, fp, tn, fn, precision, recall, f1, accuracy (0 on an empty denominator), passed."""
    k, e = F.col(kept), F.col(expected)
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in (("tp", k & e), ("fp", k & ~e), ("tn", ~k & ~e), ("fn", ~k & e))])
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    d = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn))
    return d.withColumn("passed", (F.col("precision") >= at_least) & (F.col("recall") >= at_least))


def reason_histogram(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason)


def misclassified(df: DataFrame, kept: str, expected: str, text: str = "text") -> DataFrame:
    """False positives and negatives with a clipped text."""
    kind = F.when(F.col(kept), "false positive").otherwise("false negative")
    return df.filter(F.col(kept) != F.col(expected)).select("*", kind.alias("kind"), F.substring(text, 1, 70).alias("clip"))


def rank_continue(df: DataFrame, order: list, existing: int) -> DataFrame:
    """rank: existing rows plus the place of the row in the input; filters that follow leave gaps.

    Rows are dealt into ranges of the order and numbered in each, from where the ranges before it end.
    """
    d = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    ends = d.groupBy("_part").agg(F.count("*").alias("_n"))
    ends = ends.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row a range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return d.withColumn("_place", place).join(F.broadcast(ends), "_part").withColumn("rank", (F.col("_before") + F.col("_place") + existing).cast("bigint")).drop("_part", "_place", "_before")


def topup_plan(published: DataFrame, target: int = 105, spare: int = 15, attempt: int = 1, attempts: int = 3) -> DataFrame:
    """One row: published, deficit, and the next attempt's target (deficit + spare), 0 if there is none."""
    d = published.agg(F.count("*").alias("published")).withColumn("deficit", F.greatest(F.lit(0), target - F.col("published")).cast("bigint"))
    return d.withColumn("next_target", F.when((F.col("deficit") > 0) & (F.lit(attempt) < attempts), F.col("deficit") + spare).otherwise(0).cast("bigint"))


def score_100(df: DataFrame, source: str, age: str, applicants: str, engagement: str) -> DataFrame:
    """The documented 100-point score with its parts: source 30, freshness 25, competition 25, engagement 20.

    Competition counts for job rows, engagement (signals, 0 to 3) for post rows only; an unknown source or age has no points.
    """
    tiers = lambda _, *steps: F.coalesce(*[F.when(t, F.lit(p)) for t, p in steps], F.lit(0)).cast("bigint")
    age, applicants, engagement = F.col(age), F.col(applicants), F.col(engagement)
    is_source = lambda name: F.coalesce(F.col(source) == name, F.lit(False))
    competition = tiers(applicants, (applicants < 50, 25), (applicants <= 100, 20), (applicants <= 200, 15), (applicants <= 300, 10), (applicants > 300, 5))
    signals = tiers(engagement, (engagement >= 3, 20), (engagement == 2, 15), (engagement == 1, 10), (engagement <= 0, 5))
    parts = F.struct(
        tiers(None, *[(F.col(source) == n, p) for n, p in SOURCE_POINTS.items()]).alias("source"),
        tiers(age, (age < 6, 25), (age < 12, 20), (age < 24, 15), (age <= 48, 10), (age > 48, 5)).alias("freshness"),
        F.when(is_source("LinkedIn Jobs"), competition).otherwise(0).alias("competition"),
        F.when(is_source("LinkedIn Posts"), signals).otherwise(0).alias("engagement"),
    )
    d = df.withColumn("breakdown", parts)
    return d.withColumn("score_100", F.col("breakdown.source") + F.col("breakdown.freshness") + F.col("breakdown.competition") + F.col("breakdown.engagement"))


def yield_alerts(runs: DataFrame, low: int = 5, runs_down: int = 3) -> DataFrame:
    """Per (source, run): an alert for no rows, few rows, more than 80 % duplicates, or the third failed run in a row."""
    w = Window.partitionBy("source").orderBy("run")
    group = F.sum(F.when(F.col("yielded") > 0, 1).otherwise(0)).over(w)
    d = runs.withColumn("_g", group)
    streak = F.sum(F.when(F.col("yielded") == 0, 1).otherwise(0)).over(Window.partitionBy("source", "_g").orderBy("run"))
    d = d.withColumn("failed_in_row", streak.cast("bigint"))
    alert = F.when(F.col("failed_in_row") >= runs_down, "source down").when(F.col("yielded") == 0, "no rows").when(F.col("yielded") < low, "few rows").when(F.col("removed") * 100 > F.col("yielded") * 80, "mostly duplicates").otherwise("ok")
    return d.withColumn("alert", alert).drop("_g")


def take_until_target(df: DataFrame, order: list, target: int) -> DataFrame:
    return df.orderBy(*order).limit(target)


def prune_stale(df: DataFrame, added: str = "date_added", days: int = 15, as_of: str = AS_OF) -> DataFrame:
    """Drop rows added more than days before as_of by their date part; blank and unreadable dates stay."""
    day = F.try_to_timestamp(F.substring(added, 1, 10), F.lit("yyyy-M-d"))
    return df.filter(F.coalesce(day >= F.expr(f"{as_of} - INTERVAL {days} DAYS"), F.lit(True)))


def expire_listings(df: DataFrame, days: int = 4, as_of: str = AS_OF) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by the last column named after "posted", else "added"; only readable older dates go."""
    from postsieve.functions.text import parse_listing_date

    named = lambda part: [c for c in df.columns if part in c.lower()]
    dates = named("posted") or named("added")
    if not dates:
        return df, df.limit(0)
    old = F.coalesce(F.expr(parse_listing_date(SPARK, dates[-1], as_of)) < F.expr(f"{as_of} - INTERVAL {days} DAYS"), F.lit(False))
    return df.filter(~old), df.filter(old)
