"""The reading side: listings, search, facets, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions import extract as x
from postsieve.functions import text as t
from postsieve.functions.dialect import AS_OF, column
from postsieve.operators.matching import dictionary_matches
from postsieve.operators.tables import materialise


def listings_view(published: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Published rows with a title, in the serving shape, freshest first."""
    d = published.filter("trim(title) <> ''").select("*", column(t.tags_split, "tags").alias("tag_list"), F.coalesce(column(t.parse_stipend, "stipend"), F.lit(0).cast("bigint")).alias("rupees"))
    d = d.withColumn("hours_ago", column(t.hours_since, "coalesce(nullif(trim(posted_date), ''), trim(date_added))", as_of).cast("bigint"))
    d = d.select(
        "row_no", column(t.listing_id, "hiring_organization", "title").alias("id"), "title", F.col("hiring_organization").alias("org"), column(x.infer_cluster, "title", "tag_list").alias("cluster"), "location",
        F.expr("coalesce(nullif(trim(type), ''), 'Onsite')").alias("type"), F.expr("coalesce(nullif(trim(timing), ''), 'Full-time')").alias("timing"), F.col("rupees").alias("stipend"), "hours_ago",
        column(t.listing_score, "hours_ago", "rupees").cast("bigint").alias("score"), F.col("tag_list").alias("tags"), F.col("contact_email").alias("contact"), "apply_link", "post_url",
        F.expr("concat(title, ' at ', hiring_organization, '.')").alias("description"),
    )
    return d.orderBy("hours_ago", "row_no")


def _order(sort: str) -> list:
    return {"stipend": [F.desc("stipend")], "score": [F.desc("score")]}.get(sort, [F.asc("hours_ago")]) + [F.col("row_no")]


def haystack(kind: str) -> Column:
    """The text that a search looks in: board, extended or dashboard."""
    more = {"board": [], "extended": [column(x.related_terms, "title", 1), "cluster", "location"], "dashboard": ["location"]}[kind]
    return F.concat_ws(" ", "title", "org", F.array_join("tags", " "), *more)


def _holds(kind: str, query: str) -> Column:
    return F.contains(F.lower(haystack(kind)), F.lit(query.strip().lower()))


def search_board(listings: DataFrame, query: str = "", field: str = "All", location: str = "All", kind: str | None = None, sort: str = "fresh") -> DataFrame:
    d = listings
    for c, v in (("cluster", field), ("location", location), ("type", kind or "All")):
        d = d if v == "All" else d.filter(F.col(c) == v)
    d = d.filter(_holds("board", query)) if query.strip() else d
    return d.orderBy(*_order(sort))


def search_board_extended(listings: DataFrame, query: str = "", cluster: str = "All", city: str = "All", kind: str = "All", fresh24: bool = False, today: bool = False, paid: bool = False, part_time: bool = False, sort: str = "fresh") -> DataFrame:
    """The wider haystack also holds related terms, cluster and location; fresh24 is below 24 hours, today up to 12."""
    d = search_board(listings, "", cluster, city, None if kind == "All" else kind, sort)
    if query.strip():
        d = d.filter(_holds("extended", query))
    for on, c in ((fresh24, "hours_ago < 24"), (today, "hours_ago <= 12"), (paid, "stipend > 0"), (part_time, "timing = 'Part-time'")):
        d = d.filter(c) if on else d
    return d.orderBy(*_order(sort))


def search_dashboard(listings: DataFrame, query: str = "", field: str = "All") -> DataFrame:
    d = listings if field == "All" else listings.filter(F.col("cluster") == field)
    return d.filter(_holds("dashboard", query)) if query.strip() else d


def board_facets(listings: DataFrame, column_name: str, first: list[str] | None = None) -> DataFrame:
    """Distinct values with their place: names in first by their order, others behind by name."""
    place = F.lit(99) if not first else F.coalesce(*[F.when(F.col("value") == v, i) for i, v in enumerate(first)], F.lit(99))
    d = listings.select(F.col(column_name).alias("value")).filter("value <> ''").distinct()
    return d.withColumn("place", F.row_number().over(Window.orderBy(place, "value")).cast("bigint"))


def read_subscribers(df: DataFrame) -> DataFrame:
    """(email, roles, cities) of those who haven't unsubscribed; preferences lower-cased, blanks dropped."""
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda v: F.lower(F.trim(v))), lambda v: v != "")
    return df.filter(~F.coalesce("unsubscribed", F.lit(False))).select("email", split("roles").alias("roles"), split("cities").alias("cities"))


def _first_of(df: DataFrame, by: list[str], order: list, n: int, groups: int = 64) -> DataFrame:
    """The first n rows of each key: of its share in each of some groups of rows first, so that no key is one task's."""
    spread = F.pmod(F.xxhash64(*order), F.lit(groups))
    d = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by, spread).orderBy(*order))).filter(F.col("_n") <= n)
    return d.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def match_subscribers(listings: DataFrame, subscribers: DataFrame, limit: int = 8) -> DataFrame:
    """(email, place, row_no): per subscriber the freshest listings that match roles and cities, else the freshest of all.

    What matches depends on the lower-cased cluster, title and location alone. Each distinct term of the preferences is
    sought once in each of their distinct values (dictionary_matches); the rest are joins on equal values: a set of roles
    keeps the freshest rows of each location, which then meet the locations of its sets of cities.
    """
    by = ["hours_ago", "row_no"]
    prefs = materialise(subscribers.select("roles", "cities").distinct(), "preferences")
    fresh = materialise(listings.select("row_no", "hours_ago", F.lower(F.concat_ws(" ", "cluster", "title")).alias("_role"), F.lower("location").alias("_city")), "fresh")
    heads = materialise(_first_of(fresh, ["_role", "_city"], by, limit), "heads")

    def matched(side: str, hay: str) -> DataFrame:
        terms = prefs.select(side).distinct().select(side, F.explode(side).alias("term"))
        return terms.join(dictionary_matches(heads.select(F.col(hay).alias("hay")), terms), "term").select(side, F.col("hay").alias(hay)).distinct()

    cities = materialise(matched("cities", "_city"), "city_matches")
    by_role = materialise(_first_of(heads.join(matched("roles", "_role"), "_role"), ["roles", "_city"], by, limit), "role_matches")
    asks = lambda side: F.size(side) > 0
    cols = ["roles", "cities", "row_no", "hours_ago"]
    hits = prefs.filter(asks("roles") & ~asks("cities")).join(by_role, "roles").select(*cols)
    hits = hits.unionByName(prefs.filter(asks("roles") & asks("cities")).join(by_role, "roles").join(cities, ["cities", "_city"]).select(*cols))
    by_city = _first_of(heads.join(cities, "_city"), ["cities"], by, limit)
    hits = hits.unionByName(prefs.filter(~asks("roles") & asks("cities")).join(by_city, "cities").select(*cols))
    place = F.row_number().over(Window.partitionBy("roles", "cities").orderBy(*by))
    hits = materialise(hits.withColumn("place", place).filter(F.col("place") <= limit).select("roles", "cities", "row_no", "place"), "hits")
    top = fresh.orderBy(*by).limit(limit)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(*by))).select("row_no", "place")
    none = prefs.join(hits.select("roles", "cities").distinct(), ["roles", "cities"], "left_anti").crossJoin(F.broadcast(top))  # limit rows
    found = hits.unionByName(none.select("roles", "cities", "row_no", "place"))
    return subscribers.join(found, ["roles", "cities"]).select("email", F.col("place").cast("bigint").alias("place"), "row_no")


def digest_rows(listings: DataFrame, matches: DataFrame) -> DataFrame:
    """One row a subscriber: how many, the subject line and the ordered lines."""
    line = F.concat_ws(" | ", "title", "org", "location", column(t.format_stipend, "stipend"), column(t.apply_target, "apply_link", "post_url", "contact"))
    d = matches.join(listings.select("row_no", line.alias("line")), "row_no").groupBy("email").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    lines = F.transform("lines", lambda v: v["line"])
    return d.select("email", F.size("lines").cast("bigint").alias("n"), F.concat(F.size("lines").cast("string"), F.lit(" new internships for you")).alias("subject"), F.array_join(lines, "\n").alias("body"))


#: More heads than this (some 20 a cluster) are not sent to every task.
MAX_HEADS = 100_000


def related_listings(listings: DataFrame, limit: int = 4) -> DataFrame:
    """(row_no, place, other): the first rows of the same cluster with another id, in serving order.

    Only the first rows of a cluster by distinct id can be among them; these are sought in groups of its rows first, and
    each listing then takes its own from its cluster's short list.
    """

    def heads(d: DataFrame, *group) -> DataFrame:
        each = Window.partitionBy("cluster", "id", *group).orderBy("hours_ago", "row_no")
        order = Window.partitionBy("cluster", *group).orderBy("hours_ago", "row_no")
        d = d.withColumn("_n", F.row_number().over(each)).filter(F.col("_n") <= limit)
        d = d.withColumn("_ids", F.sum(F.when(F.col("_n") == 1, 1).otherwise(0)).over(order)).filter(F.col("_ids") <= limit + 1)
        return d.drop("_n", "_ids")

    d = listings.select("row_no", "id", "cluster", "hours_ago")
    first = heads(heads(d, F.pmod(F.xxhash64("row_no"), F.lit(64))))
    first = first.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("hours_ago", "row_no", "id"))).alias("first"))
    first = materialise(first, "heads")
    first = F.broadcast(first) if first.count() <= MAX_HEADS // (limit * (limit + 1)) else first
    others = F.transform(F.slice(F.filter("first", lambda x: x["id"] != F.col("id")), 1, limit), lambda x: x["row_no"])
    d = d.join(first, "cluster").select("row_no", F.posexplode(others).alias("place", "other"))
    return d.select("row_no", (F.col("place") + 1).cast("bigint").alias("place"), "other")


def site_stats(listings: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row; counts of the last run where metrics (run_at, scanned, rejected, added) has one, else of the listings."""
    total = listings.agg(F.count("*").alias("total_active"))
    last = metrics.agg(F.max_by(F.struct("added", "rejected", "scanned", "run_at"), "run_at").alias("m"))
    d = total.crossJoin(last)  # of one row each
    return d.select(F.coalesce("m.added", "total_active").alias("verified_today"), "total_active", F.coalesce("m.rejected", F.lit(0)).cast("bigint").alias("spiked_today"), F.coalesce("m.scanned", F.lit(0)).cast("bigint").alias("scanned_today"), F.col("total_active").alias("eligible"), F.coalesce("m.run_at", F.lit("")).alias("last_run"))


def dashboard_tiles(listings: DataFrame, filtered: DataFrame) -> DataFrame:
    n = lambda d, c, name: d.agg(F.count_distinct(F.when(F.col(c) != "", F.col(c))).alias(name))
    return n(filtered, "org", "companies").crossJoin(n(listings, "cluster", "fields"))


def edition_summary(listings: DataFrame, top: int = 6) -> DataFrame:
    """One row of the best by score: how many, their rounded mean stipend with none as 0, and the best id."""
    d = listings.orderBy(F.desc("score"), "row_no").limit(top)
    return d.agg(F.count("*").alias("n"), F.floor(F.avg(F.coalesce("stipend", F.lit(0))) + 0.5).cast("bigint").alias("mean_stipend"), F.max("score").alias("best"))
