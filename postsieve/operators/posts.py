"""Jobs over posts: structuring, joining analyses, roles, and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.functions import extract as x
from postsieve.functions import text as t
from postsieve.functions.banks import INTERN_TITLES
from postsieve.functions.dialect import AS_OF, column
from postsieve.operators.dedup import append_only_new
from postsieve.operators.rank import prune_stale
from postsieve.operators.tables import materialise

#: Names that stand for an unknown company.
UNKNOWN = ("Unknown", "N/A", "Confidential", "Company", "Stealth", "null")


def structure_posts(posts: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Posts with all that is read from their texts, best first: fresh ones, then by engagement, then in order."""
    d = posts.select(
        "*", column(x.extract_role, "text").alias("role"), column(x.extract_locations, "text").alias("places"), column(x.extract_emails, "text").alias("emails"), column(x.extract_apply_link, "text").alias("link"),
        column(x.company_from_headline, "company", "author_headline", "author_name").alias("org"), column(x.work_type, "text").alias("work_type"), column(x.hiring_signals, "text").alias("signals"),
        column(t.truncate_text, "text").alias("short"), column(x.engagement_score, "likes", "comments", "reposts").cast("bigint").alias("engagement"), column(t.age_hours, "posted_time", as_of=as_of).alias("age"),
    )
    d = materialise(d.withColumn("bonus", column(x.freshness_bonus, "age").cast("bigint")), "structured")  # read once, as sorting samples it first
    return d.orderBy(F.desc("bonus"), F.desc("engagement"), "post_id")


def join_analysis(posts: DataFrame, analysis: DataFrame) -> DataFrame:
    """Posts with a model's output (post_id, ..., should_include), without those it excludes; a missing verdict includes."""
    return posts.join(analysis, "post_id", "left").filter(F.coalesce("should_include", F.lit(True))).drop("should_include")


def explode_roles(df: DataFrame, roles: str = "roles") -> DataFrame:
    """A row a role that isn't blank, with its place; Internship where there is none."""
    clean = F.filter(F.transform(F.coalesce(F.col(roles), F.array().cast("array<string>")), lambda r: F.trim(r)), lambda r: r != "")
    clean = F.when(F.size(clean) > 0, clean).otherwise(F.array(F.lit("Internship")))
    d = df.select(*[c for c in df.columns if c != roles], F.posexplode(clean).alias("place", "role"))
    return d.withColumn("place", F.col("place").cast("bigint"))


def strong_posts(df: DataFrame, company: str, roles: str, contact: str, text: str = "text", least: int = 3) -> DataFrame:
    """df with strength, without rows under the least."""
    return df.withColumn("strength", column(x.hiring_strength, company, roles, contact, text).cast("bigint")).filter(F.col("strength") >= least)


def filter_intern_titles(df: DataFrame, words=INTERN_TITLES) -> DataFrame:
    """Rows with an internship's title; what was their source becomes ats."""
    d = df.filter(column(x.intern_title, "title", words))
    return d.withColumn("ats", F.coalesce("source", F.lit("Unknown"))).withColumn("source", F.lit("company_career"))


def drop_unknown_company(df: DataFrame, company: str = "company") -> DataFrame:
    return df.filter(~F.coalesce(F.trim(company), F.lit("")).isin("", *UNKNOWN))


def require_fields(df: DataFrame, *fields: str) -> DataFrame:
    d = df
    for f in fields:
        d = d.filter(F.coalesce(F.trim(f), F.lit("")) != "")
    return d


def official_domain(df: DataFrame, url: str = "url", domains: tuple[str, ...] = ("gov.in", "nic.in")) -> DataFrame:
    """df with host, where that is one of the domains or lies under one."""
    d = df.withColumn("host", F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))))
    return d.filter(F.exists(F.array(*[F.lit(x) for x in domains]), lambda x: (F.col("host") == x) | F.endswith(F.col("host"), F.concat(F.lit("."), x))))


def quality_gate(df: DataFrame, signals: str, age: str, status: str | None = None, kind: str | None = None, least: int = 2, hours: int = 48) -> DataFrame:
    """Rows of enough signals (comma-joined) and a known age in bounds; closed ones and other types go where columns name them."""
    d = df.filter((F.size(F.split(F.nullif(signals, F.lit("")), ",")) >= least) & (F.col(age) <= hours))
    d = d.filter(F.lower(F.coalesce(status, F.lit(""))) != "closed") if status else d
    return d.filter(F.contains(F.lower(kind), F.lit("intern"))) if kind else d


def fill_defaults(df: DataFrame) -> DataFrame:
    """Published rows with serving defaults in place of blanks."""
    default = lambda c, v: F.coalesce(F.nullif(F.trim(c), F.lit("")), v)
    d = df.withColumn("title", default("title", F.lit("Internship"))).withColumn("type", default("type", F.lit("Onsite"))).withColumn("timing", default("timing", F.lit("Full-time")))
    return d.withColumn("description", F.concat("title", F.lit(" at "), "hiring_organization", F.lit(".")))


def publish_run(candidates: DataFrame, table: DataFrame, added: str, order: str = "post_id", as_of: str = AS_OF) -> DataFrame:
    """The published table (order, keys, date_added) after a run: new candidates appended with date added, stale rows pruned."""
    new = append_only_new(candidates, "keys", order, table.select(F.explode("keys").alias("key")))
    return prune_stale(table.unionByName(new.withColumn("date_added", F.lit(added)).select(*table.columns)), as_of=as_of)
