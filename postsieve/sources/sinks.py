"""Sinks: the published table, tabs, run log, keys and row layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.functions import extract as x
from postsieve.functions import text as t
from postsieve.functions.banks import TABS
from postsieve.functions.dialect import SPARK, column


def write_published(df: DataFrame, path: str, mode: str = "append", run: str | None = None) -> None:
    """Append rows; those of a named run go to its own folder, which a repeated run replaces, so that it changes nothing."""
    if run is None:
        df.write.mode(mode).partitionBy("date_added").parquet(path)
    else:
        df.write.mode("overwrite").partitionBy("date_added").parquet(f"{path}/run={run}")


def write_tabs(df: DataFrame, path: str, role: str = "title", text: str = "location", tabs=None) -> None:
    df.withColumn("tab", column(x.assign_tab, role, text, tabs)).write.mode("overwrite").partitionBy("tab").parquet(path)


def tab_inventory(df: DataFrame, role: str, text: str, tabs=None) -> DataFrame:
    """(place, tab, n): All first, tabs in rule order, Other last; empty tabs are left out."""
    names = [n for n, _ in (tabs or TABS)]
    place = F.coalesce(*[F.when(F.col("tab") == n, k + 1) for k, n in enumerate(names)], F.lit(len(names) + 1)).cast("bigint")
    each = df.groupBy(F.expr(x.assign_tab(SPARK, role, text, tabs)).alias("tab")).agg(F.count("*").alias("n")).select(place.alias("place"), "tab", "n")
    return each.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(0).cast("bigint").alias("place"), F.lit("All").alias("tab"), "n"))


def append_run_log(log: DataFrame, entry: DataFrame, order: str = "run_at", keep: int = 100) -> DataFrame:
    return log.unionByName(entry).orderBy(F.desc(order)).limit(keep)


def export_dedup_keys(published: DataFrame) -> DataFrame:
    """(key, kind): each URL, and each company:role of rows with both."""
    company, role = column(t.normalize_company_key, "hiring_organization"), column(t.role_bucket_8, "lower(trim(title))")
    pair = F.when((F.col("hiring_organization") != "") & (F.trim("title") != ""), F.concat(company, F.lit(":"), role))
    both = F.array(F.struct(F.nullif(F.trim("post_url"), F.lit("")).alias("key"), F.lit("url").alias("kind")), F.struct(pair.alias("key"), F.lit("company_role").alias("kind")))
    return published.select(F.inline(both)).filter("key IS NOT NULL").distinct()


def _or(default: str, *columns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in columns) + f", '{default}')"


#: Layout -> (header, expression) with its display defaults; the inputs are columns of the published table.
LAYOUTS = {
    "city": [
        ("Role", "title"), ("Type", _or("Internship", "type")), ("Work Mode", "work_mode"), ("Timing", "timing"), ("Description", "description"), ("Stipend", _or("Not Specified", "stipend")),
        ("Stipend Available", "CASE WHEN stipend <> '' THEN 'Yes' ELSE 'No' END"), ("Duration", "duration"), ("Experience", "experience"), ("Location", "location"), ("Deadline", "deadline"), ("Tags", "tags"),
        ("Company", "hiring_organization"), ("Author", "hiring_manager"), ("Post URL", "post_url"), ("Apply Link", "apply_link"), ("Contact Email", "contact_email"), ("Date Added", "date_added"),
    ],
    "remote": [
        ("Title", "title"), ("Type", "'Internship'"), ("Timing", _or("Full-time", "timing")), ("Description", "description"), ("Stipend", _or("Unpaid", "stipend")), ("Duration", _or("3-6 months", "duration")),
        ("Experience", _or("Fresher", "experience")), ("Location", "location"), ("Deadline", _or("N/A", "deadline")), ("Tags", "tags"), ("HiringOrganization", "hiring_organization"), ("HiringManager", _or("N/A", "hiring_manager")),
        ("Post URL", _or("", "post_url", "source_url")), ("Apply Link", "apply_link"), ("Contact Email", "contact_email"), ("Date Added", "date_added"),
    ],
}


def project_layout(df: DataFrame, layout: str, keep: tuple[str, ...] = ("row_no",)) -> DataFrame:
    """The columns of a layout under its headers; columns that df lacks are blank."""
    needed = ("title", "type", "work_mode", "timing", "description", "stipend", "duration", "experience", "location", "deadline", "tags", "hiring_organization", "hiring_manager", "post_url", "source_url", "apply_link", "contact_email", "date_added")
    d = df.select("*", *[F.lit("").alias(c) for c in needed if c not in df.columns])
    return d.selectExpr(*keep, *[f"{e} AS `{n}`" for n, e in LAYOUTS[layout]])
