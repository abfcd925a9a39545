"""Registered queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postsieve.plans.fixtures import with_views
from postsieve.plans.handwritten import HANDWRITTEN
from postsieve.plans.relational import RELATIONAL, RELATIONAL_SQL
from postsieve.plans.scalar import SCALARS, duck_sql, spark_query

QUERIES = {n: spark_query(n) for n in SCALARS} | RELATIONAL
ORACLES = {n: duck_sql(n) for n in SCALARS} | RELATIONAL_SQL | {n: with_views(sql) for n, sql in HANDWRITTEN.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["f6_classify_posts"](spark, sf_dir)
