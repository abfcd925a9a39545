"""Joins that leave rows without a partner where they are."""

import random

import pytest
from pyspark.sql import functions as F

from postsieve.llm import common


@pytest.mark.parametrize(("n", "how", "most"), [(0, "left", 1 << 30), (300, "left", 1 << 30), (5000, "left", 1 << 15), (1, "left_semi", 1 << 30), (5000, "left_semi", 1 << 15), (0, "left_anti", 1 << 30), (5000, "left_anti", 1 << 30)])
def test_same_rows_as_a_plain_join(spark, monkeypatch, n, how, most):
    """Whatever the number of keys, also where the filter is too small for them; null and repeated keys too."""
    monkeypatch.setattr(common, "MOST_FILTER_BITS", most)
    rng = random.Random(n)
    df = spark.createDataFrame([(rng.choice([None, "", *map(str, range(20000))]), f"text {i}") for i in range(4000)] + [(None, "a"), ("", "b"), ("", "b")], "k string, text string")
    keys = sorted(rng.sample(range(20000), max(n - 2, 0)))
    few = spark.createDataFrame([(k, [k or "none"]) for k in ([None, ""] if n else []) + [str(k) for k in keys]], "k string, v array<string>")
    few = few if how == "left" else few.select("k")
    want = df.join(few.withColumnRenamed("k", "_k"), F.col("k").eqNullSafe(F.col("_k")), how).drop("_k")
    got = common.sparse_join(df, few, "k", how)
    assert got.columns == want.columns and got.schema == want.schema
    show = lambda d: sorted(map(str, d.collect()))
    assert show(got) == show(want)


@pytest.mark.parametrize("kind", ["bigint", "binary", "struct<a:int,b:string>"])
def test_keys_of_other_types(spark, kind):
    make = {"bigint": "id", "binary": "CAST(CAST(id AS STRING) AS BINARY)", "struct<a:int,b:string>": "named_struct('a', CAST(id AS INT), 'b', CAST(id AS STRING))"}[kind]
    d = spark.range(-500, 1000).selectExpr(f"{make} AS k", "id")
    few = spark.range(-100, 50).selectExpr(f"{make} AS k")
    assert sorted(r.id for r in common.sparse_join(d, few, "k", "left_semi").collect()) == list(range(-100, 50))
    assert sorted(r.id for r in common.sparse_join(d, few, "k", "left_anti").collect()) == [*range(-500, -100), *range(50, 1000)]


def test_rows_without_a_partner_are_not_shuffled(spark, tmp_path):
    spark.range(20000).selectExpr("id AS k", "repeat('x', 200) AS text").write.parquet(str(tmp_path / "d"))
    few = common.materialise(spark.range(0, 20000, 100).selectExpr("id AS k", "'y' AS v"), "few")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = common.sparse_join(spark.read.parquet(str(tmp_path / "d")), few, "k")
        run = out._jdf.queryExecution()
        assert run.executedPlan().execute().count() == 20000  # of this very plan, so that its figures can be read
        shuffled = []

        def walk(node):
            kind, children = node.getClass().getSimpleName(), node.children()
            if kind == "ShuffleExchangeExec" and "text#" in node.output().mkString(","):
                shuffled.append(node.metrics().apply("shuffleRecordsWritten").value())
            if kind == "AdaptiveSparkPlanExec":
                walk(node.executedPlan())
            elif kind.endswith("QueryStageExec"):
                walk(node.plan())
            for i in range(children.length()):
                walk(children.apply(i))

        walk(run.executedPlan())
        assert shuffled and all(200 <= n < 2000 for n in shuffled)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
