"""Selection in order: a row is taken unless a row taken before it has put its mark on something that the row checks.

Deduplication across queries, by near titles and under quotas are all of this kind; they differ in what a row marks, what
it checks, and how far back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postsieve.operators.tables import materialise


def ordered_selection(rows: DataFrame, marks: DataFrame, checks: DataFrame, quotas: dict[str, int] | None = None) -> DataFrame:
    """(o) of the rows that are taken.

    rows: (o), o unique and comparable, with quotas also (source); marks: (o, token); checks: (o, token, bound), bound not
    above o. In order of o, a row is passed over if a taken row with o below its bound has marked one of the tokens it
    checks; passed-over rows mark nothing. With quotas a source takes so many rows at most, and what comes behind them
    marks nothing either; other sources take none.

    All sources and all rows are worked on at once, in rounds. A row is clear if no undecided row below its bound marks a
    token it checks. Clear rows are taken, with quotas if they are among the first undecided rows that their source still
    has room for; then the rows that these block are passed over. The first undecided row is decided in each round, so
    rounds end; there are as many as the longest chain of rows that depend on each other, in usual data few. A round is a
    few shuffles of the marks and checks still open.
    """
    room = dict(quotas or {})
    if quotas is not None:
        rows = rows.filter(F.col("source").isin([s for s, n in room.items() if n > 0]))
        marks = marks.join(rows.select("o"), "o", "left_semi")
    open_rows, open_marks, open_checks = (materialise(d, "open") for d in (rows, marks.distinct(), checks.distinct()))
    taken = []
    while not open_rows.isEmpty():
        first = open_marks.groupBy("token").agg(F.min("o").alias("m"))
        waiting = open_checks.join(first, "token").filter("m < bound").select("o").distinct()
        clear = open_rows.join(waiting, "o", "left_anti")
        if quotas is not None:
            clear = clear.join(_first_of_each(open_rows, room), "o", "left_semi")
        now = materialise(clear, "taken")
        taken.append(now.select("o"))
        fresh = open_marks.join(now.select("o"), "o", "left_semi").groupBy("token").agg(F.min("o").alias("m"))
        decided = now.select("o").unionByName(open_checks.join(fresh, "token").filter("m < bound").select("o"))
        if quotas is not None:
            for r in now.groupBy("source").agg(F.count("*").alias("n")).collect():  # a row a source that has a quota
                room[r.source] -= r.n
            decided = decided.unionByName(open_rows.filter(~F.col("source").isin([s for s, n in room.items() if n > 0])).select("o"))
        decided = materialise(decided.distinct(), "decided")
        open_rows, open_marks, open_checks = (materialise(d.join(decided, "o", "left_anti"), "open") for d in (open_rows, open_marks, open_checks))
    return reduce(DataFrame.unionByName, taken) if taken else rows.select("o").limit(0)


def _first_of_each(rows: DataFrame, room: dict[str, int], groups: int = 64) -> DataFrame:
    """(o) of the first rows of each source, as many as it has room for: of its shares by hash first, so that no source is one task's."""
    most = F.coalesce(*[F.when(F.col("source") == s, F.lit(n)) for s, n in room.items()], F.lit(0))
    d = rows.select("o", "source", most.alias("_most")).filter("_most > 0")
    for by in (["source", F.pmod(F.xxhash64("o"), F.lit(groups))], ["source"]):
        d = d.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("o"))).filter("_n <= _most").drop("_n")
    return d.select("o")
