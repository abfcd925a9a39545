"""The stored board index and publishing by runs, against plain models."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from postsieve.operators import serve
from postsieve.operators.board_index import BoardIndex
from postsieve.operators.ranked import RankedTable
from postsieve.sources import sinks

COLUMNS = ["row_no", "title", "type", "timing", "stipend", "location", "tags", "hiring_organization", "post_url", "apply_link", "contact_email", "date_added", "posted_date"]


def published(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} {'bigint' if c == 'row_no' else 'string'}" for c in COLUMNS))


def some_rows(n, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abÉé ") for _ in range(rng.randint(0, 7)))
    return [(i, word() + word(), "", "", "", rng.choice(["Pune", "Goa", None]), rng.choice(["x, Ab", "", None]), word(), f"u{i}", "", "", "2024-01-01 09:00", "") for i in range(n)]


@pytest.mark.parametrize("kind", ["board", "extended", "dashboard"])
def test_index_gives_the_rows_of_the_scan(spark, tmp_path, kind):
    rows = some_rows(300)
    d = published(spark, rows)
    index = BoardIndex(spark, str(tmp_path / "index"), kind, buckets=4, shares=4)
    search = {"board": serve.search_board, "extended": serve.search_board_extended, "dashboard": serve.search_dashboard}[kind]
    index.add(d.filter("row_no < 120"))
    index.add(d.filter("row_no >= 100"))
    index.add(d)
    assert sorted(r.row_no for r in index.rows().collect()) == list(range(300))
    some = 0
    for query in ("", " ", "a", "éa", "aba", " ÉAB ", "b a", "pune", "aaaaaaa", "zzz", "x ab"):
        want = [r.row_no for r in search(serve.listings_view(d), query).collect()]
        assert [r.row_no for r in search(serve.listings_view(index.rows(query)), query).collect()] == want
        some += 0 < len(want) < 300
    assert some >= 5


def test_a_search_reads_the_buckets_of_its_grams(spark, tmp_path):
    index = BoardIndex(spark, str(tmp_path / "index"))
    index.add(published(spark, some_rows(50)))
    plan = index.candidates("aba")._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "gram" in line)
    assert "PartitionFilters: []" not in scan and "bucket" in scan[scan.index("PartitionFilters") :] and "gram" in scan[scan.index("PushedFilters") :]
    assert index.rows("aba").count() < index.rows().count()


def test_index_without_rows_and_with_what_a_broken_add_left(spark, tmp_path):
    d = published(spark, some_rows(40))
    index = BoardIndex(spark, str(tmp_path / "index"))
    with pytest.raises(AnalysisException):
        index.rows("abc")
    index.add(d.limit(0))
    assert not index.holds_rows()
    index.add(d)
    before = sorted(r.row_no for r in index.rows("aba").collect())
    left = index._read("postings", "row_no bigint, gram string, bucket int").filter("row_no < 5").withColumn("row_no", F.explode(F.array("row_no", F.lit(999).cast("bigint"))))
    left.write.mode("append").partitionBy("bucket").parquet(f"{index.path}/postings")  # postings twice, and of a row that isn't there
    assert sorted(r.row_no for r in index.rows("aba").collect()) == before
    index.add(published(spark, [(3, "another title", *[""] * 11), (None, "abab", *[""] * 11)]))
    assert sorted(r.row_no for r in index.rows("aba").collect()) == before and index.rows().count() == 40


def test_sort_orders(spark):
    rows = [(1, 5, 10, 3), (2, 5, 10, 1), (3, 9, 2, 1), (4, 1, 30, 2)]
    d = spark.createDataFrame([(i, "t", "o", "c", "l", "k", "f", h, s, p, ["g"]) for i, s, p, h in rows], "row_no int, title string, org string, cluster string, location string, type string, timing string, hours_ago int, stipend int, score int, tags array<string>")
    for search in (serve.search_board, serve.search_board_extended):
        for sort, want in (("fresh", [2, 3, 4, 1]), ("stipend", [3, 1, 2, 4]), ("score", [4, 1, 2, 3]), ("other", [2, 3, 4, 1])):
            assert [r.row_no for r in search(d, sort=sort).collect()] == want


def model(runs, score):
    """Sequential: keys seen are skipped, then all rows are ranked."""
    kept, keys = [], set()
    for rows in runs:
        for r in sorted(rows):
            key = (r[1] or "").strip() or ("h", r[2] or "", r[3] or "")
            if key not in keys:
                keys.add(key)
                kept.append(r)
    order = sorted(kept, key=lambda r: (-score(r), r[0]))
    return {r[0]: k + 1 for k, r in enumerate(order)}


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_follow_the_model_and_runs_count_once(spark, tmp_path, seed):

    def make(lo, hi):  # a row is the same in every run
        rngs = [(i, random.Random(1000 * seed + i)) for i in range(lo, hi)]
        return [(i, r.choice(["", None, f" u{r.randint(0, 60)}"]), r.choice(["a", None]), f"t{r.randint(0, 9)}", r.randint(0, 9)) for i, r in rngs]

    runs = [make(0, 60), make(40, 130), make(130, 150)]
    schema = "row_no int, post_url string, hiring_organization string, title string, points int"
    to = RankedTable(spark, str(tmp_path / "ranked"))
    with pytest.raises(ValueError):
        to.read()
    for k, rows in enumerate(runs):
        d = spark.createDataFrame(rows, schema)
        for _ in range(2):  # the score of a run holds for older rows too
            assert to.publish(d, f"run{k}", F.pmod(F.col("points") * (k + 3), F.lit(7)), ["row_no"]) == k + 1
        if k == 1:  # what a run that was broken off leaves is no version
            spark.createDataFrame([("u:left", 1)], "_key string, row_no int").write.parquet(f"{to.path}/rows/version=3")
            assert max(to.runs().values()) == 2
        got = {r.row_no: r["rank"] for r in RankedTable(spark, to.path).read().collect()}
        assert got == model(runs[: k + 1], lambda r, k=k: r[4] * (k + 3) % 7)
    files = sorted(p.name for p in (tmp_path / "ranked").rglob("*.parquet"))
    assert to.publish(spark.createDataFrame(runs[0], schema), "run1", F.col("points"), ["row_no"]) == 2
    assert to.publish(spark.createDataFrame([], schema), "run9", F.col("points"), ["row_no"]) == 3
    assert sorted(p.name for p in (tmp_path / "ranked").rglob("*.parquet")) == files


def test_a_run_written_twice(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "row_no int, date_added string")
    for run, rows in (("a", d), ("b", d.filter("row_no = 1")), ("a", d.filter("row_no = 2"))):
        sinks.write_published(rows, str(tmp_path / "p"), run=run)
    got = spark.read.parquet(str(tmp_path / "p")).collect()
    assert sorted((r.run, r.row_no, str(r.date_added)) for r in got) == [("a", 2, "2024-01-02"), ("b", 1, "2024-01-01")]


def test_a_text_of_many_rows_is_cut_into_grams_once(spark, tmp_path):
    rows = [(i, "data intern", "", "", "", "Pune", "", f"org {i % 3}", f"u{i}", "", "", "2024-01-01 09:00", "") for i in range(60)]
    index = BoardIndex(spark, str(tmp_path / "index"))
    index.add(published(spark, rows))
    postings = index._read("postings").filter("gram = 'ata'").collect()
    assert len(postings) == 3 and sorted(p.row_no for p in postings) == [0, 1, 2]
    assert sorted(r.row_no for r in index.rows("org 1").collect()) == list(range(1, 60, 3))
