"""Every registered query with a DuckDB counterpart, on the smallest tables."""

import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from postsieve.plans.fixtures import view
from postsieve.plans.registry import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral() else round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got and got == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_posts_are_read_to_their_end(spark, tmp_path):
    """What stands behind character 400 of a document is found, by Spark and by DuckDB alike."""
    fill = "lorem ipsum dolor " * 60
    rows = [(6, f"{fill}write to late0@kite.in from Pune", "src000", "en", 9), (22, fill, "src001", "en", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {6: ("late0@kite.in", "Pune"), 22: ("", "")}
    for name, k in (("c2_extract_emails", 0), ("c3_extract_locations", 1)):
        assert {r[0]: r[1] or "" for r in QUERIES[name](spark, str(tmp_path)).collect()} == {d: w[k] for d, w in want.items()}
        assert {r[0]: r[1] or "" for r in con.execute(ORACLES[name]).fetchall()} == {d: w[k] for d, w in want.items()}


def test_whole_tables_are_worked_on(spark, sf_dir):
    """Listings of any age have relations, every scam post counts, and what is seen grows with the posts."""
    rows = [(r.row_no, r.id, r.cluster, r.hours_ago) for r in QUERIES["q1_listings_view"](spark, sf_dir).collect()]
    assert any(h >= 200 for *_, h in rows)
    first = {}
    for row, i, cluster, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        first.setdefault(cluster, []).append((row, i))
    want = {(row, k + 1, other) for row, i, cluster, _ in rows for k, other in enumerate([o for o, j in first[cluster] if j != i][:4])}
    assert {(r.row_no, r.place, r.other) for r in QUERIES["j12_related_listings"](spark, sf_dir).collect()} == want
    posts = {r.post_id: r for r in view(spark, sf_dir, "fx_posts").collect()}
    assert QUERIES["a16_topup_deficit"](spark, sf_dir).first().published == sum(p.label == "scam" for p in posts.values())
    for name, earlier in (("f7_prefilter_posts", 10), ("j2_anti_seen", 10), ("j5_dedup_company_role", 1)):
        got = [posts[r.post_id] for r in QUERIES[name](spark, sf_dir).collect()]
        assert got and all(p.query_seq >= earlier for p in got)
    seen = {p.url for p in posts.values() if p.query_seq < 10}
    assert all(not posts[r.post_id].url or posts[r.post_id].url not in seen for r in QUERIES["f7_prefilter_posts"](spark, sf_dir).collect())
