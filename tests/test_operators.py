"""Operators over rows against plain sequential models."""

import json
import random
import re
import shutil
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from postsieve.operators import dedup, posts, rank, serve, taxonomy
from postsieve.sources import readers, sinks
from postsieve.streaming import streams


def greedy(rows, seen=()):
    used, kept = set(seen), []
    for pos, keys in rows:
        if not used & set(keys):
            kept.append(pos)
            used |= set(keys)
    return kept


def keyed(spark, rows):
    return spark.createDataFrame(rows, "pos bigint, keys array<string>")


def test_multi_key_is_not_components(spark):
    rows = [(1, ["u1", "c1"]), (2, ["u1", "c2"]), (3, ["u3", "c2"]), (4, [])]
    assert sorted(r.pos for r in dedup.ordered_multi_key_dedup(keyed(spark, rows), "keys", "pos").collect()) == [1, 3, 4]


@pytest.mark.parametrize("seed", [1, 2])
def test_multi_key_random(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [f"a{rng.randint(0, 25)}", f"b{rng.randint(0, 25)}"][: rng.randint(1, 2)]) for i in range(120)]
    seen = ["a3", "b7"]
    got = dedup.ordered_multi_key_dedup(keyed(spark, rows), "keys", "pos", spark.createDataFrame([(s,) for s in seen], "key string"))
    kept = sorted(r.pos for r in got.collect())
    assert kept == greedy(rows, seen)
    again = dedup.ordered_multi_key_dedup(got, "keys", "pos")
    assert sorted(r.pos for r in again.collect()) == kept


def test_multi_key_long_chain(spark):
    """Each row depends on the one before it: every second one stays, whatever the number of rounds."""
    rows = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(24)]
    assert sorted(r.pos for r in dedup.ordered_multi_key_dedup(keyed(spark, rows), "keys", "pos").collect()) == list(range(0, 24, 2))


def test_cross_query(spark):
    rows = [(1, 0, "u1", "t"), (2, 0, "u1", "x"), (3, 0, "u2", "t"), (4, 0, "", "t"), (5, 1, "u3", "t"), (6, 1, "u4", "y"), (7, 1, "", "y"), (8, 1, "", "z"), (9, 1, "", "z"), (10, 2, "u1", "q"), (11, 2, None, None)]
    got = dedup.dedup_cross_query(spark.createDataFrame(rows, "post_id bigint, q int, url string, txt string"), "q", "url", "txt", ["post_id"])
    kept = {r.post_id for r in got.collect()}
    assert {1, 3, 6, 8, 11} <= kept and not kept & {2, 5, 9, 10}


def test_fuzzy_titles(spark):
    rng = random.Random(4)
    words = ["backend", "developer", "intern", "remote", "data", "science", "growth"]
    rows = [(i, " ".join(rng.sample(words, 4)) + rng.choice(["", " i", " ii", " 2"])) for i in range(60)] + [(60, "internship"), (61, "internship"), (62, "")]
    kept = []
    for pos, title in rows:
        if title in ("", "internship") or not any(SequenceMatcher(None, title, k).ratio() > 0.85 for _, k in kept if k not in ("", "internship")):
            kept.append((pos, title))
    got = dedup.fuzzy_title_dedup(spark.createDataFrame(rows, "pos bigint, title string"), "title", "pos")
    assert sorted(r.pos for r in got.collect()) == [p for p, _ in kept]


def quota_model(items, sources, target):
    used, chosen, pool = set(), [], []
    for name, quota in sources:
        n = 0
        for it in sorted((i for i in items if i[1] == name), key=lambda i: (-i[2], i[0])):
            if used & set(it[3]):
                continue
            if n < quota:
                chosen.append(it)
                used |= set(it[3])
                n += 1
            else:
                pool.append(it)
    for it in sorted(pool, key=lambda i: -i[2]):  # ties as they came
        if len(chosen) >= target:
            break
        if not used & set(it[3]):
            chosen.append(it)
            used |= set(it[3])
    return [i[0] for i in sorted(chosen, key=lambda i: -i[2])][:target]


def test_quota_select(spark):
    rng = random.Random(8)
    sources = [("a", 4), ("b", 0), ("c", 3)]
    items = [(i, rng.choice("abc"), rng.choice([40, 50, 60]), [f"k{rng.randint(0, 30)}", f"m{rng.randint(0, 30)}"]) for i in range(70)]
    got = rank.quota_select(spark.createDataFrame(items, "pos bigint, source string, score bigint, keys array<string>"), sources, 12)
    assert [r.pos for r in got.collect()] == quota_model(items, sources, 12)


def test_prune_and_expire(spark):
    d = spark.createDataFrame([(1, "2024-01-16 09:00"), (2, "2024-01-15 23:00"), (3, ""), (4, "soon"), (5, None)], "row_no int, date_added string")
    kept = {r.row_no for r in rank.prune_stale(d).collect()}
    assert kept == {1, 3, 4, 5} and {r.row_no for r in rank.prune_stale(rank.prune_stale(d)).collect()} == kept
    late = rank.prune_stale(d, as_of="TIMESTAMP '2024-01-31 00:00:01'")
    assert {r.row_no for r in late.collect()} == {3, 4, 5}
    kept, removed = rank.expire_listings(d.withColumnRenamed("date_added", "posted_date"))
    assert {r.row_no for r in removed.collect()} == {1, 2} - ({1, 2} & {r.row_no for r in kept.collect()})


def test_search_boundaries(spark):
    rows = [(1, "a", "x", "Software", "Pune", "Remote", "Full-time", 24, 5, 60, ["t"]), (2, "b", "y", "Design", "Pune", "Onsite", "Part-time", 12, 0, 70, ["u"])]
    d = spark.createDataFrame(rows, "row_no int, title string, org string, cluster string, location string, type string, timing string, hours_ago int, stipend int, score int, tags array<string>")
    assert [r.row_no for r in serve.search_board_extended(d, fresh24=True).collect()] == [2]
    assert [r.row_no for r in serve.search_board(d, sort="score").collect()] == [2, 1]
    assert [r.row_no for r in serve.search_board_extended(d, paid=True).collect()] == [1]


def test_matching_falls_back(spark):
    rows = [(i, f"t{i}", "Software" if i % 2 else "Design", "Pune", i) for i in range(20)]
    d = spark.createDataFrame(rows, "row_no int, title string, cluster string, location string, hours_ago int")
    subs = spark.createDataFrame([("none", "", "", False), ("miss", "zzz", "", False), ("both", "design", "mumbai", False), ("hit", "design", "pune", False), ("gone", "", "", True)], "email string, roles string, cities string, unsubscribed boolean")
    got = {}
    for r in serve.match_subscribers(d, serve.read_subscribers(subs)).collect():
        got.setdefault(r.email, {})[r.place] = r.row_no
    top = {i + 1: i for i in range(8)}
    assert got == {"none": top, "miss": top, "both": top, "hit": {i + 1: 2 * i for i in range(8)}}


def test_files(spark, tmp_path):
    posts = [{"authorName": "", "author": {"name": "n", "company": "c"}, "text": "", "postText": "hi", "likes": [1, 2], "commentCount": {"count": 4}, "link": "l", "time": "5h"}, {"text": "x", "likes": "7", "reposts": "many"}]
    (tmp_path / "posts.json").write_text(json.dumps(posts))
    rows = readers.read_raw_posts(spark, str(tmp_path / "posts.json")).collect()
    assert (rows[0].author_name, rows[0].company, rows[0].text, rows[0].likes, rows[0].comments, rows[0].url) == ("n", "c", "hi", 2, 4, "l")
    assert (rows[1].likes, rows[1].reposts, rows[1].author_name) == (7, 0, "")
    (tmp_path / "a.json").write_text(json.dumps([{"title": "t", "url": "u"}]))
    got = readers.load_sources(spark, {"LinkedIn Posts": str(tmp_path / "a.json"), "Unstop": str(tmp_path / "missing.json")})
    assert [(r.title, r.source, r.priority) for r in got.collect()] == [("t", "LinkedIn Posts", 50)]
    head = ",".join(readers.HEADERS)
    (tmp_path / "p.csv").write_text(head + '\n"T1",Remote,,"line one\nline ""two"""\n"  ",x\nT2\n')
    got = readers.read_published(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.title, r.description, r.posted_date) for r in got] == [("T1", 'line one\nline "two"', ""), ("T2", "", "")]
    assert {"hiring_organization", "post_url", "date_added", "posted_date"} <= set(got[0].asDict())


def test_layout_and_tabs(spark, tmp_path):
    d = spark.createDataFrame([("Backend developer", "Pune"), ("Zookeeper", "")], "title string, location string")
    sinks.write_tabs(d, str(tmp_path / "tabs"))
    assert {r.tab for r in spark.read.parquet(str(tmp_path / "tabs")).select("tab").collect()} == {"Backend", "Other"}


def test_publish_stream_twice(spark, sf_dir, tmp_path):
    rows = [(i, [f"u{i % 7}", f"c{i % 11}"]) for i in range(60)]
    d = spark.createDataFrame(rows, "post_id bigint, keys array<string>")
    d.filter("post_id < 30").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    streams.publish_stream(source(), out, state).awaitTermination()
    first = greedy([r for r in rows if r[0] < 30])
    assert sorted(r.post_id for r in spark.read.parquet(out).collect()) == first
    streams.publish_stream(source(), out, str(tmp_path / "replayed")).awaitTermination()  # batch 0 delivered again
    assert sorted(r.post_id for r in spark.read.parquet(out).collect()) == first
    d.filter("post_id >= 30").write.mode("append").parquet(str(tmp_path / "in"))
    streams.publish_stream(source(), out, state).awaitTermination()
    assert sorted(r.post_id for r in spark.read.parquet(out).collect()) == greedy(rows)


def test_publish_run_is_idempotent(spark):
    rows = [(i, [f"u{i % 7}"]) for i in range(20)]
    table = keyed(spark, rows[:3]).withColumnRenamed("pos", "post_id").selectExpr("post_id", "keys", "'2024-01-30 09:00' AS date_added")
    fresh = keyed(spark, rows).withColumnRenamed("pos", "post_id")
    once = posts.publish_run(fresh, table, "2024-01-31 00:00")
    twice = posts.publish_run(fresh, once, "2024-01-31 00:00")
    assert sorted(r.post_id for r in once.collect()) == sorted(r.post_id for r in twice.collect()) == list(range(7))


def test_publish_stream_with_a_new_checkpoint_keeps_older_rows(spark, tmp_path):
    d = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "post_id bigint, keys array<string>")
    out = str(tmp_path / "out")
    for k in (1, 2):
        d.filter(f"post_id = {k}").write.parquet(str(tmp_path / f"in{k}"))
        source = spark.readStream.schema(d.schema).parquet(str(tmp_path / f"in{k}"))
        streams.publish_stream(source, out, str(tmp_path / f"state{k}")).awaitTermination()
    assert sorted(r.post_id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_publish_stream_finds_batches_that_were_broken_off(spark, tmp_path):
    """Rows whose keys never reached the index, and tables older than the index, block later rows all the same."""
    d = spark.createDataFrame([(i, [f"u{i % 5}", None]) for i in range(9)] + [(9, []), (10, None), (11, [None])], "post_id bigint, keys array<string>")
    out = str(tmp_path / "out")
    old = d.filter("post_id < 2").withColumn("run", F.lit("old")).withColumn("batch_id", F.lit(0).cast("bigint"))
    old.write.partitionBy("run", "batch_id").parquet(out)
    d.filter("post_id < 4").write.parquet(str(tmp_path / "in1"))
    d.filter("post_id >= 4").write.parquet(str(tmp_path / "in2"))
    stream = lambda k: streams.publish_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / f"in{k}")), out, str(tmp_path / f"state{k}")).awaitTermination()
    stream(1)
    assert sorted(r.post_id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
    run = spark.read.parquet(out).filter("run <> 'old'").first().run
    shutil.rmtree(tmp_path / f"out_batches/run={run}")
    for found in (tmp_path / "out_keys").glob(f"bucket=*/run={run}"):
        shutil.rmtree(found)
    stream(2)
    assert sorted(r.post_id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 9, 10, 11]


def test_published_keys_are_read_by_bucket(spark, tmp_path):
    rows = spark.createDataFrame([(i, [f"k{i}"], "a", i % 3) for i in range(600)], "post_id bigint, keys array<string>, run string, batch_id bigint")
    index = streams.KeyIndex(spark, str(tmp_path / "t"), "keys")
    assert index.seen(rows, "b", 0).count() == 0
    index.add(rows)
    index.add(rows)
    few = rows.filter("post_id IN (5, 6)").unionByName(rows.limit(1).withColumn("keys", F.array(F.lit("never"))))
    assert sorted(r.key for r in index.seen(few, "b", 0).collect()) == ["k5", "k6"]
    assert [r.key for r in index.seen(few, "a", 0).collect()] == ["k5"]  # 6 is the asking batch's own
    buckets = {r.b for r in few.selectExpr(f"CAST(pmod(xxhash64(keys[0]), {index.BUCKETS}) AS INT) AS b").collect()}
    files = index.seen(few, "b", 0).inputFiles()
    assert {int(re.search(r"bucket=(\d+)", f).group(1)) for f in files if "/t_keys/" in f} <= buckets


def test_dedup_stream(spark, tmp_path):
    """The first row of each address stays; one seen again within the retention doesn't come back."""
    rows = [(1, "u1", "2024-01-01 00:00:00"), (2, "u2", "2024-01-01 01:00:00"), (3, "u1", "2024-01-02 00:00:00"), (4, "u3", "2024-01-03 00:00:00"), (5, "u2", "2024-01-04 00:00:00")]
    d = spark.createDataFrame(rows, "post_id int, url string, at string").selectExpr("post_id", "url", "CAST(at AS TIMESTAMP) AS posted_ts")
    d.filter("post_id < 4").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
        writer = streams.dedup_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        writer.start().awaitTermination()
        d.filter("post_id >= 4").write.mode("append").parquet(str(tmp_path / "in"))
    got = [r.url for r in spark.read.schema(d.schema).parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == ["u1", "u2", "u3"]


SHOP = """<html><body><article><h2> First <b>offer</b> here </h2><p>text</p><a href="/one">x</a></article><article><h2>Tiny</h2><a href="/two">x</a></article>
<article><p>no title at all</p></article><article><h3>Absolute address</h3><a href="https://b.in/z">x</a><a href="/no">y</a></article><article><h2>Relative address</h2><a name="n">x</a><a href="deep">y</a></article>
<article><h2>Without any link</h2></article></body></html>"""


def page(spark, *html):
    return spark.createDataFrame([(k, "https://a.in/jobs/list/", h) for k, h in enumerate(html)], "page_id bigint, url string, html string")


def test_cards(spark):
    got = [(r.title, r.url, r.company, r.location, r.source) for r in readers.extract_cards(page(spark, SHOP, None)).orderBy("page_id", "idx").collect()]
    same = ("See listing", "India", "a.in")
    assert got == [("Firstofferhere", "https://a.in/one", *same), ("Absolute address", "https://b.in/z", *same), ("Relative address", "https://a.in/jobs/list/", *same), ("Without any link", "", *same)]
    few = readers.extract_cards(page(spark, SHOP), per_site=2).collect()
    assert [r.title for r in few] == ["Firstofferhere"]  # the cut comes before the short title goes


def test_portal_cards(spark):
    html = "".join(f"<article><h3>{t}</h3>{a}</article>" for t, a in [("Young fellows", '<a name="x">n</a><a href="apply">y</a>'), ("A trainee job", ""), ("Other thing", ""), ("Intern" + "x" * 300, '<a href="https://c.in">y</a>')])
    got = [(r.title, r.url, r.company, r.source) for r in readers.gov_cards(page(spark, html)).orderBy("idx").collect()]
    assert got == [("Young fellows", "https://a.inapply", "a.in", "Government"), ("A trainee job", "https://a.in/jobs/list/", "a.in", "Government"), ("Intern" + "x" * 194, "https://c.in", "a.in", "Government")]
    assert readers.gov_cards(page(spark, html), per_site=1).count() == 1


def test_blocks(spark):
    body = "We are hiring people for this and that, and for much more of it"
    html = f'<div>{body}<a href="/x">go</a></div><li>{body}<a href="/x">go</a></li><li>short hiring</li><article>{"no word of it " * 9}</article><div>{body} again</div>'
    got = [(r.idx, r.url) for r in readers.extract_blocks(page(spark, html)).orderBy("idx").collect()]
    assert got == [(0, "https://a.in/jobs/list//x"), (4, "https://a.in/jobs/list/")]


def test_bad_source_files(spark, tmp_path):
    (tmp_path / "bad.json").write_text("this is not JSON")
    (tmp_path / "good.json").write_text('[{"title": "a"}]')
    got = readers.load_sources(spark, {"LinkedIn Posts": str(tmp_path / "bad.json"), "Unstop": str(tmp_path / "good.json")}).collect()
    assert [(r.title, r.source, r.priority) for r in got] == [("a", "Unstop", 40)]


def test_score_100(spark):
    rows = [("LinkedIn Posts", 5, 400, 3), ("LinkedIn Jobs", 48, 300, 3), ("LinkedIn Jobs", 49, 301, 0), ("Unstop", None, 10, 2), ("elsewhere", 12, 10, 2)]
    d = rank.score_100(spark.createDataFrame(rows, "source string, age int, applicants int, signals int"), "source", "age", "applicants", "signals")
    assert [(tuple(r.breakdown), r.score_100) for r in d.collect()] == [((30, 25, 0, 20), 75), ((25, 10, 10, 0), 45), ((25, 5, 5, 0), 35), ((15, 0, 0, 0), 15), ((0, 15, 0, 0), 15)]


def test_taxonomy_as_a_table(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"place": 2, "keywords": ["data"], "subchips": ["D"], "similar_fields": ["E"]}\n{"place": 1, "keywords": ["data eng", "etl"], "subchips": ["A", "B"], "similar_fields": ["C"]}\n')
    d = spark.createDataFrame([("Data Engineer",), ("Data Entry",), ("Cook",), (None,)], "title string")
    got = taxonomy.related_terms(d, taxonomy.read_taxonomy(spark, str(tmp_path / "t.json"))).collect()
    assert {tuple(r) for r in got} == {("Data Engineer", "A, B", "C"), ("Data Entry", "D", "E"), ("Cook", "", ""), (None, "", "")}


def test_rank_continue_over_ranges(spark):
    d = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "pos bigint")
    got = rank.rank_continue(d, ["pos"], 10).collect()
    assert len(got) == 1000 and all(r["rank"] == r.pos + 11 for r in got)


def test_cards_and_rows_of_posts(spark):
    d = spark.createDataFrame([(1, [" a ", "", "b"]), (2, None), (3, [" "])], "post_id int, roles array<string>")
    assert [(r.post_id, r.place, r.role) for r in posts.explode_roles(d).orderBy("post_id", "place").collect()] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "Internship"), (3, 0, "Internship")]
    d = spark.createDataFrame([("https://niti.gov.in/x",), ("https://gov.in.evil.com",), ("http://NIC.in/",), ("not a url",), (None,)], "url string")
    assert [r.url for r in posts.official_domain(d).collect()] == ["https://niti.gov.in/x", "http://NIC.in/"]
