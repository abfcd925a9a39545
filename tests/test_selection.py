"""Selection in order, near titles and dictionary matches against sequential and brute-force models."""

import random
from difflib import SequenceMatcher

import pytest

from postsieve.operators import dedup, matching, rank, serve, taxonomy

WORDS = ["backend", "developer", "intern", "remote", "data", "science", "growth", "marketing", "ui", "ux", "ai", "a", "sr", "jr"]


def titles(seed, n):
    """Titles of few words, and variants of earlier ones by some characters."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        t = list(rng.choice(out)) if out and rng.random() < 0.6 else list(" ".join(rng.choices(WORDS, k=rng.randrange(1, 6))))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(3)] = rng.choice(["", "x", "in", " "])
        out.append("".join(t).strip() or "a")
    return out


def near(new, kept, ratio=0.85):
    return SequenceMatcher(None, new, kept).ratio() > ratio


@pytest.mark.parametrize("ratio", [0.85, 0.6])
def test_near_titles_are_all_found(spark, ratio):
    given = sorted(set(titles(7, 500)) | {"ab", "abc", "abcd", "abxc", "abcdefg", "axbcdyefg", "aaaa", "aaaaaaa", "internship", "internships"})
    df = spark.createDataFrame([(t,) for t in [*given, None, ""]], "title string")
    want = {(k, n) for k in given for n in given if k != n and near(n, k, ratio)}
    assert {tuple(r) for r in matching.near_titles(df, ratio).collect()} == want and len(want) > 100
    pairs = {tuple(r) for r in matching.candidate_titles(df, ratio).collect()}
    assert {tuple(sorted(w)) for w in want} <= pairs and (ratio < 0.85 or len(pairs) < len(given) ** 2 / 10)


def test_fuzzy_dedup_of_many_titles(spark):
    rows = list(enumerate(titles(3, 2000))) + [(2000, "internship"), (2001, "internship"), (2002, "internships"), (2003, ""), (2004, None)]
    random.Random(1).shuffle(rows)
    kept, seen = [], []
    for pos, t in sorted(rows):
        if t in ("", "internship", None) or not any(near(t, k) for k in seen):
            kept.append(pos)
            seen += [t] if t and t not in seen else []
    got = dedup.fuzzy_title_dedup(spark.createDataFrame(rows, "pos bigint, title string"), "title", "pos")
    assert sorted(r.pos for r in got.collect()) == kept


def cross_query(rows):
    seen, kept = set(), []
    for q in sorted({r[1] for r in rows}):
        before = set(seen)
        for pos, _, url, text in sorted(r for r in rows if r[1] == q):
            url, text = url and "u" + url, text and "t" + text
            if url in seen or (text and text in (before if url else seen)):
                continue
            kept.append(pos)
            seen |= {k for k in (url, text) if k}
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_cross_query_random(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(12), rng.choice([None, "", *(f"u{k}" for k in range(60))]), rng.choice([None, "", *(f"t{k}" for k in range(60))])) for i in range(300)]
    got = dedup.dedup_cross_query(spark.createDataFrame(rows, "post_id bigint, q int, url string, txt string"), "q", "url", "txt", ["post_id"])
    assert sorted(r.post_id for r in got.collect()) == sorted(cross_query(rows))


def quota(items, sources, target):
    """items: (pos, source, score, keys, title)."""
    used, fuzzy, chosen, pool = set(), [], [], []

    def seen(it):
        if it[3]:
            return bool(used & set(it[3]))
        return bool(it[4]) and it[4] != "internship" and any(near(it[4], k) for k in fuzzy if k)

    def take(it):
        chosen.append(it)
        used.update(it[3])
        if not it[3]:
            fuzzy.append(it[4])

    for name, most in sources:
        n = 0
        for it in sorted((i for i in items if i[1] == name), key=lambda i: (-i[2], i[0])):
            if not seen(it):
                if n < most:
                    take(it)
                    n += 1
                else:
                    pool.append(it)
    for it in sorted(pool, key=lambda i: -i[2]):
        if len(chosen) >= target:
            break
        if not seen(it):
            take(it)
    return [i[0] for i in sorted(chosen, key=lambda i: -i[2])][:target]


@pytest.mark.parametrize(("seed", "target"), [(1, 40), (2, 9), (3, 200)])
def test_quota_with_near_titles(spark, seed, target):
    rng, names = random.Random(seed), titles(seed, 60) + ["internship", "internships", "", None]
    items = [(i, rng.choice("abcx"), rng.choice([40, 50, 60]), [f"k{rng.randrange(40)}"] * rng.randrange(2) + [f"m{rng.randrange(40)}"] * rng.randrange(2), rng.choice(names)) for i in range(160)]
    sources = [("b", 7), ("a", 0), ("c", 12)]
    got = rank.quota_select(spark.createDataFrame(items, "pos bigint, source string, score bigint, keys array<string>, name string"), sources, target, title="name")
    assert [r.pos for r in got.collect()] == quota(items, sources, target)


def test_quota_of_no_rows(spark):
    empty = spark.createDataFrame([], "pos bigint, source string, score bigint, keys array<string>, name string")
    assert rank.quota_select(empty, [("a", 3)], 5, title="name").count() == 0


def test_dictionary_matches(spark):
    rng = random.Random(6)
    hays = ["".join(rng.choices("abcde ", k=rng.randrange(1, 25))) for _ in range(300)] + ["éa😀b", "", None]
    terms = ["".join(rng.choices("abcde ", k=rng.randrange(1, 7))) for _ in range(200)] + ["😀", "éa😀", "zzz", "zz", "", None]
    got = matching.dictionary_matches(spark.createDataFrame([(h,) for h in hays], "hay string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    assert sorted(map(tuple, got)) == sorted({(h, t) for h in hays for t in terms if h and t and t in h})


def test_matching_of_random_preferences(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["ui designer", "data analyst", "hr", "ai engineer", None]), rng.choice(["Design", "Data", "HR"]), rng.choice(["Pune", "New Delhi", "Delhi", "Remote", None]), rng.randrange(30)) for i in range(200)]
    pick = lambda words: ",".join(rng.sample(words, rng.randrange(4)))
    subs = [(f"s{i}", pick(["ui", "Data", "ai", "zzz", "x"]), pick(["delhi", "pune", "mars", "r"]), False) for i in range(80)]
    got = {}
    listings = spark.createDataFrame(rows, "row_no int, title string, cluster string, location string, hours_ago int")
    matches = serve.match_subscribers(listings, serve.read_subscribers(spark.createDataFrame(subs, "email string, roles string, cities string, unsubscribed boolean")))
    for r in matches.collect():
        got.setdefault(r.email, {})[r.place] = r.row_no
    fresh = sorted(rows, key=lambda r: (r[4], r[0]))
    for email, roles, cities, _ in subs:
        roles, cities = ([x.lower() for x in v.split(",") if x] for v in (roles, cities))
        hit = [r[0] for r in fresh if (not roles or any(x in f"{r[2]} {r[1] or ''}".lower() for x in roles)) and (not cities or any(x in (r[3] or "").lower() for x in cities))]
        assert got[email] == dict(enumerate((hit or [r[0] for r in fresh])[:8], 1)), (email, roles, cities)


def test_plan_of_matching_has_no_nested_loop_but_for_the_fallback(spark):
    rows = [(1, "t", "Design", "Pune", 3)]
    listings = spark.createDataFrame(rows, "row_no int, title string, cluster string, location string, hours_ago int")
    subs = spark.createDataFrame([("s", "design", "pune", False)], "email string, roles string, cities string, unsubscribed boolean")
    plan = serve.match_subscribers(listings, serve.read_subscribers(subs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct") <= 2  # it is printed once or twice


def test_first_keyword_of_a_large_taxonomy_wins(spark):
    rows = [(k, [f"key{k}", f"word{k % 50}"], [f"chip{k}"], [f"field{k}"]) for k in range(3000)]
    names = spark.createDataFrame([(f"A KEY{k} or word{k % 60} x",) for k in range(0, 3000, 37)], "title string")
    got = {r.title: r.subchips for r in taxonomy.related_terms(names, spark.createDataFrame(rows, taxonomy.SCHEMA)).collect()}
    for t, chips in got.items():
        want = next((c[0] for _, keys, c, _ in rows if any(k in t.lower() for k in keys)), "")
        assert chips == want, t
    assert len(got) == 82


@pytest.mark.parametrize("ratio", [0.85, 0.6])
def test_tiles_of_titles_lose_no_pair_and_leave_few(spark, ratio):
    """Blocks of a few titles, in many tiles; long titles, other scripts and frequent characters; far titles of the same characters go."""
    rng = random.Random(11)
    far = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz " * 2, 54)) for _ in range(300)]
    given = sorted({*titles(5, 60), *far, "ab" * 150, "ab" * 150 + "c", "日本語の求人" * 4, "日本語の求人" * 4 + "。", "😀" * 9, "😀" * 8, "x" * 70, "x" * 66 + "yy", "a", "b"})
    df = spark.createDataFrame([(t,) for t in given], "title string")
    pairs = [tuple(r) for r in matching.candidate_titles(df, ratio, block=16).collect()]
    want = {tuple(sorted((k, n))) for k in given for n in given if k != n and near(n, k, ratio)}
    assert want <= set(pairs) and len(pairs) == len(set(pairs)) and len(want) > 10
    assert all(x < y for x, y in pairs) and sum(x in far and y in far for x, y in pairs) <= (0 if ratio > 0.8 else 2000)
