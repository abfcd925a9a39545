"""Hard negatives, the Jaccard join and collocations against brute force, on the small tables and on awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest

from postsieve.llm import collocations, hard_negatives, jaccard_join
from postsieve.llm.common import table
from postsieve.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.llm import brute
from tests.llm.test_contracts import PLAIN, ROWS, awkward, same  # noqa: F401
from tests.test_queries import duck, plain  # noqa: F401

NEW = ["op11_hard_negatives", "op12_jaccard_join", "op13_collocations"]


@pytest.mark.parametrize("name", NEW)
def test_query_and_sql(spark, sf_dir, duck, name):  # noqa: F811
    df = LLM_QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(LLM_ORACLES[name])
    names = [d[0] for d in found.description]
    assert got and got == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


# Hard negatives.


def negatives(rows, every=50, positives=5, first=3):
    """rows: (vec_id, vector, label) that take part, in order."""
    dims = max(len(v) for _, v, _ in rows)
    x = [[math.floor(256 * c) for c in v] + [0] * (dims - len(v)) for _, v, _ in rows]
    out = []
    for a, (vec_id, _, label) in enumerate(rows):
        if vec_id % every:
            continue
        score = [sum(map(lambda p, q: p * q, x[a], y)) for y in x]
        order = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-score[i], rows[i][0], i))
        for p in [i for i in order if rows[i][2] == label][:positives]:
            ns = [i for i in order if rows[i][2] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:first]
            out += [(vec_id, rows[p][0], k + 1, rows[i][0], score[p], score[i]) for k, i in enumerate(ns)]
    return out


VECTORS = "vec_id bigint, embedding array<float>, label int, row string, cell string, block string"


def vectors(seed, n, dims, copies):
    """Clustered vectors, many of them equal."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    out = [(i, [float(np.float32(c + rng.gauss(0, 0.2))) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]
    return out + [(n + i, [float(np.float32(c)) for c in centres[0]], rng.randrange(4)) for i in range(copies)]


@pytest.mark.parametrize("p", [hard_negatives.HardNegatives(), hard_negatives.HardNegatives(split_points=5, sample=30, block_rows=64, arity=3, leaf=8, batch=4)])
def test_hard_negatives(spark, p):
    rows = vectors(3, 500, 6, 250)
    df = spark.createDataFrame([(*r, "r", "c", "b") for r in rows], VECTORS)
    want = negatives(rows)
    assert len(want) > 100 and same(hard_negatives.mine(df, p), want)


def test_hard_negatives_are_not_sent_through_the_driver(spark, monkeypatch):
    """What anchors make on their way to cells and blocks is larger than Spark takes it for, so no join's side is broadcast."""
    plans, names, run = [], [], hard_negatives.materialise

    def spy(df, name, *more):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        names.append(name)
        return run(df, name, *more)

    monkeypatch.setattr(hard_negatives, "materialise", spy)
    out = hard_negatives.mine(spark.createDataFrame([(*r, "r", "c", "b") for r in vectors(3, 200, 6, 50)], VECTORS))
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert sum("SortMergeJoin" in x for x in plans) >= 3 and not any("Broadcast" in x for x in plans)
    assert "sample" in names  # made by tasks: each one's first rows don't come to the driver


def test_hard_negatives_of_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(0, [1.0, 0.5], 1), (50, [1.0], 1), (50, [1.0], 1), (3, [0.75, -0.25], 2), (4, [0.75, -0.25], 2), (5, [0.5, 0.5], 1), (6, [0.25, 1.0], 3), (7, [], 2), (100, [-1.0, 0.0], 1), (101, [0.0, 0.0], 1)]
    bad = [(None, [1.0, 1.0], 1), (150, None, 1), (200, [1.0, 1.0], None), (250, [1.0, None], 1), (300, [nan, 1.0], 1), (350, [inf, 1.0], 1)]
    df = spark.createDataFrame([(*r, None, None, None) for r in good + bad], VECTORS).coalesce(1)
    assert same(hard_negatives.mine(df), negatives(good))
    assert hard_negatives.mine(df.limit(0)).count() == 0 and hard_negatives.mine(df.filter("vec_id = 7")).count() == 0
    large = [(0, [6e5, 2e5], 1), (1, [4e5, 2e5], 1), (2, [3e5, 1.8e5], 2), (3, [2.8e5, 2e5], 2)]  # products beyond 2^53
    exact = spark.createDataFrame([(*r, None, None, None) for r in large], VECTORS).coalesce(1)
    assert same(hard_negatives.mine(exact), negatives(large))
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(0, [1e30], 1, None, None, None)], VECTORS))


def test_no_subtree_within_a_window_is_left_out():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 60, (900, 5)))
    p, k = hard_negatives.HardNegatives(arity=4, leaf=16), hard_negatives.numbers(5, 500, 1e6)
    tree, ids, labels = hard_negatives.Tree(x.astype(k.exact), p, k), np.arange(900), np.zeros(900, np.int32)
    lows = rng.integers(-9000, 9000, (900, 2))
    q = hard_negatives.Queries(ids - 1000, labels, x.astype(k.exact), lows.copy(), lows + 1500, lows.copy())
    a, w, r, s = tree.search(q, ids, ids, labels, True, 1000)
    score = x @ x.T
    want = {(i, j, z) for j in range(2) for i, z in zip(*np.nonzero((score >= lows[:, j : j + 1]) & (score <= lows[:, j : j + 1] + 1500)), strict=True)}
    assert set(zip(a.tolist(), w.tolist(), r.tolist(), strict=True)) == want and (s == score[a, r]).all()


# Jaccard join.


def edited(seed, n, longest):
    """Texts of few words and close variants of each other, of all sizes around the boundary of light sets."""
    rng, out = random.Random(seed), []
    for i in range(n):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, longest))] if not out or rng.random() < 0.3 else rng.choice(out)[1].split()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(base) + 1)
            base[at : at + rng.randrange(2)] = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(2))]
        out.append((i, " ".join(base)))
    return out


@pytest.mark.parametrize(("words", "percent", "most"), [(1, 85, 64), (2, 70, 64), (1, 60, 8)])
def test_jaccard_join(spark, words, percent, most):
    docs = edited(words * percent + most, 400, 40)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    p = jaccard_join.JaccardJoin(words, percent, max_light=most, chunk=500, bucket=64)
    want = [r[:3] for r in brute.near_dup(docs, words, percent)]
    assert sum(c != d for d, _, c in want) > 50 and same(jaccard_join.join(df, p), want)


def test_jaccard_join_of_awkward_rows(spark, awkward):  # noqa: F811
    d = awkward.withColumnsRenamed({"lang": "n", "n_words": "fingerprint", "secrets": "component"})
    got = [tuple(r) for r in jaccard_join.join(d, jaccard_join.JaccardJoin(4, 85)).collect()]
    assert Counter(got) == Counter(r[:3] for r in brute.near_dup(PLAIN, 4, 85))
    assert jaccard_join.join(d.limit(0)).count() == 0


def test_jaccard_join_of_a_large_group(spark):
    """Near copies, each of another cut, of which many pairs lie under the threshold."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(w for w in base if rng.random() > 0.06)) for i in range(200)] + [(200 + i, " ".join(base[: 60 + i])) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert same(jaccard_join.join(df, jaccard_join.JaccardJoin(1, 85)), [r[:3] for r in brute.near_dup(docs, 1, 85)])


def test_boundary_by_cost():
    p = jaccard_join.JaccardJoin(4, 85)
    assert jaccard_join.boundary({}, p) == 0
    assert jaccard_join.boundary({n: (100, 0) for n in range(1, 60)}, p) < 6  # nothing to scan
    low, high = (jaccard_join.boundary({n: (100, 100 * scan) for n in range(1, 60)}, p) for scan in (4, 400))
    assert 6 <= low < high
    kinds = {n: p.kinds(n, 64) for n in range(1, 65)}
    assert all(a in (n, *p.partners(n)) and k == p.overlap(a, b) for n, v in kinds.items() for a, b, k in v)
    assert kinds[5] == [] and (6, 7, 6) in kinds[6] and (6, 7, 6) in kinds[7]


# Collocations.


def mined(docs, often, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(brute.LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {x: a for x, a in c.items() if len(x) > 1 and a >= often}
        gone = {x[i:j] for x, a in found.items() for i in range(len(x)) for j in range(i + 2, len(x) + 1) if j - i < len(x) and c[x[i:j]] == a}
        rows = []
        for x, a in found.items():
            if x not in gone:
                score, k = min((1000 * a * n[lang] // (c[x[:k]] * c[x[k:]]), k) for k in range(1, len(x)))
                rows.append((-score, -a, " ".join(x).encode(), c[x[:k]], c[x[k:]]))
        out += [(lang, i + 1, x.decode(), -a, l, r, n[lang], -s) for i, (s, a, x, l, r) in enumerate(sorted(rows)[:top])]
    return out


AWKWARD = [
    ("New York is big, new york IS big! new york is small", "en"), ("new york\x0bnew\tyork  new york", "en"), (None, "en"), ("", "de"), ("... ;;", None), ("new york new york new york", None), ("a a a a a a a a", "x"),
    ("É é ﬁ　ﬁ \x00 \x1c \x00 \x1c \x00 \x1c", "fr"), ("b c d e f g. " * 7, "x"), ("b c d e f g. " * 7, "x"), (" ".join(f"w{i % 50}" for i in range(30_000)), "long"),
]


@pytest.mark.parametrize("p", [collocations.Collocations(often=3, top=9), collocations.Collocations(often=2, top=5, entries=40, burst=4, tokens=64, filter_bits=8, partition_words=500)])
def test_collocations(spark, p):
    df = spark.createDataFrame([(*r, "x", "y") for r in AWKWARD], "text string, lang string, words string, n string").repartition(3)
    assert same(collocations.collocations(df, p), mined(AWKWARD, p.often, p.top))
    assert collocations.collocations(df.limit(0), p).count() == 0


def test_collocations_of_the_table(spark, sf_dir):
    docs = [(r.text, r.lang) for r in table(spark, sf_dir, "documents").select("text", "lang").collect()]
    p = replace(collocations.Collocations(), often=20, top=300)
    assert same(collocations.collocations(table(spark, sf_dir, "documents"), p), mined(docs, 20, 300))


def test_scores_beyond_64_bits(spark, monkeypatch):
    """1000 a n passes 64 bits; the floor is exact."""
    key = lambda *w: np.array(w, np.uint64).tobytes()
    counts = {key(1): 3_000_000_000_000_037, key(2): 2_999_999_999_999_999, key(1, 2): 1_999_999_999_999_993}
    total = 9_007_199_254_740_993
    given = (spark.createDataFrame(list(counts.items()), "words binary, f bigint"), spark.createDataFrame([(1, "en", "x"), (2, "en", "y")], "id bigint, lang string, word string"), spark.createDataFrame([("en", total)], "lang string, n bigint"))
    monkeypatch.setattr(collocations, "phrases", lambda *_: given)
    monkeypatch.setattr(collocations, "small", lambda d: d)
    a, l, r = counts[key(1, 2)], counts[key(1)], counts[key(2)]
    assert same(collocations.collocations(None), [("en", 1, "x y", a, l, r, total, 1000 * a * total // (l * r))])


def test_trie_spills_and_merges():
    rng = np.random.default_rng(2)
    for length in (2, 3, 5):
        p = collocations.Collocations(burst=3)
        trie, want, got = collocations.HatTrie(length, p), Counter(), Counter()
        for _ in range(30):
            x = rng.integers(1, 5, (80, length)).astype(np.uint64)
            want.update(map(tuple, x.tolist()))
            trie.add(*collocations.distinct(x))
            if trie.entries > 20:
                w, n = trie.spill(10)
                assert trie.entries <= 10 and w.tolist() == sorted(w.tolist())
                got.update(dict(zip(map(tuple, w.tolist()), n.tolist(), strict=True)))
        if (rest := trie.spill(0)) is not None:
            got.update(dict(zip(map(tuple, rest[0].tolist()), rest[1].tolist(), strict=True)))
        assert got == want
