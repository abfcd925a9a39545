"""Scoring, passages, licenses, training order and the pipeline against brute force and round trips."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from postsieve.llm import decontaminate, licenses, lm_scoring, near_dup, passages, quality_rules, secrets, sentencepieces, training_order
from postsieve.llm.common import new_path, table
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, tail string, row string, score string"


def small_docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)


AWKWARD = [(1, "One two  three"), (2, None), (3, ""), (None, "one TWO"), (None, None), (4, " \t\n"), (5, "two two É é"), (5, "two two É é"), (14, "only held out words w9"), (6, "x " * 400), (7, "a▁b ▁ A▁b\nc  d"), (8, " lead"), (9, "w" * 5000 + " long" * 30_000)]


def base_scores(rows):
    token = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(x for d, t in rows if not held(d) for x in token(t))
    n, v = sum(counts.values()), len(counts)
    for d, t in rows:
        yield d, held(d), len(token(t)), sum(counts[x] > 0 for x in token(t)), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in token(t))


@pytest.mark.parametrize("awkward", [True, False])
def test_base_scores(spark, sf_dir, awkward):
    rows = AWKWARD if awkward else [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = lm_scoring.score(small_docs(spark, rows)).collect()
    want = list(base_scores(rows))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], round(r[5], 6))
    for g, w in zip(sorted(([r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score] for r in got), key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == w[:5] and abs(g[5] - w[5]) < 1e-6
    assert all(r.score < 0 for r in got)


def test_words_and_their_buckets():
    chars = [c for c in map(chr, range(0x3100)) if not 0xD800 <= ord(c) < 0xE000]
    texts = [*(f"A{c}b" for c in chars), *(f"{c}x{c}" for c in chars), None, "", " ", "K İ ſ", "w" * 300]
    words, codes, sizes = lm_scoring.base_words(pa.array(texts)[1:])
    assert [words[c].as_py().encode() for c in codes] == [w for t in texts[1:] for w in (t or "").encode().lower().split()]
    assert sizes.tolist() == [len((t or "").encode().lower().split()) for t in texts[1:]]
    raw, order, bucket = lm_scoring.dealt(words)
    assert raw.to_pylist() == [words[i].as_py().encode() for i in order] and (np.diff(bucket) >= 0).all() and sorted(order) == list(range(len(words)))
    _, again, other = lm_scoring.dealt(words[::-1].take(pa.array(range(len(words)))))
    assert dict(zip(raw.to_pylist(), bucket)) == {words[len(words) - 1 - i].as_py().encode(): b for i, b in zip(again, other)}
    many, _, spread = lm_scoring.dealt(pa.array([f"word{i}" for i in range(200_000)]))
    assert np.bincount(spread, minlength=1 << lm_scoring.BUCKET_BITS).max() < 4 * len(many) >> lm_scoring.BUCKET_BITS


def test_word_counts(spark):
    rows = [*AWKWARD, *((100 + i, f"two w{i % 7} rare{i}\n" * (1 + i % 5)) for i in range(200))]
    docs = small_docs(spark, rows).coalesce(2)
    folder = lm_scoring.word_counts(docs.selectExpr("text", "true AS train"))
    got = spark.read.parquet(folder)
    assert got.agg({"total": "sum"}).first()[0] == sum(len((t or "").encode().lower().split()) for _, t in rows)
    assert got.agg({"known": "sum"}).first()[0] == len({w for _, t in rows for w in (t or "").encode().lower().split()})
    long = [(i, f"two w{i % 7} rare{i}\n" * (2000 + i % 5)) for i in range(400)]  # several slices a partition
    docs = small_docs(spark, long).coalesce(1)
    assert spark.read.parquet(lm_scoring.word_counts(docs.selectExpr("text", "doc_id < 390 AS train"))).selectExpr("max(slice) > 0", "sum(total)", "sum(known)").first() == (True, sum(3 * (2000 + i % 5) for i in range(390)), 398)
    for g, w in zip(sorted(lm_scoring.score(docs, lm_scoring.Model(rounds=0)).collect()), sorted(base_scores(long)), strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5] and abs(g.base_score / w[5] - 1) < 1e-9


def test_no_rows_to_score(spark):
    assert lm_scoring.score(small_docs(spark, [(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 4, 100])
def test_words_of_earlier_slices_are_segmented_once(most):
    lib, asked = sentencepieces.model(sentencepieces.model_path()), []

    class Spy:
        def flat(self, words):
            asked.extend(words)
            return lib.flat(words)

    kept = sentencepieces.Kept(Spy(), most)
    for words in (["one", "", "two"], ["three", "two", "one"], [], ["zürich", "three", "", "one", "four"], ["zürich"]):
        ids, n = kept.flat(pa.array(words, pa.string()))
        want, sizes = lib.flat(words)
        assert ids.tolist() == want.tolist() and n.tolist() == sizes.tolist()
    assert len(asked) == {0: 12, 4: 7, 100: 6}[most]


def test_gradients():
    m = lm_scoring.Model(window=6, stride=4, width=4, classes=3)
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.3 for k, v in m.start(7).items()}
    x, y, use = rng.integers(0, 7, (5, 6)), rng.integers(0, 3, (5, 6)), rng.random((5, 6)) > 0.3
    _, grads = lm_scoring.backward(w, x, y, use)
    for k in w:
        at = tuple(rng.integers(0, s) for s in w[k].shape)
        up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
        if k == "E":
            rows, given = grads[k]
            grads[k] = np.zeros_like(w[k])
            grads[k][rows] = given
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        slope = (lm_scoring.backward(up, x, y, use)[0] - lm_scoring.backward(down, x, y, use)[0]) / 2e-4
        assert abs(slope - grads[k][at]) < 1e-3 * max(1, abs(slope))


def test_windows_score_each_token_once_and_causally():
    m = lm_scoring.Model(window=8, stride=5)
    ids = [np.arange(1, n + 2) for n in (1, 3, 8, 9, 13, 40)]
    x, y, use, text = lm_scoring.windows(ids, m)
    for k, i in enumerate(ids):
        assert sorted(y[text == k][use[text == k]]) == list(i[1:])
        assert all((y[text == k] == x[text == k] + 1)[use[text == k]])
    w = m.start(50)
    changed = x[:1].copy()
    changed[0, 5] = 49
    a, b = lm_scoring.forward(w, x[:1])[0], lm_scoring.forward(w, changed)[0]
    assert np.allclose(a[:, :5], b[:, :5]) and not np.allclose(a[:, 5:], b[:, 5:]) and np.allclose(a.sum(0), 1)


def test_model_learns(spark):
    """Held-out texts of a language with context score above their class unigram."""
    rng = np.random.default_rng(2)
    nouns = ["cat", "dog", "sun", "bird"]
    rows = [(i, " ".join(f"the {a} saw the {b} and then" for a, b in rng.choice(nouns, (40, 2)))) for i in range(160)]
    docs = small_docs(spark, rows)
    m = lm_scoring.Model(shares=1, rounds=3, batch=16)
    trained = {r.doc_id: r.score for r in lm_scoring.score(docs, m).filter("held_out").collect()}
    start = {r.doc_id: r.score for r in lm_scoring.score(docs, lm_scoring.Model(rounds=0)).filter("held_out").collect()}
    assert trained and all(trained[d] > 0.6 * start[d] for d in trained)


def test_every_training_document_reaches_the_model(spark, monkeypatch):
    """With the settings of the registered query; no document here is of the crc32 remainders 0 and 1 of 24."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) // 7 % 24 > 1]
    docs = small_docs(spark, [(i, f"d{i} " + "the cat saw the dog and then " * 40) for i in ids])
    reached, run, lib = [], lm_scoring.train_round, sentencepieces.model(sentencepieces.model_path()).lib

    def spy(part, *more):
        reached.extend(lib.decode(np.frombuffer(r.ids, "<u4").tolist()).split()[0] for r in part.collect())
        return run(part, *more)

    monkeypatch.setattr(lm_scoring, "train_round", spy)
    trained = {r.doc_id: r.score for r in lm_scoring.score(docs).filter("held_out").collect()}
    assert sorted(reached) == sorted(f"d{i}" for i in ids if zlib.crc32(str(i).encode()) % 7 != 2)
    start = {r.doc_id: r.score for r in lm_scoring.score(docs, lm_scoring.Model(rounds=0)).collect()}
    assert trained and all(s > start[d] + 1 for d, s in trained.items())
    m = lm_scoring.Model()
    assert m.window >= 32 and m.window - m.stride >= 8 and m.classes >= 64


def test_scores_against_one_position_at_a_time(spark):
    """The column score of an untrained model, computed anew from each token's own window."""
    m = lm_scoring.Model(window=8, stride=5, rounds=0)
    rows = [(i, t) for i, t in enumerate(["one two three four five six seven", "", "the cat and the dog " * 9, None])]
    got = {r.doc_id: r.score for r in lm_scoring.score(small_docs(spark, rows), m).collect()}
    lib = sentencepieces.model(sentencepieces.model_path()).lib
    ids = {d: lib.encode(t or "", add_bos=True, add_eos=True) for d, t in rows}
    counts = np.zeros(lib.get_piece_size())
    for d, i in ids.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            np.add.at(counts, i[1:], 1)
    cls, within = lm_scoring.classes(counts, m.classes)
    w = m.start(len(counts))
    for d, i in ids.items():
        total = 0.0
        for k in range(1, len(i)):
            first = 0 if k <= m.window else m.stride * -(-(k - m.window) // m.stride)
            x = np.array(i[first:k])
            h = (w["E"][x] + w["P"][: len(x)]).astype(np.float64)
            q, key, v = np.split(h @ w["W"], 3, axis=-1)
            s = np.exp(key @ q[-1] / 4)
            z = h[-1] + (s @ v / s.sum()) @ w["O"]
            e = np.exp(z @ w["C"] + w["b"])
            total += math.log10(e[cls[i[k]]] / e.sum()) + within[i[k]] / math.log(10)
        assert abs(total - got[d]) < 1e-3 * max(1, abs(total))


def test_class_shares_sum_to_one():
    cls, within = lm_scoring.classes(np.array([50.0, 0, 3, 3, 100, 7, 0, 1]), 4)
    sums = np.bincount(cls, np.exp(within))
    assert np.allclose(sums[np.unique(cls)], 1)


PASSAGE = " ".join(f"p{i}" for i in range(60))
FILL = lambda a, n: " ".join(f"{a}{i}" for i in range(n))


def test_passages(spark):
    edited = PASSAGE.split()
    edited[20] = "changed"
    del edited[40]
    rows = [
        (1, f"{FILL('a', 80)} {PASSAGE} {FILL('b', 30)}"), (2, f"{FILL('c', 10)} {PASSAGE.upper()} {FILL('d', 90)}"), (3, f"{FILL('e', 70)} {' '.join(edited)} {FILL('f', 9)}"), (4, FILL("g", 200)), (5, FILL("g", 200)),
        (6, f"{FILL('h', 60)} {' '.join(PASSAGE.split()[:40])} {FILL('i', 60)}"), (7, None), (8, ""), (9, PASSAGE.split()[0]), (None, f"{FILL('j', 10)} {PASSAGE}"),
    ]
    got = {(r.doc_id, r.src_doc_id): r for r in passages.passages(small_docs(spark, rows)).collect()}
    assert set(got) in ({(2, 1), (3, 1), (None, 1), (5, 4)}, {(2, 1), (3, 1), (None, 1), (4, 5)})
    r = got[2, 1]
    assert (r.start, r.end, r.src_start, r.src_end, r.n_equal, r.percent) == (10, 70, 80, 140, 60, 100)
    r = got[3, 1]
    assert (r.start, r.end, r.src_start, r.src_end, r.n_equal) == (70, 129, 80, 140, 58)
    assert passages.passages(small_docs(spark, rows).limit(0)).count() == 0


def test_passages_beside_text_that_half_agrees(spark):
    rows = lambda own: " ".join(f"{FILL(f'{own}{k}_', 4)} row{k} of the list" for k in range(12))
    docs = [(1, f"{rows('a')} {PASSAGE} {rows('b')}"), (2, f"{rows('c')} {PASSAGE} {rows('d')}")]
    found = passages.passages(small_docs(spark, docs)).collect()
    assert len(found) == 1
    r = found[0]
    assert r.start <= 96 and r.end >= 156 and r.start == r.src_start and r.end == r.src_end and r.percent >= 80 and r.n_equal >= 60


def test_parts_that_are_equal_enough():
    rng, p = np.random.default_rng(8), passages.Passages(min_words=12)
    for _ in range(200):
        runs, i, j = [], 0, 0
        for _ in range(int(rng.integers(1, 12))):
            size = int(rng.integers(1, 12))
            runs.append((i, j, size))
            i, j = i + size + int(rng.integers(0, 5)), j + size + int(rng.integers(0, 5))
        parts = [(sum(r[2] for r in runs[s:e]), runs[s][0], runs[e - 1][0] + runs[e - 1][2], runs[s][1], runs[e - 1][1] + runs[e - 1][2]) for s in range(len(runs)) for e in range(s + 1, len(runs) + 1)]
        good = [x for x in parts if x[0] >= 12 and 100 * x[0] >= 80 * max(x[2] - x[1], x[4] - x[3])]
        got = passages.equal_enough(runs, p)
        assert all((n, s, e, t, g) in good for s, e, t, g, n in got) and bool(got) == bool(good)
        assert not good or got[0][4] == max(x[0] for x in good)
        assert all(any(s < x[2] and x[1] < e for s, e, *_ in got) for x in good)


def test_passages_of_many_copies(spark):
    rows = [(i, f"{FILL(f'x{i}_', 20)} {PASSAGE} {FILL(f'y{i}_', 20)}") for i in range(300)]
    got = passages.passages(small_docs(spark, rows)).collect()
    assert len(got) == 299 and len({r.doc_id for r in got}) == 299 and {r.n_equal for r in got} == {60}


def test_passages_against_brute_force(spark, sf_dir):
    """Of the words that lie in 50 equal words of an earlier document, nearly all are found; of other documents, none."""
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    first, want = {}, {}
    for k, (d, t) in enumerate(rows):
        w = passages.words_of((t or "").encode())
        grams = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        hit = {i + j for i, g in enumerate(grams) if first.setdefault(g, k) < k for j in range(50)}
        want |= {d: hit} if hit else {}
    got = {}
    for r in passages.op6_passages(spark, sf_dir).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    recall = sum(len(h & got.get(d, set())) for d, h in want.items()) / sum(map(len, want.values()))
    print("recall", recall, "documents", len(want))
    assert recall >= 0.95 and sum(d in got for d in want) >= 0.97 * len(want)


@pytest.mark.parametrize(("every", "least"), [(12, 0.9), (9, 0.6)])
def test_recall_of_edited_passages(spark, every, least):
    """Passages of 120 words of which every so many-th is replaced in the later copy."""
    rng, rows = np.random.default_rng(every), []
    for k in range(60):
        words = [f"v{k}_{x}" for x in rng.integers(0, 10**6, 120)]
        edited = [f"e{k}_{i}" if i % every == every - 1 else w for i, w in enumerate(words)]
        rows += [(2 * k, f"{FILL(f'a{k}_', 30)} {' '.join(words)} {FILL(f'b{k}_', 30)}"), (2 * k + 1, f"{FILL(f'c{k}_', 20)} {' '.join(edited)} {FILL(f'd{k}_', 50)}")]
    found = {r.doc_id // 2 for r in passages.passages(small_docs(spark, rows)).collect()}
    print("recall", len(found) / 60)
    assert len(found) >= least * 60


def test_passage_behind_other_first_holders(spark):
    """A and B share 30 words that X has and 30 that Y has, one after the other: neither X nor Y holds 50 of them."""
    a, b = FILL("m", 30), FILL("n", 30)
    rows = [(1, f"{FILL('x', 60)} {a}"), (2, f"{b} {FILL('y', 60)}"), (3, f"{FILL('u', 20)} {a} {b} {FILL('v', 20)}"), (4, f"{FILL('w', 33)} {a} {b} {FILL('z', 9)}")]
    found = {(r.doc_id, r.src_doc_id, r.n_equal) for r in passages.passages(small_docs(spark, rows).coalesce(1)).collect()}
    assert found == {(4, 3, 60)}


def test_passage_whose_words_all_have_other_holders(spark):
    """1 and 100 share 60 words; all of them, 20 at a time, also lie in earlier texts than 1 and in later ones."""
    words = PASSAGE.split()
    pieces = [" ".join(words[i : i + 20]) for i in range(0, 50, 10)]
    rows = [(i, f"{FILL(f'x{i}_', 40)} {pieces[k]} {FILL(f'y{i}_', 40)}") for i, k in [(20 + k, k) for k in range(5)] + [(60 + k, k) for k in range(5)]]
    rows = [*rows[:5], (1, f"{FILL('c', 20)} {PASSAGE} {FILL('d', 20)}"), *rows[5:], (100, f"{FILL('e', 33)} {PASSAGE} {FILL('f', 9)}")]
    found = {(r.doc_id, r.src_doc_id, r.n_equal) for r in passages.passages(small_docs(spark, rows).coalesce(1)).collect()}
    assert found == {(100, 1, 60)}


def test_passages_of_all_pairs_are_not_kept():
    """Of two blocks' pairs each row keeps the passages that lie in no other; pairs and results are the same however rows are dealt."""
    p, texts = passages.Passages(), [f"{FILL(f'c{k}_', 20 + k)} {PASSAGE} {FILL(f'd{k}_', 20)}" for k in range(6)]
    rows, ids = [], {}
    for k, text in enumerate(texts):
        w = text.split()
        seeds = [ids.setdefault(tuple(w[i : i + 4]), len(ids)) for i in range(len(w) - 3)]
        places = list(range(len(seeds)))
        rows.append({"row": 10 + k, "doc_id": 5 * k if k else None, "text": text, "seeds": seeds, "places": places, "own_seeds": seeds if k else None, "own_places": places if k else None, "asked": seeds if k else None, "answered": seeds if k < 5 else None})
    kind = pa.schema([(c, pa.int64()) for c in ("row", "doc_id")] + [("text", pa.string())] + [(c, pa.list_(pa.int32() if "places" in c else pa.int64())) for c in ("seeds", "places", "own_seeds", "own_places", "asked", "answered")])
    for size in (6, 2, 1):
        blocks = [passages.Block(pa.Table.from_pylist(rows[a : a + size], schema=kind)) for a in range(0, 6, size)]
        found = [f for i, own in enumerate(blocks) for src in blocks[: i + 1] for f in passages.passages_of_blocks(own, src, p)]
        assert sorted({f[:2] for f in found}) == [(10 + k, 10 + j) for k in range(1, 6) for j in range(k)]
        kept = [f for f in found if f[4] is not None]
        assert {f for f in kept if f[1] == 10} == {(10 + k, 10, 5 * k, None, 20 + k, 80 + k, 20, 80, 60, 100) for k in range(1, 6)}
        assert size < 6 or len(kept) == 5
        best = {k: passages.longest([(*f[3:], f[1]) for f in kept if f[0] == k]) for k in range(11, 16)}
        assert all(len(x) == 1 and x[0][-1] == 10 for x in best.values())
    assert passages.longest([(7, 0, 9, 3, 12), (2, 0, 9, 4, 13), (1, 1, 9, 0, 8), (1, 5, 11, 0, 6)]) == [(2, 0, 9, 4, 13), (1, 5, 11, 0, 6)]


def plain_walk(a, b, i, j, step, p):
    n, m, runs = len(a), len(b), []
    while 0 <= i < n and 0 <= j < m:
        size = 0
        while 0 <= i < n and 0 <= j < m and a[i] == b[j]:
            size, i, j = size + 1, i + step, j + step
        if size:
            runs.append((i - size, j - size, size) if step > 0 else (i + 1, j + 1, size))
        edits = [(i + step * s, j + step * (skip - s)) for skip in range(1, p.max_skip + 1) for s in range(skip + 1)]
        fits = lambda u, v: all(0 <= u + step * e < n and 0 <= v + step * e < m and a[u + step * e] == b[v + step * e] for e in range(p.resume))
        i, j = next((x for x in edits if fits(*x)), (n, m))
    return runs


def test_walks_that_share_their_ends():
    rng, p = np.random.default_rng(9), passages.Passages()
    for most in (2, 3, 60):
        a, b = ([b"%d" % x for x in rng.integers(0, most, 70)] for _ in range(2))
        b[10:60] = a[:30] + a[33:53]
        walks = passages.Walker(a, b, p)
        for i, j, step in zip(rng.integers(-1, 71, 600).tolist(), rng.integers(-1, 71, 600).tolist(), rng.choice([-1, 1], 600).tolist(), strict=True):
            assert walks.extend(i, j, step) == plain_walk(a, b, i, j, step, p)


def test_passages_of_short_runs(spark):
    """Every fifth word is replaced: 52 equal words of 64, four in a row."""
    rows = []
    for k in range(30):
        words = FILL(f"v{k}_", 64).split()
        edited = [f"e{k}_{i}" if i % 5 == 4 else w for i, w in enumerate(words)]
        rows += [(2 * k, f"{FILL(f'a{k}_', 30)} {' '.join(words)} {FILL(f'b{k}_', 30)}"), (2 * k + 1, f"{FILL(f'c{k}_', 20)} {' '.join(edited)} {FILL(f'd{k}_', 50)}")]
    assert {(r.doc_id // 2, r.n_equal) for r in passages.passages(small_docs(spark, rows)).collect()} == {(k, 52) for k in range(30)}


def test_no_passage_lies_outside_those_listed(spark, sf_dir):
    """All pairs of the given documents and of made-up mosaics, aligned from all words that four in a row are shared."""
    rng, p = np.random.default_rng(4), passages.Passages()
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    pool, starts = [f"m{i}" for i in range(400)], rng.integers(0, 350, 25)
    for k in range(60):
        words = [w for a in rng.choice(starts, 10) for w in pool[a : a + int(rng.integers(8, 60))]]
        rows.append((10**6 + k, " ".join(f"o{k}_{i}" if rng.random() < 0.06 else w for i, w in enumerate(words))))
    docs, listed, held, met, n = [passages.words_of((t or "").encode()) for _, t in rows], {}, {}, {}, 0
    for r in passages.passages(small_docs(spark, [(k, t) for k, (_, t) in enumerate(rows)]).coalesce(1), p).collect():
        listed.setdefault(r.doc_id, []).append((r.start, r.end))
    for d, w in enumerate(docs):
        for i in range(len(w) - 3):
            held.setdefault(tuple(w[i : i + 4]), []).append((d, i))
    for at in held.values():
        for d, i in at:
            for e, j in at:
                if d > e and docs[d] != docs[e]:
                    met.setdefault((d, e), []).append((i, j))
    for (d, e), places in met.items():
        if len(places) >= 10:
            x, y = map(list, zip(*sorted(places), strict=True))
            for s, t, *_ in passages.align(docs[d], docs[e], x, y, p)[0]:
                n += 1
                assert any(a < t and s < b for a, b in listed.get(d, ())), (d, e, s, t)
    print("passages of pairs", n)
    assert n > 100


def test_frequent_runs_in_other_orders_are_no_pairs(spark, monkeypatch):
    """Texts of the same word runs in other orders share most of their k-mers; only two of them hold a passage."""
    rng, made, run = np.random.default_rng(6), {}, passages.materialise
    texts = [" ".join(" ".join(f"r{k}w{j}" for j in range(4)) for k in rng.permutation(90)) for _ in range(12)]
    words = texts[3].split()
    words[100:181:9] = [f"other{i}" for i in range(9)]
    texts.append(" ".join([texts[7], *words[95:185]]))

    def spy(df, name, *more):
        made[name] = run(df, name, *more)
        return made[name]

    monkeypatch.setattr(passages, "materialise", spy)
    found = passages.passages(small_docs(spark, list(enumerate(texts))).coalesce(1)).collect()
    assert {(r.doc_id, r.src_doc_id) for r in found} == {(12, 3), (12, 7)}
    assert {(r.row, r.src) for r in made["pairs_of_rest"].collect()} <= {(12, 3)}


def test_k_mers_of_pairs_are_not_written(spark, monkeypatch):
    """The second round, in blocks of one row: its tables hold no k-mers and no texts of pairs."""
    rng, made, run = np.random.default_rng(6), {}, passages.materialise
    texts = [" ".join(" ".join(f"r{k}w{j}" for j in range(4)) for k in rng.permutation(90)) for _ in range(12)]
    words = texts[3].split()
    words[100:181:9] = [f"other{i}" for i in range(9)]
    texts.append(" ".join([texts[7], *words[95:185]]))

    def spy(df, name, *more):
        made.setdefault(name, []).append(df.columns)
        return run(df, name, *more)

    monkeypatch.setattr(passages, "materialise", spy)
    monkeypatch.setattr(passages, "BLOCK_ROWS", 1)
    found = passages.passages(small_docs(spark, list(enumerate(texts))).coalesce(1)).collect()
    assert {(r.doc_id, r.src_doc_id) for r in found} == {(12, 3), (12, 7)}
    assert made["pairs_of_rest"] == [["row", "src", "doc_id", "src_doc_id", "start", "end", "src_start", "src_end", "n_equal", "percent"]]
    assert made["pairs_of_blocks"] == [["own", "src"]] and "candidates" not in made


def test_k_mers_of_passages_stay():
    rng, p, n = np.random.default_rng(7), passages.Passages(min_words=16), 0
    for _ in range(150):
        a = [b"%d" % i for i in rng.integers(0, 9, 120)]
        b = [w for w in a for w in [w] * int(rng.choice([0, 1, 1, 1, 1, 1, 1, 1, 1, 2]))][rng.integers(0, 20) :]
        at = np.array([(i, j) for i in range(len(a) - 3) for j in range(len(b) - 3) if a[i : i + 4] == b[j : j + 4]]).reshape(-1, 2)
        keep = passages.chained(np.zeros(len(at), int), at[:, 0], at[:, 1], p)
        stay = {tuple(v) for v in at[keep].tolist()}
        for i, j in at.tolist():
            runs = [*passages._extend(a, b, i - 1, j - 1, -1, p)[::-1], *passages._extend(a, b, i, j, 1, p)]
            for *_, same in passages.equal_enough(runs, p):
                n += 1
                assert same < p.min_words or (i, j) in stay
    assert n > 1000
    for many in (1, 40, 1 << 21):  # pairs in one call, and looked at together or not
        hashes = [100 * k + rng.permutation(40) for k in range(6)]
        sides = [(np.concatenate([hashes[k] for k in ks]), np.tile(np.arange(40), 3), np.full(3, 40)) for ks in ((0, 1, 2), (3, 1, 5))]
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(passages, "MOST_COMMON", many)
            assert [(of.tolist(), x.tolist(), y.tolist()) for of, x, y in passages.met_by(*sides, p) if len(of)] == [([1], [0], [0])]


def test_passages_of_a_frequent_seed_and_long_texts(spark):
    """With groups of a few rows, and texts of 30,000 words that share one passage."""
    rows = [(i, f"{FILL(f'x{i}_', 20)} {PASSAGE} {FILL(f'y{i}_', 20)}") for i in range(60)] + [(100 + i, f"{FILL(f'l{i}_', 30_000)} {PASSAGE}") for i in range(2)]
    got = passages.passages(small_docs(spark, rows), passages.Passages(group=7)).collect()
    assert len(got) == 61 and len({r.doc_id for r in got}) == 61 and {r.n_equal for r in got} == {60}


def chain_model(x, y, p):
    order = sorted(range(len(x)), key=lambda i: (x[i], -y[i]))
    f = {}
    for i in order:
        f[i] = p.k + max([0.0] + [f[j] - p.gap_cost * ((x[i] - x[j]) + (y[i] - y[j])) for j in f if x[j] < x[i] and y[j] < y[i]])
    return max(f.values())


def test_passages_whose_words_are_fetched_again(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(150)
    shared = " ".join(f"s{i}" for i in range(700))
    longer = [(10**6 + k, " ".join(f"x{k}y{i}" for i in range(90)) + " " + shared + " " + " ".join(f"z{k}y{i}" for i in range(90))) for k in range(3)]
    docs = docs.unionByName(spark.createDataFrame(longer, "doc_id long, text string"))
    near, whole = (sorted(map(tuple, passages.passages(docs, passages.Passages(margin=m)).collect())) for m in (13, 10**7))
    assert near == whole and any(r[0] > 10**6 and r[3] - r[2] == 700 for r in near)


def test_chains_are_best():
    rng, p = np.random.default_rng(3), passages.Passages()
    for _ in range(60):
        n = int(rng.integers(1, 25))
        x, y = (list(map(int, rng.integers(0, 60, n))) for _ in range(2))
        found = passages.chains(x, y, p)
        assert sorted(i for c in found for i in c) == list(range(n))
        best = found[0]
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(best, best[1:]))
        score = p.k * len(best) - sum(p.gap_cost * ((x[b] - x[a]) + (y[b] - y[a])) for a, b in zip(best, best[1:]))
        assert abs(score - chain_model(x, y, p)) < 1e-9


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    rows = [
        (1, "Before.\nLicensed under the Apache License, Version 2.0.\nafter"), (2, "x " * 50 + mit.replace("without restriction", "with no restriction").upper()), (3, "a license to thrill, all rights are reserved"), (4, None), (5, ""),
        (6, "All rights reserved. " * 3), (None, "licensed under CC BY-NC 4.0."), (7, mit[: len(mit) // 3]),
    ]
    got = {r.doc_id: [(x.license, x.start, x.end, x.percent) for x in r.licenses] for r in licenses.scan_licenses(small_docs(spark, rows)).collect()}
    assert got[1] == [("Apache-2.0", 1, 9, 100)] and [x[0] for x in got[2]] == ["MIT"] and got[2][0][3] >= 90 and got[3] == got[4] == got[5] == got[7] == []
    assert [x[:3] for x in got[6]] == [("all-rights-reserved", k, k + 3) for k in (0, 3, 6)] and got[None][0][0] == "CC-BY-NC-4.0"
    assert licenses.scan_licenses(small_docs(spark, rows).limit(0)).count() == 0


def test_full_texts_and_families_of_licenses(spark):
    known = licenses.all_templates()
    texts = {name: max(known[name], key=len) for name in ("MPL-2.0", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT", "CC0-1.0")}
    assert all(len(t.split()) > 100 for t in texts.values())
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    lesser = gpl.replace("GNU General", "GNU Lesser General").replace("version 2", "version 3")
    cc = "This work is licensed under a Creative Commons Attribution{} {} International License."
    rows = list(texts.items()) + [("GPL-2.0", gpl), ("LGPL-3.0", lesser), ("AGPL-3.0", lesser.replace("Lesser", "Affero")), ("CC-BY-SA-4.0", cc.format("-ShareAlike", "4.0")), ("CC-BY-4.0", cc.format("", "4.0")), (None, cc.format("-ShareAlike", "3.0")), (None, gpl.replace("version 2", "version 1"))]
    docs = small_docs(spark, [(k, f"Some words before it. {t} And after it") for k, (_, t) in enumerate(rows)] + [(len(rows), texts["MIT"] + "\n" + texts["MIT"]), (len(rows) + 1, texts["MPL-2.0"] * 2)])
    got = {r.doc_id: [x.license for x in r.licenses] for r in licenses.scan_licenses(docs).collect()}
    assert [got[k] for k in range(len(rows))] == [[name] * (name is not None) for name, _ in rows]
    assert got[len(rows)] == ["MIT"] * 2 and got[len(rows) + 1] == ["MPL-2.0"] * 2


def test_patience_is_ordered_and_common():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = (list(rng.integers(0, 12, rng.integers(0, 20))) for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert licenses.patience(list("xabcdy"), list("abqcd")) == [(1, 0), (2, 1), (3, 3), (4, 4)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 5000])
def test_permutation(n):
    p = training_order.Permutation(n, 5)
    out = p(np.arange(n))
    assert sorted(out) == list(range(n)) and (p(out, back=True) == np.arange(n)).all()
    assert n < 257 or (out != training_order.Permutation(n, 6)(np.arange(n))).any()


def test_training_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "x"), (None, "", "y")], docs.schema))
    layout = training_order.Layout(length=64, shard_records=500)
    rows = training_order.write_shards(docs, new_path(spark, "shards"), layout).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    paths = {r.shard: r.path for r in rows}
    stored = [x for s in sorted(paths) for x in training_order.read_shard(paths[s], layout)]
    assert [zlib.crc32(x.tobytes()) for x in stored] == [r.crc32 for r in rows]
    assert [x.tobytes() for x in training_order.read_shard(paths[0], layout, first=7)] == [x.tobytes() for x in stored[7:500]]
    names = [paths[s] for s in sorted(paths)]
    assert [x.tobytes() for x in training_order.read_from(names, layout, 507)] == [x.tobytes() for x in stored[507:]]
    assert all(r.byte_offset == r.slot % 500 * layout.stride and r.shard == r.slot // 500 for r in rows)
    number = training_order.Permutation(len(rows), layout.key)(np.arange(len(rows)))
    stream = np.concatenate([stored[s][: rows[s].n_tokens] for s in number])
    lib = sentencepieces.model(sentencepieces.model_path()).lib
    encoded = [(r.doc_id, np.array(lib.encode(r.text or "", add_eos=True))) for r in docs.collect()]
    assert (stream == np.concatenate([e for _, e in encoded])).all()
    owners = [d for d, e in encoded for _ in e]
    at = 0
    for s in number:
        assert rows[s].doc_ids == list(dict.fromkeys(owners[at : at + rows[s].n_tokens]))
        at += rows[s].n_tokens
    assert training_order.write_shards(docs.limit(0), new_path(spark, "shards"), layout).count() == 0


def test_training_order_of_odd_rows(spark):
    """Very long, repeated, null and empty texts, a null doc_id, and columns named like the result's."""
    rows = [(1, "word " * 40_000), (1, "word " * 40_000), (None, "x"), (2, None), (2, "")]
    docs = spark.createDataFrame([(d, t, 7, "p") for d, t in rows], "doc_id bigint, text string, slot int, path string").coalesce(1)
    layout = training_order.Layout(length=100, shard_records=64)
    records = training_order.write_shards(docs, new_path(spark, "shards"), layout)
    lib = sentencepieces.model(sentencepieces.model_path()).lib
    assert records.agg({"n_tokens": "sum"}).first()[0] == sum(len(lib.encode(t or "", add_eos=True)) for _, t in rows)
    held = [d for r in records.collect() for d in r.doc_ids]
    assert set(held) == {1, 2, None} and {r.n_records for r in training_order.shards(records).collect()[:-1]} == {64}


def test_training_order_tells_other_words_of_the_same_length(spark):
    """What the first pass keeps belongs to its words: a second read that gives others raises, even with as many ids."""

    def either(batches):
        import uuid

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join("ab"[int(c, 16) % 2] for c in uuid.uuid4().hex) for _ in range(batch.num_rows)])], names=["doc_id", "text"])

    docs = spark.range(64).withColumnRenamed("id", "doc_id").coalesce(1).mapInArrow(either, "doc_id bigint, text string")
    lib = sentencepieces.model(sentencepieces.model_path()).lib
    assert len(lib.encode("a b a")) == len(lib.encode("b b b"))
    first = [docs.head().text.split(" ")[0] for _ in range(40)]
    assert set(first) == {"a", "b"}
    raised = 0
    for _ in range(12):  # the words are the same two, so that their order alone tells
        try:
            training_order.sequences(docs)[0].collect()
        except Exception as e:
            assert training_order.OTHER_INPUT in str(e)
            raised += 1
    assert raised


def test_marks_of_words():
    marks = {training_order.mark(pa.array(w)) for w in (["same", "size", "", "é"], ["size", "same", "", "é"], ["sames", "ize", "", "é"], ["same", "size"])}
    assert len(marks) == 4 and training_order.mark(pa.array(["x", "same", "size", "y"])[1:3]) in marks
    assert training_order.mark(pa.array([], pa.string())) == 0
    texts = pa.array(["a  b a", None, "one two", "x▁y one"])
    s, sp = sentencepieces.split(texts), sentencepieces.model(sentencepieces.model_path())
    ids, low, high = s.join(*sp.flat(s.distinct))
    assert [ids[a:b].tolist() for a, b in zip(low, high, strict=True)] == [sp.lib.encode(t or "") for t in texts.to_pylist()]


def test_pipeline(spark, sf_dir):
    """Each stage against brute force on what the stage before it kept."""
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality_rules.op9_quality_rules(spark, sf_dir).collect() if r.kept}
    groups = brute.near_dup([(d, rows[d].text) for d in sorted(kept)], 5, 80)
    kept = {d for d, _, _, k in groups if k}
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    kept = {r[0] for r in brute.contamination([(d, rows[d].text) for d in kept], items) if not r[-1]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == kept
    clean = {r.doc_id: r.text for r in secrets.redact(docs.filter(docs.doc_id.isin(*kept))).collect()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path())
    assert all(got[d].ids == sp.encode(clean[d], add_bos=True, add_eos=True) for d in kept)


def test_pipeline_keeps_columns_and_handles_odd_rows(spark, sf_dir):
    good = lambda i: " ".join(f"the w{i}x{k} and of" for k in range(40))
    rows = [(1, good(1), "en", "src0", 9), (2, good(1), "en", "src0", 9), (2, good(2), None, None, None), (None, good(3), "en", "s", 1), (None, good(1), "en", "s", 1), (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, good(6) + " token = abcdefgh1234", "en", "s", 7), (6, good(6) + " token = abcdefgh1234", "en", "s", 7), (7, good(7), "en", "s", 3), (7, good(7) + " more", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = Counter(r.doc_id for r in docs.collect())
    assert got == {1: 1, 2: 1, None: 1, 6: 1, 7: 1}
    assert "[assign]" in docs.filter("doc_id = 6").first().text
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0
    assert near_dup and decontaminate
