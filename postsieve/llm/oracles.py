"""DuckDB SQL of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

from postsieve.llm.quality_rules import COMMON_WORDS, Rules
from postsieve.llm.secrets import BASE_RULES, MORE_RULES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
SPACED = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
gram AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM win))),
hit AS (SELECT g.rid, g.i, g.n, win.item_id FROM gram g JOIN win ON g.n = win.n AND g.gram = win.gram),
n_hit AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest(range(0, n)) AS k FROM hit) GROUP BY rid),
found AS (SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS name FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
 coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated FROM d LEFT JOIN n_hit h ON d.rid = h.rid LEFT JOIN found f ON d.rid = f.rid
"""


def _either_case(regex: str) -> str:
    """(?i) for A-Z alone: other engines also fold letters beyond ASCII."""
    body = regex.removeprefix("(?i)")
    head, sep, rest = body.partition(")")
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in head) + sep + rest if regex.startswith("(?i)") else regex


def _spans(k: int, rule) -> str:
    rx = _either_case(rule.regex).replace("'", "''")
    failing = f"WHERE length(regexp_extract(m[i], '{rx}', {rule.group})) >= {rule.min_length}" if rule.min_length else ""
    return f"""SELECT rid, {k} AS k, '{rule.kind}' AS kind, s, s + length(m[i]) AS e FROM (SELECT rid, m, i, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
 FROM (SELECT rid, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{rx}') AS m, string_split_regex(t, '{rx}') AS p FROM d WHERE regexp_matches(t, '{rx}')))) {failing}"""


OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_spans(k, r) for k, r in enumerate(BASE_RULES + MORE_RULES))}),
a AS (SELECT rid, {', '.join(f"count(*) FILTER (WHERE k = {k}) AS n{k}" for k in range(3))}, string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, k) AS spans,
 string_agg(CASE WHEN k < 3 THEN kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) END, ',' ORDER BY s, k) AS base FROM s GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON d.rid = a.rid
"""

_B32 = "substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // {d}) % 32 + 1 AS BIGINT), 1)"
OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
digest AS (SELECT page_id, h, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([CAST('0x' || substring(x, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)], lambda v: {' || '.join(_B32.format(d=d) for d in (32768, 1024, 32, 1))}), '')), '') AS b FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM digest)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, b AS payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM m
"""

def _linked(words: int) -> str:
    """component_id by row (rid) and n by rid, for links at 85 % of the union of shingles of some words."""
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOW}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + {words - 1}], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - {words - 1}) + 1)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
link AS (SELECT a, b FROM shared JOIN z x ON x.rid = a JOIN z y ON y.rid = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT reach.a AS rid, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.b GROUP BY reach.a)
"""


OP7 = _linked(3) + "SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id, d.doc_id IS NOT DISTINCT FROM c.component_id AS kept FROM d JOIN c ON d.rid = c.rid LEFT JOIN z ON d.rid = z.rid"
OP12 = _linked(4) + "SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id FROM d JOIN c ON d.rid = c.rid LEFT JOIN z ON d.rid = z.rid"

OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id AS other, a.label = x.label AS same, CAST(list_inner_product(a.e, x.e) AS BIGINT) AS score FROM v a JOIN v x ON a.vec_id % 50 = 0 AND a.vec_id <> x.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS k FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
 AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""

OP13 = rf"""
WITH piece AS (SELECT row_number() OVER () AS pid, lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)) WHERE len(w) > 0),
total AS (SELECT lang, sum(len(w)) AS n FROM piece GROUP BY lang),
gram AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY lang, k, phrase HAVING count(*) >= 100),
part AS (SELECT lang, k, f, w, i, m, array_to_string(w[i:i + m - 1], ' ') AS part FROM (SELECT lang, k, f, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, k, f, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
most AS (SELECT lang, part, max(f) AS f FROM part GROUP BY lang, part),
cand AS (SELECT f.lang, f.phrase, f.k, f.f AS a, string_split(f.phrase, ' ') AS w FROM f LEFT JOIN most m ON f.lang = m.lang AND f.phrase = m.part WHERE f.k > 1 AND (m.f IS NULL OR 100 * m.f < 100 * f.f)),
cut AS (SELECT *, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scored AS (SELECT cut.lang, cut.phrase, c, a, l.f AS l, r.f AS r, CAST(t.n AS BIGINT) AS n, CAST(CAST(1000 AS HUGEINT) * a * t.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM cut JOIN f l ON cut.lang = l.lang AND cut.x = l.phrase JOIN f r ON cut.lang = r.lang AND cut.y = r.phrase JOIN total t ON cut.lang = t.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def _js(p: str, q: str, n: int) -> str:
    """Jensen-Shannon distance of two lists of n counts."""
    x, y = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    half = f"(({x} + {y}) / 2)"
    term = lambda v: f"CASE WHEN {v} > 0 THEN {v} * log2({v} / {half}) ELSE 0 END"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(range(1, {n + 1}), lambda i: ({term(x)} + {term(y)}) / 2)))) END"


_R = Rules()
_BARE = lambda rx: f"length(t) - length(regexp_replace(t, '{rx}', '', 'g'))"
_NW = len(COMMON_WORDS) + 1
OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest(range(0, 8)) AS k FROM again) GROUP BY rid),
f AS (SELECT d.rid, doc_id, lang, length(t) AS chars, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({_BARE('[#*$%&|<>]')} AS BIGINT) AS n_symbols, {_BARE('[0-9]')} AS digits, {_BARE('[A-Z]')} AS upper_, strlen(t) - length(t) AS wide,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, [{', '.join(f"len(list_filter(w, lambda x: x = '{c}'))" for c in COMMON_WORDS)}] AS v FROM d LEFT JOIN cov ON d.rid = cov.rid),
h AS (SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed, list_transform([chars - word_chars, n_symbols, digits, upper_, wide, word_chars - n_symbols - digits - upper_], lambda x: CAST(x AS DOUBLE)) AS ch,
 list_transform(list_concat(v, [n_words - list_sum(v)]), lambda x: CAST(x AS DOUBLE)) AS wh FROM f),
ref AS (SELECT lang, sum(n_words) AS words, [{', '.join(f'sum(ch[{i}])' for i in range(1, 7))}] AS rc, [{', '.join(f'sum(wh[{i}])' for i in range(1, _NW + 1))}] AS rw FROM h WHERE NOT base_failed GROUP BY lang),
j AS (SELECT h.*, coalesce(ref.words >= {_R.guard_reference_words}, false) AS usable, {_js('ch', 'rc', 6)} AS cd, {_js('wh', 'rw', _NW)} AS wd FROM h LEFT JOIN ref ON h.lang IS NOT DISTINCT FROM ref.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT ((usable AND chars >= {_R.guard_chars} AND coalesce(cd > {_R.max_char_distance}, false)) OR (usable AND n_words >= {_R.guard_words} AND coalesce(wd > {_R.max_word_distance}, false))) AS kept FROM j
"""

ORACLES: dict[str, str] = {"op1_decontamination": OP1, "op2_secrets": OP2, "op4_warc_zip": OP4, "op7_near_dup": OP7, "op9_quality_rules": OP9, "op11_hard_negatives": OP11, "op12_jaccard_join": OP12, "op13_collocations": OP13}
