"""Normalisation and scalar projections."""

from __future__ import annotations

from postsieve.functions.banks import CORPORATE_SUFFIXES, CORPORATE_WORDS, ROLE_BUCKETS_8, ROLE_BUCKETS_11
from postsieve.functions.dialect import AS_OF, Dialect

NOT_WORD = r"[^\p{L}\p{N}_\s]"


def normalize_text(q: Dialect, x: str) -> str:
    """First 300 characters without punctuation, lower case, single spaces, first 150; blank for null."""
    bare = f"lower({q.sub(f'substring(coalesce({x}, {q.lit('')}), 1, 300)', NOT_WORD)})"
    return f"substring(trim({q.sub(bare, r'\s+', ' ')}), 1, 150)"


def normalize_company_key(q: Dialect, x: str) -> str:
    return q.sub(q.sub(f"lower(trim({x}))", CORPORATE_WORDS), "[^a-z0-9]")


def normalize_company_loose(q: Dialect, x: str) -> str:
    out = f"lower(trim({x}))"
    for s in CORPORATE_SUFFIXES:
        out = f"replace({out}, {q.lit(s)}, '')"
    return q.sub(q.sub(out, NOT_WORD), r"\s+", " ")


def title_case(q: Dialect, x: str) -> str:
    """Every run of letters capitalised, also behind hyphens and digits."""
    return q.join(q.map(q.extract_all(x, r"\p{L}+|[^\p{L}]+"), lambda w: f"concat(upper(substring({w}, 1, 1)), lower(substring({w}, 2)))", "w"), "")


def clean_company_url(q: Dialect, x: str) -> str:
    """A company's name from its address: no scheme, www, path or top-level domain, the last dot part in title case."""
    host = q.sub(q.sub(q.sub(x, "^https?://"), r"^www\."), "/.*$")
    bare = q.sub(host, r"(?i)\.(com|in|org|net|io|co|ai|edu|gov|info|biz)$")
    return title_case(q, q.extract(bare, r"[^.]*$"))


def clean_company_analysis(q: Dialect, x: str) -> str:
    bare = q.sub(q.sub(x, r"https?://|www\."), "/.*$")
    for s in (".com", ".in", ".co"):
        bare = f"replace({bare}, '{s}', '')"
    return f"CASE WHEN {q.any_of(f'lower({x})', ['.com', 'www.', 'http'])} THEN {title_case(q, bare)} ELSE {x} END"


def normalize_title(q: Dialect, x: str) -> str:
    return q.sub(q.sub(f"lower(trim({x}))", NOT_WORD), r"\s+", " ")


def role_bucket_8(q: Dialect, x: str) -> str:
    return q.let(f"lower({x})", lambda t: q.first_match(t, ROLE_BUCKETS_8, q.sub(t, r"[^\p{L}]")))


def role_bucket_11(q: Dialect, x: str) -> str:
    return q.let(f"lower({x})", lambda t: q.first_match(t, ROLE_BUCKETS_11, f"substring({t}, 1, 20)"))


def _hours_between(q: Dialect, ts: str, as_of: str) -> str:
    return f"({q.seconds(as_of)} - {q.seconds(ts)})"


def _relative(q: Dialect, x: str, months: bool) -> str:
    t = f"lower(trim({x}))"
    n = lambda rx, k: q.bigint(q.extract(t, rx, 1)) + f" * {k}"
    rules = [(q.matches(t, r"(\d+)\s*h"), n(r"(\d+)\s*h", 1)), (q.matches(t, r"(\d+)\s*m"), "0"), (q.matches(t, r"(\d+)\s*d"), n(r"(\d+)\s*d", 24)), (q.matches(t, r"(\d+)\s*w"), n(r"(\d+)\s*w", 168))]
    rules += [(q.matches(t, r"(\d+)\s*mo"), n(r"(\d+)\s*mo", 720))] if months else []
    return q.cases([*rules, (q.any_of(t, ["just", "now"]), "0")], "NULL")


def age_hours(q: Dialect, text: str, millis: str = "CAST(NULL AS BIGINT)", as_of: str = AS_OF) -> str:
    """Hours since posting: epoch milliseconds, ISO text, then relative text, where minutes come before months."""
    iso = q.when_parsed(q.sub(q.sub(text, r"Z$"), r"(\.\d+)?(\+.*)?$"), [("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"), ("yyyy-MM-dd'T'HH:mm", "%Y-%m-%dT%H:%M")])
    stamp = q.div(f"({q.seconds(as_of)} - {q.div(f'({millis})', 1000)})", 3600)
    from_iso = q.div(_hours_between(q, iso, as_of), 3600)
    return f"coalesce(CASE WHEN ({millis}) > 0 THEN {stamp} END, CASE WHEN {q.has(text, 'T')} THEN {from_iso} END, CASE WHEN {text} <> '' THEN {_relative(q, text, True)} END)"


def age_hours_simple(q: Dialect, x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN {_relative(q, x, False)} END"


def age_days_regex(q: Dialect, x: str) -> str:
    """Days of the regex analyser; months and years are 30."""
    n = lambda rx: q.bigint(q.extract(x, rx, 1))
    return q.cases([(q.any_of(x, ["mo", "yr"]), "30"), (q.has(x, "w"), f"coalesce({n(r'(\d+)w')} * 7, 0)"), (q.has(x, "d"), f"coalesce({n(r'(\d+)d')}, 0)")], "0")


LISTING_FORMATS = [
    ("yyyy-M-d", "%Y-%m-%d"), ("yyyy-M-d H:m:s", "%Y-%m-%d %H:%M:%S"), ("d-M-yyyy", "%d-%m-%Y"), ("d/M/yyyy", "%d/%m/%Y"), ("yyyy/M/d", "%Y/%m/%d"),
    ("MMM d, yyyy", "%b %d, %Y"), ("d MMM yyyy", "%d %b %Y"), ("yyyy-M-d'T'H:m:s", "%Y-%m-%dT%H:%M:%S"),
]
SERVING_FORMATS = [("yyyy-M-d H:m:s", "%Y-%m-%d %H:%M:%S"), ("yyyy-M-d H:m", "%Y-%m-%d %H:%M"), ("yyyy-M-d", "%Y-%m-%d"), ("d/M/yyyy", "%d/%m/%Y"), ("M/d/yyyy", "%m/%d/%Y")]


def parse_listing_date(q: Dialect, x: str, as_of: str = AS_OF) -> str:
    """Eight formats in order, then "N hours / days / minutes / weeks ago"; else null."""
    rx = r"(\d+)\s*(hour|day|minute|week)s?\s*ago"
    unit = q.cases([(f"{q.extract(f'lower({x})', rx, 2)} = '{u}'", str(s)) for u, s in (("hour", 3600), ("day", 86400), ("minute", 60), ("week", 604800))], "NULL")
    ago = q.of_seconds(f"{q.seconds(as_of)} - {q.bigint(q.extract(f'lower({x})', rx, 1))} * ({unit})")
    return f"coalesce({q.when_parsed(f'trim({x})', LISTING_FORMATS)}, CASE WHEN {q.matches(f'lower({x})', rx)} THEN {ago} END)"


def hours_since(q: Dialect, x: str, as_of: str = AS_OF) -> str:
    """Whole hours, 1 at least; 24 where nothing parses."""
    hours = q.div(_hours_between(q, q.when_parsed(f"trim({x})", SERVING_FORMATS), as_of), 3600)
    return q.let(hours, lambda h: f"CASE WHEN {h} IS NULL THEN 24 ELSE greatest(1, {h}) END")


def resolve_posted_date(q: Dialect, age: str, as_of: str = AS_OF) -> str:
    return f"coalesce({q.day_text(q.of_seconds(f'{q.seconds(as_of)} - ({age}) * 3600'))}, '')"


def parse_stipend(q: Dialect, x: str) -> str:
    """Rupees: 10k, 5L or the first number; null where there is none. Scaled in doubles and truncated."""
    bare, rx = f"trim(replace({x}, ',', ''))", r"(\d+(?:\.\d+)?)\s*([kKlL])\b"
    amount = f"TRY_CAST({q.extract(bare, rx, 1)} AS DOUBLE)"
    scaled = q.toint(f"{amount} * CAST(CASE WHEN lower({q.extract(bare, rx, 2)}) = 'k' THEN 1000 ELSE 100000 END AS DOUBLE)")
    return f"CASE WHEN {q.matches(bare, rx)} THEN {scaled} ELSE {q.bigint(q.extract(bare, r'\d+'))} END"


def blank_sentinels(q: Dialect, x: str) -> str:
    return f"CASE WHEN {x} IN ('', 'null', 'Unknown') THEN NULL ELSE {x} END"


def tags_split(q: Dialect, x: str) -> str:
    return q.keep(q.map(q.split(x, ","), lambda t: f"trim({t})"), lambda t: f"{t} <> ''")


def tags_join(q: Dialect, a: str) -> str:
    return q.join(a, ", ")


def url_role_key(q: Dialect, url: str, role: str) -> str:
    return f"concat({url}, '|', {role_bucket_8(q, role)})"


def company_role_key(q: Dialect, company: str, role: str) -> str:
    """Null where the company is blank or unknown, or the role's bucket blank or just an internship."""
    org, bucket = normalize_company_loose(q, company), role_bucket_8(q, role)
    return f"CASE WHEN {org} IN ('', 'unknown') OR {bucket} IN ('', 'internship') THEN NULL ELSE concat({org}, '|', {bucket}) END"


def text_role_key(q: Dialect, text: str, role: str) -> str:
    return f"md5(concat(substring({text}, 1, 100), {role}))"


def raw_engagement(q: Dialect, likes: str, comments: str) -> str:
    return f"(coalesce({likes}, 0) + coalesce({comments}, 0))"


def listing_id(q: Dialect, org: str, title: str) -> str:
    return f"concat('sh-', substring(md5(concat({org}, ':', {title})), 1, 8))"


def truncate_text(q: Dialect, x: str, n: int = 500) -> str:
    return f"CASE WHEN length({x}) > {n} THEN concat(substring({x}, 1, {n}), '...') ELSE {x} END"


def format_stipend(q: Dialect, n: str) -> str:
    tenth = f"CAST(floor({n} / 10000.0 + 0.5) AS BIGINT)"
    text = lambda x: f"CAST({x} AS VARCHAR(20))"
    lakh = f"CASE WHEN {n} % 100000 = 0 THEN {text(q.div(n, 100000))} ELSE concat({text(q.div(tenth, 10))}, '.', {text(f'{tenth} % 10')}) END"
    return q.cases([(f"{n} IS NULL OR {n} <= 0", "'Unpaid / Undisclosed'"), (f"{n} >= 100000", f"concat('₹', {lakh}, 'L/mo')"), (f"{n} >= 1000", f"concat('₹', {text(f'CAST(floor({n} / 1000.0 + 0.5) AS BIGINT)')}, 'K/mo')")], f"concat('₹', {text(n)}, '/mo')")


def format_age(q: Dialect, h: str) -> str:
    days = f"CAST(floor({h} / 24.0 + 0.5) AS BIGINT)"
    return q.cases([(f"coalesce({h}, 0) < 1", "'Just now'"), (f"{h} < 24", f"concat(CAST({h} AS VARCHAR(20)), 'h ago')"), (f"{days} = 1", "'1 day ago'")], f"concat(CAST({days} AS VARCHAR(20)), ' days ago')")


def apply_target(q: Dialect, link: str, post: str, contact: str, site: str = "https://site.example") -> str:
    return f"coalesce(nullif(trim({link}), ''), nullif(trim({post}), ''), concat('mailto:', nullif(trim({contact}), '')), {q.lit(site)})"


def apply_label(q: Dialect, link: str, post: str, contact: str) -> str:
    return q.cases([(f"trim({link}) <> ''", "'Apply now'"), (f"trim({post}) <> ''", "'Apply via post'"), (f"trim({contact}) <> ''", "'Email to apply'")], "'View role'")


def org_initials(q: Dialect, x: str) -> str:
    return f"upper({q.join(q.map(q.first(q.split(x, ' '), 2), lambda w: f'substring({w}, 1, 1)'), '')})"


def fresh_flag(q: Dialect, h: str) -> str:
    return f"coalesce(nullif({h}, 0), 99) <= 24"


def freshness_points(q: Dialect, h: str) -> str:
    return q.cases([(f"{h} IS NULL", "10"), (f"{h} < 6", "25"), (f"{h} < 12", "20"), (f"{h} < 24", "15"), (f"{h} < 48", "10")], "5")


def listing_score(q: Dialect, h: str, stipend: str) -> str:
    fresh = q.div(f"greatest(0, 100 - 3 * {h})", 2)
    return f"least(99, greatest(50, {fresh} + least(40, {q.toint(f'coalesce({stipend}, 0) / 1500.0')}) + 50))"


def unfenced(q: Dialect, x: str) -> str:
    """The JSON text of a model's answer without its code fence."""
    return q.sub(q.sub(q.sub(x, r"(?s)^.*?```(json)?"), r"(?s)```.*$"), r"^\s+|\s+$")
