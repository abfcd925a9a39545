"""Extraction from texts, and classification with reasons."""

from __future__ import annotations

from postsieve.functions import banks as b
from postsieve.functions.dialect import Dialect
from postsieve.functions.text import normalize_text, title_case


def _low(x: str) -> str:
    return f"lower(coalesce({x}, ''))"


def extract_role(q: Dialect, x: str) -> str:
    return q.let(_low(x), lambda t: q.cases([(q.seek(t, rx), q.lit(name)) for rx, name in b.ROLE_PATTERNS], "'Internship'"))


def extract_emails(q: Dialect, x: str) -> str:
    # Spark's engine would try each place of a word: it is led to where words begin and where the last address ended.
    before, local = (r"(?:\G|(?<![a-zA-Z0-9._%+\-]))", r"[a-zA-Z0-9._%+\-]++") if q.spark else ("", r"[a-zA-Z0-9._%+\-]+")
    found = q.extract_all(x, before + local + r"@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")
    kept = q.join(q.distinct(q.keep(found, lambda e: f"NOT {q.matches(e, r'\.(png|jpg|gif|svg)$')}")), ", ")
    return f"CASE WHEN {q.has(x, '@')} THEN {kept} ELSE '' END"


def extract_locations(q: Dialect, x: str) -> str:
    shown = lambda p: q.lit(b.PLACE_NAMES.get(p, p.title()))
    named = q.let(f"lower({x})", lambda t: q.array(*[f"CASE WHEN {q.has(t, p)} THEN {shown(p)} END" for p in b.EXTRACT_PLACES]))
    found = q.keep(named, lambda v: f"{v} IS NOT NULL")
    return q.join(q.first(q.distinct(found), 2), ", ")


def extract_apply_link(q: Dialect, x: str) -> str:
    urls = q.extract_all(x, r"https?://[^\s<>\")]+")
    return f"coalesce({q.at(q.keep(urls, lambda u: q.any_of(f'lower({u})', b.LINK_WORDS)), 0)}, {q.at(urls, 0)}, '')"


def company_from_headline(q: Dialect, company: str, headline: str, author: str) -> str:
    """The given company, else "at X", else what follows a separator unless it names a role; else the author."""
    name = r"([A-Z][\p{L}\p{N}_\s&.]*?)"
    at = f"trim({q.extract(headline, r'\bat\s+' + name + r'(?:\s*[|·•–-]|$)', 1)})"
    sep = f"trim({q.extract(headline, r'[|·•–-]\s*' + name + r'(?:\s*[|·•–-]|$)', 1)})"
    sep = f"CASE WHEN {q.any_of(f'lower({sep})', b.HEADLINE_ROLES)} THEN '' ELSE {sep} END"
    return q.nonblank(company, at, sep, author)


def work_type(q: Dialect, x: str) -> str:
    return q.first_match(f"lower({x})", [("Part-time", ["part-time", "part time"]), ("Full-time", ["full-time", "full time"])], "''")


def hiring_signals(q: Dialect, x: str) -> str:
    """Comma-joined tags of the kinds of signals found."""

    def of(t: str) -> str:
        kinds = [("role_keyword", q.any_of(t, b.ROLE_SIGNALS)), ("role_type", q.any_of(t, b.TYPE_SIGNALS)), ("action_word", q.any_of(t, b.ACTION_SIGNALS)), ("urgency", q.any_of(t, b.URGENCY_SIGNALS)), ("contact_method", q.seek(t, "|".join(b.CONTACT_SIGNALS)))]
        return q.join(q.keep(q.array(*[f"CASE WHEN {c} THEN '{k}' END" for k, c in kinds]), lambda v: f"{v} IS NOT NULL"), ",")

    return q.let(f"lower({x})", of)


def engagement_score(q: Dialect, likes: str, comments: str, reposts: str) -> str:
    return " + ".join(f"CASE WHEN {c} > {n} THEN 1 ELSE 0 END" for c, n in ((likes, 50), (comments, 10), (reposts, 5)))


def freshness_bonus(q: Dialect, age: str) -> str:
    return f"CASE WHEN {age} <= 24 THEN 1 ELSE 0 END"


def is_stale(q: Dialect, age: str, engagement: str) -> str:
    return f"coalesce({age} > 12 AND ({engagement}) = 0, false)"


def analyser_roles(q: Dialect, x: str) -> str:
    """Comma-joined roles of the regex analyser: named ones, else keywords next to "intern", else Internship."""
    t = f"lower({x})"
    named = q.map(q.first(q.extract_all(t, r"(?:hiring|looking) for ([\p{L}\p{N}_\s]+?)(?:intern|internship)", 1), 2), lambda r: f"concat({title_case(q, f'trim({r})')}, ' Intern')", "r")
    words = q.keep(q.array(*[f"CASE WHEN {q.has(t, k)} AND {q.has(t, 'intern')} THEN {q.lit(k.title() + ' Intern')} END" for k in b.ANALYSER_ROLES]), lambda v: f"{v} IS NOT NULL")
    return q.nonblank(q.join(named, ", "), q.join(words, ", "), "'Internship'")


def analyser_location(q: Dialect, x: str) -> str:
    t = f"lower({x})"
    return q.cases([(q.any_of(t, ["remote", "work from home"]), "'Remote'"), *[(q.has(t, p), q.lit(p.title())) for p in b.ANALYSER_PLACES]], "''")


def analyser_exclusion(q: Dialect, x: str, age_days: str, stale: str) -> str:
    return q.cases([(q.any_of(f"lower({x})", ["registration fee", "security deposit"]), "'Spam keywords detected'"), (stale, "'Old post (> 4 days)'")], "''")


def analyser_company(q: Dialect, x: str) -> str:
    name = q.extract(x, r"\bat ([A-Z][\p{L}\p{N}_\s.]+?)(?:\.|,|\n| is| hiring| looking|!)", 1)
    return f"CASE WHEN length({name}) < 30 AND lower(trim({name})) NOT IN ('the', 'a', 'an', 'this', 'my', 'our', 'least', 'target', 'all') THEN trim({name}) ELSE '' END"


def hiring_strength(q: Dialect, company: str, roles: str, contact: str, text: str) -> str:
    """roles: an array. Company +2, a specific role +2, contact +2 or else -2, keyword +1."""
    specific = f"{q.size(q.keep(roles, lambda r: f'''lower({r}) NOT IN ({', '.join(q.lit(v) for v in b.VAGUE_ROLES)})'''))} > 0"
    parts = [f"CASE WHEN {company} <> '' AND lower({company}) <> 'unknown' THEN 2 ELSE 0 END", f"CASE WHEN {specific} THEN 2 ELSE 0 END", f"CASE WHEN {contact} <> '' THEN 2 ELSE -2 END", f"CASE WHEN {q.any_of(f'lower({text})', b.STRENGTH_WORDS)} THEN 1 ELSE 0 END"]
    return " + ".join(parts)


def infer_cluster(q: Dialect, title: str, tags: str) -> str:
    """tags: an array."""
    return q.first_match(f"lower(concat({title}, ' ', {q.join(tags, ' ')}))", b.CLUSTERS, "'Operations'")


def related_terms(q: Dialect, title: str, which: int, taxonomy=None) -> str:
    """which: 1 subchips, 2 similar fields, of the first taxonomy row with a keyword in the title; blank if none."""
    rows = taxonomy or b.TAXONOMY
    return q.cases([(q.any_of(f"lower({title})", row[0]), q.lit(", ".join(row[which]))) for row in rows], "''")


def assign_tab(q: Dialect, role: str, text: str, tabs=None) -> str:
    return q.first_match(f"lower(concat({role}, ' ', {text}))", tabs or b.TABS, "'Other'")


def work_mode(q: Dialect, location: str, text: str) -> str:
    def of(t: str) -> str:
        here, remote = q.matches(t, b.HOME_CITY), q.matches(t, r"\b(remote|wfh|work from home)\b")
        return q.cases([(f"{here} AND {remote}", "'Bangalore / Remote'"), (here, "'Bangalore (On-site)'")], "'Remote (India)'")

    return q.let(f"lower(concat({location}, ' ', {text}))", of)


def priority_boost(q: Dialect, role: str, company: str, words=b.PRIORITY_TECH) -> str:
    """5 where role and company, run together, hold a priority word, else 1."""
    return f"CASE WHEN {q.any_of(f'lower(concat({role}, {company}))', words)} THEN 5 ELSE 1 END"


def fallback_role(q: Dialect, x: str) -> str:
    return q.let(_low(x), lambda t: q.cases([(q.has(t, w), q.lit(w.title() + " Intern")) for w in b.FALLBACK_ROLES], "'Internship'"))


def flag_scam(q: Dialect, x: str) -> str:
    return q.any_of(normalize_text(q, x), b.SCAM)


def flag_scam_raw(q: Dialect, x: str) -> str:
    return q.any_of(f"lower({x})", b.SCAM_RAW)


def flag_story(q: Dialect, x: str) -> str:
    return q.any_of(normalize_text(q, x), b.STORY)


def flag_hiring_intent(q: Dialect, x: str) -> str:
    return q.any_of(normalize_text(q, x), [*b.HIRING, "intern"])


def flag_blacklist(q: Dialect, x: str) -> str:
    return q.any_of(f"lower(trim({x}))", b.BLACKLIST)


def flag_region_eligible(q: Dialect, location: str, text: str, places=None, texts=None) -> str:
    """Not where only a foreign place is named; yes for a home place; else the text must name one."""
    loc = f"lower(coalesce({location}, ''))"
    abroad = f"{q.any_of(loc, b.FOREIGN_PLACES)} AND NOT {q.has(loc, 'india')}"
    return q.cases([(abroad, "false"), (q.any_of(loc, places or b.HOME_PLACES), "true")], q.any_of(f"lower(coalesce({text}, ''))", texts or b.HOME_TEXT))


def flag_region_hot(q: Dialect, location: str, text: str) -> str:
    """The analyser's variant: no "work from home" place, and fewer words count in the text where the place is unknown."""
    loc, body = f"lower(coalesce({location}, ''))", f"lower(coalesce({text}, ''))"
    abroad = f"{q.any_of(loc, b.FOREIGN_PLACES)} AND NOT {q.has(loc, 'india')}"
    return q.cases([(abroad, "false"), (q.any_of(loc, b.HOME_PLACES[:-1]), "true"), (q.has(loc, "remote"), q.any_of(body, b.HOME_TEXT))], q.any_of(body, b.HOME_TEXT[:14]))


def verdict(q: Dialect, text: str, location: str, company: str, normalized: str | None = None) -> str:
    """The reason for dropping a post, or ok. normalized: a column that already holds normalize_text(text)."""
    if normalized is None:
        return q.let(normalize_text(q, text), lambda n: verdict(q, text, location, company, n))
    n = normalized
    rules = [(flag_blacklist(q, company), "'blacklisted_company'"), (q.any_of(n, b.SCAM), "'scam'"), (q.any_of(n, b.STORY), "'personal_story'"), (f"NOT {q.any_of(n, [*b.HIRING, 'intern'])}", "'no_hiring_intent'"), (f"NOT ({flag_region_eligible(q, location, text)})", "'not_india_eligible'")]
    return q.cases(rules, "'ok'")


def early_filter(q: Dialect, author: str, posted: str, normalized: str) -> str:
    """Whether a post passes the cheap filters before analysis; normalized holds normalize_text of its text."""
    n, p = normalized, f"lower(trim({posted}))"
    drops = [
        q.has(n, "hiring for multiple positions"), f"({q.has(n, 'apply now for internship')} AND {q.has(n, 'hiring')})", q.any_of(f"lower({author})", b.BLACKLIST), q.any_of(f"substring({n}, 1, 80)", b.BLACKLIST),
        q.any_of(n, b.SCAM_EARLY), q.any_of(n, b.STORY_EARLY), f"NOT {q.any_of(n, [*b.HIRING_EARLY, 'intern'])}", q.any_of(p, ["w", "mo", "yr", "year"]), f"coalesce({q.bigint(q.extract(p, r'(\d+)\s*d', 1))} > 4, false)",
    ]
    return f"NOT ({' OR '.join(drops)})"


def _both(location: str, text: str) -> str:
    return f"lower(concat(coalesce({location}, ''), ' ', coalesce({text}, '')))"


def remote_only(q: Dialect, location: str, text: str) -> str:
    """Remote words in location or text, and the text doesn't rule remote work out."""
    return f"({q.any_of(_both(location, text), b.REMOTE_WORDS)} AND NOT {q.any_of(_low(text), ['no remote', 'not remote'])})"


def city_or_home_or_remote(q: Dialect, location: str, text: str) -> str:
    """No foreign location, and Chennai, India or a remote word anywhere."""
    return f"(NOT {q.matches(_low(location), b.ABROAD_LOCATION)} AND {q.any_of(_both(location, text), ['chennai', 'india', *b.REMOTE_WORDS])})"


def remote_home(q: Dialect, location: str, text: str) -> str:
    """Remote work with a home context; on-site only, hybrid only and foreign ones are out."""
    return q.let(_both(location, text), lambda t: f"(NOT {q.matches(t, b.NO_REMOTE)} AND NOT {q.matches(t, b.HYBRID_ONLY)} AND NOT {q.matches(t, b.ABROAD)} AND {q.matches(t, b.REMOTE)} AND {q.matches(t, b.HOME)})")


def city_or_remote_home(q: Dialect, location: str, text: str) -> str:
    """The home city, or remote work with a home context; on-site only elsewhere and foreign ones are out."""
    return q.let(_both(location, text), lambda t: f"(NOT ({q.matches(t, b.NO_REMOTE)} AND NOT {q.matches(t, b.HOME_CITY)}) AND NOT {q.matches(t, b.ABROAD)} AND ({q.matches(t, b.HOME_CITY)} OR ({q.matches(t, b.REMOTE)} AND {q.matches(t, b.HOME)})))")


POLICIES = {f.__name__: f for f in (remote_only, city_or_home_or_remote, remote_home, city_or_remote_home)}


def relevant_role(q: Dialect, role: str, text: str, words=b.PRIORITY_REMOTE) -> str:
    return q.let(_both(role, text), lambda t: f"({q.any_of(t, words)} OR {q.matches(t, r'\b(intern|internship)\b')})")


def intern_title(q: Dialect, x: str, words=b.INTERN_TITLES) -> str:
    return q.any_of(f"lower({x})", words)
