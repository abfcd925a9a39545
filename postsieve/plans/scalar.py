"""Registered queries that project expressions over an adapter view; both engines get the text in their dialect."""

from __future__ import annotations

from collections.abc import Callable

from postsieve.functions import extract as x
from postsieve.functions import text as t
from postsieve.functions.banks import PORTAL_TITLES, PRIORITY_AI, PRIORITY_FOUNDERS, PRIORITY_REMOTE
from postsieve.functions.dialect import DUCK, SPARK, Dialect
from postsieve.plans.fixtures import view, with_views

Expr = Callable[[Dialect], str]
NORM = "_norm"
SCALARS: dict[str, tuple[str, str, dict[str, Expr]]] = {}


def scalar(name: str, source: str, key: str, **exprs: Expr) -> None:
    SCALARS[name] = (source, key, exprs)


def spark_query(name: str):
    source, key, exprs = SCALARS[name]

    def query(spark, sf_dir):
        return view(spark, sf_dir, source).selectExpr(key, *[f"{e(SPARK)} AS `{n}`" for n, e in exprs.items()])

    query.__name__ = name
    return query


def duck_sql(name: str) -> str:
    source, key, exprs = SCALARS[name]
    return with_views(f"SELECT {key}, {', '.join(f'{e(DUCK)} AS {n}' for n, e in exprs.items())} FROM {source}")


def counter(q: Dialect) -> str:
    """A polymorphic counter made of the post's number."""
    return "CASE post_id % 4 WHEN 0 THEN '[1, 2, 3]' WHEN 1 THEN concat('{\"count\": ', CAST(likes AS VARCHAR(9)), '}') WHEN 2 THEN CAST(likes AS VARCHAR(9)) ELSE 'many' END"


def safe_count(q: Dialect) -> str:
    c = counter(q)
    field = f"get_json_object({c}, '$.count')" if q.spark else f"json_extract_string(CASE WHEN {c} LIKE '{{%' THEN {c} END, '$.count')"
    length = f"json_array_length({c})" if q.spark else f"json_array_length(CASE WHEN {c} LIKE '[%' THEN {c} END)"
    return f"CAST(coalesce(CASE WHEN {c} LIKE '[%' THEN {length} END, CASE WHEN {c} LIKE '{{%' THEN TRY_CAST({field} AS INT) END, TRY_CAST({c} AS INT), 0) AS BIGINT)"


def model_json(q: Dialect) -> str:
    """A model's answer, fenced or not, as an object, a list, or broken."""
    fence = q.lit("```json\n")
    close = q.lit("\n```")
    one = "concat('{\"role\": \"r', CAST(post_id AS VARCHAR(20)), '\"}')"
    return f"CASE post_id % 4 WHEN 0 THEN concat({fence}, {one}, {close}) WHEN 1 THEN {one} WHEN 2 THEN concat('[', {one}, ']') ELSE 'no json' END"


def model_role(q: Dialect) -> str:
    bare = t.unfenced(q, model_json(q))
    safe = bare if q.spark else f"CASE WHEN json_valid({bare}) THEN {bare} END"
    get = (lambda p: f"get_json_object({safe}, '{p}')") if q.spark else (lambda p: f"json_extract_string({safe}, '{p}')")
    return f"coalesce({get('$.role')}, {get('$[0].role')}, '')"


P, L = "fx_posts", "fx_published"
scalar("n1_normalize_text", P, "post_id", norm=lambda q: t.normalize_text(q, "text"))
scalar("n2a_normalize_company_key", P, "post_id", company_key=lambda q: t.normalize_company_key(q, "company"))
scalar("n2b_normalize_company_loose", P, "post_id", company_loose=lambda q: t.normalize_company_loose(q, "company"))
scalar("n2c_clean_company_url", P, "post_id", company_name=lambda q: t.clean_company_url(q, "company"))
scalar("n2d_clean_company_analysis", P, "post_id", company_name=lambda q: t.clean_company_analysis(q, "company"))
scalar("n3_normalize_title", L, "row_no", title_norm=lambda q: t.normalize_title(q, "title"))
scalar("n4a_role_bucket_8", L, "row_no", bucket=lambda q: t.role_bucket_8(q, "title"))
scalar("n4b_role_bucket_11", L, "row_no", bucket=lambda q: t.role_bucket_11(q, "title"))
scalar("n5a_age_hours", P, "post_id", age=lambda q: t.age_hours(q, "posted_time", "CASE WHEN post_id % 10 = 0 THEN 1706600000000 + post_id * 60000 ELSE 0 END"))
scalar("n5b_age_hours_simple", P, "post_id", age=lambda q: t.age_hours_simple(q, "posted_time"))
scalar("n5c_freshness_regex", P, "post_id", days=lambda q: f"CAST({t.age_days_regex(q, 'posted_time')} AS BIGINT)", stale=lambda q: f"({q.any_of('posted_time', ['mo', 'yr'])} OR {t.age_days_regex(q, 'posted_time')} > 8)")
scalar("n6a_parse_listing_date", L, "row_no", at=lambda q: q.seconds(t.parse_listing_date(q, "posted_date")))
scalar("n6b_hours_since", L, "row_no", hours=lambda q: f"CAST({t.hours_since(q, 'date_added')} AS BIGINT)")
scalar("n6c_resolve_posted_date", P, "post_id", posted=lambda q: t.resolve_posted_date(q, t.age_hours(q, "posted_time")))
scalar("n7_parse_stipend", L, "row_no", rupees=lambda q: t.parse_stipend(q, "stipend"), rupees_or_0=lambda q: f"coalesce({t.parse_stipend(q, 'stipend')}, 0)")
scalar("n8_safe_count", P, "post_id", n=safe_count)
scalar("n9_blank_sentinels", P, "post_id", company_or_null=lambda q: t.blank_sentinels(q, "company"))
scalar("n10_tags", L, "row_no", n_tags=lambda q: f"CAST({q.size(t.tags_split(q, 'tags'))} AS BIGINT)", joined=lambda q: t.tags_join(q, t.tags_split(q, "tags")))
scalar("n11_listing_id", L, "row_no", id=lambda q: t.listing_id(q, "hiring_organization", "title"))
scalar("n13_truncate_text", P, "post_id", short=lambda q: t.truncate_text(q, "text", 300), description=lambda q: "CASE WHEN length(author_headline) > 20 THEN author_headline ELSE substring(text, 1, 5000) END")
scalar("n14_formats", L, "row_no", stipend_text=lambda q: t.format_stipend(q, t.parse_stipend(q, "stipend")), age_text=lambda q: t.format_age(q, t.hours_since(q, "date_added")))
scalar("n15_apply_target", L, "row_no", target=lambda q: t.apply_target(q, "apply_link", "CASE WHEN row_no % 4 = 0 THEN '' ELSE post_url END", "contact_email"), label=lambda q: t.apply_label(q, "apply_link", "CASE WHEN row_no % 4 = 0 THEN '' ELSE post_url END", "contact_email"))
scalar("n16_clean_model_json", P, "post_id", role=model_role)
scalar("n17_org_initials", L, "row_no", initials=lambda q: t.org_initials(q, "hiring_organization"))
scalar("c1_extract_role", P, "post_id", role=lambda q: x.extract_role(q, "text"))
scalar("c2_extract_emails", P, "post_id", emails=lambda q: x.extract_emails(q, "text"))
scalar("c3_extract_locations", P, "post_id", places=lambda q: x.extract_locations(q, "text"))
scalar("c4_extract_apply_link", P, "post_id", link=lambda q: x.extract_apply_link(q, "text"))
scalar("c5_company_from_headline", P, "post_id", org=lambda q: x.company_from_headline(q, "company", "author_headline", "author_name"), org_by_headline=lambda q: x.company_from_headline(q, "''", "author_headline", "author_name"))
scalar("c6_work_type", P, "post_id", work_type=lambda q: x.work_type(q, "text"))
scalar("c7_hiring_signals", P, "post_id", signals=lambda q: x.hiring_signals(q, "text"))
scalar("c8_engagement_score", P, "post_id", engagement=lambda q: f"CAST({x.engagement_score(q, 'likes', 'comments', 'reposts')} AS BIGINT)")
scalar("c9_freshness_flags", P, "post_id", bonus=lambda q: f"CAST({x.freshness_bonus(q, t.age_hours(q, 'posted_time'))} AS BIGINT)", stale=lambda q: x.is_stale(q, t.age_hours(q, "posted_time"), x.engagement_score(q, "likes", "comments", "reposts")))
scalar(
    "c10_structure_posts", P, "post_id", role=lambda q: x.extract_role(q, "text"), places=lambda q: x.extract_locations(q, "text"), emails=lambda q: x.extract_emails(q, "text"), link=lambda q: x.extract_apply_link(q, "text"),
    org=lambda q: x.company_from_headline(q, "company", "author_headline", "author_name"), work_type=lambda q: x.work_type(q, "text"), signals=lambda q: x.hiring_signals(q, "text"), short=lambda q: t.truncate_text(q, "text"),
    engagement=lambda q: f"CAST({x.engagement_score(q, 'likes', 'comments', 'reposts')} AS BIGINT)", bonus=lambda q: f"CAST({x.freshness_bonus(q, t.age_hours(q, 'posted_time'))} AS BIGINT)",
)
scalar("c11_analyze_posts_regex", P, "post_id", roles=lambda q: x.analyser_roles(q, "text"), org=lambda q: x.analyser_company(q, "text"), place=lambda q: x.analyser_location(q, "text"), link=lambda q: q.extract("text", r"https?://[^\s]+"), work_type=lambda q: x.work_type(q, "text"), excluded=lambda q: x.analyser_exclusion(q, "text", t.age_days_regex(q, "posted_time"), f"({q.any_of('posted_time', ['mo', 'yr'])} OR {t.age_days_regex(q, 'posted_time')} > 8)"))
scalar("c13_hiring_strength", P, "post_id", strength=lambda q: f"CAST({x.hiring_strength(q, 'company', q.array(x.extract_role(q, 'text')), x.extract_emails(q, 'text'), 'text')} AS BIGINT)")
scalar("c15_fallback_role", P, "post_id", role=lambda q: x.fallback_role(q, "text"))
scalar("c16_infer_cluster", L, "row_no", cluster=lambda q: x.infer_cluster(q, "title", t.tags_split(q, "tags")))
scalar("c17_related_terms", L, "row_no", subchips=lambda q: x.related_terms(q, "title", 1), similar_fields=lambda q: x.related_terms(q, "title", 2))
scalar("c18_assign_tab", L, "row_no", tab=lambda q: x.assign_tab(q, "title", "tags"))
scalar("c18_assign_tab_posts", P, "post_id", tab=lambda q: x.assign_tab(q, "author_headline", "text"))
scalar("c19_work_mode", P, "post_id", mode=lambda q: x.work_mode(q, "location", "text"))
scalar("c20_priority_boost", L, "row_no", boost=lambda q: x.priority_boost(q, "title", "hiring_organization"), boost_remote=lambda q: x.priority_boost(q, "title", "hiring_organization", PRIORITY_REMOTE), boost_founders=lambda q: x.priority_boost(q, "title", "hiring_organization", PRIORITY_FOUNDERS), boost_ai=lambda q: x.priority_boost(q, "title", "hiring_organization", PRIORITY_AI))
scalar("f1_flag_scam", P, "post_id", scam=lambda q: x.flag_scam(q, "text"), scam_raw=lambda q: x.flag_scam_raw(q, "text"))
scalar("f2_flag_story", P, "post_id", story=lambda q: x.flag_story(q, "text"))
scalar("f3_flag_hiring_intent", P, "post_id", intent=lambda q: x.flag_hiring_intent(q, "text"))
scalar("f4_flag_blacklist", P, "post_id", blacklisted=lambda q: x.flag_blacklist(q, "company"))
scalar("f5_flag_region_eligible", P, "post_id", eligible=lambda q: x.flag_region_eligible(q, "location", "text"))
scalar("f5b_flag_region_hot", P, "post_id", eligible=lambda q: x.flag_region_hot(q, "location", "text"))
scalar("f6_classify_posts", P, "post_id", reason=lambda q: x.verdict(q, "text", "location", "company"))
scalar("f8_region_policies", P, "post_id", **{name: (lambda q, f=f: f(q, "location", "text")) for name, f in x.POLICIES.items()})
scalar("f9_relevant_role", P, "post_id", relevant=lambda q: x.relevant_role(q, "author_headline", "text"))
scalar("f10_intern_titles", L, "row_no", intern_title=lambda q: x.intern_title(q, "title"), portal_title=lambda q: x.intern_title(q, "title", PORTAL_TITLES))
scalar("a1_source_score", P, "post_id", points=lambda q: f"CAST({t.freshness_points(q, t.age_hours_simple(q, 'posted_time'))} AS BIGINT)", score=lambda q: f"CAST({t.freshness_points(q, t.age_hours_simple(q, 'posted_time'))} + CASE query_seq % 5 WHEN 0 THEN 50 WHEN 1 THEN 45 WHEN 2 THEN 40 WHEN 3 THEN 35 ELSE 15 END AS BIGINT)")
scalar("a6_listing_score", L, "row_no", score=lambda q: f"CAST({t.listing_score(q, t.hours_since(q, 'date_added'), t.parse_stipend(q, 'stipend'))} AS BIGINT)")
scalar("a19_raw_engagement", P, "post_id", engagement=lambda q: f"CAST({t.raw_engagement(q, 'likes', 'comments')} AS BIGINT)")
scalar("q6_fresh_flag", L, "row_no", fresh=lambda q: t.fresh_flag(q, t.hours_since(q, "date_added")))
scalar("j8_composite_keys", L, "row_no", url_role=lambda q: t.url_role_key(q, "post_url", "title"), company_role=lambda q: t.company_role_key(q, "hiring_organization", "title"), text_key=lambda q: t.text_role_key(q, "tags", "title"))
