"""Boundary rows of the scalar operators, in both dialects."""

import duckdb
import pytest

from postsieve.functions import extract as x
from postsieve.functions import text as t
from postsieve.functions.dialect import DUCK, SPARK

CASES = [
    (t.age_hours, ["5h"], 5), (t.age_hours, ["3d"], 72), (t.age_hours, ["2w"], 336), (t.age_hours, ["30m"], 0), (t.age_hours, ["2mo"], 0), (t.age_hours, ["just now"], 0), (t.age_hours, ["yesterday-ish"], None), (t.age_hours, [""], None),
    (t.age_hours, ["2024-01-30T10:30:00.000Z"], 13), (t.age_hours_simple, ["1 mo"], 0), (t.age_days_regex, ["2w"], 14), (t.age_days_regex, ["1 yr"], 30),
    (t.parse_stipend, ["10k"], 10000), (t.parse_stipend, ["5L"], 500000), (t.parse_stipend, ["2.3L"], 229999), (t.parse_stipend, ["5,000/month"], 5000), (t.parse_stipend, ["10-15k"], 15000), (t.parse_stipend, ["10kpm"], 10),
    (t.parse_stipend, ["unpaid"], None), (t.parse_stipend, [""], None), (t.normalize_company_key, ["Acme Technologies Pvt. Ltd."], "acme"), (t.normalize_company_key, ["ACME, Inc."], "acme"), (t.normalize_company_key, ["acme inc"], "acme"),
    (t.normalize_company_loose, ["Acme Pvt. Ltd."], "acme"), (t.clean_company_url, ["https://www.physics-wallah.com/jobs"], "Physics-Wallah"), (t.clean_company_analysis, ["Plain Name"], "Plain Name"), (t.clean_company_analysis, ["www.kite.com/x"], "Kite"),
    (t.role_bucket_8, ["Senior Backend Developer Intern"], "software"), (t.role_bucket_8, ["Machine Learning Intern"], "data"), (t.role_bucket_8, ["Recruitment Intern"], "design"), (t.role_bucket_8, ["Apprentice"], "software"),
    (t.role_bucket_11, ["Zookeeping and more words"], "zookeeping and more w"[:20]), (t.normalize_text, ["héllo,  WORLD! 100% x_y"], "héllo world 100 x_y"), (t.normalize_text, [None], ""), (t.normalize_title, [" A-b  C "], "ab c"),
    (t.title_case, ["physics-wallah 3d"], "Physics-Wallah 3D"), (t.hours_since, [""], 24), (t.hours_since, ["2024-01-31"], 1), (t.hours_since, ["2024-01-05 09:00"], 615), (t.truncate_text, ["x" * 501], "x" * 500 + "..."), (t.truncate_text, ["x" * 500], "x" * 500),
    (t.org_initials, ["north wind labs"], "NW"), (t.listing_id, ["Org", "Title"], "sh-e2a9df4c"), (t.unfenced, ['```json\n{"a": 1}\n```'], '{"a": 1}'), (t.blank_sentinels, ["null"], None),
    (x.extract_emails, ["a jobs@acme.com logo@2x.png jobs@acme.com"], "jobs@acme.com"), (x.extract_locations, ["in Bengaluru"], "Bangalore"), (x.extract_locations, ["remote"], "Remote"), (x.extract_locations, ["New Delhi"], "Delhi, New Delhi"),
    (x.extract_apply_link, ["https://a.in/x https://forms.gle/y"], "https://forms.gle/y"), (x.extract_apply_link, ["https://a.in/x https://b.in"], "https://a.in/x"), (x.extract_apply_link, ["none"], ""),
    (x.flag_region_eligible, ["London, UK", "x"], False), (x.flag_region_eligible, ["Dubai / India", "x"], True), (x.flag_region_eligible, ["Remote", "Indian candidates"], True), (x.flag_region_eligible, ["Remote", "anyone"], False), (x.flag_region_eligible, ["Pan India", ""], True),
    (x.flag_scam, ["a" * 150 + " registration fee"], False), (x.flag_scam, ["Pay a Registration-Fee"], False), (x.flag_scam, ["pay a registration fee!"], True), (x.work_type, ["full time or part-time"], "Part-time"),
    (x.extract_role, ["nothing"], "Internship"), (x.company_from_headline, ["", "Recruiter at Northwind Labs", "me"], "Northwind Labs"), (x.company_from_headline, ["", "CEO | Manager Hub", "me"], "me"), (x.hiring_signals, ["hiring, mail a@b.c"], "role_keyword,contact_method"),
    (x.verdict, ["Hiring a developer intern", "Pan India", "GAO Tek"], "blacklisted_company"), (x.verdict, ["Hiring a developer intern", "Pan India", "Kite"], "ok"), (x.work_mode, ["Bangalore", "or remote"], "Bangalore / Remote"), (x.work_mode, ["", "in Bengaluru"], "Bangalore (On-site)"), (x.work_mode, ["Pune", "office"], "Remote (India)"),
    (x.fallback_role, ["HR and data science"], "Hr Intern"), (x.fallback_role, ["a business analyst"], "Business Analyst Intern"), (x.fallback_role, ["software"], "Internship"),
    (x.assign_tab, ["SEO Intern", "Vue and CSS"], "Frontend"), (x.assign_tab, ["Founder's Office", "nothing"], "Founder's Office"), (x.assign_tab, ["Cook", "kitchen"], "Other"),
    (x.priority_boost, ["Growth Intern", "Kite"], 5), (x.priority_boost, ["Cook", "Kite"], 1), (x.priority_boost, ["Cook ba", "cke"], 1), (x.priority_boost, ["fro", "ntend"], 5),
    (x.remote_only, ["Remote", "not remote"], False), (x.remote_only, ["not remote", "wfh"], True), (x.remote_only, ["Pune", "on site"], False),
    (x.city_or_home_or_remote, ["London, UK", "india"], False), (x.city_or_home_or_remote, ["Ukraine", "remote"], True), (x.city_or_home_or_remote, ["Pune", "office"], False),
    (x.remote_home, ["Remote", "for indian students"], True), (x.remote_home, ["Remote", "india, on-site only"], False), (x.remote_home, ["Remote", "india, hybrid only"], False), (x.remote_home, ["Remote", "india or london"], False), (x.remote_home, ["Remote", "anyone"], False),
    (x.city_or_remote_home, ["Bengaluru", "office mandatory"], True), (x.city_or_remote_home, ["Pune", "remote, office mandatory"], False), (x.city_or_remote_home, ["Bangalore", "or Dubai"], False), (x.city_or_remote_home, ["Pune", "virtual"], True),
    (x.relevant_role, ["Intern", ""], True), (x.relevant_role, ["", "international"], False), (x.relevant_role, ["Ops", ""], True), (x.intern_title, ["Campus Hire"], True), (x.intern_title, ["Junior Fellow"], False),
    (t.company_role_key, ["Kite Pvt Ltd", "Data Intern"], "kite|data"), (t.company_role_key, ["Unknown", "Data Intern"], None), (t.company_role_key, ["Kite", "Internship"], None),
]


def _call(q, f, args):
    return f(q, *["CAST(NULL AS VARCHAR(9))" if a is None else q.lit(a) for a in args])


def test_boundaries(spark):
    names = [f"c{i}" for i in range(len(CASES))]
    row = spark.range(1).selectExpr(*[f"{_call(SPARK, f, a)} AS {n}" for n, (f, a, _) in zip(names, CASES, strict=True)]).first()
    con = duckdb.connect()
    wrong = []
    for n, (f, a, want) in zip(names, CASES, strict=True):
        duck = con.execute(f"SELECT {_call(DUCK, f, a)}").fetchone()[0]
        if f is not t.listing_id and (row[n], duck) != (want, want) or row[n] != duck:
            wrong.append((f.__name__, a, want, row[n], duck))
    assert not wrong


@pytest.mark.parametrize(("hours", "stipend"), [(0, 0), (200, 200_000), (24, 15_000)])
def test_score_range(spark, hours, stipend):
    got = spark.range(200).selectExpr(f"{t.listing_score(SPARK, f'(id + {hours})', str(stipend))} AS s").selectExpr("min(s)", "max(s)").first()
    assert 50 <= got[0] <= got[1] <= 99


def test_formats(spark):
    got = spark.sql("SELECT explode(array(0L, 999L, 1500L, 100000L, 229999L)) AS n").selectExpr(f"{t.format_stipend(SPARK, 'n')} AS s").collect()
    assert [r.s for r in got] == ["Unpaid / Undisclosed", "₹999/mo", "₹2K/mo", "₹1L/mo", "₹2.3L/mo"]
    got = spark.sql("SELECT explode(array(0, 5, 24, 36, 60)) AS n").selectExpr(f"{t.format_age(SPARK, 'n')} AS s").collect()
    assert [r.s for r in got] == ["Just now", "5h ago", "1 day ago", "2 days ago", "3 days ago"]
