"""Adapter views: posting feeds projected from the given tables, in SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FX_POSTS = """
SELECT doc_id AS post_id, CAST(substring(source, 4, 3) AS INT) AS query_seq,
       'author ' || CAST(doc_id % 211 AS STRING) AS author_name,
       CASE doc_id % 4 WHEN 0 THEN 'Recruiter at Northwind Labs' WHEN 1 THEN 'Founder | Bluepeak' WHEN 2 THEN 'HR Manager - Kite Works' ELSE 'Engineer' END AS author_headline,
       CASE doc_id % 7 WHEN 0 THEN 'Northwind Technologies Pvt. Ltd.' WHEN 1 THEN 'northwind' WHEN 2 THEN 'Bluepeak Inc.' WHEN 3 THEN 'https://www.kiteworks.com/jobs' WHEN 4 THEN 'GAO Tek' WHEN 5 THEN '' ELSE 'Unknown' END AS company,
       CASE doc_id % 9 WHEN 0 THEN 'Bangalore' WHEN 1 THEN 'Remote' WHEN 2 THEN 'London, UK' WHEN 3 THEN '' WHEN 4 THEN 'Pan India' WHEN 5 THEN 'Dubai / India' WHEN 6 THEN 'Mumbai' WHEN 7 THEN 'Lisbon' ELSE 'Gurugram, Hybrid' END AS location,
       CASE doc_id % 16
         WHEN 0 THEN 'Hiring a backend developer intern. Apply: https://forms.gle/a1 or jobs@acme.in. '
         WHEN 1 THEN 'Hiring data analyst interns for India, stipend 15k. Read https://blog.acme.in then https://acme.in/careers. '
         WHEN 2 THEN 'Pay a small registration fee and start the internship. '
         WHEN 3 THEN 'Typing job, earn daily, easy money. '
         WHEN 4 THEN 'Excited to announce that I completed my internship. '
         WHEN 5 THEN 'Open to work and seeking an opportunity. '
         WHEN 6 THEN 'Lunch with the team was great. '
         WHEN 7 THEN 'Urgent opening: marketing intern, part-time, remote, Indian candidates only. DM or mail hr@kite.in. '
         WHEN 8 THEN 'Recruitment intern needed, full time, Noida. Share CV at people@kite.in. '
         WHEN 9 THEN 'Hiring for multiple positions! Apply. '
         WHEN 10 THEN 'We are expanding in Pune and Bengaluru. UI/UX design intern. '
         WHEN 11 THEN 'Finance intern, Chennai, 5L. See logo@2x.png and https://acme.in/about. '
         WHEN 12 THEN 'Legal intern, New Delhi. Apply by mail: law@acme.in. '
         WHEN 13 THEN 'Apprentice trainee role available. '
         WHEN 14 THEN 'Product management intern, work from home, apply in India. '
         ELSE '' END || text AS text,
       CASE WHEN doc_id % 23 = 0 THEN '' ELSE 'https://posts.example/' || CAST(doc_id % 787 AS STRING) END AS url,
       CASE doc_id % 12 WHEN 0 THEN '5h' WHEN 1 THEN '3d' WHEN 2 THEN '2w' WHEN 3 THEN '30m' WHEN 4 THEN '2mo' WHEN 5 THEN 'just now' WHEN 6 THEN '2024-01-30T10:30:00.000Z' WHEN 7 THEN ''
                        WHEN 8 THEN 'yesterday-ish' WHEN 9 THEN '9d' WHEN 10 THEN '23 hours ago' ELSE '1 yr' END AS posted_time,
       CAST(n_chars % 131 AS INT) AS likes, CAST(n_chars % 29 AS INT) AS comments, CAST(n_chars % 13 AS INT) AS reposts,
       CASE WHEN doc_id % 16 IN (2, 3) THEN 'scam' WHEN doc_id % 16 IN (4, 5) THEN 'story' WHEN doc_id % 16 IN (6, 15) THEN 'noise' WHEN doc_id % 9 IN (2, 7) THEN 'foreign' ELSE 'real' END AS label
FROM documents
"""

FX_PUBLISHED = """
SELECT o_orderkey AS row_no,
       CASE o_orderkey % 13 WHEN 0 THEN 'Backend Developer Intern' WHEN 1 THEN 'Machine Learning Intern' WHEN 2 THEN 'Product Manager Intern' WHEN 3 THEN 'UI/UX Designer Intern' WHEN 4 THEN 'SEO Intern'
            WHEN 5 THEN 'Audit Intern' WHEN 6 THEN 'Sales Intern' WHEN 7 THEN 'HR Generalist Intern' WHEN 8 THEN 'Content Writer Intern' WHEN 9 THEN 'Legal Intern' WHEN 10 THEN 'Full Stack Intern' WHEN 11 THEN 'Mystery Intern' ELSE '' END AS title,
       CASE o_orderkey % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'Onsite' ELSE '' END AS type,
       CASE o_orderkey % 5 WHEN 0 THEN 'Part-time' WHEN 1 THEN '' ELSE 'Full-time' END AS timing,
       CASE o_orderkey % 10 WHEN 0 THEN '10k' WHEN 1 THEN '5L' WHEN 2 THEN '2.3L' WHEN 3 THEN '5,000/month' WHEN 4 THEN 'competitive' WHEN 5 THEN '' WHEN 6 THEN '15000' WHEN 7 THEN '10-15k' WHEN 8 THEN 'unpaid' ELSE '12 K' END AS stipend,
       CASE o_orderkey % 6 WHEN 0 THEN 'Bangalore' WHEN 1 THEN 'Mumbai' WHEN 2 THEN 'Remote' WHEN 3 THEN 'Pune' WHEN 4 THEN 'Gurgaon' ELSE 'Chennai' END AS location,
       CASE o_orderkey % 3 WHEN 0 THEN 'Engineering, Python' WHEN 1 THEN ' Startup ,, Growth' ELSE '' END AS tags,
       'Org ' || CAST(o_custkey % 389 AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' Technologies' ELSE '' END AS hiring_organization,
       'https://listings.example/' || CAST(o_orderkey % 9973 AS STRING) AS post_url,
       CASE o_orderkey % 3 WHEN 0 THEN 'https://apply.example/x' ELSE '' END AS apply_link,
       CASE o_orderkey % 2 WHEN 0 THEN 'jobs@acme.in' ELSE '' END AS contact_email,
       CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'soon' ELSE '2024-01-' || substring('0' || CAST(1 + o_orderkey % 30 AS STRING), -2, 2) || ' 09:00' END AS date_added,
       CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN '3 days ago' WHEN 2 THEN '15/01/2024' ELSE '2024-01-' || substring('0' || CAST(1 + o_orderkey % 28 AS STRING), -2, 2) END AS posted_date
FROM orders
"""

FX_SUBSCRIBERS = """
SELECT 'user' || CAST(c_custkey AS STRING) || '@mail.example' AS email, c_custkey % 11 = 0 AS unsubscribed,
       CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Software' WHEN 2 THEN 'design , Product' WHEN 3 THEN 'zzz' WHEN 4 THEN 'Data/AI,,Marketing' ELSE '' END AS roles,
       CASE c_custkey % 5 WHEN 0 THEN 'Bangalore' WHEN 1 THEN '' WHEN 2 THEN 'Mumbai, Pune' ELSE ' ' END AS cities
FROM customer
"""

FX_RUNS = """
SELECT CAST(ts AS DATE) AS day, count(*) AS scanned, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) AS verified, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views
FROM events GROUP BY CAST(ts AS DATE)
"""

FX_BLOCKS = "SELECT conv_id AS page_id, turn AS idx, CASE WHEN role = 'user' THEN 'heading_1' ELSE 'paragraph' END AS type, text AS plain_text FROM conversations"

VIEWS = {"fx_posts": (FX_POSTS, "documents"), "fx_published": (FX_PUBLISHED, "orders"), "fx_subscribers": (FX_SUBSCRIBERS, "customer"), "fx_runs": (FX_RUNS, "events"), "fx_blocks": (FX_BLOCKS, "conversations"), "pages": ("SELECT * FROM pages", "pages")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, source = VIEWS[name]
    return spark.sql(sql.replace(f"FROM {source}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def with_views(sql: str) -> str:
    """DuckDB SQL with those adapter views in front that it names."""
    used = [f"{n} AS ({q.replace(' AS STRING)', ' AS VARCHAR)')})" for n, (q, _) in VIEWS.items() if n.startswith("fx_") and n in sql]
    recursive = "RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else ""
    body = sql.lstrip()
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE") if recursive else len("WITH") :]
        return f"WITH {recursive}{', '.join([*used, body])}"
    return f"WITH {', '.join(used)} {body}" if used else body
