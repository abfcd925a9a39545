"""DuckDB SQL written by hand, with its own literals: what queries are held against shares no code with them."""

from __future__ import annotations

_NORM = r"""substring(trim(regexp_replace(lower(regexp_replace(substring(coalesce(text, ''), 1, 300), '[^\p{L}\p{N}_\s]', '', 'g')), '\s+', ' ', 'g')), 1, 150)"""
_SCAM = "registration fee|reg fee|registration charges|training fee|training charges|training cost|security deposit|caution money|certification fee|pay to join|pay to work|investment required|investment needed|typing job|data entry job|form filling|copy paste|earn daily|earn per day|easy money|work from home earn|100 genuine|100% genuine|guaranteed income|guaranteed placement|whatsapp to register|whatsapp registration|simple typing|home based typing|no investment"
_STORY = "my journey|wrapped up my time|excited to announce|officially a|vibecoding|from learning to earning|i am looking for|i''m looking for|seeking a|seeking an|open to work|happy to share|thrilled to share|completed my internship|grateful to|proud to share"
_HIRING = "hiring|looking for|apply|opportunity|openings|opening|interns required|join our team|we are expanding|internship alert|recruiting|vacancy|we''re hiring|now hiring|intern"
_ABROAD = "usa|uk|london|new york|san francisco|los angeles|dubai|uae|australia|canada|germany|singapore|hong kong|europe|united states|united kingdom|korea|japan|china|malaysia|netherlands|france|italy|toronto|sydney|berlin|amsterdam|paris|seoul|riyadh|kuwait|qatar|bahrain|oman"
_PLACES = "india|bangalore|bengaluru|mumbai|delhi|new delhi|gurgaon|gurugram|noida|hyderabad|chennai|pune|kolkata|ahmedabad|jaipur|lucknow|chandigarh|indore|kochi|coimbatore|nagpur|bhopal|visakhapatnam|thiruvananthapuram|surat|vadodara|mysore|mangalore|pan india|wfh|work from home"
_CONTEXT = "india|bangalore|bengaluru|mumbai|delhi|hyderabad|pune|noida|gurgaon|chennai|kolkata|ahmedabad|jaipur|pan india|indian students|for india|in india|indian candidates"
_BLACK = "gao group|gaotek|gao tek"
_ELIGIBLE = f"CASE WHEN regexp_matches(lower(location), '{_ABROAD}') AND position('india' IN lower(location)) = 0 THEN false WHEN regexp_matches(lower(location), '{_PLACES}') THEN true ELSE regexp_matches(lower(text), '{_CONTEXT}') END"
_REASON = f"CASE WHEN regexp_matches(lower(trim(company)), '{_BLACK}') THEN 'blacklisted_company' WHEN regexp_matches(n, '{_SCAM}') THEN 'scam' WHEN regexp_matches(n, '{_STORY}') THEN 'personal_story' WHEN NOT regexp_matches(n, '{_HIRING}') THEN 'no_hiring_intent' WHEN NOT ({_ELIGIBLE}) THEN 'not_india_eligible' ELSE 'ok' END"
_POSTS = f"(SELECT *, {_NORM} AS n FROM fx_posts)"
_TAB = r"""CASE WHEN regexp_matches(w, 'frontend|front end|react|vue|angular|javascript|typescript|next\.js|nuxt|svelte|css|html') THEN 'Frontend'
 WHEN regexp_matches(w, 'backend|back end|node\.js|python|django|fastapi|express|java|spring|golang|ruby|php|api developer') THEN 'Backend'
 WHEN regexp_matches(w, 'full stack|fullstack|mern|mean stack|full-stack') THEN 'Full Stack'
 WHEN regexp_matches(w, 'machine learning|deep learning|nlp|computer vision|data science|ai researcher|prompt engineer|rag|langchain|fine tuning|ai agent|generative ai|llm|ai engineer|ai product') THEN 'AI & ML'
 WHEN regexp_matches(w, 'ai automation|automation engineer|rpa|workflow automation|zapier|make\.com|n8n') THEN 'AI Automation'
 WHEN regexp_matches(w, 'ugc|ai video|ai content|content creator|short form|video content|reels|social media') THEN 'AI UGC & Content'
 WHEN regexp_matches(w, 'founder|chief of staff') THEN 'Founder''s Office'
 WHEN regexp_matches(w, 'growth|business development|bd intern|sales intern|gtm|go-to-market') THEN 'Growth & BizDev'
 WHEN regexp_matches(w, 'product manager|product management|pm intern|product intern|operations|ops intern|strategy intern') THEN 'Product & Ops'
 WHEN regexp_matches(w, 'software developer|software engineer|sde|swe|devops|cloud engineer|kubernetes|docker|aws|gcp|site reliability') THEN 'SDE & DevOps'
 WHEN regexp_matches(w, 'android|ios developer|flutter|react native|mobile developer') THEN 'Mobile' ELSE 'Other' END"""
_TECH = r"frontend|front end|react|vue|angular|javascript|typescript|backend|back end|node|python|django|fastapi|express|java|spring|full stack|fullstack|mern|mean|next\.js|nuxt|ai|automation|machine learning|llm|nlp|data science|prompt engineer|computer vision|deep learning|rag|langchain|fine tuning|ugc|content creator|short form|video content|founder|chief of staff|generalist|growth|business development|bd intern|product manager|product management|pm intern|product intern|operations|ops intern|strategy|gtm|go-to-market|sales intern|software developer|software engineer|sde|swe|devops|cloud|kubernetes|docker|android|ios|flutter|react native|mobile"
_REMOTE_ROLES = "founder|office|chief of staff|generalist|ai automation|ai engineer|digital marketing|growth|business development|product manager|product management|finance|financial analyst|research analyst|operations|ops|strategy|consulting|gtm|go-to-market|performance marketing|social media"
_BOOST = lambda words: f"CASE WHEN regexp_matches(w, '{words}') THEN 5 ELSE 1 END"
_FOREIGN = r"\b(usa|us only|uk only|united states|united kingdom|canada|australia|germany|france|europe|dubai|uae|singapore|malaysia|london|new york|san francisco|california|remote (us|uk|canada|australia))\b"
_ONSITE = r"\b((no|not) remote|(on.?site|in.?office) only|must relocate|office mandatory)\b"
_REMOTE = r"\b(remote|work from home|wfh|work.?from.?anywhere|virtual)\b"
_CITIES = r"\b(india|indian|bangalore|bengaluru|mumbai|delhi|hyderabad|pune|chennai|kolkata|ahmedabad|jaipur|noida|gurgaon|gurugram|chandigarh|lucknow|indore|bhopal|surat|vadodara|kochi|thiruvananthapuram|coimbatore|nagpur|visakhapatnam|pan.?india)\b"
_BLR = r"\b(bangalore|bengaluru)\b"
_AGE = "CASE WHEN posted_time = '5h' THEN 5 WHEN posted_time = '3d' THEN 72 WHEN posted_time = '2w' THEN 336 WHEN posted_time IN ('30m', '2mo', 'just now') THEN 0 WHEN posted_time = '2024-01-30T10:30:00.000Z' THEN 13 WHEN posted_time = '9d' THEN 216 WHEN posted_time = '23 hours ago' THEN 23 END"
_SOURCE = "CASE query_seq % 5 WHEN 0 THEN 'LinkedIn Posts' WHEN 1 THEN 'LinkedIn Jobs' WHEN 2 THEN 'Niche Communities' WHEN 3 THEN 'Unstop' ELSE 'Government Portals' END"

HANDWRITTEN = {
    "n1_normalize_text": f"SELECT post_id, n AS norm FROM {_POSTS}",
    "n4a_role_bucket_8": r"""SELECT row_no, CASE WHEN regexp_matches(w, 'software|sde|developer|frontend|backend|full stack|app|web|ios|android') THEN 'software' WHEN regexp_matches(w, 'data|machine learning|ml|ai|analytics|scientist') THEN 'data'
 WHEN regexp_matches(w, 'product|pm') THEN 'product' WHEN regexp_matches(w, 'marketing|seo|social media|content') THEN 'marketing' WHEN regexp_matches(w, 'design|ui|ux|graphic|video|animation') THEN 'design' WHEN regexp_matches(w, 'finance|audit|accounting|ca ') THEN 'finance'
 WHEN regexp_matches(w, 'sales|business development|bd|bdr') THEN 'sales' WHEN regexp_matches(w, 'hr|human resources|talent|recruitment') THEN 'hr' ELSE regexp_replace(w, '[^a-z]', '', 'g') END AS bucket FROM (SELECT row_no, lower(title) AS w FROM fx_published)""",
    "n7_parse_stipend": "SELECT row_no, r AS rupees, coalesce(r, 0) AS rupees_or_0 FROM (SELECT row_no, CAST(CASE stipend WHEN '10k' THEN 10000 WHEN '5L' THEN 500000 WHEN '2.3L' THEN 229999 WHEN '5,000/month' THEN 5000 WHEN '15000' THEN 15000 WHEN '10-15k' THEN 15000 WHEN '12 K' THEN 12000 END AS BIGINT) AS r FROM fx_published)",
    "n5a_age_hours": f"SELECT post_id, CAST(CASE WHEN post_id % 10 = 0 THEN (1706659200 - (1706600000 + post_id * 60)) // 3600 ELSE {_AGE} END AS BIGINT) AS age FROM fx_posts",
    "c6_work_type": "SELECT post_id, CASE WHEN regexp_matches(lower(text), 'part[- ]time') THEN 'Part-time' WHEN regexp_matches(lower(text), 'full[- ]time') THEN 'Full-time' ELSE '' END AS work_type FROM fx_posts",
    "c8_engagement_score": "SELECT post_id, CAST((likes > 50)::INT + (comments > 10)::INT + (reposts > 5)::INT AS BIGINT) AS engagement FROM fx_posts",
    "c15_fallback_role": "SELECT post_id, CASE WHEN w LIKE '%finance%' THEN 'Finance Intern' WHEN w LIKE '%marketing%' THEN 'Marketing Intern' WHEN w LIKE '%operations%' THEN 'Operations Intern' WHEN w LIKE '%hr%' THEN 'Hr Intern' WHEN w LIKE '%sales%' THEN 'Sales Intern' WHEN w LIKE '%business analyst%' THEN 'Business Analyst Intern' WHEN w LIKE '%data science%' THEN 'Data Science Intern' ELSE 'Internship' END AS role FROM (SELECT post_id, lower(text) AS w FROM fx_posts)",
    "c18_assign_tab": f"SELECT row_no, {_TAB} AS tab FROM (SELECT row_no, lower(title || ' ' || tags) AS w FROM fx_published)",
    "c18_assign_tab_posts": f"SELECT post_id, {_TAB} AS tab FROM (SELECT post_id, lower(author_headline || ' ' || text) AS w FROM fx_posts)",
    "c19_work_mode": rf"SELECT post_id, CASE WHEN NOT regexp_matches(w, '{_BLR}') THEN 'Remote (India)' WHEN regexp_matches(w, '\b(remote|wfh|work from home)\b') THEN 'Bangalore / Remote' ELSE 'Bangalore (On-site)' END AS mode FROM (SELECT post_id, lower(location || ' ' || text) AS w FROM fx_posts)",
    "c20_priority_boost": f"SELECT row_no, {_BOOST(_TECH)} AS boost, {_BOOST(_REMOTE_ROLES)} AS boost_remote, {_BOOST('founder|office|ai|automation|chief|generalist')} AS boost_founders, {_BOOST('founder|office|ai|automation|chief')} AS boost_ai FROM (SELECT row_no, lower(title || hiring_organization) AS w FROM fx_published)",
    "f1_flag_scam": f"SELECT post_id, regexp_matches(n, '{_SCAM}') AS scam, regexp_matches(lower(text), 'registration fee|reg fee|registration charges|training fee|training charges|training cost|security deposit|caution money|certification fee|pay to join|pay to work|investment required|typing job|data entry job|form filling job|copy paste job|earn daily|earn per day|easy money|work from home earn|100% genuine|guaranteed income|guaranteed placement|whatsapp to register|whatsapp registration|simple typing|home based typing') AS scam_raw FROM {_POSTS}",
    "f2_flag_story": f"SELECT post_id, regexp_matches(n, '{_STORY}') AS story FROM {_POSTS}",
    "f3_flag_hiring_intent": f"SELECT post_id, regexp_matches(n, '{_HIRING}') AS intent FROM {_POSTS}",
    "f4_flag_blacklist": f"SELECT post_id, regexp_matches(lower(trim(company)), '{_BLACK}') AS blacklisted FROM fx_posts",
    "f5_flag_region_eligible": f"SELECT post_id, {_ELIGIBLE} AS eligible FROM fx_posts",
    "f6_classify_posts": f"SELECT post_id, {_REASON} AS reason FROM {_POSTS}",
    "f8_region_policies": rf"""SELECT post_id, regexp_matches(w, 'remote|work from home|wfh') AND NOT regexp_matches(t, 'no remote|not remote') AS remote_only,
 NOT regexp_matches(l, '\b(usa|uk|united states|united kingdom|canada|australia|germany|france|europe|dubai|uae|singapore|malaysia|london|new york|san francisco|california|texas|amsterdam|remote us|remote uk|us only)\b') AND regexp_matches(w, 'chennai|india|remote|work from home|wfh') AS city_or_home_or_remote,
 NOT regexp_matches(w, '{_ONSITE}') AND NOT regexp_matches(w, '\bhybrid only\b') AND NOT regexp_matches(w, '{_FOREIGN}') AND regexp_matches(w, '{_REMOTE}') AND regexp_matches(w, '{_CITIES}') AS remote_home,
 CASE WHEN regexp_matches(w, '{_ONSITE}') AND NOT regexp_matches(w, '{_BLR}') THEN false WHEN regexp_matches(w, '{_FOREIGN}') THEN false WHEN regexp_matches(w, '{_BLR}') THEN true ELSE regexp_matches(w, '{_REMOTE}') AND regexp_matches(w, '{_CITIES}') END AS city_or_remote_home
 FROM (SELECT post_id, lower(location) AS l, lower(text) AS t, lower(location || ' ' || text) AS w FROM fx_posts)""",
    "f9_relevant_role": rf"SELECT post_id, regexp_matches(w, '{_REMOTE_ROLES}') OR regexp_matches(w, '\bintern(ship)?\b') AS relevant FROM (SELECT post_id, lower(author_headline || ' ' || text) AS w FROM fx_posts)",
    "f10_intern_titles": "SELECT row_no, regexp_matches(lower(title), 'intern|trainee|fresher|graduate|entry|campus|university') AS intern_title, regexp_matches(lower(title), 'intern|trainee|fellowship|apprentice|young') AS portal_title FROM fx_published",
    "a1_source_score": "SELECT post_id, CAST(p AS BIGINT) AS points, CAST(p + CASE query_seq % 5 WHEN 0 THEN 50 WHEN 1 THEN 45 WHEN 2 THEN 40 WHEN 3 THEN 35 ELSE 15 END AS BIGINT) AS score FROM (SELECT post_id, query_seq, CASE posted_time WHEN '5h' THEN 25 WHEN '30m' THEN 25 WHEN '2mo' THEN 25 WHEN 'just now' THEN 25 WHEN '23 hours ago' THEN 15 WHEN '3d' THEN 5 WHEN '2w' THEN 5 WHEN '9d' THEN 5 WHEN '2024-01-30T10:30:00.000Z' THEN 10 ELSE 10 END AS p FROM fx_posts)",
    "a9_reason_histogram": f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM {_POSTS}) GROUP BY reason",
    "a17_score_100": f"""SELECT post_id, source, CAST(s AS BIGINT) AS source_points, CAST(f AS BIGINT) AS freshness, CAST(c AS BIGINT) AS competition, CAST(e AS BIGINT) AS engagement, CAST(s + f + c + e AS BIGINT) AS score_100 FROM (SELECT post_id, source,
 CASE source WHEN 'LinkedIn Posts' THEN 30 WHEN 'LinkedIn Jobs' THEN 25 WHEN 'Niche Communities' THEN 20 WHEN 'Unstop' THEN 15 ELSE 10 END AS s, CASE WHEN age IS NULL THEN 0 WHEN age < 6 THEN 25 WHEN age < 12 THEN 20 WHEN age < 24 THEN 15 WHEN age <= 48 THEN 10 ELSE 5 END AS f,
 CASE WHEN source <> 'LinkedIn Jobs' THEN 0 WHEN likes * 3 < 50 THEN 25 WHEN likes * 3 <= 100 THEN 20 WHEN likes * 3 <= 200 THEN 15 WHEN likes * 3 <= 300 THEN 10 ELSE 5 END AS c,
 CASE WHEN source <> 'LinkedIn Posts' THEN 0 ELSE 5 + 5 * ((likes > 50)::INT + (comments > 10)::INT + (reposts > 5)::INT) END AS e FROM (SELECT *, {_SOURCE} AS source, {_AGE} AS age FROM fx_posts))""",
}
