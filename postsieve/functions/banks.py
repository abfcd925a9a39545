"""Pattern banks, ordered rule tables and thresholds that results depend on."""

SCAM = [
    "registration fee", "reg fee", "registration charges", "training fee", "training charges", "training cost",
    "security deposit", "caution money", "certification fee", "pay to join", "pay to work", "investment required", "investment needed",
    "typing job", "data entry job", "form filling", "copy paste", "earn daily", "earn per day", "easy money", "work from home earn",
    "100 genuine", "100% genuine", "guaranteed income", "guaranteed placement", "whatsapp to register", "whatsapp registration",
    "simple typing", "home based typing", "no investment",
]
SCAM_RAW = [
    "registration fee", "reg fee", "registration charges", "training fee", "training charges", "training cost", "security deposit", "caution money", "certification fee",
    "pay to join", "pay to work", "investment required", "typing job", "data entry job", "form filling job", "copy paste job",
    "earn daily", "earn per day", "easy money", "work from home earn", "100% genuine", "guaranteed income", "guaranteed placement",
    "whatsapp to register", "whatsapp registration", "simple typing", "home based typing",
]
SCAM_EARLY = [
    "registration fee", "reg fee", "training fee", "training charges", "security deposit", "caution money", "certification fee", "pay to join", "investment required", "typing job",
    "data entry job", "form filling job", "copy paste job", "earn daily", "easy money", "100 genuine", "guaranteed income", "whatsapp to register", "simple typing", "home based typing",
]
STORY = [
    "my journey", "wrapped up my time", "excited to announce", "officially a", "vibecoding", "from learning to earning", "i am looking for", "i'm looking for",
    "seeking a", "seeking an", "open to work", "happy to share", "thrilled to share", "completed my internship", "grateful to", "proud to share",
]
STORY_EARLY = [
    "my journey", "wrapped up my time", "excited to announce", "officially a", "vibecoding", "employee market hai", "from learning to earning",
    "i am looking for", "i'm looking for", "seeking a", "seeking an", "open to work",
]
HIRING = [
    "hiring", "looking for", "apply", "opportunity", "openings", "opening", "interns required", "join our team", "we are expanding", "internship alert",
    "recruiting", "vacancy", "we're hiring", "now hiring",
]
HIRING_EARLY = ["hiring", "looking for", "apply", "opportunity", "openings", "interns required", "join our team", "we are expanding", "internship alert"]
BLACKLIST = ["gao group", "gaotek", "gao tek"]
HOME_PLACES = [
    "india", "bangalore", "bengaluru", "mumbai", "delhi", "new delhi", "gurgaon", "gurugram", "noida", "hyderabad", "chennai", "pune",
    "kolkata", "ahmedabad", "jaipur", "lucknow", "chandigarh", "indore", "kochi", "coimbatore", "nagpur", "bhopal", "visakhapatnam",
    "thiruvananthapuram", "surat", "vadodara", "mysore", "mangalore", "pan india", "wfh", "work from home",
]
FOREIGN_PLACES = [
    "usa", "uk", "london", "new york", "san francisco", "los angeles", "dubai", "uae", "australia", "canada", "germany", "singapore",
    "hong kong", "europe", "united states", "united kingdom", "korea", "japan", "china", "malaysia", "netherlands", "france", "italy",
    "toronto", "sydney", "berlin", "amsterdam", "paris", "seoul", "riyadh", "kuwait", "qatar", "bahrain", "oman",
]
HOME_TEXT = [
    "india", "bangalore", "bengaluru", "mumbai", "delhi", "hyderabad", "pune", "noida", "gurgaon", "chennai", "kolkata", "ahmedabad", "jaipur", "pan india",
    "indian students", "for india", "in india", "indian candidates",
]
ROLE_SIGNALS = ["hiring", "looking for", "opening", "position", "opportunity", "vacancy", "recruit"]
TYPE_SIGNALS = ["intern", "internship", "job", "fresher", "trainee", "associate", "entry level"]
ACTION_SIGNALS = ["apply", "dm", "send resume", "share cv", "drop your resume", "send your cv", "reach out", "contact"]
URGENCY_SIGNALS = ["immediate", "urgent", "asap", "starting soon", "immediate joining", "walk-in"]
CONTACT_SIGNALS = [r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+", r"forms\.gle", r"bit\.ly", r"linkedin\.com/in/", "comment below"]
STRENGTH_WORDS = ["hiring", "openings", "recruiting", "vacancy", "join our team", "apply here"]
VAGUE_ROLES = ["internship", "intern", "hiring", "role", "unknown"]
CORPORATE_WORDS = r"\b(inc\.?|pvt\.?|ltd\.?|llp|llc|corp\.?|limited|private|technologies|tech|solutions|services|group|global|india)\b"
CORPORATE_SUFFIXES = [" pvt ltd", " pvt. ltd.", " private limited", " inc", " inc.", " llc", " ltd", " ltd."]
ROLE_BUCKETS_8 = [
    ("software", ["software", "sde", "developer", "frontend", "backend", "full stack", "app", "web", "ios", "android"]),
    ("data", ["data", "machine learning", "ml", "ai", "analytics", "scientist"]),
    ("product", ["product", "pm"]),
    ("marketing", ["marketing", "seo", "social media", "content"]),
    ("design", ["design", "ui", "ux", "graphic", "video", "animation"]),
    ("finance", ["finance", "audit", "accounting", "ca "]),
    ("sales", ["sales", "business development", "bd", "bdr"]),
    ("hr", ["hr", "human resources", "talent", "recruitment"]),
]
ROLE_BUCKETS_11 = [
    ("software", ["software", "sde", "developer", "frontend", "backend", "full stack", "web", "ios", "android"]),
    ("data", ["data", "machine learning", "ml", "ai", "analytics", "scientist"]),
    ("product", ["product", "apm"]),
    ("marketing", ["marketing", "seo", "social media", "content"]),
    ("design", ["design", "ui", "ux", "graphic", "video", "animation"]),
    ("finance", ["finance", "audit", "accounting", "ca "]),
    ("sales", ["sales", "business development", "bd"]),
    ("hr", ["hr", "human resources", "talent", "recruitment"]),
    ("strategy", ["founder", "generalist", "chief of staff", "operations", "strategy"]),
    ("legal", ["law", "legal", "compliance"]),
    ("research", ["research"]),
]
ROLE_PATTERNS = [
    (r"(software|sde|backend|frontend|full[- ]?stack|web|app|mobile|ios|android)\s*(developer|engineer|dev|intern)", "Software Developer Intern"),
    (r"(data\s*(science|scientist|analyst|analytics|engineer))", "Data Science Intern"),
    (r"(machine\s*learning|ml|ai|artificial\s*intelligence)\s*(engineer|intern)?", "ML/AI Intern"),
    (r"(devops|cloud|aws|azure|gcp)\s*(engineer|intern)?", "DevOps/Cloud Intern"),
    (r"(cyber\s*security|security|infosec)", "Security Intern"),
    (r"(qa|quality|test|testing)\s*(engineer|analyst|intern)?", "QA/Testing Intern"),
    (r"(business\s*(analyst|development|dev)|bd)\s*(intern)?", "Business Development Intern"),
    (r"(product\s*(manager|management|owner)|pm)\s*(intern)?", "Product Management Intern"),
    (r"(project\s*(manager|management|coordinator))", "Project Management Intern"),
    (r"(operations|ops)\s*(intern|analyst|manager)?", "Operations Intern"),
    (r"(strategy|consulting|consultant)", "Strategy/Consulting Intern"),
    (r"(digital\s*marketing|seo|sem|ppc|performance\s*marketing)", "Digital Marketing Intern"),
    (r"(social\s*media|smm|content\s*writer|content\s*creator)", "Social Media/Content Intern"),
    (r"(marketing)\s*(intern|executive|analyst)?", "Marketing Intern"),
    (r"(graphic\s*design|ui/ux|ux|ui|design)\s*(intern)?", "Design Intern"),
    (r"(video\s*edit|video\s*production|motion\s*graphics)", "Video/Motion Design Intern"),
    (r"(finance|financial\s*analyst|accounts|accounting)", "Finance/Accounts Intern"),
    (r"(investment\s*banking|ib\s*analyst|equity\s*research)", "Investment Banking Intern"),
    (r"(ca\s*intern|chartered\s*accountant|audit)", "CA/Audit Intern"),
    (r"(legal|law|paralegal|corporate\s*law)", "Legal Intern"),
    (r"(hr|human\s*resource|talent\s*acquisition|recruitment)", "HR Intern"),
    (r"(admin|administration|office|executive\s*assistant)", "Admin Intern"),
    (r"(sales|bdr|sdr|inside\s*sales)", "Sales Intern"),
    (r"(customer\s*(success|support)|client\s*relations)", "Customer Success Intern"),
    (r"(research\s*(intern|analyst|associate))", "Research Intern"),
    (r"(teaching|tutor|education|academic)", "Education/Teaching Intern"),
    (r"(intern|internship|trainee|fresher)", "Internship"),
]
EXTRACT_PLACES = [
    "bangalore", "bengaluru", "mumbai", "delhi", "new delhi", "gurgaon", "gurugram", "noida", "hyderabad", "chennai", "pune", "kolkata", "ahmedabad", "jaipur", "lucknow",
    "chandigarh", "indore", "kochi", "coimbatore", "nagpur", "bhopal", "visakhapatnam", "thiruvananthapuram", "surat", "vadodara", "mysore", "mangalore",
    "remote", "work from home", "wfh", "hybrid",
]
PLACE_NAMES = {"bengaluru": "Bangalore", "gurugram": "Gurgaon", "work from home": "Remote", "wfh": "Remote"}
ANALYSER_PLACES = ["bangalore", "bengaluru", "mumbai", "delhi", "gurgaon", "noida", "hyderabad", "chennai", "pune", "kolkata", "ahmedabad", "remote", "work from home"]
ANALYSER_ROLES = ["marketing", "finance", "sales", "hr", "operations", "tech", "data", "software", "business development", "product", "design", "graphic", "content"]
LINK_WORDS = ["form", "apply", "career", "job", "hire", "lnkd.in"]
HEADLINE_ROLES = ["intern", "manager", "director", "head", "lead", "officer", "analyst"]
CLUSTERS = [
    ("Software", ["software", "sde", "developer", "frontend", "backend", "full stack", "web", "ios", "android", "flutter", "mobile"]),
    ("Data/AI", ["data", "machine learning", "ml", "ai", "analytics", "scientist"]),
    ("Product", ["product", " pm ", "apm"]),
    ("Design", ["design", "ui", "ux", "graphic", "video", "motion", "figma"]),
    ("Marketing", ["marketing", "seo", "social media", "growth", "performance"]),
    ("Finance", ["finance", "audit", "accounting", "equity", "markets"]),
    ("Business Dev", ["sales", "business development", "bd", "bdr", "sdr"]),
    ("HR", ["hr", "human resources", "talent", "recruit"]),
    ("Content", ["content", "writing", "copywriting", "editorial"]),
    ("Legal", ["legal", "compliance", "contracts", "law"]),
]
#: Roles that raise a post's score, by run: remote company building, city tech, founders' offices, AI.
PRIORITY_REMOTE = [
    "founder", "office", "chief of staff", "generalist", "ai automation", "ai engineer", "digital marketing", "growth", "business development", "product manager", "product management",
    "finance", "financial analyst", "research analyst", "operations", "ops", "strategy", "consulting", "gtm", "go-to-market", "performance marketing", "social media",
]
PRIORITY_TECH = [
    "frontend", "front end", "react", "vue", "angular", "javascript", "typescript", "backend", "back end", "node", "python", "django", "fastapi", "express", "java", "spring",
    "full stack", "fullstack", "mern", "mean", "next.js", "nuxt", "ai", "automation", "machine learning", "llm", "generative ai", "nlp", "data science",
    "prompt engineer", "ai researcher", "computer vision", "deep learning", "rag", "langchain", "ai agent", "fine tuning", "ai product",
    "ugc", "ai ugc", "ai video", "ai content", "content creator", "short form", "video content", "founder", "chief of staff", "generalist",
    "growth", "growth marketing", "growth hacker", "business development", "bd intern", "product manager", "product management", "pm intern", "product intern",
    "operations", "ops intern", "strategy", "gtm", "go-to-market", "sales intern", "software developer", "software engineer", "sde", "swe", "devops", "cloud", "kubernetes", "docker",
    "android", "ios", "flutter", "react native", "mobile",
]
PRIORITY_FOUNDERS = ["founder", "office", "ai", "automation", "chief", "generalist"]
PRIORITY_AI = ["founder", "office", "ai", "automation", "chief"]
TABS = [
    ("Frontend", ["frontend", "front end", "react", "vue", "angular", "javascript", "typescript", "next.js", "nuxt", "svelte", "css", "html"]),
    ("Backend", ["backend", "back end", "node.js", "python", "django", "fastapi", "express", "java", "spring", "golang", "ruby", "php", "api developer"]),
    ("Full Stack", ["full stack", "fullstack", "mern", "mean stack", "full-stack"]),
    ("AI & ML", ["machine learning", "deep learning", "nlp", "computer vision", "data science", "ai researcher", "prompt engineer", "rag", "langchain", "fine tuning", "ai agent", "generative ai", "llm", "ai engineer", "ai product"]),
    ("AI Automation", ["ai automation", "automation engineer", "rpa", "workflow automation", "zapier", "make.com", "n8n"]),
    ("AI UGC & Content", ["ugc", "ai ugc", "ai video", "ai content", "content creator", "short form", "video content", "reels", "social media"]),
    ("Founder's Office", ["founder", "chief of staff", "founder's office", "founder office"]),
    ("Growth & BizDev", ["growth", "growth marketing", "growth hacker", "business development", "bd intern", "sales intern", "gtm", "go-to-market"]),
    ("Product & Ops", ["product manager", "product management", "pm intern", "product intern", "operations", "ops intern", "strategy intern"]),
    ("SDE & DevOps", ["software developer", "software engineer", "sde", "swe", "devops", "cloud engineer", "kubernetes", "docker", "aws", "gcp", "site reliability"]),
    ("Mobile", ["android", "ios developer", "flutter", "react native", "mobile developer"]),
]
#: Places and conditions that the region policies look for; regexes on lower-cased text.
NO_REMOTE = r"\b(no remote|not remote|on.?site only|in.?office only|must relocate|office mandatory)\b"
HYBRID_ONLY = r"\bhybrid only\b"
ABROAD = r"\b(usa|us only|uk only|united states|united kingdom|canada|australia|germany|france|europe|dubai|uae|singapore|malaysia|london|new york|san francisco|california|remote us|remote uk|remote canada|remote australia)\b"
ABROAD_LOCATION = r"\b(usa|uk|united states|united kingdom|canada|australia|germany|france|europe|dubai|uae|singapore|malaysia|london|new york|san francisco|california|texas|amsterdam|remote us|remote uk|us only)\b"
REMOTE = r"\b(remote|work from home|wfh|work.?from.?anywhere|fully remote|100.?remote|virtual)\b"
HOME_CITY = r"\b(bangalore|bengaluru)\b"
HOME = r"\b(india|indian|bangalore|bengaluru|mumbai|delhi|hyderabad|pune|chennai|kolkata|ahmedabad|jaipur|noida|gurgaon|gurugram|chandigarh|lucknow|indore|bhopal|surat|vadodara|kochi|thiruvananthapuram|coimbatore|nagpur|visakhapatnam|pan.?india)\b"
REMOTE_WORDS = ["remote", "work from home", "wfh"]
FALLBACK_ROLES = ["finance", "marketing", "operations", "hr", "sales", "business analyst", "data science"]
INTERN_TITLES = ["intern", "trainee", "fresher", "graduate", "entry", "campus", "university"]
PORTAL_TITLES = ["intern", "trainee", "fellowship", "apprentice", "young"]
BLOCK_WORDS = ["intern", "hiring", "opportunity", "apply", "vacancy", "fellowship"]
#: Points of the documented score by source.
SOURCE_POINTS = {"LinkedIn Posts": 30, "LinkedIn Jobs": 25, "Niche Communities": 20, "Unstop": 15, "Company Career Pages": 15, "Government Portals": 10}
#: An own short taxonomy; operators/taxonomy.py takes a full one as a table.
TAXONOMY = [
    (["machine learning", "data scien", "analyst"], ["Data Intern", "ML Intern"], ["Software Engineering", "Research"]),
    (["backend", "full stack", "software", "developer"], ["Software Intern", "Backend Intern", "Web Intern"], ["Data Science & ML", "Product"]),
    (["product manager", "product"], ["Product Intern", "APM Intern"], ["Design", "Business Development"]),
    (["ui", "ux", "design"], ["UI Intern", "UX Intern"], ["Product", "Marketing"]),
    (["seo", "content", "marketing"], ["SEO Intern", "Content Intern"], ["Design", "Sales"]),
    (["audit", "finance", "sales"], ["Finance Intern", "Sales Intern"], ["Operations"]),
    (["legal", "hr"], ["People Intern", "Legal Intern"], ["Operations", "Compliance"]),
]
SOURCES = [("LinkedIn Posts", 50, 130), ("Niche Communities", 45, 0), ("Unstop", 40, 0), ("Notion (Manual)", 35, 0), ("Government Portals", 15, 0)]
HEADERS = [
    "Title", "Type", "Timing", "Description", "Stipend", "Duration", "Experience", "Location", "Deadline", "Tags", "HiringOrganization", "HiringManager",
    "Post URL", "Apply Link", "Contact Email", "Date Added", "Subchips", "Similar Fields", "PostedDate",
]

#: Sites with cards of postings: name, address, selectors of cards, titles and links (fixed values).
NICHE_SITES = [
    ("Lawctopus", "https://www.lawctopus.com/internships/", "article, .post, .entry", "h2, h3, .entry-title", "a"),
    ("LawBhoomi", "https://lawbhoomi.com/category/internships/", "article, .post, .entry", "h2, h3, .entry-title", "a"),
    ("HelloIntern", "https://www.hellointern.com/internships", ".internship-card, .job-card, article", "h2, h3, .title, .job-title", "a"),
    ("LetsIntern", "https://www.letsintern.com/internships", ".internship-item, .listing, article", "h2, h3, .title", "a"),
    ("FreshersWorld", "https://www.freshersworld.com/internship-jobs", ".job-container, .listing, article", "h2, h3, .job-title, a", "a"),
    ("Twenty19", "https://www.twenty19.com/internships", ".internship-card, .card, article", "h2, h3, .title", "a"),
    ("StudentTribe", "https://studenttribe.in/internships/", ".job-listing, article, .post", "h2, h3, .listing-title", "a"),
    ("SkillIndiaDigital", "https://www.skillindiadigital.gov.in/internships", ".card, article, .internship-item", "h2, h3, .title", "a"),
]
#: Government portals, likewise; their links are those with an address.
PORTALS = [
    ("NITI Aayog", "https://www.niti.gov.in/careers", ".views-row, .career-item, article", "h3, h4, .title, a", "a[href]"),
    ("MyGov", "https://www.mygov.in/task/", ".views-row, .task-item, article", "h3, h4, .title, a", "a[href]"),
    ("AICTE Internship", "https://internship.aicte-india.org/", ".internship-card, .opportunity, article", "h3, h4, .title", "a[href]"),
]
