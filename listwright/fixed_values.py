"""Word lists, lookup tables, constants and patterns.

Everything in this module is a value that has to be exactly what it is for results
to be right. They are stated once, as plain text, and used everywhere else.
Patterns are Java regular expressions unless a name says otherwise.
"""

# ---------------------------------------------------------------- fixed values
# Keyword gate defaults.
DEFAULT_KEYWORDS = [
    "laravel", "php", "python", "next.js", "nextjs", "react", "node",
    "full stack", "api", "ai", "chatbot", "openai", "claude", "llm",
    "integration", "dashboard", "saas", "fastapi",
    "developer", "software engineer", "backend", "frontend", "web",
]
DEFAULT_BLOCKED = ["wordpress only", "shopify only", "unpaid", "equity only"]
PRE_FILTERED_SOURCES = ["rozee"]
# Sources whose feeds fail one by one: a failed response does not fail the source.
SOURCES_OF_MANY_FEEDS = ["upwork_rss", "reddit"]

# Suffixes a keyword / a search word may carry.
GATE_SUFFIX = r"(?:s|js|\p{Nd}+|\.js)?"
SEARCH_SUFFIX = r"(?:s|es|js|\p{Nd}+|\.js)?"

# Statuses in lifecycle order; all but the last are board columns.
STATUSES = ["new", "shortlisted", "applied", "replied", "interview", "won", "lost", "ignored"]
TRACKER_COLUMNS = ["new", "shortlisted", "applied", "replied", "interview", "won", "lost"]
APPLIED_OR_BEYOND = ["applied", "replied", "interview", "won", "lost"]
REPLIED_STATUSES = ["replied", "interview", "won"]
INTERVIEW_STATUSES = ["interview", "won"]

# Sources in registry order: key, label, chart colour, enabled by default.
SOURCES = [
    ("remoteok", "RemoteOK", "#3987e5", True),
    ("remotive", "Remotive", "#199e70", True),
    ("wwr", "We Work Remotely", "#c98500", True),
    ("jobicy", "Jobicy", "#14b8a6", True),
    ("arbeitnow", "Arbeitnow", "#eab308", True),
    ("themuse", "The Muse", "#a855f7", True),
    ("skipthedrive", "SkipTheDrive", "#f97316", True),
    ("jobgether", "Jobgether", "#22d3ee", True),
    ("underdog", "Underdog.io", "#facc15", True),
    ("wellfound", "Wellfound (AngelList)", "#f43f5e", False),
    ("builtin", "Built In", "#38bdf8", False),
    ("indeed", "Indeed", "#2557a7", False),
    ("hn", "Hacker News", "#008300", True),
    ("reddit", "Reddit", "#9085e9", True),
    ("upwork_rss", "Upwork", "#e66767", True),
    ("linkedin_email", "LinkedIn (email)", "#d55181", False),
    ("linkedin_web", "LinkedIn (web)", "#0a66c2", False),
    ("mustakbil", "Mustakbil (PK)", "#0e9f6e", True),
    ("rozee", "Rozee.pk", "#84cc16", True),
    ("bayt", "Bayt (PK)", "#f472b6", False),
    ("indeed_pk", "Indeed PK", "#60a5fa", False),
]
MANUAL_SOURCE = ("manual", "Manual", "#d95926")
DEFAULT_COLOR = "#8fa3bd"
# Order in which the activity chart lists its sources.
CHART_ORDER = [
    "remoteok", "remotive", "wwr", "hn", "reddit", "upwork_rss", "linkedin_email", "manual",
    "jobicy", "arbeitnow", "themuse", "indeed", "skipthedrive", "jobgether", "underdog",
    "wellfound", "builtin", "mustakbil", "rozee", "bayt", "indeed_pk", "linkedin_web",
]

# Search relevance.
FIELD_WEIGHTS = {"title": 10.0, "tags": 5.0, "company": 2.0, "description": 1.0}
HEAD_BOOST = 2.0
EXTRA_FIELD_FACTOR = 0.1
PHRASE_FACTOR = 1.2
ADJACENT_PAIR_FACTOR = 0.5
IDF_INFLUENCE = 0.15
IDF_MINIMUM = 0.5
RELATIVE_FLOOR = 0.25
MAX_TERMS = 8
ALIASES = {
    "website": ["web site", "web"],
    "web": ["website"],
    "js": ["javascript"],
    "javascript": ["js"],
    "ts": ["typescript"],
    "typescript": ["ts"],
    "py": ["python"],
    "k8s": ["kubernetes"],
    "kubernetes": ["k8s"],
    "ml": ["machine learning"],
    "ai": ["artificial intelligence"],
    "infosec": ["information security", "security"],
    "appsec": ["application security"],
    "cyber": ["cybersecurity", "cyber security"],
    "security": ["cybersecurity", "infosec"],
    "devops": ["dev ops", "sre"],
    "sre": ["site reliability", "devops"],
    "qa": ["quality assurance", "tester"],
    "frontend": ["front end", "front-end"],
    "backend": ["back end", "back-end"],
    "fullstack": ["full stack", "full-stack"],
    "postgres": ["postgresql"],
    "postgresql": ["postgres"],
    "rails": ["ruby on rails"],
    "node": ["nodejs", "node.js"],
    "dotnet": [".net"],
    "pm": ["product manager"],
}

# Regions: key, case-insensitive phrases, case-sensitive short tokens.
REGIONS = [
    ("worldwide", ["worldwide", "anywhere", "global", "international"], []),
    ("usa", ["usa", "united states", "north america", "northern america"], ["US", "U.S."]),
    ("canada", ["canada", "canadian"], []),
    ("uk", ["united kingdom", "britain", "england", "london"], ["UK", "U.K."]),
    ("europe", ["europe", "european", "emea"], ["EU"]),
    ("germany", ["germany", "german", "berlin", "munich", "deutschland"], []),
    ("australia", ["australia", "new zealand", "sydney", "melbourne"], ["ANZ"]),
    ("india", ["india", "bangalore", "bengaluru", "mumbai", "delhi", "hyderabad"], []),
    ("pakistan", ["pakistan", "lahore", "karachi", "islamabad"], []),
    ("middle_east", ["dubai", "middle east", "saudi", "qatar", "abu dhabi"], ["UAE", "GCC"]),
    ("latam", ["latin america", "south america", "brazil", "mexico", "argentina"], ["LATAM"]),
    ("asia", ["asia", "singapore", "japan", "philippines", "vietnam", "indonesia"], ["APAC"]),
]

# Employment types: key, pattern, whether the end of the word is left open.
EMPLOYMENT_TYPES = [
    ("full_time", r"full[\s_-]?time", False),
    ("part_time", r"part[\s_-]?time", False),
    ("contract", r"contract|c2c|1099", True),
    ("freelance", r"freelance|upwork", True),
    ("temporary", r"temporary|interim", False),
    ("permanent", r"permanent", False),
    ("internship", r"intern(ship)?s?|working student|werkstudent", False),
    ("seasonal", r"seasonal", False),
    ("volunteer", r"volunteer", False),
]

# Experience levels: key, pattern, whether the description is searched as well.
EXPERIENCE_LEVELS = [
    ("no_experience", r"no (?:prior )?experience(?: required| needed)?", True),
    ("internship", r"intern(ship)?s?|working student|werkstudent", False),
    ("entry", r"entry[\s_-]?level|junior|jr\.?|graduate|early[\s-]career", False),
    ("associate", r"associate", False),
    ("mid", r"mid[\s_-]?level|intermediate|mid[\s_-]?senior", False),
    ("senior", r"senior|sr\.?", False),
    ("principal", r"principal|staff engineer|lead|architect", False),
    ("manager", r"manager", False),
    ("director", r"director|head of", False),
    ("executive", r"executive|vice president|vp|chief|cto|ceo|cfo|coo|c[\s-]?level", False),
]
YEARS_BEFORE = (
    r"(\d{1,2})\s*\+?\s*(?:years?|yrs?)[^.\n;]{0,40}?(?:experience|exp(?![\p{L}\p{N}_]))"
)
YEARS_AFTER = (
    r"experience[^.\n;]{0,40}?(\d{1,2})\s*\+?\s*(?:years?|yrs?)(?![\p{L}\p{N}_])"
)
MAX_PLAUSIBLE_YEARS = 30
MAX_YEARS_ANY = 11

# Freelance signals.
FREELANCE_SUBSTRINGS = ["/hr", "per hour", "1099", "c2c", "corp to corp"]
FREELANCE_WORDS = [
    "freelance", "contract", "hourly", "part-time", "part time", "short-term",
    "short term", "temporary", "consultant", "consulting", "upwork",
]
FREELANCE_SOURCE = "upwork_rss"

# Feed, alerts, scoring.
POSTED_WITHIN_DAYS = [1, 3, 7, 14, 30, 90]
PAGE_SIZE = 25
DEFAULT_MIN_SCORE = 6
DEFAULT_ALERT_THRESHOLD = 8
ALERT_BATCH = 20
HIGH_SCORE = 8
MID_SCORE = 5
MAX_SCORE_ATTEMPTS = 5
PROMPT_DESCRIPTION_CHARS = 6000
STATS_DAYS = 14
STATS_WEEKS = 8

# Profiles.
PROFILE_SUMMARY_CHARS = 400
SKILLS_VOCABULARY = [
    "python", "javascript", "typescript", "php", "java", "c#", "c++", "go", "golang",
    "ruby", "rust", "kotlin", "swift", "scala", "perl", "bash", "sql", "html", "css",
    "laravel", "django", "flask", "fastapi", "express", "node.js", "node", "nestjs",
    "react", "react native", "next.js", "nextjs", "vue", "nuxt", "angular", "svelte",
    "tailwind", "bootstrap", "jquery", "redux",
    "rest", "rest api", "graphql", "grpc", "websockets", "microservices",
    "mysql", "postgresql", "postgres", "mongodb", "redis", "sqlite", "elasticsearch",
    "mariadb", "dynamodb", "oracle", "mssql",
    "aws", "gcp", "azure", "docker", "kubernetes", "terraform", "ansible", "nginx",
    "linux", "git", "ci/cd", "jenkins", "github actions",
    "ai", "machine learning", "deep learning", "nlp", "llm", "openai", "claude",
    "langchain", "tensorflow", "pytorch", "pandas", "numpy", "scikit-learn",
    "data analysis", "data engineering", "etl",
    "chatbot", "integration", "dashboard", "saas", "api", "asterisk", "voip", "webrtc",
    "sentiment analysis", "speech-to-text", "transcription", "real-time",
    "wordpress", "shopify", "magento", "woocommerce",
    "agile", "scrum", "rbac", "oauth", "stripe", "twilio", "celery", "rabbitmq", "kafka",
]
SENIORITY_LEAD = r"lead|principal|staff|head of|architect|director"
SENIORITY_SENIOR = r"senior|sr\.?"
SENIORITY_JUNIOR = r"junior|jr\.?|intern|entry[- ]level|graduate"

# Contact e-mails.
EMAIL_PATTERN = r"[A-Za-z0-9_%+\-][A-Za-z0-9._%+\-]*@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
EMAIL_SKIP_LOCALS = ["noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon"]
EMAIL_SKIP_DOMAINS = [
    "example.com", "example.org", "example.net", "domain.com", "yourcompany.com",
    "company.com", "email.com", "sentry.io", "wixpress.com", "sentry-next.wixpress.com",
]
EMAIL_SKIP_ENDINGS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"]

# Relative age labels: unit -> seconds.
RELATIVE_UNIT_SECONDS = {
    "minute": 60, "min": 60, "hour": 3600, "hr": 3600,
    "day": 86400, "week": 604800, "month": 2592000, "year": 31536000,
}
# Zone names that feed dates use: name -> numeric offset.
FEED_ZONES = {
    "GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}

# Company names inside slugs.
SLUG_NON_COMPANY = ["sponsored", "job", "sponsored-job", "featured"]
SLUG_NOISE = ["amp", "nbsp", "quot", "8211", "8217"]
SLUG_ACRONYMS = [
    "ai", "ml", "hr", "it", "io", "ui", "ux", "api", "apis", "sdk", "saas",
    "crm", "erp", "b2b", "b2c", "us", "usa", "uk", "eu", "llc", "inc", "ltd",
    "cx", "qa", "bi", "iot", "vr", "ar", "3d", "pr", "seo", "sms", "tv",
]

# Salary and location patterns inside text.
SALARY_TEXT_PATTERN = (
    r"\$\s?[\d,]+(?:\.\d+)?\s*(?:k|K)?\s*(?:[-–—]|to)\s*\$?\s?[\d,]+(?:\.\d+)?\s*"
    r"(?:k|K)?\s*(?:/\s*(?:hr|hour|yr|year|mo|month)|per\s+(?:hour|year|month))?"
)
SALARY_CHIP_PATTERN = (
    r"(?:[$€£]\s?[\d,.]+|\d[\d,.]*)\s*(?:[-–—]\s*(?:[$€£]\s?)?[\d,.]+\s*)?[kK]\b"
    r"|[$€£]\s?[\d,.]{3,}"
)
LOCATION_LINE_PATTERN = r"(?i)Location\s*:\s*([^\n]{2,160})"
LOCATION_STOP_PATTERN = (
    r"(?i)\s+(?:Job\s+(?:Summary|Description|Type|Title)|About\s+(?:the|us|our)|"
    r"Responsibilities|Requirements|Role\s+Overview|Compensation|Salary)\b.*"
)
REMOTE_FROM_PATTERN = r"Remote from\s+(.{2,80}?)(?:\s{2,}|$|Full time|Part time|Contract)"
CARD_JOB_TYPES = ["full time", "part time", "contract", "internship", "freelance"]
CHIP_NOT_A_SKILL = [
    "full-time", "full time", "part-time", "part time", "contract",
    "internship", "freelance", "temporary",
]
CHIP_NON_TAG_SLUGS = ["full-time", "part-time", "contract", "internship", "freelance"]
ROW_JOB_TYPES = ["full-time", "part-time", "contract", "internship", "cofounder"]
BLOCK_MARKERS = ["captcha-delivery.com", "Just a moment", "Attention Required"]
UPSTREAM_BUG_MARKER = "ats_details"

# Link and line rules of the HTML sources.
OFFER_HREF = r"^/offer/"
OFFER_COMPANY_HREF = r"^/remote-jobs/company-"
STARTUP_JOB_HREF = r"^/jobs/\d+"
STARTUP_COMPANY_HREF = r"^/company/"
MAIL_JOB_HREF = r"/jobs/view/(\d+)"
MAIL_SKIP_TITLES = [
    "view job", "view jobs", "see all jobs", "view all jobs", "see more jobs",
    "unsubscribe", "see all", "jobs", "linkedin",
]
YEARS_CHIP = r"(?i)^\d{1,2}\+?\s*Years?$"
ROZEE_HREF = r"(?i)rozee\.pk/.*-jobs?-\d{4,}"
ROZEE_RELATIVE_HREF = r"(?i)^/.*-jobs?-\d{4,}(?:\?|$)"
ROZEE_NOT_COMPANY = r"(?i)(?:pkr|rs\.?\s?\d|\$\s?\d|salary|posted|ago\b|apply|save\b|views?\b|^\d)"
ROZEE_CITY = r"(?i)\b(karachi|lahore|islamabad|rawalpindi|faisalabad|multan|peshawar)\b"
BAYT_HREF = (
    r"(?i)^(?:https?://www\.bayt\.com)?/en/[a-z/-]*jobs?/[^?\s]*\d{4,}[^?\s]*$"
)

# Base addresses that relative links are resolved against.
BASE_URLS = {
    "jobgether": "https://jobgether.com",
    "underdog": "https://underdog.io/jobs/",
    "wellfound": "https://wellfound.com",
    "builtin": "https://builtin.com",
    "hn": "https://news.ycombinator.com/item?id=",
    "reddit": "https://www.reddit.com",
    "linkedin": "https://www.linkedin.com/jobs/view/",
    "mustakbil": "https://www.mustakbil.com",
    "rozee": "https://www.rozee.pk",
    "bayt": "https://www.bayt.com",
}
HN_THREAD_AUTHOR = "whoishiring"
HN_THREAD_PHRASES = ("who is hiring", "ask hn")
# ------------------------------------------------------------ end fixed values
