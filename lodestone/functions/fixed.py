"""Vocabulary, word lists, weights and limits that results depend on."""

# Closed attribute vocabulary, (kind, unit, choices)
ATTRIBUTES = {
    "pricing.model": ("enum", None, ["seat", "usage", "flat", "freemium", "free"]),
    "pricing.entry_usd_month": ("numeric", "usd/month", None),
    "pricing.free_tier": ("boolean", None, None),
    "pricing.trial_days": ("numeric", "days", None),
    "product.launch_date": ("date", None, None),
    "product.platforms": ("list", None, None),
    "product.integrations": ("list", None, None),
    "company.funding_total_usd": ("numeric", "usd", None),
    "company.stage": ("text", None, None),
    "oss.repo": ("text", None, None),
    "oss.stars": ("numeric", None, None),
    "oss.stars_90d_delta": ("numeric", None, None),
    "oss.last_commit_at": ("date", None, None),
    "oss.license": ("text", None, None),
    "oss.contributors_90d": ("numeric", None, None),
}
FAMILIES = [
    (r"^feature\.[a-z0-9-]{2,40}\.present$", "boolean"),
    (r"^complaint\.[a-z0-9-]{2,40}$", "text"),
    (r"^request\.[a-z0-9-]{2,40}\.reactions$", "numeric"),
    (r"^request\.[a-z0-9-]{2,40}$", "text"),
]

# confidence
GRADE_BASE = {"A": 0.90, "B": 0.75, "C": 0.55, "D": 0.35}
DOMAIN_STEP, DOMAIN_STEPS, DECAY_30_DAYS, CONTRADICTED, CONFIDENCE_CAP = 0.05, 4, 0.98, 0.6, 0.97

# Grades by source kind
SOURCE_GRADE = {"own_domain_structured": "A", "structured_api": "A", "own_domain_prose": "B", "launch_announcement": "B", "aggregator": "C", "community": "D"}
PROSE_PATHS = ["/changelog", "/releases", "/whats-new", "/blog/changelog", "/blog"]

# maturity
ABANDONED_MONTHS, DAYS_PER_MONTH, DAYS_PER_YEAR, ESTABLISHED_YEARS = 18, 30.44, 365.25, 3.0
ESTABLISHED_INSTALLS, ESTABLISHED_DOWNLOADS, ESTABLISHED_STARS = 100_000, 100_000, 5_000
HOBBY_STARS, HOBBY_DOWNLOADS = 100, 1_000

# Promotion, clustering, context, coverage weights
PROMOTE_CLAIMS, PROMOTE_THREADS, PROMOTE_REACTIONS = 5, 3, 20
SIMILARITY, CONTEXT_RADIUS = 0.86, 2000
OBSERVATION_ENTITIES, SYNTHESIS_FINDINGS, SYNTHESIS_PAINS = 2, 3, 1

# Entity key schemes in order of precedence
SCHEMES = ["web", "gh", "npm", "pypi", "chrome", "ios", "hf", "ph"]

# URL handling
TRACKING_PREFIX, TRACKING = "utm_", ["fbclid", "gclid", "ref", "source", "mc_cid", "mc_eid"]
NO_CRAWL = ["g2.com", "capterra.com"]
NON_CANDIDATES = [
    "g2.com", "capterra.com", "getapp.com", "trustradius.com", "alternativeto.net", "producthunt.com", "crunchbase.com", "news.ycombinator.com",
    "reddit.com", "stackoverflow.com", "stackexchange.com", "twitter.com", "x.com", "youtube.com", "wikipedia.org", "en.wikipedia.org", "linkedin.com",
    "facebook.com", "instagram.com", "medium.com", "github.com", "google.com",
]
NON_REPO_OWNERS = ["orgs", "sponsors", "topics", "search", "about", "marketplace"]
PATHS = {
    "pricing": ["/pricing", "/plans", "/pricing-plans", "/price", "/pricing/", "/plans-and-pricing", "/subscribe"],
    "docs": ["/docs", "/documentation", "/developers", "/api"],
    "changelog": ["/changelog", "/releases", "/whats-new", "/blog/changelog"],
}
PATH_ATTEMPTS = 4

# Page classification
THIN_CHARS, PARKED_CHARS = 200, 80
CONSENT = ["accept cookies", "cookie consent", "we use cookies", "manage preferences", "accept all cookies"]
PARKED = ["domain is for sale", "this domain may be for sale", "buy this domain", "domain parking", "this domain is parked", "related searches", "checkout the full domain"]
CONTENT_TYPES = ["text/html", "application/xhtml+xml"]
PRICE_SHAPE = r"(?i)([$€£¥₹]\s?\d|(?:per\s+(?:mo|month|seat|user|year)\b|/\s?(?:mo|month)\b)|\bfree\b)"

# Query validation
MAX_QUERY_CHARS = 300
INJECTION = [
    r"ignore (all |any )?(previous|prior|above) instructions", r"disregard (the |all )?(above|prior|previous)", r"you are now", r"\bact as\b", r"system prompt",
    r"reveal your (system )?(prompt|instructions)", r"new instructions\s*:", r"\bjailbreak\b", r"</?(system|assistant|user)>",
]
BLOCKED = ["weapon", "explosive", "firearm", "bioweapon", "malware", "ransomware", "csam", "child sexual", "human trafficking", "drug trafficking"]
NON_PRODUCT = [
    r"^\s*what('?s| is)\s+\d+\s*[\+\-\*/]\s*\d+", r"write me a (poem|song|story|essay)", r"tell me a joke", r"what('?s| is) the weather",
    r"who (is|was) the president", r"translate (this|the following)", r"^\s*(hi|hello|hey)[.!]?\s*$",
]
LIST_REPO_NAME = r"(?i)^awesome-"
LIST_REPO_TEXT = r"(?i)curated list|awesome list|collection of (awesome|useful|best)|list of (the )?(awesome|best|useful)"

# Ledgers, retries, budgets
MODEL_RATES = {"deepseek/deepseek-v4-flash": (0.09, 0.18, 0.02), "openai/text-embedding-3-small": (0.02, 0.02, 0.02)}  # USD per million: input, output, cached input
RETRY_STATUS, RETRIES, BACKOFF_BASE_S, BACKOFF_CAP_S = [429, 500, 502, 503, 504], 3, 0.5, 30.0
POSITIVE_TTL_DAYS, NEGATIVE_TTL_HOURS, EVENT_DAYS = 7, 24, 30
TASK_WEIGHTS = [3, 2, 1, 4, 1, 1, 2]
FACT_TOLERANCE, STALE_DAYS, RECALL_DROP, COST_RISE, TRAP_QUERY = 1.0, 60, 0.10, 0.50, "q07"
LEASE_MINUTES, SYNTHETIC_DAYS, VERIFY_HOURS, HOST_GAP_S = 2, 7, 24, 0.25

# Discovery, community, funding, trends, disambiguation
VERIFY_LIMIT, PROFILE_LIMIT, FUNDING_LIMIT, SEARCH_LIMIT, PAGES, THREADS, TREND_KEYWORDS = 24, 8, 3, 20, 4, 20, 5
PAGE_KINDS = ["pricing", "docs", "changelog"]
FUNDING_ATTRIBUTES = ["company.funding_total_usd", "company.stage"]
LOW_CONFIDENCE, MOST_FIELDS, FIELD_WEIGHT = 0.6, 2, {"category": 3.0, "segment": 2.0, "geography": 1.5}

# Operational metrics: key -> (unit, threshold, alert level); what the first breaches under, the rest over
METRICS = {
    "sentence_binding_rate": ("fraction", 1.0, "page"),
    "runs_today": ("runs", 4.0, "degradation"),
    "cost_per_run_mean": ("USD", 0.1242, "degradation"),
    "search_spend_mtd": ("USD", 7.0, "degradation"),
    "extraction_drop_rate": ("fraction", 0.3, "degradation"),
    "p95_run_latency_s": ("seconds", 512.0, "degradation"),
    "task_failure_rate": ("fraction", 0.1, "degradation"),
    "db_size_pct": ("fraction", 0.7, "degradation"),
}
BELOW, METRIC_DAYS, DB_CEILING_BYTES = "sentence_binding_rate", 30, 524_288_000
