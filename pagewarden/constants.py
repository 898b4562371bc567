"""Fixed values.

Everything here is a value the results depend on: benchmark bounds, weights,
word lists, label texts and patterns. They are kept together, in natural order,
so that a reader can check them in one place.
"""

# --- fixed values: page benchmarks -----------------------------------------
BENCHMARK_YEAR = 2026
TITLE_MIN, TITLE_MAX = 50, 60
META_MIN, META_MAX = 140, 160
LINK_DENSITY_MIN = 65.0
MIN_WORDS = 300

BENCHMARK_LABELS = {
    "title": "50-60 characters",
    "meta": "140-160 characters",
    "h1": "Exactly 1 H1",
    "viewport": "Viewport meta present for mobile-first indexing",
    "alt": "100% descriptive alt-text coverage",
    "links": "65%+ internal link density",
    "canonical": "Self-referencing canonical tag present",
    "authority": "60%+",
    "follow": "Balanced distribution",
    "speed": "90+",
}

# --- fixed values: weights --------------------------------------------------
PAGE_WEIGHTS = {
    "metadata": 20,
    "headings": 20,
    "technical": 20,
    "performance": 15,
    "links": 15,
    "accessibility": 10,
}
SITE_WEIGHTS = {"metadata": 30, "content": 20, "indexation": 20, "serp": 15, "integrity": 15}
HEALTH_WEIGHTS = {
    "technical": 0.25,
    "onpage": 0.20,
    "content": 0.20,
    "performance": 0.20,
    "issues": 0.15,
}
LOCAL_HEALTH_WEIGHTS = {"website": 0.30, "profile": 0.30, "reviews": 0.25, "performance": 0.15}

# --- fixed values: site coverage metrics -----------------------------------
# (key, metric name, category, minimum percent)
SITE_METRICS = [
    ("title_coverage", "Title Coverage", "Metadata", 90),
    ("meta_description_coverage", "Meta Description Coverage", "Metadata", 85),
    ("unique_title_coverage", "Title Uniqueness", "Metadata", 100),
    ("h1_compliance", "H1 Compliance", "Headings", 90),
    ("substantive_content_coverage", "Content Depth", "Headings", 70),
    ("canonical_coverage", "Canonical Coverage", "Technical", 95),
    ("indexability_coverage", "Indexability", "Technical", 90),
]
# benchmarks that are configured but not part of the default site score
OPTIONAL_SITE_METRICS = [
    ("structured_data_coverage", "Structured Data Coverage", "Technical", 50),
    ("social_metadata_coverage", "Social Metadata Coverage", "Metadata", 80),
    ("alt_text_coverage", "Alt Text Coverage", "Accessibility", 95),
    ("unique_meta_coverage", "Meta Uniqueness", "Metadata", 100),
]
BROKEN_RATIO_MAX = 2.0

# --- fixed values: limits ---------------------------------------------------
MAX_PAGES = 500
SAMPLE_LIMIT = 5
EVIDENCE_LIMIT = 3
RECENT_EVENTS = 50
SNAPSHOT_LIMIT = 12
SITEMAP_FILE_LIMIT = 50000

# --- fixed values: order of labels -----------------------------------------
PRIORITIES = ["High", "Medium", "Low"]

# --- fixed values: word lists ----------------------------------------------
STOPWORDS = [
    "the", "and", "for", "with", "that", "this", "your", "from", "into", "about",
    "our", "you", "are", "how", "why", "what", "when", "where", "which", "can",
    "will", "all", "best", "more", "than", "services", "service",
]
PROFILE_STOPWORDS = STOPWORDS + ["solutions", "solution", "home", "official"]
COMPOUND_SECOND_LEVELS = ["co", "com", "org", "net", "gov", "edu", "ac"]

DEFAULT_COMPANY = "This Website"
DEFAULT_AUDIENCE = "Management Board"
DEFAULT_PILLARS = [
    "Primary service visibility",
    "Commercial search positioning",
    "Market discovery",
]
DEFAULT_KEYWORDS = ["primary service", "commercial intent", "customer demand"]

# --- fixed values: url rules ------------------------------------------------
SKIP_SCHEMES = ["mailto", "tel", "javascript", "data", "ftp"]
SKIP_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "pdf", "zip", "gz", "tar", "rar",
    "css", "js", "woff", "woff2", "ttf", "eot", "mp3", "mp4", "avi", "mov", "wmv",
]
PAGE_TYPES = [
    ("Contact/Conversion", ["contact", "get-in-touch", "book", "demo"]),
    ("About/Trust", ["about", "company", "team"]),
    ("Blog/Resource", ["blog", "news", "article", "post", "insight"]),
    ("Service/Product", ["service", "solution", "product", "platform"]),
]
PAGE_TYPES_SHORT = [
    ("Contact/Conversion", ["contact", "get-in-touch"]),
    ("About/Trust", ["about", "company", "team"]),
    ("Blog/Resource", ["blog", "news", "article"]),
    ("Service/Product", ["service", "solution", "product"]),
]
SITEMAP_PRIORITIES = [
    (r"^/(services?|products?|solutions?|work|portfolio)", "0.90"),
    (r"^/(category|categories|collection|directory|shop|store)", "0.80"),
    (r"^/(blog|news|articles?|insights?|posts?|updates?)", "0.70"),
    (r"^/(about|contact|team|faq|support|company)", "0.64"),
    (r"^/(privacy|terms|legal|cookies|disclaimer|gdpr)", "0.30"),
]
SITEMAP_FREQUENCIES = [
    (r"^/(blog|news|articles?|insights?|posts?|updates?)", "weekly"),
    (r"^/(products?|items?|services?)", "weekly"),
]
SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
SITEMAP_LOCATIONS = ["/sitemap.xml", "/sitemap_index.xml"]

# --- fixed values: text patterns -------------------------------------------
WORD_PATTERN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
PHONE_PATTERN = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
TITLE_SEPARATOR = r"\s*[|:\-\x{2013}\x{2014}]\s*"
EXCLUDED_TAGS = [
    "script", "style", "noscript", "svg", "header", "footer", "nav", "head", "form",
]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]

# --- fixed values: local business -------------------------------------------
LOCAL_SCHEMA_TYPES = ["LocalBusiness", "Organization", "Store", "Restaurant"]
COMPETITOR_SCHEMA_TYPES = ["LocalBusiness", "Organization", "Store", "ProfessionalService"]
LOCATION_WORDS = ["contact", "location", "about"]
STARS = ["ONE", "TWO", "THREE", "FOUR", "FIVE"]
DAILY_METRICS = {
    "SEARCH_IMPRESSIONS": "search_impressions",
    "MAPS_IMPRESSIONS": "maps_impressions",
    "WEBSITE_CLICKS": "website_clicks",
    "CALL_CLICKS": "call_clicks",
    "DIRECTIONS_REQUESTS": "direction_requests",
}
