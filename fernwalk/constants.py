"""Lists that the engine works by, as plain data."""

# Domains that give no usable content.
NO_CONTENT = ("facebook.com", "tiktok.com", "instagram.com", "linkedin.com", "youtube.com", "msn.com")

# Domains that refuse to be fetched.
REFUSING = (
    "forbes.com",
    "nytimes.com",
    "edmunds.com",
    "cars.com",
    "nejm.org",
    "cell.com",
    "sciencedirect.com",
    "onlinelibrary.wiley.com",
    "dl.acm.org",
    "zenodo.org",
    "percona.com",
    "mctlaw.com",
    "amjmed.com",
)
BLOCKED = NO_CONTENT + REFUSING

# Hosts that are read through an interface of their own, and by which method.
ROUTES = (
    ("twitter.com", "fxtwitter"),
    ("x.com", "fxtwitter"),
    ("reddit.com", "snippet"),
    ("en.wikipedia.org", "mediawiki"),
    ("github.com", "github"),
    ("arxiv.org", "arxiv"),
    ("semanticscholar.org", "semanticscholar"),
    ("europepmc.org", "europepmc"),
)
#: Hosts for which subdomains aren't routed.
EXACT_ROUTES = ("en.wikipedia.org", "github.com")
DEFAULT_METHOD = "http"

# The sources that each flag adds.
FLAG_SOURCES = (
    ("sci", "arxiv"),
    ("sci", "openalex"),
    ("med", "pubmed"),
    ("med", "europepmc"),
    ("med", "openalex"),
    ("tech", "hackernews"),
    ("tech", "stackoverflow"),
    ("tech", "devto"),
    ("tech", "github"),
)
#: Sources that every search asks: the web, its fallback, and the bonus sources.
BASE_SOURCES = ("web", "news", "discussions")
PER_SOURCE, TOP_RESULTS = 5, 50

#: BM25, the weight of centrality beside it, and the default budget in characters.
K1, B, LAMBDA, BUDGET = 1.2, 0.75, 0.5, 400

#: Search regions by language; the codes are our choice.
REGIONS = {"ja": "jp-jp", "zh": "cn-zh", "ko": "kr-kr", "ru": "ru-ru", "ar": "xa-ar", "th": "th-th"}
DEFAULT_REGION = "wt-wt"
