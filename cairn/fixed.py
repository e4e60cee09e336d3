"""Word lists, domains, patterns and weights that results depend on.

They are given as they have to be, in natural order, and nothing here is
logic.  Everything else in the package reads them from here.
"""

# --- fixed values: URLs ------------------------------------------------------------

JUNK_EXTENSIONS = "pdf docx? xlsx? pptx? zip gz tar mp4 mp3 avi mov jpg jpeg png gif svg ico woff2?".split()
JUNK_DOMAINS = (
    r"youtube\.com youtu\.be twitter\.com x\.com facebook\.com instagram\.com tiktok\.com reddit\.com "
    r"pinterest\.com linkedin\.com/in/ play\.google\.com apps\.apple\.com webcache\.googleusercontent\.com"
).split()

# --- fixed values: cell values -----------------------------------------------------

PLACEHOLDERS = (
    "n/a", "na", "not applicable", "not available", "not specified", "not found", "not provided", "not stated",
    "not listed", "unknown", "unspecified", "none", "null", "tbd", "tba", "pending", "coming soon",
    "to be determined", "to be announced", "—", "–", "-", "...", "…", "?", "??",
)
#: Columns that hold an entity's own address, in the order in which they are asked.
WEBSITE_COLUMNS = (
    "website", "url", "official_website", "homepage", "website_or_repo", "website_or_profile", "site", "link",
)
PHONE_COLUMNS = ("phone", "phone_number", "telephone", "contact_phone")
RATING_COLUMNS = ("rating", "score", "stars")
VALUE_ARTICLE_SEGMENTS = (
    "article", "articles", "blog", "blogs", "insights", "magazine", "news", "post", "posts", "press", "report",
    "reports", "review", "reviews", "story", "stories",
)
VALUE_DIRECTORY_SEGMENTS = (
    "categories", "category", "collections", "companies", "company-list", "directory", "directories", "industry",
    "industries", "list", "lists", "marketplace",
)
VALUE_DIRECTORY_PARAMETERS = ("category=", "categories=", "industry=", "industries=", "tag=", "tags=", "type=", "collection=")
VALUE_ARTICLE_TITLES = ("blog", "news", "report", "review", "guide", "top ", "best ")
VALUE_DIRECTORY_TITLES = ("category", "directory", "industry", "list")

# --- fixed values: kinds of pages --------------------------------------------------

REGIMES = (
    "official_site", "directory_listing", "editorial_article", "local_business_listing", "software_repo_or_docs",
    "marketplace_aggregator", "unknown",
)
REGIME_QUALITY = {
    "official_site": 0.72,
    "software_repo_or_docs": 0.8,
    "local_business_listing": 0.7,
    "editorial_article": 0.72,
    "directory_listing": 0.58,
    "marketplace_aggregator": 0.15,
    "unknown": 0.55,
}
PAGE_ARTICLE_SEGMENTS = (
    "analysis", "announcement", "announcements", "article", "articles", "blog", "blogs", "column", "columns",
    "coverage", "editorial", "essay", "feature", "features", "insights", "magazine", "news", "opinion", "post",
    "posts", "press", "report", "reports", "review", "reviews", "story", "stories",
)
PAGE_DIRECTORY_SEGMENTS = (
    "browse", "categories", "category", "collection", "collections", "companies", "compare", "comparison",
    "database", "databases", "directory", "directories", "discover", "explore", "industry", "industries", "list",
    "lists", "listing", "listings", "results", "search", "tag", "tags", "topic", "topics",
)
PAGE_DIRECTORY_PARAMETERS = (
    "browse=", "category=", "categories=", "collection=", "filter=", "industry=", "industries=", "list=", "q=",
    "query=", "search=", "tag=", "tags=", "topic=", "type=",
)
PAGE_MARKETPLACE_DOMAINS = (
    "airbnb.com", "amazon.com", "booking.com", "doordash.com", "ebay.com", "etsy.com", "expedia.com", "grubhub.com",
    "hotels.com", "instacart.com", "kayak.com", "postmates.com", "ubereats.com",
)
REPOSITORY_DOMAINS = (
    "bitbucket.org", "codeberg.org", "docs.rs", "gitlab.com", "github.com", "npmjs.com", "pypi.org", "readthedocs.io",
)
PAGE_DIRECTORY_TITLES = ("category", "compare", "directory", "list of", "top ", "best ", "results")
PAGE_ARTICLE_TITLES = ("analysis", "blog", "news", "review", "story", "why ", "how ")
PAGE_MARKETPLACE_TITLES = ("buy", "book", "delivery", "order online", "reserve")
PAGE_MARKETPLACE_PATHS = ("/book", "/booking", "/buy", "/cart", "/checkout", "/delivery", "/order")
PAGE_SOFTWARE_TITLES = ("api", "developer", "docs", "documentation", "github", "reference", "readme")
PAGE_SOFTWARE_PATHS = ("/docs", "/documentation", "/reference", "/api", "/readme")
LOCAL_BUSINESS_TYPES = (
    "bakery", "barorspub", "cafetorcoffeeshop", "foodestablishment", "healthandbeautybusiness", "hotel",
    "lodgingbusiness", "localbusiness", "organization", "place", "restaurant", "store",
)
SOFTWARE_TYPES = ("dataset", "howto", "softwareapplication", "softwarepackage", "techarticle", "webapi", "webpage")
ARTICLE_TYPES = (
    "article", "blogposting", "discussionforumposting", "newsarticle", "report", "reviewnewsarticle",
    "scholarlyarticle", "socialmediaposting", "techarticle",
)
HOURS_HINTS = ("hours", "open now", "reservations", "book a table")
SHELL_MARKERS = (
    "__NEXT_DATA__", "data-reactroot", 'id="__next"', 'id="app"', 'id="root"', "ng-version",
    "Please enable JavaScript", "Loading...", "window.__INITIAL_STATE__",
)
PHONE_PATTERN = r"(?:\+?\d[\d\-\(\) ]{7,}\d)"
STREET_PATTERN = (
    r"\b\d{1,5}\s+[a-z0-9][a-z0-9 .'-]{2,80}\b(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|way|court|ct)\b"
)

# --- fixed values: sources ---------------------------------------------------------

EDITORIAL_DOMAINS = (
    "acm.org", "arstechnica.com", "arxiv.org", "bbc.com", "bloomberg.com", "cnet.com", "economist.com", "forbes.com",
    "ft.com", "ieee.org", "nature.com", "newyorker.com", "nytimes.com", "pubmed.ncbi.nlm.nih.gov", "reuters.com",
    "sciencemag.org", "springer.com", "techcrunch.com", "theatlantic.com", "theguardian.com", "theverge.com",
    "vox.com", "wired.com", "zdnet.com",
)
DIRECTORY_DOMAINS = (
    "booking.com", "capterra.com", "crunchbase.com", "g2.com", "glassdoor.com", "opentable.com", "producthunt.com",
    "tripadvisor.com", "trustpilot.com", "yelp.com",
)
MARKETPLACE_DOMAINS = (
    "airbnb.com", "amazon.com", "doordash.com", "ebay.com", "etsy.com", "expedia.com", "grubhub.com", "hotels.com",
    "kayak.com", "postmates.com", "ubereats.com",
)
SOURCE_KINDS = ("official", "editorial", "directory", "marketplace", "unknown")
HIGH_SIGNAL_TITLES = ("about", "contact", "docs", "documentation", "official", "overview")
LOW_SIGNAL_TITLES = ("category", "compare", "directory", "results")

# --- fixed values: query families --------------------------------------------------

FAMILY_TEMPLATES = {
    "organization_company": ("organization", ("name", "website", "headquarters", "focus_area", "product_or_service", "stage_or_status")),
    "place_venue": ("place", ("name", "website", "location", "category", "offering", "contact_or_booking")),
    "software_project": ("software project", ("name", "website_or_repo", "primary_use_case", "license", "language_or_stack", "maintainer_or_org")),
    "product_offering": ("product", ("name", "website", "category", "key_feature", "price_or_availability", "maker_or_brand")),
    "person_group": ("person", ("name", "affiliation", "role_or_title", "notable_work", "location", "website_or_profile")),
    "generic_entity_list": ("entity", ("name", "website", "description", "category", "location")),
}
ORGANIZATION_SIGNALS = (
    "company companies corporation corporations firm firms agency agencies organization organizations org orgs "
    "startup startups nonprofit nonprofits foundation foundations institution institutions association associations "
    "society societies enterprise enterprises group groups team teams lab labs studio studios publisher publishers "
    "vc venture investor investors funded funding series founded founders ipo acquired operator operators"
).split()
PLACE_SIGNALS = (
    "place places venue venues location locations spot spots destination destinations site sites landmark landmarks "
    "park parks trail trails route routes beach beaches museum museums gallery galleries market markets shop shops "
    "store stores outlet outlets restaurant restaurants cafe cafes bar bars pub pubs bakery bakeries diner diners "
    "hotel hotels hostel hostels inn inns lodge lodges resort resorts motel motels stadium stadiums arena arenas "
    "theater theatres theaters clinic clinics hospital hospitals school schools library libraries"
).split()
SOFTWARE_SIGNALS = (
    "software program programs application applications app apps tool tools toolkit toolkits platform platforms "
    "framework frameworks library libraries package packages sdk sdks api apis cli database databases repo repos "
    "repository repositories engine engines module modules plugin plugins extension extensions script scripts "
    "runtime runtimes compiler compilers interpreter interpreters open-source opensource foss devtool devtools developer"
).split()
SOFTWARE_PHRASES = ("open source",)
PRODUCT_SIGNALS = (
    "product products brand brands model models item items goods gadget gadgets device devices appliance appliances "
    "equipment gear"
).split()
PERSON_SIGNALS = (
    "person people individual individuals author authors writer writers researcher researchers scientist scientists "
    "engineer engineers developer developers founder founders ceo executive executives artist artists designer "
    "designers musician musicians professor professors expert experts speaker speakers contributor contributors "
    "maintainer maintainers"
).split()
LOCATION_WORDS = ("in", "near", "around", "at", "from")
GENERIC_ENTITY_TYPES = (
    "entity entities item items thing things business businesses organization organizations company companies "
    "product products tool tools place places"
).split()
INTENT_PREFIX = r"^(top|best|leading|most\s+promising|highest\s+rated|top\s+rated|popular|great|notable|recommended|must[- ]?visit)\s+"
TRAILING_LOCATION = r"\s+(in|near|around|at|from)\s+.+$"
YEAR_SUFFIX = r"\s+(?:in\s+)?(?:19|20)\d{2}s?\s*$"

# --- fixed values: query repair ----------------------------------------------------

TOKEN_FIXES = {
    "restraunts": "restaurants",
    "resturants": "restaurants",
    "resturant": "restaurant",
    "restraunt": "restaurant",
    "cofee": "coffee",
    "coffe": "coffee",
    "ramenn": "ramen",
    "softwre": "software",
    "databse": "database",
    "datbases": "databases",
    "compaines": "companies",
    "brookln": "Brooklyn",
    "brookyln": "Brooklyn",
    "newyork": "New York",
    "losangeles": "Los Angeles",
    "seattel": "Seattle",
    "lisbonn": "Lisbon",
    "denvar": "Denver",
    "londn": "London",
    "amhersrt": "Amherst",
}
STATES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or "
    "pa ri sc sd tn tx ut vt va wa wv wi wy dc"
).split()
AMBIGUOUS_STATES = ("hi", "in", "me", "ok", "or")
KNOWN_LOCATIONS = (
    "Amherst", "Brooklyn", "Colorado", "Denver", "Lisbon", "London", "Los Angeles", "Massachusetts", "New York",
    "Portugal", "Seattle", "United States",
)
REPAIR_PREPOSITIONS = ("in", "near", "around", "at")
REPAIR_CUTOFF = 0.84

# --- fixed values: requirements ----------------------------------------------------

FIELD_COLUMNS = {
    "location": ("location", "address", "headquarters", "hq", "country", "city", "region"),
    "funding": ("funding", "raised", "funding_raised", "total_raised", "valuation", "capital"),
    "stage": ("stage", "stage_or_status", "status", "funding_stage", "company_stage"),
    "license": ("license", "licence", "open_source", "license_type"),
    "founded": ("founded", "founded_year", "year_founded", "established"),
    "employees": ("employees", "team_size", "headcount", "size"),
    "category": ("category", "industry", "sector", "type", "vertical"),
    "topic": ("category", "industry", "sector", "type", "vertical", "description", "about"),
}
FAMILY_BINDINGS = {
    "organization_company": {
        "location": ("headquarters",),
        "topic": ("focus_area", "product_or_service"),
        "stage": ("stage_or_status",),
        "funding": ("funding",),
        "founded": ("founded",),
        "employees": ("employees",),
        "license": ("license",),
    },
    "place_venue": {
        "location": ("location", "address"),
        "topic": ("category", "offering"),
        "price": ("price_or_availability",),
        "founded": ("founded",),
    },
    "software_project": {
        "topic": ("primary_use_case",),
        "license": ("license",),
        "maintainer": ("maintainer_or_org",),
        "language": ("language_or_stack",),
        "website": ("website_or_repo",),
    },
    "product_offering": {
        "topic": ("category", "key_feature"),
        "price": ("price_or_availability",),
        "maker": ("maker_or_brand",),
    },
    "person_group": {
        "location": ("location",),
        "topic": ("role_or_title", "notable_work"),
        "affiliation": ("affiliation",),
        "website": ("website_or_profile",),
    },
    "generic_entity_list": {
        "location": ("location",),
        "topic": ("description", "category"),
        "website": ("website",),
    },
}
LOCATION_NAMES = {
    "us": ("us", "usa", "united states", "united states of america", "america"),
    "uk": ("uk", "gb", "united kingdom", "great britain", "britain"),
    "eu": ("eu", "europe", "european union"),
    "canada": ("ca", "canada"),
    "australia": ("au", "australia"),
}
EU_COUNTRIES = (
    "austria", "belgium", "bulgaria", "croatia", "cyprus", "czechia", "czech republic", "denmark", "estonia",
    "finland", "france", "germany", "greece", "hungary", "ireland", "italy", "latvia", "lithuania", "luxembourg",
    "malta", "netherlands", "poland", "portugal", "romania", "slovakia", "slovenia", "spain", "sweden",
)
STATE_NAMES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida",
    "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine",
    "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska",
    "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio",
    "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas",
    "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming", "washington dc",
    "district of columbia",
)
ENTITY_TYPE_WORDS = (
    "startup startups company companies firm firms tool tools platform platforms product products service services "
    "app apps software framework library database restaurant restaurants cafe cafes agency agencies studio studios"
).split()
QUALIFIER_WORDS = (
    "top best leading popular major top-rated well-known famous notable prominent successful innovative emerging"
).split()
TOPIC_STOPS = ("in", "from", "at", "with", "for", "and", "or", "the", "a", "an")
STAGES = (
    (r"\bearly[- ]stage\b", "early-stage"),
    (r"\bpre[- ]seed\b", "pre-seed"),
    (r"\bseed[- ]stage\b", "seed"),
    (r"\bseries\s+([a-d])\b", None),
    (r"\bstartups?\b", "startup"),
    (r"\bpublic(?:ly\s+(?:listed|traded))?\b", "public"),
    (r"\bprivate(?:ly\s+held)?\b", "private"),
    (r"\bbootstrapped\b", "bootstrapped"),
)
REQUIRED_LOCATION = (
    r"\b(?:[Ii]n|[Ff]rom|[Bb]ased\s+in|[Ll]ocated\s+in|[Hh]eadquartered\s+in)\s+"
    r"(?:[Tt]he\s+)?([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*){0,3}|US|UK|EU|USA|NYC)\b"
)
MONEY_VALUE = r"\d+(?:\.\d+)?(?:\s*(?:k|m|b|thousand|million|billion))?"
FUNDING_OVER = rf"\b(?:funding|raised|valuation)\s*(>|≥|over|more\s+than|greater\s+than|at\s+least)\s*\$?({MONEY_VALUE})\b"
FUNDING_UNDER = rf"\b(?:funding|raised|valuation)\s*(<|≤|under|less\s+than|below)\s*\$?({MONEY_VALUE})\b"
OPEN_SOURCE = r"\bopen[- ]source\b"
LICENSE_NAMED = r"\b(mit|apache|gpl|bsd|mpl|lgpl)\s+licen[cs]e?\b"
FOUNDED = (
    ("greater_than", "after", r"\bfounded\s+after\s+(\d{4})\b"),
    ("less_than", "before", r"\bfounded\s+before\s+(\d{4})\b"),
    ("equals", "in", r"\bfounded\s+(?:in\s+)?(\d{4})\b"),
)
STAFF = (
    ("greater_than", ">", r"\b(?:more\s+than|over|at\s+least)\s+(\d+)\s+(?:employees|people|staff)\b"),
    ("less_than", "<", r"\b(?:fewer\s+than|under|less\s+than)\s+(\d+)\s+(?:employees|people|staff)\b"),
)
MONEY_PATTERN = r"\$?(\d[\d,]*(?:\.\d+)?)\s*([kmb]|thousand|million|billion)?"
NUMBER_PATTERN = r"\d[\d,]*(?:\.\d+)?"
MONEY_HINTS = ("fund", "rais", "valuation", "capital", "$")
MAX_COLUMNS = 8

# --- fixed values: ranking ---------------------------------------------------------

#: (key, label, weight); the weight of source_diversity is the one in use.
WEIGHTS = (
    ("completeness", "Schema coverage", 0.13),
    ("field_importance", "Important fields filled", 0.10),
    ("avg_confidence", "Cell confidence", 0.13),
    ("source_support", "Source support", 0.04),
    ("actionable", "Actionable detail", 0.04),
    ("source_quality", "Evidence quality", 0.16),
    ("source_diversity", "Source diversity", 0.08),
    ("local_fit", "Location fit", 0.06),
    ("freshness", "Freshness", 0.04),
    ("reputation", "Reputation", 0.04),
    ("official_fit", "Official-site fit", 0.04),
    ("structured_fit", "Structured-source fit", 0.02),
    ("requirement_satisfaction", "Requirement match", 0.15),
)
WEAK_COLUMNS = ("category", "description", "industry", "notes", "overview", "summary", "tagline", "tags", "type")
GENERIC_NAMES = ("business", "company", "entity", "item", "organization", "place", "platform", "product", "service", "thing", "tool")
FIELD_IMPORTANCE = {
    "organization_company": {"website": 0.28, "headquarters": 0.2, "focus_area": 0.18, "product_or_service": 0.2, "stage_or_status": 0.14},
    "place_venue": {"website": 0.18, "location": 0.32, "category": 0.16, "offering": 0.14, "contact_or_booking": 0.2},
    "software_project": {"website_or_repo": 0.3, "primary_use_case": 0.22, "license": 0.16, "language_or_stack": 0.14, "maintainer_or_org": 0.18},
    "product_offering": {"website": 0.24, "category": 0.18, "key_feature": 0.24, "price_or_availability": 0.14, "maker_or_brand": 0.2},
    "person_group": {"affiliation": 0.28, "role_or_title": 0.24, "notable_work": 0.2, "location": 0.14, "website_or_profile": 0.14},
}
FRESHNESS_HINTS = ("current", "fresh", "latest", "new", "recent", "today")
LOCATION_TAIL = r"\b(?:in|near|around|at|from)\s+([a-z0-9 ,.'-]+)$"

# --- fixed values: verification ----------------------------------------------------

HIGH_INTENT = ("best", "top", "leading", "highest rated", "must visit", "must-visit")
CTA_TAIL = (
    r"(?:\s+(?:now|free|online|here|today|us|all|more|it|them|your|yours|in|out|up|started|forward|available|a\s+table|"
    r"a\s+demo|a\s+quote|a\s+seat|directions?|menu|details?|the\s+(?:app|menu|pdf|guide)|for\s+free))?"
)
CTA_PHRASES = (
    "order" + CTA_TAIL,
    "buy" + CTA_TAIL,
    "book" + CTA_TAIL,
    r"sign\s+up" + CTA_TAIL,
    r"get\s+started" + CTA_TAIL,
    r"learn\s+more" + CTA_TAIL,
    r"read\s+more" + CTA_TAIL,
    r"view\s+(?:all|more|menu|details?|directions?)",
    r"see\s+(?:all|more|menu|details?)",
    r"click\s+here",
    r"contact\s+us",
    r"call\s+(?:us|now)" + CTA_TAIL,
    r"reserve\s+(?:a\s+)?(?:table|seat|spot|now|online)",
    r"explore\s+(?:more|now|all)",
    r"watch\s+(?:now|the\s+video)",
    "download" + CTA_TAIL,
    "subscribe" + CTA_TAIL,
    r"add\s+to\s+(?:cart|bag|wishlist)",
    r"shop\s+(?:now|all)",
    r"find\s+(?:out\s+more|us\s+on)",
    "access" + CTA_TAIL,
    r"visit\s+us",
    r"check\s+(?:out|availability)",
    r"browse\s+(?:all|more)",
    r"try\s+(?:it\s+)?(?:free|now)",
    r"get\s+(?:it|them|access|yours|directions?|the\s+app)",
    r"apply\s+(?:now|online)",
    "register" + CTA_TAIL,
    r"see\s+directions?",
)
CTA_PATTERN = "^(?:" + "|".join(CTA_PHRASES) + ")$"
ARTICLE_TITLE_PATTERN = (
    r"^(?:the\s+)?(?:\d+\s+)?(?:best|top|worst|greatest|biggest|leading|most\s+\w+|popular|famous|notable|"
    r"must[-\s](?:try|visit|see|have)|highest[-\s]rated|award[-\s]winning)\s+\w"
)
OPERATIONAL_PATTERN = (
    r"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[\s,\-]+|open\s+(?:daily|now|until|monday)|closed\s+(?:on|monday)|"
    r"hours?:|free\s+(?:delivery|shipping|parking)|\$\d[\d.,]*(?:\s*[-–]\s*\$\d[\d.,]*)?$)"
)
PSEUDO_TERMS = (
    "agents", "businesses", "companies", "copilots", "places", "platforms", "products", "providers", "restaurants",
    "services", "solutions", "startups", "tools",
)
PSEUDO_FAMILY_TERMS = {
    "organization_company": ("companies", "firms", "organizations", "providers", "services", "solutions", "startups"),
    "place_venue": ("bars", "cafes", "destinations", "places", "restaurants", "shops", "venues"),
    "software_project": ("apps", "frameworks", "libraries", "platforms", "projects", "repositories", "tools"),
    "product_offering": ("brands", "devices", "items", "offerings", "products"),
    "person_group": ("authors", "experts", "people", "researchers", "speakers"),
    "generic_entity_list": ("entities", "items", "things"),
}
PSEUDO_CONNECTORS = (" for ", " in ", " & ", "/")
PSEUDO_PATHS = (
    "/article", "/articles", "/blog", "/blogs", "/categories", "/category", "/companies", "/directory", "/industry",
    "/list", "/lists", "/news", "/post", "/posts", "/report", "/reports",
)
PSEUDO_TITLES = ("category", "directory", "industry", "companies", "top ", "best ")
UNCOUNTED_COLUMNS = ("name", "category", "description", "overview", "summary", "type")
MAX_ROWS, MAX_STRICT_ROWS = 20, 15

# --- fixed values: alignment and official sites ------------------------------------

UNALIGNED_COLUMNS = ("name", "category", "type", "description", "overview", "summary", "tagline", "tags", "notes", "industry")
ALIGNMENT_RATIO, ALIGNMENT_PENALTY = 80.0, 0.6
NAME_RATIO = 82.0
OFFICIAL_HINTS = ("official", "about", "contact", "home", "docs", "overview")
OFFICIAL_THRESHOLD = 0.7
LISTING_PATHS = ("/category", "/categories", "/directory", "/industry", "/list", "/lists", "/tag", "/tags")
LISTING_PARAMETERS = ("category=", "categories=", "industry=", "industries=", "tag=")
LISTING_TITLES = ("directory", "industry", "category", "list of", "top ", "best ")

# --- fixed values: extraction and gap filling --------------------------------------

LICENSE_PATTERN = r"\b(?:mit|apache(?:\s+2\.0)?|bsd(?:\s+\d-clause)?|gpl(?:v?\d(?:\.\d)?)?|lgpl|mpl|agpl)\b"
NAVIGATION_TEXTS = (
    "about", "account", "blog", "careers", "contact", "docs", "documentation", "features", "help", "home", "jobs",
    "learn more", "login", "pricing", "privacy", "read more", "resources", "search", "sign in", "sign up", "support",
    "terms",
)
LOCAL_ITEM_TYPES = (
    "bakery", "barorspub", "cafetorcoffeeshop", "foodestablishment", "hotel", "localbusiness", "place", "restaurant",
    "store",
)
LANGUAGES = ("python", "typescript", "javascript", "go", "rust", "java", "kotlin", "swift", "ruby", "php", "c++", "c#")
GAP_HINTS = {
    "website": "official website",
    "url": "official website",
    "homepage": "official website",
    "site": "official website",
    "website_or_repo": "official website repository",
    "website_or_profile": "official website profile",
    "address": "address",
    "location": "location",
    "headquarters": "headquarters",
    "phone": "phone number",
    "phone_number": "phone number",
    "telephone": "phone number",
    "contact_or_booking": "contact booking",
    "category": "category",
    "offering": "offering services",
    "focus_area": "focus area",
    "product_or_service": "product service",
    "stage_or_status": "status stage",
    "funding": "funding raised",
    "founded": "founded year",
    "employees": "employees headcount",
    "primary_use_case": "use case",
    "license": "license",
    "language_or_stack": "language stack technology",
    "maintainer_or_org": "maintainer organization",
    "key_feature": "features",
    "price_or_availability": "price availability",
    "maker_or_brand": "brand manufacturer",
    "affiliation": "affiliation",
    "role_or_title": "role title",
    "notable_work": "notable work",
    "rating": "reviews rating",
    "score": "score",
}
#: In the order of REGIMES.
GAP_PRIORITY = {
    "organization_company": (4, 2, 3, 0, 1, -2, 1),
    "place_venue": (4, 2, 1, 4, 0, -2, 1),
    "software_project": (3, 1, 2, 0, 5, -2, 1),
    "product_offering": (4, 2, 2, 1, 1, -1, 1),
    "person_group": (3, 1, 3, 0, 0, -2, 1),
    "generic_entity_list": (2, 2, 2, 2, 2, -2, 1),
}
EVALUATED_ACTIONABLE = (
    "website", "homepage", "url", "phone", "phone_number", "email", "address", "location", "rating", "price",
    "price_range", "funding",
)

# --- fixed values: display ---------------------------------------------------------

#: By priority, from 0 on; other columns go by their endings, then 2.
COLUMN_PRIORITY = (
    ("name", "entity_name", "company", "title"),
    ("website", "address", "headquarters", "location", "focus_area", "website_or_repo", "stage_or_status", "rating", "offering", "type"),
    ("price_range", "neighborhood", "category", "investors", "phone_number", "phone", "founded", "year_founded", "employees", "email", "ceo", "founder"),
    ("description", "summary", "overview", "bio", "notable_claim", "notes", "details", "about"),
)
CONFIDENCE_BANDS = (("high", 0.8), ("medium", 0.5), ("low", 0.0))
