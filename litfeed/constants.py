"""Fixed values of the data model.

These values must equal the ones the feed application uses, so they are stated
plainly, in their natural order, in one place.
"""

# --- fixed values: enrichable fields, in canonical provenance order ---
ENRICHABLE_FIELD_ORDER = ("title", "authors", "abstract", "published_at", "article_type", "oa_status")

# --- fixed values: metadata status ranks ---
METADATA_STATUS_RANK = {"rss_only": 0, "partial": 1, "enriched": 2}

# --- fixed values: placeholder texts (compared after punctuation strip + casefold) ---
TITLE_PLACEHOLDERS = ("na", "no title", "not available", "title unavailable", "unknown", "untitled")
AUTHOR_PLACEHOLDERS = (
    "anonymous", "et al", "na", "not available", "unknown", "unknown author", "unknown authors",
)
ABSTRACT_PLACEHOLDERS = (
    "abstract unavailable", "na", "no abstract", "no abstract available", "not available",
    "unknown", "unknown abstract",
)

# --- fixed values: URL tracking parameters (plus any name starting with utm_) ---
TRACKING_PARAMETERS = ("fbclid", "gclid", "spm")
TRACKING_PREFIX = "utm_"

# --- fixed values: publication year window ---
MIN_PUBLICATION_YEAR = 1900
MAX_PUBLICATION_YEAR = 2100

# --- fixed values: article type patterns, checked in this order (case-insensitive, word bounded) ---
ARTICLE_TYPE_PATTERNS = (
    ("correction", r"\b(?:correction|erratum|corrigendum)\b"),
    ("review", r"\breview(?:\s+article)?\b"),
    ("editorial", r"\b(?:editorial|comment(?:ary)?|perspective|letter\s+to\s+the\s+editor)\b"),
    ("research", r"\b(?:research|article|letter)\b"),
)
NEWS_ARTICLE_PATTERN = r"\bnews\s+article\b"

# --- fixed values: HTML tags whose bodies are hidden, and tags that separate words ---
HIDDEN_TAGS = ("script", "style", "template", "noscript")
SEPARATOR_TAGS = (
    "br", "dd", "div", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "li",
    "list-item", "p", "pre", "sec", "td", "th", "title", "tr",
)

# --- fixed values: enums ---
ARTICLE_TYPES = ("research", "review", "editorial", "correction", "other")
OA_STATUSES = ("open", "closed", "unknown")
METADATA_STATUSES = ("rss_only", "partial", "enriched")
RUN_STATUSES = ("running", "ok", "partial", "error")
FEED_STATUSES = ("ok", "not_modified", "partial", "error")
SUCCESSFUL_FEED_STATUSES = ("ok", "not_modified")
PUBLISHERS = ("aaas", "aip", "aps", "elsevier", "ieee", "nature", "springer", "wiley")

# --- fixed values: limits ---
MAX_FEED_BYTES = 8 * 1024 * 1024
MAX_METADATA_BYTES = 2 * 1024 * 1024
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
MAX_SELECTED_TAGS = 32
MAX_TAG_LENGTH = 128
MAX_ITEM_ERRORS = 20
MAX_STATUS_ERRORS = 20
MAX_NOTE_FEEDS = 100
MAX_IDENTIFIER_LENGTH = 128
MIN_COUNT_RATIO = 0.5
SCHEMA_VERSION = 4
ACCEPTED_PREVIOUS_VERSIONS = (3, 4)

# --- fixed values: separator used in tag id / label strings ---
TAG_SEPARATOR = "|||"
# --- fixed values: field separator inside the fallback identity hash ---
UID_FIELD_SEPARATOR = "\u001f"
