"""Results are only right when these equal the published rules.

Plain data, in the order in which it takes effect.
"""

# --- fixed values: product categories a reading may use -----------------------
CATEGORIES = [
    "apparel", "footwear", "accessories", "jewellery", "beauty", "home",
    "kitchen", "electronics", "stationery", "food", "toys", "unmapped",
]
UNMAPPED = "unmapped"

# --- fixed values: data-quality flags and their tiers -------------------------
WITHHOLDING_FLAGS = [
    "MISSING_REQUIRED_FIELD", "PRICE_AMBIGUOUS", "PRICE_OUT_OF_BAND", "TITLE_INFERRED",
]
REVIEW_ONLY_FLAGS = ["CATEGORY_UNMAPPED", "STOCK_UNKNOWN"]
ADVISORY_FLAGS = [
    "VARIANTS_SPLIT", "CURRENCY_ASSUMED", "MULTILINGUAL_SOURCE", "STOCK_NOT_TRACKED",
]

# --- fixed values: header spellings per role, preferred first -----------------
ROLE_SYNONYMS = {
    "price": [
        "sale price", "selling price", "offer price", "our price", "price", "rate",
        "amount", "cost", "net", "விலை",
    ],
    "list_price": ["mrp", "m.r.p", "m.r.p.", "list price", "retail price", "compare at"],
    "pack_size": [
        "pack size", "packaging size", "net quantity", "net weight", "pack weight",
        "weight", "packing",
    ],
    "stock": [
        "stock", "in stock", "availability", "available", "qty", "quantity", "pcs",
        "balance",
    ],
}

# --- fixed values: header names that raise a sheet's header score -------------
KNOWN_HEADERS = [
    "item", "item name", "itemname", "product", "product name", "name", "title",
    "description", "particulars", "goods",
    "category", "type", "group", "section",
    "price", "rate", "mrp", "amount", "cost", "sale price", "selling price",
    "offer price", "net", "value",
    "stock", "qty", "quantity", "available", "availability", "in stock", "pcs",
    "size", "colour", "color", "shade", "variant",
    "code", "sku", "item code", "brand", "unit", "hsn",
]

# --- fixed values: units, as (dimension, factor to gram or millilitre) --------
UNITS = {
    "kg": ("mass", 1000), "kgs": ("mass", 1000), "kilo": ("mass", 1000),
    "kilos": ("mass", 1000), "kilogram": ("mass", 1000), "kilograms": ("mass", 1000),
    "g": ("mass", 1), "gm": ("mass", 1), "gms": ("mass", 1),
    "gram": ("mass", 1), "grams": ("mass", 1),
    "l": ("volume", 1000), "ltr": ("volume", 1000), "litre": ("volume", 1000),
    "litres": ("volume", 1000), "liter": ("volume", 1000), "liters": ("volume", 1000),
    "ml": ("volume", 1),
}

# --- fixed values: money and cart rules ---------------------------------------
CURRENCY = "INR"
MIN_PLAUSIBLE_MINOR = 100
MAX_PLAUSIBLE_MINOR = 100_000_000
DELIVERY_FLAT_MINOR = 5_000
FREE_DELIVERY_FROM_MINOR = 100_000
TAX_BASIS_POINTS = 500
MAX_QUANTITY = 99

# --- fixed values: confidence thresholds of a reading -------------------------
CATEGORY_CONFIDENCE_MIN = 0.7
ROW_CONFIDENCE_MIN = 0.6

# --- fixed values: time rules --------------------------------------------------
LINK_TTL_MINUTES = 30
LINK_MIN_TTL_MINUTES = 15
EXPIRY_GRACE_SECONDS = 120
CLAIM_TIMEOUT_MINUTES = 15
MANDATE_DEFAULT_TTL_MINUTES = 60
MANDATE_MAX_TTL_MINUTES = 1440

# --- fixed values: session states ----------------------------------------------
SESSION_STATES = [
    "incomplete", "not_ready_for_payment", "requires_escalation",
    "authentication_required", "ready_for_payment", "pending_approval",
    "complete_in_progress", "completed", "canceled", "in_progress", "expired",
]
TERMINAL_STATES = ["completed", "canceled", "expired"]

# --- fixed values: spending-mandate checks in verdict order, and reply codes ---
GATE_VERSION = "2026-08-24.1"
PEER_ORDER = ["validity_window", "single_use", "ceiling", "category", "item_count"]
REPLY_CODES = {
    "MANDATE_MISSING": "approval_required",
    "MANDATE_SIGNATURE_INVALID": "invalid",
    "MANDATE_EXPIRED": "expired",
    "MANDATE_NOT_YET_VALID": "invalid",
    "MANDATE_ALREADY_CONSUMED": "conflict",
    "MANDATE_CURRENCY_MISMATCH": "invalid",
    "MANDATE_CEILING_EXCEEDED": "maximum_exceeded",
    "MANDATE_CATEGORY_NOT_PERMITTED": "approval_required",
    "MANDATE_ITEM_COUNT_EXCEEDED": "quantity_exceeded",
}
ANSWERABLE_CODES = [
    "MANDATE_CEILING_EXCEEDED",
    "MANDATE_CATEGORY_NOT_PERMITTED",
    "MANDATE_ITEM_COUNT_EXCEEDED",
]

# --- fixed values: alternatives offered on a refusal ---------------------------
ALTERNATIVES_OFFERED = 3
ALTERNATIVES_WINDOW = 12

# --- fixed values: audit vocabulary ---------------------------------------------
ACTORS = ["agent", "system", "merchant", "psp"]
OUTCOMES = ["allowed", "refused", "error", "observed"]

# --- fixed values: what the error text of a failed batch says about its reason; the first match counts ---
FAILURE_PATTERNS = [
    (r"(?i)429|quota|rate limit", "PROVIDER_RATE_LIMITED"),
    (r"(?i)schema validation|not valid JSON", "EXTRACTION_MALFORMED"),
    (r"(?i)truncated|MAX_TOKENS|finish_reason=length", "EXTRACTION_TRUNCATED"),
    (r"(?i)blocked|refus", "PROVIDER_REFUSED"),
]
OTHER_FAILURE = "PROVIDER_ERROR"

# Published names of the category systems. The first is ours.
TAXONOMY_NAME = "stallbook"
MERCHANT_TAXONOMY_NAME = "merchant"
PAYMENT_HANDLER = "payment_link"
