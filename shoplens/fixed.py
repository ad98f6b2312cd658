"""Names, word lists, thresholds and formats the results depend on.

Everything here is data, not logic. Functions take these as default arguments,
so a caller can replace any of them.
"""

# Canonical product field -> accepted input column names.
PRODUCT_ALIASES = {
    "id": ["id", "ITEM_ID"],
    "itemGroupId": ["itemGroupId", "ITEM_GROUP_ID"],
    "mpn": ["mpn", "MPN"],
    "name": ["name", "TITLE"],
    "manufacturer": ["manufacturer", "MFTR"],
    "brand": ["brand", "BRAND"],
    "imageLink": ["imageLink", "image", "IMAGE_LINK"],
    "productLink": ["productLink", "link", "LINK"],
    "description": ["description", "DESCRIPTION"],
    "price": ["price", "PRICE"],
    "salePrice": ["salePrice", "SALE_PRICE"],
    "productType": ["productType", "PRODUCT_TYPE"],
    "categoryL1": ["categoryL1", "category", "CATEGORY_L1"],
    "categoryL2": ["categoryL2", "CATEGORY_L2"],
    "categoryL3": ["categoryL3", "CATEGORY_L3"],
    "categoryL4": ["categoryL4", "CATEGORY_L4"],
    "categoryL5": ["categoryL5", "CATEGORY_L5"],
    "inStock": ["inStock", "availability", "AVAILABILITY"],
    "reviewRating": ["reviewRating", "REVIEW_RATING"],
    "color": ["color", "COLOR"],
    "material": ["material", "MATERIAL"],
    "theme": ["theme", "THEME"],
    "occasion": ["occasion", "OCCASION", "SPECIAL_OCCASION_OR_EVENT"],
    "holiday": ["holiday", "HOLIDAYS"],
    "forWhom": ["forWhom", "FOR_WHOM"],
    "ageGroup": ["ageGroup", "AGE_GROUP"],
    "gender": ["gender", "GENDER"],
    "size": ["size", "SIZE"],
    "industryType": ["industryType", "INDUSTRY_TYPE"],
    "businessUnit": ["businessUnit", "BUSINESS_UNIT"],
    "isBundle": ["isBundle", "IS_BUNDLE"],
    "isBulk": ["isBulk", "bulkAssortments", "BULK_ASSORTMENTS"],
    "isOnSale": ["isOnSale", "NOW_ON_SALE"],
}

# Canonical customer field -> accepted input column names.
CUSTOMER_ALIASES = {
    "userId": ["userId", "USER_ID"],
    "customerType": ["customerType", "CUSTOMER_TYPE"],
    "customerSegment": ["customerSegment", "CUSTOMER_SEGMENT"],
    "businessUnit": ["businessUnit", "BUSINESS_UNIT"],
    "preferredCategoryL1": ["preferredCategoryL1", "PREFERRED_CATEGORY_L1"],
    "preferredCategoryL2": ["preferredCategoryL2", "PREFERRED_CATEGORY_L2"],
    "preferredOccasion": ["preferredOccasion", "PREFERRED_OCCASION"],
    "preferredTheme": ["preferredTheme", "PREFERRED_THEME"],
    "priceAffinity": ["priceAffinity", "PRICE_AFFINITY"],
    "discountAffinity": ["discountAffinity", "DISCOUNT_AFFINITY"],
    "region": ["region", "REGION"],
    "state": ["state", "STATE"],
    "accountAgeDays": ["accountAgeDays", "ACCOUNT_AGE_DAYS"],
    "lifetimeOrderCount": ["lifetimeOrderCount", "LIFETIME_ORDER_COUNT"],
    "lifetimeSpend": ["lifetimeSpend", "LIFETIME_SPEND"],
    "avgOrderValue": ["avgOrderValue", "AVG_ORDER_VALUE"],
    "daysSinceLastOrder": ["daysSinceLastOrder", "DAYS_SINCE_LAST_ORDER"],
    "emailOptIn": ["emailOptIn", "EMAIL_OPT_IN"],
}

# Canonical interaction field -> accepted input column names.
INTERACTION_ALIASES = {
    "userId": ["userId", "USER_ID"],
    "itemId": ["itemId", "ITEM_ID"],
    "timestamp": ["timestamp", "TIMESTAMP"],
    "eventType": ["eventType", "EVENT_TYPE"],
    "eventValue": ["eventValue", "EVENT_VALUE"],
    "quantity": ["quantity", "QUANTITY"],
    "price": ["price", "PRICE"],
    "recommendationId": ["recommendationId", "RECOMMENDATION_ID"],
}

# Spellings read as true.
TRUE_WORDS = ["true", "yes", "y", "1", "in stock"]

# Closed lists.
EVENT_TYPES = ["view", "add_to_cart", "purchase"]
PRICE_AFFINITIES = ["LOW", "MID", "HIGH", "BULK"]
CUSTOMER_SEGMENTS = ["PREMIUM", "STANDARD", "BUDGET", "B2B"]
CUSTOMER_TYPES_KEPT = ["CONSUMER", "B2B", "BUSINESS"]
REGION_LABELS = [
    "Northeast", "Southeast", "Midwest", "Southwest",
    "West", "Pacific", "Mountain", "Central",
]

# Interest weight of one event.
EVENT_WEIGHTS = {"view": 1.0, "add_to_cart": 2.0, "purchase": 5.0}

# Inclusive price band of each affinity.
PRICE_BANDS = {"LOW": (0, 30), "MID": (20, 80), "HIGH": (60, 1000), "BULK": (0, 1000)}

# Words for a budget tier, and texts used when nothing is known.
TIER_WORDS = {
    "LOW": "budget-friendly affordable",
    "MID": "mid-range",
    "HIGH": "premium upscale",
    "BULK": "bulk wholesale",
}
DEFAULT_CRITERIA_TEXT = "party supplies"
DEFAULT_PROFILE_TEXT = "popular party supplies"

# Re-rank bonuses.
BONUS_THEME = 0.10
BONUS_OCCASION = 0.08
BONUS_PRICE = 0.05
BONUS_BULK = 0.05

# Embedding request, index and write sizes.
EMBED_DIMENSIONS = 1024
DISTANCE_METRIC = "cosine"
CHUNK_SIZE = 50_000

# Metadata limits (characters, bytes) and keys outside the cap.
LONG_FIELD_CHARS = 500
FACET_FIELD_CHARS = 100
FILTERABLE_BYTE_CAP = 1800
NON_FILTERABLE_KEYS = ["name", "description", "link", "image"]
CAP_ROUNDS = 20
CAP_STEP = 200
CAP_FLOOR = 20

# Facet sizes and the lists used for an empty catalog.
FACET_LIMITS = {"themes": 12, "occasions": 10, "categories": 8, "colors": 10}
FALLBACK_FACETS = {
    "themes": ["Elegant", "Tropical", "Rustic", "Superhero", "Princess", "Dinosaur",
               "Unicorn", "Spooky", "Vintage"],
    "occasions": ["Birthday", "Wedding", "Baby Shower", "Graduation", "Halloween",
                  "Christmas", "Anniversary"],
    "categories": ["Balloons", "Tableware", "Decorations", "Party Packs", "Costumes",
                   "Banners"],
    "colors": ["Gold", "Pink", "Blue", "Green", "Red", "Purple", "Silver"],
}

# Lines of the customer tips.
TIP_THEME = '- This customer prefers "%s" themed items - prioritize these in recommendations'
TIP_CATEGORY = '- They frequently shop in "%s" - suggest related products'
TIP_PREMIUM = "- This is a premium customer - feel free to suggest higher-end options"
TIP_BULK = ("- This is a bulk/business customer - emphasize quantity discounts and "
            "bulk options")
TIP_LAPSED = ("- It's been %s days since their last order - consider a "
              "welcome-back message")
TIP_LOYAL = "- This is a loyal customer - thank them for their continued business"
LAPSED_DAYS = 90
LOYAL_ORDERS = 10
NO_HISTORY_TEXT = "(no recent interactions on file)"

# Response shapes.
RESPONSE_TYPES = ["answer", "followup", "blocked"]
BLOCK_MARKER = "I'm sorry, I can't provide that information."
BLOCK_MID_TEXT = (
    "Part of my response was filtered. Try a more specific query - e.g., a particular "
    "theme, color, or occasion - and I can give you a complete list."
)
BLOCK_FULL_TEXT = (
    "I couldn't complete that request. Try rephrasing with a specific theme, occasion, "
    "or product category."
)
FENCED_JSON = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
BRACED_JSON = r"(?s)\{.*\}"
PRODUCT_CARD = ("struct<id: string, title: string, price: string, link: string, image: string, theme: string, "
                "category: string, description: string, score: double>")
FOLLOWUP = "struct<id: string, label: string, options: array<struct<label: string, value: string>>>"
SCRATCHPAD_TAGS = ["thinking", "scratchpad", "reflection"]

# Phrases of each denied topic. Company names are the caller's to add.
TOPIC_TERMS = {
    "Politics": ["election", "political party", "candidate", "vote"],
    "MedicalAdvice": ["allergy", "make you sick", "medicine", "diagnosis"],
    "LegalAdvice": ["sue", "is it legal", "my rights", "liability"],
}

# Alert rules (metric, comparison, threshold, window in minutes, severity).
ALERT_RULES = [
    ("error_rate", ">", 0.01, 5, "P1"),
    ("latency_p99_ms", ">", 10000.0, 5, "P2"),
    ("block_rate", ">", 0.05, 15, "P3"),
    ("cache_hit_rate", "<", 0.30, 60, "P3"),
    ("prompt_fallback_rate", ">", 0.99, 5, "P2"),
]
