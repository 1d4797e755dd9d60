"""Fixed values of the item-master domain: word lists, maps, limits and texts.

All of them are plain values that must match the given behaviour, in their natural order.
"""

from __future__ import annotations

#: Field name, display name, required.
FIELDS = (
    ("CONTRACT", "Site", False),
    ("PART_NO", "Part No", True),
    ("DESCRIPTION", "Item Description", True),
    ("TYPE_CODE", "Purchase Type", False),
    ("UNIT_MEAS", "Inventory UOM", False),
    ("PRIME_COMMODITY", "Com Group 01", False),
    ("SECOND_COMMODITY", "Com Group 02", False),
    ("HAZARD_CODE", "Safety Code", False),
    ("ACCOUNTING_GROUP", "Accounting Group", False),
    ("PART_PRODUCT_CODE", "Product Code", False),
    ("PART_PRODUCT_FAMILY", "Product Family", False),
    ("PRODUCT_CATEGORY_ID", "Product Category", False),
    ("HSN_SAC_CODE", "HSN/SAC Code", False),
)
REQUIRED_FIELDS = ("DESCRIPTION", "PART_NO")

#: What a field says about a pair: identity (a difference speaks against a duplicate), support, or scope.
FIELD_ROLES = {
    "HSN_SAC_CODE": "identity",
    "UNIT_MEAS": "identity",
    "TYPE_CODE": "identity",
    "PRODUCT_CATEGORY_ID": "identity",
    "HAZARD_CODE": "identity",
    "PRIME_COMMODITY": "support",
    "SECOND_COMMODITY": "support",
    "ACCOUNTING_GROUP": "support",
    "PART_PRODUCT_CODE": "support",
    "PART_PRODUCT_FAMILY": "support",
    "CONTRACT": "scope",
}

ALIASES = {
    "PART_TYPE": "TYPE_CODE",
    "INVENTORY_UOM": "UNIT_MEAS",
    "COMMODITY_GROUP_1": "PRIME_COMMODITY",
    "COMMODITY_GROUP_2": "SECOND_COMMODITY",
    "SAFETY_CODE": "HAZARD_CODE",
}

#: Cell texts that a CSV reader takes for missing.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

ABBREVIATIONS = {
    "dec": "desiccated",
    "desicated": "desiccated",
    "decicated": "desiccated",
    "decicatted": "desiccated",
    "coco": "coconut",
    "co": "coconut",
    "c01": "type 1",
    "co1": "type 1",
    "c02": "type 2",
    "co2": "type 2",
    "flt": "filter",
    "filt": "filter",
    "gen": "generator",
    "hvac": "hvac",
    "ss": "stainless steel",
    "stl": "steel",
    "bat": "battery",
    "temp": "temperature",
    "press": "pressure",
    "elec": "electrical",
    "hyd": "hydraulic",
    "pneu": "pneumatic",
}
#: Abbreviations that only the main normal form knows.
LATER_ABBREVIATIONS = ("elec", "hyd", "pneu")
UNITS = ("mm", "cm", "m", "kg", "g", "l", "ml", "v", "volt", "a", "amp", "ph")
MODIFIERS = (
    "oil", "fuel", "air", "water", "hydraulic", "cabin", "lube", "coolant", "stainless", "carbon", "rubber", "copper", "pvc", "left", "right",
    "red", "blue", "green", "yellow", "black", "white", "orange", "purple", "grey", "gray", "brown", "silver", "gold",
)
CONTEXT_WORDS = {
    "gen": "generator",
    "generator": "generator",
    "hvac": "hvac",
    "elec": "electrical",
    "electrical": "electrical",
    "hyd": "hydraulic",
    "hydraulic": "hydraulic",
    "pneu": "pneumatic",
    "pneumatic": "pneumatic",
    "auto": "vehicle",
    "veh": "vehicle",
    "vehicle": "vehicle",
    "pump": "pump",
    "comp": "compressor",
    "compressor": "compressor",
}
PRODUCT_CLASSES = ("filter", "paint", "mcb", "coconut", "label", "labels", "sensor", "pipe", "battery", "shoe", "bicycle")
CONTEXTS = ("generator", "hvac", "electrical", "hydraulic", "pneumatic", "vehicle", "pump", "compressor")
FUNCTIONS_OR_MEDIA = ("fuel", "air", "oil", "warning", "temperature", "pressure")
COLORS = ("red", "blue", "black", "white", "green", "yellow", "orange", "grey", "gray")
SIZES = ("xs", "small", "medium", "large", "xl", "extra small", "extra large")
MATERIALS = ("stainless steel", "steel", "plastic", "rubber", "copper", "aluminium", "aluminum")
PACKAGING = ("can", "box", "bottle", "bag", "roll", "pack")
GENERIC_TERMS = ("label", "labels", "filter", "pipe", "bolt", "nut", "screw", "washer", "cable", "sensor", "paint", "oil", "material", "item", "part", "spare", "tool", "kit")

#: Variant groups in order of precedence, with their labels.
VARIANT_LABELS = {
    "FILTER_FUNCTION": "critical function",
    "COLOR": "color",
    "SIZE": "size",
    "TYPE_OR_GRADE": "type",
    "ELECTRICAL_RATING": "ampere rating",
    "DIMENSION": "dimension",
    "SENSOR_TYPE": "sensor type",
    "SIDE": "side",
}
VARIANT_FUNCTIONS = ("air", "fuel", "oil", "water", "hydraulic")
VARIANT_COLORS = ("red", "blue", "green", "black", "white", "yellow")
VARIANT_SIZES = {"xs": "extra small", "xl": "extra large", "small": "small", "medium": "medium", "large": "large"}
SENSOR_TYPES = ("temperature", "pressure", "flow", "level")
SIDES = ("left", "right", "front", "rear")

LOW_VALUE_TOKENS = ("type", "item", "part", "spare", "material", "can", "box", "bag", "pack", "roll")
TOKEN_LENGTH = 3
BLOCK_ATTRIBUTES = ("product_class", "type_code", "rating", "color", "application_context", "function_or_media")
FEATURES = ("product_class", "type_code", "rating", "color", "volume", "material", "application_context", "function_or_media")
SHOWN_ATTRIBUTES = ("product_class", "type_code", "rating", "color", "application_context", "function_or_media", "generic_terms")
TECHNICAL_WEIGHTS = {"numbers": 40, "measurements": 25, "dimensions": 15, "units": 10, "modifiers": 10}
PAIR_LIMIT = 20_000
MAX_BYTES, MAX_ROWS = 50 * 1024 * 1024, 100_000

DUPLICATE, POSSIBLE, RELATED, CONFLICT, CROSS_SITE, INSUFFICIENT, UNIQUE = STATUSES = (
    "DUPLICATE_CANDIDATE",
    "POSSIBLE_DUPLICATE_REVIEW",
    "RELATED_BUT_NOT_DUPLICATE",
    "DATA_CONFLICT_REVIEW",
    "CROSS_SITE_STANDARDIZATION_CANDIDATE",
    "INSUFFICIENT_DATA",
    "UNIQUE_NO_MATCH",
)
REVIEW_STATUSES = (DUPLICATE, POSSIBLE, CONFLICT, CROSS_SITE, INSUFFICIENT)
SCAN_MODES = ("SAME_SITE_DUPLICATE", "CROSS_SITE_STANDARDIZATION", "DISCOVERY")
LEVELS = (("HIGH", 90), ("MEDIUM", 75), ("LOW", 60))
LEVEL_ACTIONS = {
    "HIGH": "Review as likely duplicate",
    "MEDIUM": "Manual review recommended",
    "LOW": "Weak match; review only in discovery mode",
    "IGNORE": "Not likely duplicate",
}
STATUS_ACTIONS = {
    DUPLICATE: "Review as likely duplicate candidate",
    RELATED: "Do not merge; related item only",
    CONFLICT: "Resolve data conflict before duplicate review",
    CROSS_SITE: "Review for cross-site standardization",
    INSUFFICIENT: "Improve master data before deciding",
}

#: Names that statuses are shown by.
STATUS_NAMES = {
    DUPLICATE: "Duplicate Candidate",
    POSSIBLE: "Possible Duplicate",
    CONFLICT: "Data Conflict",
    CROSS_SITE: "Cross-Site Candidate",
    INSUFFICIENT: "Insufficient Data",
    RELATED: "Related, Not Duplicate",
    UNIQUE: "Unique / No Match",
    "LIKELY_DUPLICATE": "Duplicate Candidate",
}

#: Field, label, rule decision, score of the fields whose difference stops a pair.
HARD_FIELDS = (
    ("HSN_SAC_CODE", "HSN/SAC Code", "DATA_CONFLICT", 45.0),
    ("UNIT_MEAS", "Inventory UOM", "REJECT", 45.0),
    ("PRODUCT_CATEGORY_ID", "Product category", "REJECT", 50.0),
    ("HAZARD_CODE", "Safety code", "REJECT", 50.0),
)

#: Kind, pattern, what it is called, of values that may be sensitive.
SENSITIVE = (
    ("POSSIBLE_EMAIL", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "email-like values"),
    ("POSSIBLE_PHONE", r"\+?\d[\d\s().-]{7,}\d", "phone-like values"),
    ("POSSIBLE_PROJECT_REFERENCE", r"(?i)\b(?:PROJECT|PROJ|JOB|WO|WORK\s*ORDER)[-_ /]?[A-Z0-9]{3,}\b", "project/work-order references"),
    ("POSSIBLE_SUPPLIER_REFERENCE", r"(?i)\b(?:SUPPLIER|VENDOR|MAKE|BRAND|MFR|MANUFACTURER)[:\s-]+[A-Z0-9][A-Z0-9 ._-]{2,}\b", "supplier/vendor/manufacturer references"),
)

#: Part number, full description, variant description, unit, commodity of made-up records.
SYNTHETIC = (
    ("MCB30A", "MCB30A", "Miniature Circuit Breaker 30A", "EA", "ELECTRICAL"),
    ("COCO-1", "Decicated Coconut type 1", "Desiccated Coconut type 1", "KG", "FOOD"),
    ("GOF-1", "Generator Oil Filter", "Generator Oil Filter", "EA", "FILTER"),
    ("GAF-1", "Generator Air Filter", "Generator Air Filter", "EA", "FILTER"),
    ("BOLT-10", "Bolt 10MM", "Bolt 10 mm", "EA", "FASTENER"),
    ("BOLT-12", "Bolt 12MM", "Bolt 12 mm", "EA", "FASTENER"),
    ("SSP-1", "Stainless Steel Pipe", "SS Pipe", "M", "PIPE"),
)

#: Columns of an exported candidate, in order.
EXPORT_COLUMNS = (
    "part_no_a", "description_a", "contract_a", "part_no_b", "description_b", "contract_b",
    "similarity_score", "confidence_level", "business_status", "rule_decision", "rejection_reason",
    "confidence_score", "matched_evidence", "differences", "warnings",
    "scan_mode", "critical_mismatches", "generic_description_warning",
    "application_context_a", "application_context_b", "application_context_warning",
    "normalized_description_a", "normalized_description_b", "normalized_part_no_a", "normalized_part_no_b",
    "extracted_attributes_a", "extracted_attributes_b",
    "variant_attributes_a", "variant_attributes_b",
    "description_similarity", "tfidf_score", "fuzzy_score", "part_no_similarity",
    "technical_token_score", "matched_fields", "mismatched_fields", "explanation",
    "reason", "final_score", "score", "recommended_action", "review_status",
)

#: Plain values that must match the given behaviour: texts of warnings, by kind.
WARNING_TEXTS = {
    "EMPTY_DESCRIPTION": "{n} record(s) have empty descriptions and will be skipped.",
    "DUPLICATE_PART_NO": "{n} row(s) use a repeated part number.",
    "MISSING_SELECTED_FIELD": "Selected field {field} is unavailable and will be ignored.",
    "HIGH_NULL_FIELD": "Selected field {field} is {percent}% empty.",
    "SENSITIVE": "Detected {n} {what} in columns: {columns}. Review data handling before sharing exports.",
    "IGNORED_FIELD": "Selected field {field} is unavailable and was ignored.",
    "PAIR_LIMIT_REACHED": "Candidate generation stopped at the safety limit of {most} pairs.",
}
