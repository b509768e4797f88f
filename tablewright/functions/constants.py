"""Word lists, patterns, thresholds and weights the results depend on.

Patterns avoid look-around and back-references, so that other SQL engines read them too.
"""

from __future__ import annotations

# Every character Python's str.strip() and re's \s treat as white space.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACE_CHARACTERS = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Text meaning "missing", compared after strip and lower-casing.
NULL_TOKENS = [
    "n/a", "na", "null", "none", "nil", "nan", "undefined",
    "-", "--", "---", ".", "..", "...",
    "#n/a", "#na", "#null", "#ref!", "#value!",
    "not available", "not applicable", "missing",
    "n.a.", "n.a", "n/d", "nd",
    "unknown", "",
]

# Boolean vocabulary.
TRUE_TOKENS = ["yes", "y", "true", "t", "1", "on", "active", "enabled", "si", "oui", "हां"]
FALSE_TOKENS = ["no", "n", "false", "f", "0", "off", "inactive", "disabled", "non", "नहीं"]

# E-mail domain typos and their corrections.
EMAIL_DOMAIN_FIXES = {
    "gmial.com": "gmail.com",
    "gmaill.com": "gmail.com",
    "gamil.com": "gmail.com",
    "gmai.com": "gmail.com",
    "gmail.co": "gmail.com",
    "yaho.com": "yahoo.com",
    "yahooo.com": "yahoo.com",
    "hotmal.com": "hotmail.com",
    "hotmial.com": "hotmail.com",
    "outlok.com": "outlook.com",
}

# Label prefixes that contaminate values.
LABEL_PREFIXES = [
    "written by:", "writtenby:", "written by",
    "narrated by:", "narratedby:", "narrated by",
    "translated by:", "translatedby:",
    "edited by:", "editedby:",
    "author:", "authors:",
    "narrator:", "narrators:",
    "publisher:", "published by:",
    "director:", "directed by:",
]

# Value shapes.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
PERCENT = r"^[+-]?\s*\d+[\d,]*\.?\d*\s*%$"
PHONE = r"^[\+]?[\d\s\-\.\(\)]{7,18}$"
INDIAN_NUMBER = r"^\d{1,2}(,\d{2})*(,\d{3})(\.\d+)?$"
WESTERN_NUMBER = r"^\d{1,3}(,\d{3})+(\.\d+)?$"
EUROPEAN_NUMBER = r"^\d{1,3}(\.\d{3})+(,\d+)?$"
PAREN_NUMBER = r"^\([\$₹£€¥]?\s*[\d,]+\.?\d*\)$"
RATING = r"(?i)^([0-9]+(?:\.[0-9]+)?)\s+out\s+of\s+[0-9]+\s+stars?"
REFERENCE_MARK = r"\[\w+\]"
CURRENCY = r"[\$₹£€¥]"
YEAR = r"^\d{4}$"
YEAR_FLOAT = r"^\d{4}\.0$"
YEAR_SHORT = r"^\d{1,2}$"
YEAR_ONLY = r"^\d{4}(\.0)?$"
YEAR_RANGE = r"^\d{4}(\s*[-–—]\s*\d{4})?$"
DATE_SHAPES = {
    "DD/MM/YYYY": r"^\d{1,2}/\d{1,2}/\d{4}",
    "YYYY-MM-DD": r"^\d{4}-\d{1,2}-\d{1,2}",
    "DD.MM.YYYY": r"^\d{1,2}\.\d{1,2}\.\d{4}",
}
SEEN_DATE_FORMATS = {
    "ISO": r"^\d{4}-\d{2}-\d{2}",
    "SLASH": r"^\d{1,2}/\d{1,2}/\d{4}",
    "DASH": r"^\d{1,2}-\d{1,2}-\d{4}",
    "DOT": r"^\d{1,2}\.\d{1,2}\.\d{4}",
    "NAMED": r"[A-Za-z]",
}

# Personal-data patterns.
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d[ -]*){13,16}\b",
}
PII_LABELS = {
    "email": "Email Addresses",
    "phone": "Phone Numbers",
    "ssn": "SSN/National IDs",
    "credit_card": "Credit Card Numbers",
}

# Broken byte sequences and their repair, applied in this order.
MOJIBAKE = [
    ("â\u0080\u0099", "'"), ("â\u0080\u009c", '"'), ("â\u0080\u009d", '"'),
    ("â\u0080\u0094", "—"), ("â\u0080\u0093", "–"), ("â\u0080¦", "…"),
    ("Ã©", "é"), ("Ã¨", "è"), ("Ã¼", "ü"),
    ("Ã¶", "ö"), ("Ã¤", "ä"), ("Ã±", "ñ"),
    ("Â£", "£"), ("Â¥", "¥"), ("â\u0082¹", "₹"),
    ("Â°", "°"), ("Â©", "©"), ("Â®", "®"),
    ("Â\u00a0", " "), ("Â ", " "), ("Â", ""),
    ("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€�", '"'),
    ("â€”", "—"), ("â€“", "–"), ("â€¦", "…"),
    ("â€ ", "†"), ("â€¡", "‡"), ("â‚¹", "₹"),
    ("\x00", ""), ("\ufeff", ""),
]

# Words in column names.
YEAR_NAMES = ["year", "yr", "fiscal", "fy"]
PHONE_NAMES = ["phone", "mobile", "tel", "cell", "contact", "fax"]
EMAIL_NAMES = ["email", "mail", "e-mail", "e_mail"]
DATE_NAMES = ["date", "time", "created", "updated", "timestamp", "reported", "started", "ended", "dob", "birth", "expir"]
PARSE_DATE_NAMES = ["date", "time", "year", "month", "day", "period", "quarter"]
FRESHNESS_NAMES = ["date", "timestamp", "updated", "created", "reported"]
IDENTIFIER_NAMES = ["id", "key", "code", "number"]
MONEY_NAMES = ["revenue", "amount", "price", "cost", "sales", "total", "income"]
REPORT_MONEY_NAMES = ["revenue", "amount", "price", "cost", "sales", "total", "income", "salary"]
MEASURE_NAMES = ["total", "amount", "revenue", "sales", "price"]
SEGMENT_NAMES = ["price", "amount", "revenue", "cost"]
DATE_PART_NAMES = ["date", "time", "timestamp"]
EMPTY_REFERENCE_NAMES = ["ref", "ref.", "reference", "references", "citation", "citations", "source"]
SENSITIVE_NAMES = [
    "salary", "ssn", "social_security", "password", "credit_card", "health_condition", "religion",
    "ethnicity", "sexual_orientation", "disability", "political_affiliation",
]

# Noise words dropped before fuzzy comparison.
NOISE_PREFIXES = ["the ", "a ", "an ", "dr. ", "mr. ", "ms. ", "mrs. ", "prof. ", "sr. ", "jr. "]
NOISE_SUFFIXES = [" inc", " inc.", " ltd", " llc", " corp", " co.", " co"]

# Quality dimensions, their weights, and the grade floors.
QUALITY_WEIGHTS = {
    "completeness": 0.20, "uniqueness": 0.15, "consistency": 0.15, "type_correctness": 0.15,
    "validity": 0.10, "accuracy": 0.10, "timeliness": 0.15,
}
GRADE_FLOORS = [(95.0, "A+"), (90.0, "A"), (80.0, "B"), (60.0, "C"), (40.0, "D")]

# An alternative published weighting of the dimensions, and its grade floors.
CATALOGUE_WEIGHTS = {
    "completeness": 0.25, "uniqueness": 0.20, "consistency": 0.20, "validity": 0.15,
    "accuracy": 0.10, "timeliness": 0.10,
}
CATALOGUE_GRADE_FLOORS = [(95.0, "A+"), (85.0, "A"), (70.0, "B"), (50.0, "C"), (30.0, "D")]

# Business sectors with their column-name words and weight.
SECTORS = {
    "retail": ("Retail & E-Commerce", 1.0, [
        "sku", "product", "price", "quantity", "order", "cart", "category", "discount", "revenue",
        "inventory", "stock", "item", "shipping", "customer", "sale", "payment", "coupon", "return"]),
    "healthcare": ("Healthcare", 1.2, [
        "patient", "diagnosis", "icd", "medication", "prescription", "admit", "discharge", "readmit",
        "blood_pressure", "treatment", "insurance_claim", "hospital", "symptom", "dose", "vitals"]),
    "finance": ("Finance & Banking", 1.1, [
        "transaction", "balance", "account", "loan", "interest", "credit", "debit", "portfolio",
        "investment", "yield", "risk", "apy", "apr", "maturity", "collateral", "default"]),
    "hr": ("Human Resources", 1.0, [
        "employee", "salary", "department", "hire_date", "performance", "attrition", "tenure",
        "job_title", "leave", "overtime", "manager", "appraisal", "promotion", "headcount"]),
    "manufacturing": ("Manufacturing", 1.1, [
        "machine", "sensor", "production", "defect", "batch", "yield_rate", "maintenance", "downtime",
        "quality_score", "throughput", "cycle_time", "oee", "scrap"]),
    "education": ("Education", 1.0, [
        "student", "grade", "enrollment", "course", "gpa", "attendance", "semester", "faculty",
        "curriculum", "score", "exam", "assignment", "dropout", "graduation"]),
    "logistics": ("Logistics & Supply Chain", 1.0, [
        "shipment", "tracking", "warehouse", "delivery", "route", "carrier", "freight", "lead_time",
        "supply", "demand", "procurement", "vendor", "fulfillment", "dock"]),
    "real_estate": ("Real Estate", 1.0, [
        "property", "listing", "listing_price", "sale_price", "sqft", "square_feet", "bedrooms",
        "bathrooms", "lot_size", "year_built", "mls", "agent", "hoa", "zoning", "appraisal"]),
}

# Per-sector bands (excellent, good, acceptable, poor) of each quality ratio.
SECTOR_BANDS = {
    "completeness": {
        "healthcare": (0.99, 0.97, 0.95, 0.90), "finance": (0.995, 0.98, 0.95, 0.90),
        "retail": (0.97, 0.93, 0.90, 0.85), "hr": (0.98, 0.95, 0.92, 0.85),
        "manufacturing": (0.98, 0.95, 0.92, 0.88), "education": (0.97, 0.93, 0.90, 0.85),
        "logistics": (0.98, 0.95, 0.92, 0.87), "general": (0.97, 0.93, 0.90, 0.85)},
    "uniqueness": {
        "healthcare": (0.999, 0.998, 0.995, 0.99), "finance": (0.999, 0.997, 0.995, 0.99),
        "retail": (0.99, 0.98, 0.97, 0.95), "hr": (0.998, 0.995, 0.99, 0.98),
        "manufacturing": (0.995, 0.99, 0.98, 0.97), "general": (0.99, 0.98, 0.97, 0.95)},
    "consistency": {
        "healthcare": (0.99, 0.97, 0.95, 0.90), "finance": (0.995, 0.98, 0.96, 0.92),
        "retail": (0.97, 0.94, 0.91, 0.85), "general": (0.97, 0.94, 0.91, 0.85)},
    "timeliness_days": {
        "healthcare": (1, 3, 7, 30), "finance": (1, 1, 3, 7), "retail": (1, 7, 14, 30),
        "manufacturing": (1, 1, 7, 14), "general": (7, 14, 30, 90)},
}
