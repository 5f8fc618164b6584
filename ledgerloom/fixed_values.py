"""Fixed values.

Everything in this module is data whose exact value decides the results: thresholds, word lists, header patterns,
date formats, message texts and the seasonal calendar. There is no logic here.
"""

from datetime import date

# --- Fixed values: comparison periods -------------------------------------------------------------------------------
# (longest span in days, period length in days); a longer span uses LONGEST_PERIOD_DAYS.
PERIOD_STEPS = ((14, 7), (90, 30))
LONGEST_PERIOD_DAYS = 90
TREND_PCT = 5
PERIOD_LABELS = {7: "This week vs last week", 30: "This month vs last month", 90: "This quarter vs last quarter"}
PERIOD_THIS = {7: "this week", 30: "this month", 90: "this quarter"}
PERIOD_LAST = {7: "last week", 30: "last month", 90: "last quarter"}

# --- Fixed values: KPI limits ---------------------------------------------------------------------------------------
TOP_PRODUCTS = 5
DEAD_STOCK_DAYS = 14
CHART_DAYS = 60
INSIGHT_PCT = 10

# --- Fixed values: cleaning and health ------------------------------------------------------------------------------
EXTREME_SIGMAS = 3
EXTREME_MIN_ROWS = 4
NAME_SIMILARITY = 85
NAME_MIN_COUNT = 2
HEALTH_MIN_ROWS = 5
HEALTH_MIN_SCORE = 40
HEALTH_PART = 25
GRADES = (
    (80, "Excellent"),
    (65, "Good"),
    (40, "Fair — analysis will run but results may be imprecise"),
)
LOWEST_GRADE = "Poor — please fix issues before analysis"
SAMPLE_SEED = 42

# --- Fixed values: anomaly thresholds -------------------------------------------------------------------------------
SLOW_STOCK_DAYS = 14
SLOW_STOCK_HIGH_DAYS = 30
CHURN_DAYS = 21
CHURN_HIGH_ORDER = 5000
LARGE_MULTIPLE = 3
LARGE_MIN_ROWS = 3
DROP_PCT = 20
MIN_WEEKS_ZSCORE = 3
MIN_WEEKS_OUTLIER = 4
OUTLIER_SHARE = 0.1
ZSCORE_LIMIT = 2.5
MIN_CONFIDENCE = 0.5
SEVERITIES = ("HIGH", "MEDIUM", "LOW")
STORED_ANOMALIES = 10
REPORTED_ANOMALIES = 3

# --- Fixed values: defaults for missing names -----------------------------------------------------------------------
WALK_IN = "Walk-in Customer"
GENERAL_PRODUCT = "General"
GENERAL_SALES = "General Sales"
UNKNOWN_COMPANY = "Unknown Company"
DEFAULT_OWNER = "Business Owner"

# --- Fixed values: voucher types that count as sales ----------------------------------------------------------------
SALES_VOUCHER_TYPES = (
    "sales",
    "credit sales",
    "cash sales",
    "retail sales",
    "wholesale sales",
    "export sales",
    "local sales",
    "interstate sales",
    "intrastate sales",
    "tax invoice",
    "sale",
    "sale invoice",
)

# --- Fixed values: header patterns per ledger field, in matching order ----------------------------------------------
HEADER_PATTERNS = {
    "date": [
        "date", "dt", "invoice date", "bill date", "transaction date", "sale date", "voucher date", "posting date",
        "entry date", "inv date", "txn date", "trans date", "document date", "challan date", "receipt date",
        "payment date", "booking date", "order date", "tarikh", "तारीख", "दिनांक",
    ],
    "customer": [
        "customer", "client", "party", "party name", "customer name", "buyer", "purchaser", "ledger name",
        "account name", "vendor", "supplier", "counterparty", "recipient", "consignee", "payer", "payee", "naam",
        "नाम", "ग्राहक", "khata",
    ],
    "product": [
        "product", "item", "description", "particulars", "goods", "article", "product name", "item name",
        "item description", "narration", "nature of supply", "service", "category", "account head", "sub ledger",
        "sku", "hsn code", "maal", "saman", "माल", "सामान", "वस्तु",
    ],
    "amount": [
        "amount", "total", "net amount", "sale amount", "revenue", "value", "net total", "invoice amount",
        "bill amount", "taxable value", "invoice value", "gross amount", "total amount", "transaction amount",
        "net value", "subtotal", "rashi", "राशि", "मूल्य", "कुल",
    ],
    "debit": ["debit", "dr amount", "debit amount", "withdrawal", "withdrawl", "outflow"],
    "credit": ["credit", "cr amount", "credit amount", "deposit", "inflow", "received"],
    "quantity": ["qty", "quantity", "units", "nos", "number", "count", "matra", "मात्रा", "pieces", "pcs"],
    "unit_price": ["rate", "price", "unit price", "per unit", "mrp", "dar", "दर", "unit rate"],
}

# --- Fixed values: date formats, in parsing order (Spark datetime patterns) -----------------------------------------
DATE_FORMATS = (
    "d/M/yyyy",
    "d-M-yyyy",
    "d/M/yy",
    "d-M-yy",
    "d/M/yyyy H:m",
    "d/M/yyyy H:m:s",
    "yyyy-M-d",
    "yyyy-M-d H:m",
    "yyyy-M-d H:m:s",
    "yyyyMMdd",
    "d MMM yyyy",
    "d MMM yy",
    "d-MMM-yyyy",
    "d-MMM-yy",
    "d/MMM/yyyy",
    "MMMM d, yyyy",
    "d.M.yyyy",
    "d.M.yy",
    "M/d/yyyy H:m",
    "M/d/yyyy H:m:s",
    "M/d/yyyy",
    "M/d/yy",
    "M-d-yyyy",
)
NULL_WORDS = ("nan", "none", "null", "-", "")

# --- Fixed values: file signatures (hex of the first bytes) and types ------------------------------------------------
FILE_SIGNATURES = (
    ("FFD8FF", "image"),
    ("89504E47", "image"),
    ("3C3F786D6C", "tally_xml"),
    ("3C454E5645", "tally_xml"),
    ("3C54414C4C", "tally_xml"),
    ("504B0304", "excel"),
    ("D0CF11E0A1B11AE1", "excel"),
)
XML_MARKERS = ("<ENVELOPE", "<TALLYMESSAGE")
EXTENSION_TYPES = {"xml": "tally_xml", "xlsx": "excel", "xls": "excel", "csv": "csv"}
MEDIA_FILE_NAMES = {
    "text/csv": "data.csv",
    "application/vnd.ms-excel": "data.xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "data.xlsx",
    "text/xml": "data.xml",
    "application/xml": "data.xml",
    "image/jpeg": "photo.jpg",
    "image/png": "photo.png",
    "application/octet-stream": "data.csv",
}
DEFAULT_MEDIA_FILE_NAME = "data.csv"
CAPTION_EXTENSIONS = (".csv", ".xlsx", ".xls", ".xml", ".jpg", ".jpeg", ".png")

# --- Fixed values: customer segments --------------------------------------------------------------------------------
SEGMENTS = ("Champion", "Loyal", "Potential", "At Risk", "Lost", "New", "Average")
SEGMENT_DESCRIPTIONS = {
    "Champion": "Your best customers — buy often, spend the most, bought recently.",
    "Loyal": "Regular buyers with consistent spend. High retention value.",
    "Potential": "Recent buyers who haven't become regulars yet. High growth potential.",
    "At Risk": "Used to buy often but have gone quiet. Intervention needed now.",
    "Lost": "Haven't bought in a long time and were low-value. Low priority to recover.",
    "New": "Brand new customer — only bought once. Focus on second purchase.",
    "Average": "Middle-of-the-road customers. Can be nudged up with offers.",
}
SEGMENT_ACTIONS = {
    "Champion": "Treat them as VIPs. Offer early access to new products. Ask for referrals.",
    "Loyal": "Reward with loyalty benefits. Ask for testimonials or referrals.",
    "Potential": "Send personalised follow-up. Offer a small discount on next order.",
    "At Risk": "Call them personally. Find out why they stopped. Offer to win them back.",
    "Lost": "Send a re-engagement offer. If no response, deprioritise.",
    "New": "Send a thank-you message. Recommend complementary products.",
    "Average": "Send targeted promotions on their most-purchased category.",
}
TOP_CUSTOMERS = 10

# --- Fixed values: message intents (first rule with a matching token wins) and routes --------------------------------
INTENT_TOKENS = (
    ("revenue_today", ("aaj", "आज", "today", "abhi")),
    ("alerts", ("alert", "problem", "gadbad", "dikkat", "loss", "nuksan")),
    ("best_product", ("top", "best", "sabse", "sbse", "popular", "most sold")),
    ("slow_stock", ("slow", "dead stock", "nahi bik", "nhi bik", "unsold")),
    ("customer_count", ("customer", "grahak", "ग्राहक", "buyers")),
    ("revenue_query", ("biki", "bikri", "sales", "revenue", "kamai", "income", "profit")),
    ("report", ("report", "summary", "weekly", "monthly")),
    ("upload_link", ("upload", "csv", "excel", "file", "tally")),
    ("help", ("help", "hi", "hello", "namaste", "menu", "start")),
)
FALLBACK_INTENT = "ai_generated"
GREETINGS = ("hi", "hello", "start", "help", "menu", "namaste", "नमस्ते", "हेलो", "helo", "hey")
UPLOAD_WORDS = ("upload", "csv", "excel", "file bhejo", "data bhejo", "data send", "tally export")
HISTORY_MESSAGES = 10

# --- Fixed values: allowed values of the operational tables ---------------------------------------------------------
ALLOWED_VALUES = {
    "users": {
        "user_type": ("ca_firm", "smb_owner"),
        "language_preference": ("hi", "en", "hinglish"),
        "subscription_status": ("trial", "active", "cancelled", "expired"),
    },
    "uploads": {
        "file_type": ("tally_xml", "excel", "csv", "image"),
        "status": ("pending", "processing", "done", "error"),
    },
    "reports": {
        "report_type": ("weekly", "monthly", "alert", "on_demand"),
        "language": ("hi", "en", "hinglish"),
    },
    "messages": {"direction": ("inbound", "outbound")},
}
RETENTION_DAYS = 30
RECENT_ALERT_DAYS = 7
AT_RISK_DAYS = 30
ANALYSIS_MAX_AGE_DAYS = 60
ALERT_CLIENTS = 5

# --- Fixed values: seasonal calendar --------------------------------------------------------------------------------
# (name, local name, first day, last day, impact, industries (empty = all), note)
SEASONAL_WINDOW_DAYS = 14
_FESTIVE = ("retail", "fmcg", "electronics", "clothing", "sweets")
_FASTING = ("food", "fmcg", "clothing", "jewellery")
_COLOURS = ("retail", "fmcg", "clothing", "sweets")
_SUMMER_SCHOOL = ("stationery", "bags", "shoes", "clothing", "books")
_WINTER_SCHOOL = ("stationery", "books", "clothing")
EVENTS_BEFORE_TAX = (
    ("Diwali Season", "दीवाली", date(2024, 10, 29), date(2024, 11, 15), "spike", _FESTIVE,
     "Diwali season — expect 30–50% revenue spike in retail/FMCG. "
     "B2B collections may slow as businesses are in festival mode."),
    ("Diwali Season", "दीवाली", date(2025, 10, 18), date(2025, 11, 3), "spike", _FESTIVE,
     "Diwali season — expect 30–50% revenue spike in retail/FMCG."),
    ("Diwali Season", "दीवाली", date(2026, 11, 7), date(2026, 11, 22), "spike", _FESTIVE,
     "Diwali season — expect 30–50% revenue spike in retail/FMCG."),
    ("Post-Diwali Slowdown", "दीवाली के बाद", date(2024, 11, 16), date(2024, 11, 30), "dip", (),
     "Post-Diwali period — consumer spending typically drops sharply as budgets are exhausted. "
     "A revenue dip here is normal."),
    ("Post-Diwali Slowdown", "दीवाली के बाद", date(2025, 11, 4), date(2025, 11, 20), "dip", (),
     "Post-Diwali period — consumer spending typically drops sharply."),
    ("Post-Diwali Slowdown", "दीवाली के बाद", date(2026, 11, 23), date(2026, 12, 7), "dip", (),
     "Post-Diwali period — consumer spending typically drops sharply."),
    ("Navratri", "नवरात्रि", date(2024, 10, 3), date(2024, 10, 12), "mixed", _FASTING,
     "Navratri — fasting reduces certain food sales in North India. Clothing and jewellery see a spike."),
    ("Navratri", "नवरात्रि", date(2025, 9, 22), date(2025, 10, 1), "mixed", _FASTING,
     "Navratri — fasting reduces certain food sales in North India."),
    ("Navratri", "नवरात्रि", date(2026, 10, 11), date(2026, 10, 20), "mixed", _FASTING,
     "Navratri — fasting reduces certain food sales in North India."),
    ("Holi", "होली", date(2025, 3, 13), date(2025, 3, 17), "spike", _COLOURS,
     "Holi festival — spike in colors, sweets, clothing. "
     "Business activity pauses for 2–3 days around the main day."),
    ("Holi", "होली", date(2026, 3, 2), date(2026, 3, 6), "spike", _COLOURS,
     "Holi festival — spike in colors, sweets, clothing."),
    ("School Reopening (Summer)", "स्कूल खुलना (गर्मी)", date(2025, 6, 1), date(2025, 6, 20), "spike", _SUMMER_SCHOOL,
     "Schools reopen after summer break — spike in stationery, school bags, shoes, and uniforms."),
    ("School Reopening (Summer)", "स्कूल खुलना (गर्मी)", date(2026, 6, 1), date(2026, 6, 20), "spike", _SUMMER_SCHOOL,
     "Schools reopen after summer break — spike in stationery and school supplies."),
    ("School Reopening (Winter)", "स्कूल खुलना (सर्दी)", date(2025, 1, 2), date(2025, 1, 15), "spike", _WINTER_SCHOOL,
     "New academic semester — stationery and book sales spike."),
    ("School Reopening (Winter)", "स्कूल खुलना (सर्दी)", date(2026, 1, 2), date(2026, 1, 15), "spike", _WINTER_SCHOOL,
     "New academic semester — stationery and book sales spike."),
)
TAX_DEADLINE_YEARS = (2025, 2026)
TAX_DEADLINE_DAYS = (18, 22)
TAX_DEADLINE_NAME = "GST Filing Deadline (%d %d)"
TAX_DEADLINE_LOCAL = "GST भरने का समय"
TAX_DEADLINE_NOTE = (
    "GST filing deadline week — CA firms and businesses are occupied with compliance. "
    "B2B payment collections often slow by 15–20% this week."
)
EVENTS_AFTER_TAX = (
    ("Financial Year End", "वित्तीय वर्ष समाप्ति", date(2025, 3, 20), date(2025, 3, 31), "spike", (),
     "Indian financial year closes on March 31 — many businesses rush to complete purchases and clear invoices. "
     "Revenue spike is common."),
    ("Financial Year End", "वित्तीय वर्ष समाप्ति", date(2026, 3, 20), date(2026, 3, 31), "spike", (),
     "Indian financial year closes on March 31 — revenue spike common."),
    ("Republic Day", "गणतंत्र दिवस", date(2025, 1, 24), date(2025, 1, 28), "dip", (),
     "Republic Day holiday — government offices and many businesses closed. "
     "Government contractor payments often delayed."),
    ("Republic Day", "गणतंत्र दिवस", date(2026, 1, 23), date(2026, 1, 27), "dip", (),
     "Republic Day holiday — business activity pauses for 2–3 days."),
    ("Independence Day", "स्वतंत्रता दिवस", date(2025, 8, 13), date(2025, 8, 17), "dip", (),
     "Independence Day holiday — business activity dip expected."),
    ("Independence Day", "स्वतंत्रता दिवस", date(2026, 8, 13), date(2026, 8, 17), "dip", (),
     "Independence Day holiday — business activity dip expected."),
    ("Rabi Harvest Season", "रबी फसल", date(2025, 11, 1), date(2026, 1, 31), "spike",
     ("agricultural inputs", "hardware", "wholesale"),
     "Rabi harvest season — farmers have cash. Agricultural input demand and rural retail spending typically spike."),
)
