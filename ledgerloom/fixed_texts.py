"""The sentences of anomalies, health reports, insights and text reports, which results must show word for word.

Names in braces stand for values; `fill` puts them in.
"""

# --- Anomalies: title, explanation, action --------------------------------------------------------------------------
SLOW_STOCK = (
    "Dead stock: {product}",
    "{quoted} has not been sold in {days} days (last sold on {last}). Total historical revenue from this product: {total}.",
    "Consider running a discount offer, bundling with a fast-moving product, or returning to supplier if possible.",
)
CHURN = (
    "Churn risk: {customer}",
    "{quoted} has not ordered in {days} days (last order: {last}). Their average order value is {average}.",
    "Call or message {quoted} today. A quick check-in can recover the relationship. They may have switched to a competitor.",
)
LARGE_SALE = (
    "Unusually large sale: {amount}",
    "A transaction of {amount} on {day} is {times}× your average order value ({mean}). Customer: {customer}.",
    "Verify this is a genuine sale and not a data entry error. If real, this is a big win — consider how to replicate it.",
)
REVENUE_DROP = (
    "Revenue dropped {drop} {this}",
    "Revenue {this} is {current}, down {drop} from {previous} {last}. This is a significant drop that needs immediate attention.",
    "Review which products or customers drove {last}'s revenue and check if those sales are missing {this}. "
    "Check for pending orders that haven't been invoiced yet.",
)
UNUSUAL_WEEK = (
    "Unusual revenue week ending {short}",
    "Revenue of {revenue} for the week ending {day} is statistically {side} (z-score: {z}). "
    "Your typical weekly revenue is {mean} ± {deviation}.",
    "Investigate what drove the unusual activity this week.",
)
OUTLIER_WEEK = (
    "ML: unusual pattern week of {short}",
    "Machine learning detected an unusual revenue pattern for the week ending {day} ({revenue}). "
    "This week's pattern doesn't fit your historical trend.",
    "Review what was different this week — products, customers, or external factors.",
)
NOBODY = "Unknown"

# --- Health: issue, suggestion --------------------------------------------------------------------------------------
COLUMN_ABSENT = ("Required column '{column}' is missing entirely.", "Ensure your file has a column for {column}.")
CELLS_MISSING = (
    "Column '{column}' has {pct}% missing values.", "Fill in missing {column} values in your file before uploading.",
)
FEW_CELLS_MISSING = "Column '{column}' has {pct}% missing values (minor)."
OPTIONAL_ABSENT = "Optional column '{column}' not found — customer/product analysis will be limited."
LONG_RANGE = "Date range spans {years} years — consider uploading year-by-year for better analysis."
ONE_DATE = (
    "All transactions have the same date — this is unusual.", "Verify that your date column is correctly identified.",
)
WILD_AMOUNTS = (
    "Amount values vary extremely widely — some amounts may be in different units (e.g., paise vs rupees).",
    "Check if all amounts are in the same currency unit (₹).",
)
FUTURE_DATES = (
    "{n} transactions ({pct}%) have future dates — likely data entry errors.",
    "Correct the dates on future-dated transactions in your file.",
)
EXTREME_AMOUNTS = "{n} transactions have unusually large amounts — please verify they are correct."
MOSTLY_DUPLICATES = (
    "{n} duplicate transactions found ({pct}%) — this is very high.",
    "Remove duplicate entries from your file. Each transaction should appear only once.",
)
MANY_DUPLICATES = (
    "{n} duplicate transactions found ({pct}%).", "Review and remove duplicate entries from your file.",
)
FEW_DUPLICATES = "{n} possible duplicate transactions found (minor)."
LOW_SCORE = (
    "Data Health Score ({score}/100) is below the minimum of {least}.", "Fix the issues listed below, then re-upload your file.",
)
FEW_ROWS = (
    "Only {rows} rows found — need at least {least} to analyze.",
    "Upload a file with more transaction history (at least 2 weeks of data).",
)

# --- Insights: title, text ------------------------------------------------------------------------------------------
GROWTH = ("Strong Revenue Growth", "Revenue grew +{pct}% vs last period. Your business is gaining momentum!")
DECLINE = ("Revenue Decline Alert", "Revenue dropped {pct}% vs last period. Review pricing or top-product stock levels.")
SLOW_PRODUCTS = (
    "{n} Slow-Moving Products",
    "These items haven't sold in 14+ days. Consider discounts, bundles, or promotions to free up stock.",
)
TOP_SELLER = (
    "Top Seller: {product}", "Your best product earns {revenue}. Ensure stock is always available to maximise sales.",
)

# --- Text reports: words for up, down and unchanged, and the report --------------------------------------------------
TREND_HINDI = ("बढ़ी है 📈", "घटी है ⚠️", "स्थिर है")
TREND_ENGLISH = ("up 📈", "down ⚠️", "stable")
REPORT_HINDI = (
    "नमस्ते {owner} जी! 🙏\n\nइस हफ्ते की रिपोर्ट:\n• Revenue: {revenue} ({size} {trend})\n• सबसे अच्छा product: {best}\n\n"
    "3 काम करें:\n1. अपने top customers को call करें\n2. Dead stock को check करें\n3. इस हफ्ते का target set करें\n\n— {signature}"
)
REPORT_ENGLISH = (
    "Hello {owner}!\n\nThis week's summary:\n• Revenue: {revenue} ({size} {trend})\n• Best product: {best}\n\n"
    "3 actions for this week:\n1. Call your top customers\n2. Review dead stock items\n3. Set a revenue target for next week\n\n— {signature}"
)
