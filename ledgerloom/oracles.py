"""DuckDB SQL for the registered queries, written independently over the same tables."""

from ledgerloom import testviews as V
from ledgerloom.fixed_values import (
    EVENTS_AFTER_TAX,
    EVENTS_BEFORE_TAX,
    GREETINGS,
    INTENT_TOKENS,
    SEGMENT_ACTIONS,
    SEGMENT_DESCRIPTIONS,
    TAX_DEADLINE_NOTE,
    UPLOAD_WORDS,
)

ORACLES: dict[str, str] = {}

LEDGER = """
ledger AS (
  SELECT n_name AS tenant,
         printf('%012d-%d-%010d-%08d-%s', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                strftime(l_shipdate, '%Y%m%d')) AS row_id,
         l_orderkey AS voucher_id, o_orderdate AS date, c_name AS customer, p_brand || ' ' || p_name AS product,
         CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2)
              AS DECIMAL(18,2)) * (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS amount,
         l_quantity AS quantity, p_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)
"""
WIDE = LEDGER + """,
wide AS (SELECT * REPLACE (CAST(amount * CAST(quantity AS DECIMAL(6,0)) AS DECIMAL(18,2)) AS amount) FROM ledger)
"""


def bounds(source: str = "ledger", name: str = "bounds", where: str = "true", ref: str | None = None) -> str:
    ref_expr = f"TIMESTAMP '{ref}'" if ref else f"(SELECT max(date) FROM {source} r WHERE r.tenant = s.tenant)"
    return f"""
{name} AS (
  SELECT tenant, ref, n_days, ref - to_days(n_days - 1) AS start, ref - to_days(2 * n_days - 1) AS prev_start,
         ref - to_days(n_days) AS prev_end
  FROM (SELECT tenant, {ref_expr} AS ref,
               CASE WHEN date_diff('day', min(date), max(date)) <= 14 THEN 7
                    WHEN date_diff('day', min(date), max(date)) <= 90 THEN 30 ELSE 90 END AS n_days
        FROM {source} s WHERE {where} GROUP BY tenant))
"""


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} <> 0 THEN round(CAST({part} AS DOUBLE) * 100 / CAST({whole} AS DOUBLE), 2) END"


def trend(change: str) -> str:
    return f"CASE WHEN {change} IS NULL THEN 'new' WHEN {change} > 5 THEN 'up' WHEN {change} < -5 THEN 'down' " \
           "ELSE 'flat' END"


def add(name: str, ctes: str, body: str) -> None:
    ORACLES[name] = f"WITH {'RECURSIVE ' if 'RECURSIVE' in ctes else ''}{ctes.replace('RECURSIVE', '')} {body}" \
        if ctes else body


# --- KPIs ---
add("period_bounds", f"{LEDGER}, {bounds()}, {bounds(name='sale_bounds', where='amount > 0')}", """
SELECT *, 'all rows' AS variant FROM bounds UNION ALL SELECT *, 'sales' FROM sale_bounds""")


def revenue_ctes(ref: str | None = None) -> str:
    return f"""{LEDGER}, {bounds(ref=ref)}, rev AS (
  SELECT b.tenant, b.start AS period_start, b.ref AS period_end, n_days,
         coalesce(sum(amount) FILTER (date BETWEEN start AND ref), 0) AS cur,
         coalesce(sum(amount) FILTER (date BETWEEN prev_start AND prev_end), 0) AS prev
  FROM bounds b LEFT JOIN ledger l ON l.tenant = b.tenant AND amount > 0 GROUP BY ALL),
rev2 AS (SELECT *, {pct('(cur - prev)', 'prev')} AS change_pct FROM rev)"""


REVENUE = """
SELECT tenant, period_start, period_end, n_days, CAST(cur AS DOUBLE) AS current_revenue,
       CAST(prev AS DOUBLE) AS previous_revenue, CAST(cur - prev AS DOUBLE) AS change_amount, change_pct,
       {trend} AS trend,
       CASE n_days WHEN 7 THEN 'This week vs last week' WHEN 30 THEN 'This month vs last month'
                   ELSE 'This quarter vs last quarter' END AS period_label FROM rev2""".replace(
    "{trend}", trend("change_pct"))
add("revenue", revenue_ctes(), REVENUE)
add("revenue_at_date", revenue_ctes("2000-06-30"), REVENUE)

TOP = f"""top AS (
  SELECT *, {pct('(revenue - previous_revenue)', 'previous_revenue')} AS change_pct FROM (
    SELECT l.tenant, product, coalesce(sum(amount) FILTER (date BETWEEN start AND ref), 0) AS revenue,
           coalesce(sum(amount) FILTER (date BETWEEN prev_start AND prev_end), 0) AS previous_revenue,
           CAST(coalesce(sum(quantity) FILTER (date BETWEEN start AND ref), 0) AS BIGINT) AS units_sold,
           row_number() OVER (PARTITION BY l.tenant
             ORDER BY coalesce(sum(amount) FILTER (date BETWEEN start AND ref), 0) DESC, product) AS rank
    FROM ledger l JOIN bounds b ON l.tenant = b.tenant WHERE amount > 0
    GROUP BY l.tenant, product HAVING count(*) FILTER (date BETWEEN start AND ref) > 0) WHERE rank <= 5)"""
add("top_products", f"{LEDGER}, {bounds()}, {TOP}", f"""
SELECT tenant, product, CAST(revenue AS DOUBLE) AS revenue, CAST(previous_revenue AS DOUBLE) AS previous_revenue,
       units_sold, rank, change_pct, {trend('change_pct')} AS trend FROM top""")


def idle(entity: str, source: str = "ledger", name: str = "idle") -> str:
    return f"""{name} AS (
  SELECT s.tenant, {entity}, date_diff('day', max(date), any_value(ref)) AS days, max(date) AS last, sum(amount) AS total,
         count(*) AS n
  FROM {source} s JOIN (SELECT tenant, max(date) AS ref FROM {source} GROUP BY tenant) r ON r.tenant = s.tenant
  WHERE amount > 0 GROUP BY s.tenant, {entity})"""


add("dead_stock", f"{LEDGER}, {idle('product')}", """
SELECT tenant, product, days AS days_since_sale, last AS last_sale_date, CAST(total AS DOUBLE) AS locked_value
FROM idle WHERE days > 14""")
SPLIT = """split AS (
  SELECT tenant, count(*) FILTER (first >= start) AS new_customers, count(*) FILTER (first < start) AS repeat_customers,
         coalesce(sum(cur) FILTER (first >= start), 0) AS new_revenue,
         coalesce(sum(cur) FILTER (first < start), 0) AS repeat_revenue
  FROM (SELECT l.tenant, customer, any_value(start) AS start, min(date) AS first,
               sum(amount) FILTER (date BETWEEN start AND ref) AS cur
        FROM ledger l JOIN bounds b ON l.tenant = b.tenant WHERE amount > 0 GROUP BY l.tenant, customer)
  WHERE cur IS NOT NULL GROUP BY tenant)"""
add("customer_split", f"{LEDGER}, {bounds()}, {SPLIT}", """
SELECT b.tenant, coalesce(new_customers, 0) AS new_customers, coalesce(repeat_customers, 0) AS repeat_customers,
       CAST(coalesce(new_revenue, 0) AS DOUBLE) AS new_revenue,
       CAST(coalesce(repeat_revenue, 0) AS DOUBLE) AS repeat_revenue,
       CASE WHEN new_revenue + repeat_revenue > 0
            THEN round(CAST(new_revenue AS DOUBLE) * 100 / CAST(new_revenue + repeat_revenue AS DOUBLE), 2)
            ELSE 0.0 END AS new_revenue_pct
FROM bounds b LEFT JOIN split s ON s.tenant = b.tenant""")
DAILY = "SELECT tenant, CAST(date AS DATE) AS day, CAST(sum(amount) AS DOUBLE) AS revenue FROM ledger " \
        "WHERE amount > 0 GROUP BY ALL"
add("daily_revenue", LEDGER, DAILY)
add("stored_results", LEDGER, DAILY)
add("chart_revenue", LEDGER, """
SELECT tenant, date, CAST(sum(amount) AS DOUBLE) AS revenue FROM ledger GROUP BY tenant, date
QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY date DESC) <= 60""")
add("insights", f"{revenue_ctes()}, {TOP}, {idle('product')}, dead AS (SELECT tenant, count(*) AS n FROM idle "
    "WHERE days > 14 GROUP BY tenant)", """
SELECT tenant, 'celebration' AS type, 'Strong Revenue Growth' AS title, 1 AS priority FROM rev2 WHERE change_pct >= 10
UNION ALL SELECT tenant, 'warning', 'Revenue Decline Alert', 1 FROM rev2 WHERE change_pct <= -10
UNION ALL SELECT tenant, 'action', n || ' Slow-Moving Products', 2 FROM dead
UNION ALL SELECT tenant, 'opportunity', 'Top Seller: ' || product, 3 FROM top WHERE rank = 1""")
add("metrics_summary", f"{revenue_ctes()}, {TOP}, {SPLIT}, {idle('product')}", f"""
SELECT r.tenant, CAST(cur AS DOUBLE) AS current_revenue, {trend('r.change_pct')} AS trend, t.product AS best,
       CAST((SELECT count(*) FROM idle i WHERE i.tenant = r.tenant AND days > 14) AS DOUBLE) AS dead_stock_count,
       CAST(coalesce(repeat_customers, 0) AS DOUBLE) AS repeat_customers
FROM rev2 r LEFT JOIN top t ON t.tenant = r.tenant AND t.rank = 1 LEFT JOIN split s ON s.tenant = r.tenant""")

# --- Cleaning and health ---
FLAGGED = f"""{WIDE}, flagged AS (
  SELECT *, date > TIMESTAMP '{V.AS_OF_FLAGS}' AS flag_future_date, amount < 0 AS flag_negative_amount,
         coalesce(CASE WHEN count(*) OVER t >= 4 AND stddev_samp(CAST(amount AS DOUBLE)) OVER t > 0
              THEN abs(amount) > avg(CAST(amount AS DOUBLE)) OVER t + 3 * stddev_samp(CAST(amount AS DOUBLE)) OVER t
              END, false) AS flag_extreme_amount,
         row_number() OVER (PARTITION BY tenant, date, customer, product, amount ORDER BY row_id) > 1 AS flag_duplicate
  FROM wide WINDOW t AS (PARTITION BY tenant))"""
FLAG_NAMES = "flag_future_date, flag_negative_amount, flag_extreme_amount, flag_duplicate"
add("row_flags", FLAGGED, f"SELECT tenant, row_id, {FLAG_NAMES} FROM flagged")
add("duplicate_flags", LEDGER, """
SELECT tenant, row_id, row_number() OVER (PARTITION BY tenant, customer, product ORDER BY row_id) > 1 AS flag_duplicate
FROM ledger""")
add("flag_summary", FLAGGED, "SELECT tenant, count(*) AS n_rows, " + ", ".join(
    f"count(*) FILTER ({f}) AS {f}" for f in FLAG_NAMES.split(", ")) + " FROM flagged GROUP BY tenant")
ORACLES["name_normalisation"] = r"""
SELECT CAST(doc_id AS VARCHAR) AS row_id,
       'O''Brien-' || upper(source[1]) || lower(source[2:]) || ' 3M ' || doc_id AS customer,
       sha256(nfc_normalize(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS product_digest
FROM documents"""

GRADE = """CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 65 THEN 'Good'
     WHEN score >= 40 THEN 'Fair — analysis will run but results may be imprecise'
     ELSE 'Poor — please fix issues before analysis' END"""
HEALTH = FLAGGED + """, c AS (
  SELECT tenant, count(*) AS total_rows, count(*) FILTER (NOT flag_duplicate AND NOT flag_future_date) AS usable_rows,
         count(*) FILTER (flag_future_date) AS nf, count(*) FILTER (flag_extreme_amount) AS ne,
         count(*) FILTER (flag_duplicate) AS nd, date_diff('day', min(date), max(date)) AS days,
         stddev_samp(CAST(amount AS DOUBLE)) FILTER (amount <> 0) / avg(CAST(amount AS DOUBLE)) FILTER (amount <> 0) AS cv
  FROM flagged GROUP BY tenant),
p AS (SELECT *, 25 AS completeness_score,
         25 - CASE WHEN days > 1825 OR (days = 0 AND total_rows > 10) THEN 5 ELSE 0 END
            - CASE WHEN cv > 10 THEN 5 ELSE 0 END AS consistency_score,
         greatest(0, 25 - least(15, CAST(floor(nf / total_rows * 100 / 2) AS INT)) - least(5, ne)) AS validity_score,
         25 - CASE WHEN nd / total_rows * 100 > 30 THEN 20 WHEN nd / total_rows * 100 > 10 THEN 10
                   WHEN nd > 0 THEN 3 ELSE 0 END AS uniqueness_score FROM c),
h AS (SELECT *, completeness_score + consistency_score + validity_score + uniqueness_score AS score FROM p)"""
add("health_scores", HEALTH, f"""
SELECT tenant, CAST(score AS INT) AS score, CAST(completeness_score AS INT) AS completeness_score,
  CAST(consistency_score AS INT) AS consistency_score, CAST(validity_score AS INT) AS validity_score,
  CAST(uniqueness_score AS INT) AS uniqueness_score, total_rows, usable_rows, {GRADE} AS grade,
  score >= 40 AND usable_rows >= 5 AS can_analyze,
  concat_ws('|',
    CASE WHEN score < 40 THEN 'Data Health Score (' || score || '/100) is below the minimum of 40.' END,
    CASE WHEN days > 1825 THEN 'Date range spans ' || (days // 365)
         || ' years — consider uploading year-by-year for better analysis.'
         WHEN days = 0 AND total_rows > 10 THEN 'All transactions have the same date — this is unusual.' END,
    CASE WHEN cv > 10 THEN 'Amount values vary extremely widely — some amounts may be in different units '
         || '(e.g., paise vs rupees).' END,
    CASE WHEN nf > 0 THEN nf || ' transactions (' || printf('%.1f', nf / total_rows * 100)
         || '%) have future dates — likely data entry errors.' END,
    CASE WHEN ne > 0 THEN ne || ' transactions have unusually large amounts — please verify they are correct.' END,
    CASE WHEN nd / total_rows * 100 > 30 THEN nd || ' duplicate transactions found ('
         || printf('%.1f', nd / total_rows * 100) || '%) — this is very high.'
         WHEN nd / total_rows * 100 > 10 THEN nd || ' duplicate transactions found ('
         || printf('%.1f', nd / total_rows * 100) || '%).'
         WHEN nd > 0 THEN nd || ' possible duplicate transactions found (minor).' END) AS issues,
  concat_ws('|',
    CASE WHEN score < 40 THEN 'Fix the issues listed below, then re-upload your file.' END,
    CASE WHEN days = 0 AND total_rows > 10 THEN 'Verify that your date column is correctly identified.' END,
    CASE WHEN cv > 10 THEN 'Check if all amounts are in the same currency unit (₹).' END,
    CASE WHEN nf > 0 THEN 'Correct the dates on future-dated transactions in your file.' END,
    CASE WHEN nd / total_rows * 100 > 30
         THEN 'Remove duplicate entries from your file. Each transaction should appear only once.'
         WHEN nd / total_rows * 100 > 10 THEN 'Review and remove duplicate entries from your file.' END) AS suggestions
FROM h""")
add("health_copies", LEDGER + """, two AS (
  SELECT tenant, date, amount, false AS dup FROM ledger
  UNION ALL SELECT tenant, date, amount, true FROM ledger WHERE voucher_id % 3 = 0),
keyed AS (SELECT tenant, date, customer, product, amount, row_id FROM ledger
  UNION ALL SELECT tenant, date, customer, product, amount, row_id || '-copy' FROM ledger WHERE voucher_id % 3 = 0),
marked AS (SELECT *, row_number() OVER (PARTITION BY tenant, date, customer, product, amount ORDER BY row_id) > 1 AS dup
  FROM keyed),
c AS (SELECT tenant, count(*) AS total_rows, count(*) FILTER (NOT dup) AS usable_rows, count(*) FILTER (dup) AS nd,
        date_diff('day', min(date), max(date)) AS days,
        stddev_samp(CAST(amount AS DOUBLE)) FILTER (amount <> 0) / avg(CAST(amount AS DOUBLE)) FILTER (amount <> 0) AS cv
      FROM marked GROUP BY tenant),
p AS (SELECT *, 25 - CASE WHEN nd / total_rows * 100 > 30 THEN 20 WHEN nd / total_rows * 100 > 10 THEN 10
                   WHEN nd > 0 THEN 3 ELSE 0 END AS uniqueness_score,
        50 + 25 - CASE WHEN days > 1825 OR (days = 0 AND total_rows > 10) THEN 5 ELSE 0 END
            - CASE WHEN cv > 10 THEN 5 ELSE 0 END AS rest FROM c),
h AS (SELECT *, rest + uniqueness_score AS score FROM p)""", f"""
SELECT tenant, CAST(score AS INT) AS score, CAST(uniqueness_score AS INT) AS uniqueness_score, total_rows, usable_rows,
       {GRADE} AS grade, score >= 40 AND usable_rows >= 5 AS can_analyze FROM h""")
add("analysis_gate", HEALTH, """
SELECT tenant, total_rows AS n_rows FROM h WHERE score >= 40 AND usable_rows >= 5""")
add("similar_names", LEDGER + """, names AS (
  SELECT tenant, product AS name, length(product) AS len FROM ledger GROUP BY ALL HAVING count(*) >= 2)""", """
SELECT a.tenant, a.name AS name_a, b.name AS name_b,
       round(100 * (1 - levenshtein(a.name, b.name) / greatest(a.len, b.len)), 6) AS similarity
FROM names a JOIN names b ON a.tenant = b.tenant AND a.name < b.name
WHERE levenshtein(a.name, b.name) * 100 <= 15 * greatest(a.len, b.len)""")
CANONICAL = """RECURSIVE """ + LEDGER + """, names AS (
  SELECT tenant, p_name AS name, count(*) AS n FROM ledger GROUP BY ALL HAVING count(*) >= 2),
edges AS (SELECT a.tenant, a.name AS a, b.name AS b FROM names a JOIN names b ON a.tenant = b.tenant
  WHERE levenshtein(a.name, b.name) * 100 <= 15 * greatest(length(a.name), length(b.name))),
reach(tenant, a, b) AS (SELECT tenant, a, b FROM edges
  UNION SELECT r.tenant, r.a, e.b FROM reach r JOIN edges e ON e.tenant = r.tenant AND e.a = r.b),
canon AS (SELECT r.tenant, r.a AS name, n.name AS canonical FROM reach r
  JOIN names n ON n.tenant = r.tenant AND n.name = r.b
  QUALIFY row_number() OVER (PARTITION BY r.tenant, r.a ORDER BY length(n.name) DESC, n.n DESC, n.name) = 1)"""
add("canonical_names", CANONICAL, "SELECT tenant, name, canonical FROM canon")
add("merged_products", CANONICAL, """
SELECT l.tenant, coalesce(canonical, p_name) AS product, count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS amount
FROM ledger l LEFT JOIN canon c ON c.tenant = l.tenant AND c.name = l.p_name GROUP BY ALL""")
BY_WORDS = """RECURSIVE """ + LEDGER + r""", spelled AS (
  SELECT tenant, amount, CASE voucher_id % 4 WHEN 0 THEN upper(turned) WHEN 1 THEN p_name || ' 1kg' WHEN 2 THEN '1 KG, ' || turned ELSE p_name END AS name
  FROM (SELECT *, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS turned FROM ledger)),
names AS (SELECT tenant, name, count(*) AS n, list_sort(regexp_extract_all(lower(name), '[0-9]+|[^\x00-\x60\x7B-\x7F]+')) AS words
  FROM spelled GROUP BY ALL HAVING count(*) >= 2),
bags AS (SELECT DISTINCT tenant, words, array_to_string(words, ' ') AS bag FROM names),
edges AS (SELECT a.tenant, a.bag AS a, b.bag AS b FROM bags a JOIN bags b ON a.tenant = b.tenant
  WHERE levenshtein(a.bag, b.bag) * 100 <= 15 * greatest(length(a.bag), length(b.bag))
    OR list_has_all(b.words, a.words) AND len(list_distinct(a.words)) >= 2 AND length(b.bag) < 1.5 * length(a.bag)
    OR list_has_all(a.words, b.words) AND len(list_distinct(b.words)) >= 2 AND length(a.bag) < 1.5 * length(b.bag)),
reach(tenant, a, b) AS (SELECT tenant, a, b FROM edges
  UNION SELECT r.tenant, r.a, e.b FROM reach r JOIN edges e ON e.tenant = r.tenant AND e.a = r.b),
canon AS (SELECT m.tenant, m.name, n.name AS canonical FROM reach r
  JOIN (SELECT *, array_to_string(words, ' ') AS bag FROM names) m ON m.tenant = r.tenant AND m.bag = r.a
  JOIN (SELECT *, array_to_string(words, ' ') AS bag FROM names) n ON n.tenant = r.tenant AND n.bag = r.b
  QUALIFY row_number() OVER (PARTITION BY m.tenant, m.name ORDER BY length(n.name) DESC, n.n DESC, n.name) = 1)"""
add("products_by_words", BY_WORDS, """
SELECT tenant, canonical, n_names, CAST(total AS DOUBLE) AS amount FROM
  (SELECT tenant, canonical, count(*) AS n_names FROM canon GROUP BY ALL) JOIN
  (SELECT s.tenant, coalesce(canonical, s.name) AS canonical, sum(amount) AS total FROM spelled s
   LEFT JOIN canon c ON c.tenant = s.tenant AND c.name = s.name GROUP BY ALL) USING (tenant, canonical)""")
add("sampled_ledger", LEDGER, """
SELECT tenant, count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS amount FROM ledger
WHERE substr(md5(row_id || '42'), 1, 7) < printf('%07x', CAST(0.25 * 268435456 AS BIGINT)) GROUP BY tenant""")


# --- Anomalies ---
def slow(source: str) -> str:
    return f"""{idle('product', source, 'idle_products')}, slow AS (
  SELECT tenant, 'slow_moving_stock' AS anomaly_type, CASE WHEN days > 30 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         round(least(0.95, 0.6 + CAST(days - 14 AS DOUBLE) / 60), 6) AS confidence, product AS entity,
         'Dead stock: ' || product AS title, 1 AS det FROM idle_products WHERE days > 14)"""


def churn(source: str) -> str:
    return f"""{idle('customer', source, 'idle_customers')}, churn AS (
  SELECT tenant, 'customer_churn_risk' AS anomaly_type,
         CASE WHEN CAST(total AS DOUBLE) / n > 5000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         round(least(0.9, 0.55 + CAST(days - 21 AS DOUBLE) / 90), 6) AS confidence, customer AS entity,
         'Churn risk: ' || customer AS title, 2 AS det FROM idle_customers WHERE days > 21)"""


REPORTED = "tenant, anomaly_type, severity, confidence, entity, title"
add("slow_moving_stock", f"{LEDGER}, {slow('ledger')}", f"SELECT {REPORTED} FROM slow")
add("churn_risk", f"{LEDGER}, {churn('ledger')}", f"SELECT {REPORTED} FROM churn")
LARGE = """large AS (
  SELECT w.* FROM wide w JOIN (SELECT tenant, avg(CAST(amount AS DOUBLE)) AS mean FROM wide WHERE amount > 0
    GROUP BY tenant HAVING count(*) >= 3) m ON m.tenant = w.tenant
  WHERE amount > 0 AND CAST(amount AS DOUBLE) > mean * 3),
first_large AS (SELECT * FROM large
  QUALIFY row_number() OVER (PARTITION BY tenant, customer ORDER BY date, row_id) = 1)"""
add("large_transactions", f"{WIDE}, {LARGE}",
    "SELECT tenant, row_id, customer, CAST(amount AS DOUBLE) AS amount FROM large")
add("first_large_transactions", f"{WIDE}, {LARGE}", """
SELECT tenant, customer AS entity, CAST(CAST(date AS DATE) AS VARCHAR) AS day, 'MEDIUM' AS severity,
       CAST(0.75 AS DOUBLE) AS confidence FROM first_large""")


def drop(source: str) -> str:
    return f"""{bounds(source, 'sale_bounds', 'amount > 0')}, dropped AS (
  SELECT tenant, (prev - cur) / prev * 100 AS drop_pct FROM (
    SELECT l.tenant, CAST(coalesce(sum(amount) FILTER (date BETWEEN start AND ref), 0) AS DOUBLE) AS cur,
           CAST(coalesce(sum(amount) FILTER (date BETWEEN prev_start AND prev_end), 0) AS DOUBLE) AS prev
    FROM {source} l JOIN sale_bounds b ON b.tenant = l.tenant WHERE amount > 0 GROUP BY l.tenant)
  WHERE prev <> 0 AND (prev - cur) / prev * 100 >= 20)"""


add("revenue_drop", f"{LEDGER}, {drop('ledger')}", """
SELECT tenant, 'HIGH' AS severity, CAST(0.9 AS DOUBLE) AS confidence, 'global' AS entity, round(drop_pct, 4) AS drop_pct
FROM dropped""")


def weekly(source: str) -> str:
    return f"""sold AS (
  SELECT tenant, CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, CAST(sum(amount) AS DOUBLE) AS revenue
  FROM {source} WHERE amount > 0 GROUP BY ALL),
weeks AS (SELECT tenant, CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end
  FROM sold GROUP BY tenant),
weekly AS (SELECT w.tenant, w.week_end, coalesce(revenue, 0.0) AS revenue FROM weeks w
  LEFT JOIN sold s ON s.tenant = w.tenant AND s.week_end = w.week_end),
z AS (SELECT tenant, week_end, revenue, (revenue - avg(revenue) OVER t) / stddev_pop(revenue) OVER t AS zscore
  FROM weekly WINDOW t AS (PARTITION BY tenant)
  QUALIFY count(*) OVER t >= 3 AND stddev_pop(revenue) OVER t > 0
    AND abs((revenue - avg(revenue) OVER t) / stddev_pop(revenue) OVER t) >= 2.5)"""


add("weekly_revenue", f"{LEDGER}, {weekly('ledger')}", "SELECT tenant, week_end, revenue FROM weekly")
add("zscore_weeks", f"{WIDE}, {weekly('wide')}",
    "SELECT tenant, week_end, revenue, round(zscore, 6) AS zscore FROM z")
REPORT = f"""{WIDE}, {slow('wide')}, {churn('wide')}, {LARGE}, {drop('wide')}, {weekly('wide')}, report AS (
  SELECT {REPORTED}, det FROM slow UNION ALL SELECT {REPORTED}, det FROM churn
  UNION ALL SELECT tenant, 'large_transaction', 'MEDIUM', 0.75, customer, '', 3 FROM first_large
  UNION ALL SELECT tenant, 'revenue_drop', 'HIGH', 0.9, 'global', '', 4 FROM dropped
  UNION ALL SELECT tenant, 'revenue_anomaly_zscore', 'MEDIUM', round(least(0.9, abs(zscore) / 5), 6),
                   CAST(week_end AS VARCHAR), '', 5 FROM z)"""
add("anomaly_report", REPORT, "SELECT tenant, anomaly_type, severity, confidence, entity FROM report")
add("severity_counts", REPORT, """
SELECT tenant, count(*) AS total, count(*) FILTER (severity = 'HIGH') AS high_count,
       count(*) FILTER (severity = 'MEDIUM') AS medium_count, count(*) FILTER (severity = 'LOW') AS low_count
FROM report GROUP BY tenant""")
add("high_anomalies", REPORT, """
SELECT tenant, anomaly_type, count(*) AS n FROM report WHERE severity = 'HIGH' GROUP BY ALL""")
RANK = """ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant
  ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, confidence DESC, det, entity) AS rank
  FROM report)"""
add("top_anomalies", f"{REPORT}, {RANK}", """
SELECT tenant, rank, anomaly_type, severity, entity FROM ranked WHERE rank <= 10""")
USERS = """users AS (
  SELECT c_custkey AS user_id, lower(c_name) || '@example.com' AS email, c_name AS name,
         CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN NULL
              ELSE '+91' || lpad(CAST(c_custkey AS VARCHAR), 10, '9') END AS phone,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'ca_firm' ELSE 'smb_owner' END AS user_type,
         CASE c_custkey % 3 WHEN 0 THEN 'hi' WHEN 1 THEN 'en' ELSE 'hinglish' END AS lang, c_acctbal > 0 AS opted,
         c_custkey % 2 = 0 AS weekly, c_custkey % 4 <> 0 AS on_anomaly, n_name AS tenant, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
add("high_alerts", f"{REPORT}, {RANK}, {USERS}", """
SELECT u.user_id, u.tenant, r.anomaly_type,
       CASE r.anomaly_type WHEN 'slow_moving_stock' THEN r.title WHEN 'customer_churn_risk' THEN r.title ELSE '?' END
       AS title
FROM users u JOIN ranked r ON r.tenant = u.tenant AND r.rank = 1 AND r.severity = 'HIGH'
WHERE opted AND phone <> '' AND on_anomaly""")


# --- Segments ---
def metric_score(metric: str, low_is_good: bool) -> str:
    quint = "".join(f" WHEN {metric} <= {metric}_e[{k + 1}] THEN {6 - k if low_is_good else k}" for k in range(1, 5))
    last = 1 if low_is_good else 5
    better, worse = ("<", ">") if low_is_good else (">", "<")
    return f"""CASE WHEN {metric}_d < 5 THEN CASE WHEN n = 1 THEN 3
            ELSE greatest(1, CAST(ceil(round(5 * ({metric}_r - 1) / (n - 1), 9)) AS INT)) END
         WHEN len(list_distinct({metric}_e)) < 6 THEN CASE WHEN {metric} {better} {metric}_m THEN 5
            WHEN {metric} {worse} {metric}_m THEN 1 ELSE 3 END
         ELSE CASE{quint} ELSE {last} END END"""


def rfm(source: str) -> str:
    metrics = {"recency": True, "frequency": False, "monetary": False}
    stats = ", ".join(
        f"quantile_cont(CAST({m} AS DOUBLE), [0, 0.2, 0.4, 0.6, 0.8, 1]) AS {m}_e, "
        f"quantile_cont(CAST({m} AS DOUBLE), 0.5) AS {m}_m, count(DISTINCT {m}) AS {m}_d" for m in metrics)
    ranks = ", ".join(
        f"row_number() OVER (PARTITION BY b.tenant ORDER BY {m} {'DESC' if low else ''}, customer) AS {m}_r"
        for m, low in metrics.items())
    scores = ", ".join(f"{metric_score(m, low)} AS {m[0]}" for m, low in metrics.items())
    return f"""base AS (
  SELECT s.tenant, customer, date_diff('day', max(date), any_value(ref)) AS recency, count(date) AS frequency,
         CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS DOUBLE) AS monetary
  FROM {source} s JOIN (SELECT tenant, max(date) AS ref FROM {source} GROUP BY tenant) x ON x.tenant = s.tenant
  GROUP BY s.tenant, customer),
stats AS (SELECT tenant, count(*) AS n, {stats} FROM base GROUP BY tenant),
ranked_base AS (SELECT b.*, s.* EXCLUDE (tenant), {ranks} FROM base b JOIN stats s ON s.tenant = b.tenant),
scored AS (SELECT tenant, customer, recency, frequency, monetary, {scores} FROM ranked_base),
rfm AS (SELECT tenant, customer, recency AS recency_days, frequency, monetary, CAST(r AS INT) AS r_score,
  CAST(f AS INT) AS f_score, CAST(m AS INT) AS m_score, CAST(r AS VARCHAR) || f || m AS rfm_score,
  CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champion' WHEN r >= 3 AND f >= 3 THEN 'Loyal'
       WHEN r >= 4 AND f <= 2 THEN 'Potential' WHEN r <= 2 AND f >= 3 THEN 'At Risk'
       WHEN r <= 2 AND f <= 2 AND m <= 2 THEN 'Lost' WHEN f = 1 AND r >= 4 THEN 'New' ELSE 'Average' END AS segment
  FROM scored)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TEXTS = ", ".join(
    f"({quoted(s)}, {quoted(SEGMENT_DESCRIPTIONS[s])}, {quoted(SEGMENT_ACTIONS[s])})" for s in SEGMENT_DESCRIPTIONS)
add("rfm_segments", f"{LEDGER}, {rfm('ledger')}", f"""
SELECT rfm.*, description, action FROM rfm JOIN (VALUES {TEXTS}) t(name, description, action) ON t.name = segment""")
add("rfm_by_firm", """fewvalues AS (
  SELECT event_type || '-' || (user_id % 40) AS tenant, date_trunc('month', ts) AS date,
         CAST(user_id AS VARCHAR) AS customer, CAST(value AS DECIMAL(18,2)) AS amount FROM events), """
    + rfm("fewvalues"), "SELECT * FROM rfm")
add("segment_counts", f"{LEDGER}, {rfm('ledger')}", "SELECT tenant, count(*) AS total, " + ", ".join(
    f"count(*) FILTER (segment = '{s}') AS {s.lower().replace(' ', '_')}" for s in SEGMENT_DESCRIPTIONS)
    + " FROM rfm GROUP BY tenant")
add("top_customers", f"{LEDGER}, {rfm('ledger')}", """
SELECT tenant, row_number() OVER (PARTITION BY tenant ORDER BY monetary DESC, customer) AS rank, customer, segment,
       rfm_score FROM rfm QUALIFY rank <= 10""")
add("champions", f"{LEDGER}, {rfm('ledger')}",
    "SELECT tenant, customer, rfm_score FROM rfm WHERE segment = 'Champion'")


# --- Calendar ---
def calendar() -> str:
    def row(number: int, event: tuple) -> str:
        name, _, first, last, impact, industries, note = event
        tags = "[" + ", ".join(quoted(i) for i in industries) + "]" + ("::VARCHAR[]" if not industries else "")
        return f"({number}, {quoted(name)}, DATE '{first}', DATE '{last}', {quoted(impact)}, {tags}, {quoted(note)})"

    before = len(EVENTS_BEFORE_TAX)
    rows = [row(i, e) for i, e in enumerate(EVENTS_BEFORE_TAX)]
    rows += [row(before + 24 + i, e) for i, e in enumerate(EVENTS_AFTER_TAX)]
    return f"""cal(no, name, d1, d2, impact, industries, note) AS (
  SELECT * FROM (VALUES {', '.join(rows)})
  UNION ALL SELECT {before} + m, 'GST Filing Deadline (' || (m % 12 + 1) || ' ' || (2025 + m // 12) || ')',
    make_date(2025 + m // 12, m % 12 + 1, 18), make_date(2025 + m // 12, m % 12 + 1, 22), 'dip', []::VARCHAR[],
    {quoted(TAX_DEADLINE_NOTE)} FROM (SELECT CAST(unnest(range(24)) AS INT) AS m)),
spans AS (SELECT o_orderkey AS tenant, CAST(o_orderdate + INTERVAL 288 MONTH AS DATE) AS ref FROM orders),
hits AS (SELECT tenant, no AS event_no, name, impact, industries, note FROM spans JOIN cal
  ON ref - 3 <= d2 AND d1 <= ref + 3)"""


def context(where: str = "true") -> str:
    return f""", found AS (
  SELECT tenant, bool_or(impact = 'dip') AS dip, bool_or(impact = 'spike') AS spike,
         string_agg(name, '|' ORDER BY event_no) AS events, string_agg(note, '|' ORDER BY event_no) AS notes
  FROM hits WHERE {where} GROUP BY tenant),
ctx AS (SELECT s.tenant, f.tenant IS NOT NULL AS in_season,
  CASE WHEN f.tenant IS NULL THEN 'none' WHEN dip THEN 'downgrade' WHEN spike THEN 'upgrade' ELSE 'downgrade' END
  AS severity_modifier, coalesce(events, '') AS events, coalesce(notes, '') AS notes
  FROM spans s LEFT JOIN found f ON f.tenant = s.tenant)"""


add("seasonal_events", calendar(), "SELECT tenant, event_no, name, impact FROM hits")
add("seasonal_context", calendar() + context(), "SELECT * FROM ctx")
add("seasonal_context_for_industry", calendar() + context(
    "len(industries) = 0 OR len(list_filter(industries, lambda i: contains(lower(i), 'clothing') "
    "OR contains('clothing', lower(i)))) > 0"), "SELECT tenant, in_season, severity_modifier, events FROM ctx")
add("season_around_orders", calendar(), """
SELECT s.tenant, count(no) > 0 AS in_season, count(no) AS n_events FROM spans s
LEFT JOIN cal ON ref - 14 <= d2 AND d1 <= ref + 14 GROUP BY s.tenant""")

add("anomalies_in_season", f"""{WIDE}, moved AS (SELECT * REPLACE (date + INTERVAL 24 YEAR AS date) FROM wide),
{slow('moved')}, {churn('moved')}, {drop('moved')}, {weekly('moved')}, {calendar().split("spans AS")[0]}
refs AS (SELECT tenant, CAST(max(date) AS DATE) AS ref FROM moved GROUP BY tenant),
season AS (SELECT tenant, count(no) > 0 AS busy, coalesce(string_agg(note, '|' ORDER BY no), '') AS notes
  FROM refs LEFT JOIN cal ON ref - 14 <= d2 AND d1 <= ref + 14 GROUP BY tenant),
report AS (SELECT tenant, anomaly_type, severity, entity FROM slow UNION ALL SELECT tenant, anomaly_type, severity, entity FROM churn
  UNION ALL SELECT tenant, 'revenue_drop', CASE WHEN busy THEN 'MEDIUM' ELSE 'HIGH' END, 'global' FROM dropped JOIN season USING (tenant)
  UNION ALL SELECT tenant, 'revenue_anomaly_zscore', 'MEDIUM', CAST(week_end AS VARCHAR) FROM z)""", """
SELECT tenant, anomaly_type, severity, entity, notes FROM report JOIN season USING (tenant)""")

# --- Portfolio ---
UPLOADS = """uploads AS (
  SELECT o_orderkey AS upload_id, o_custkey AS user_id, o_custkey AS client_id,
         'order-' || o_orderkey || '.csv' AS file_name,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'excel' WHEN '5-LOW' THEN 'pdf' ELSE 'csv' END AS file_type,
         CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status,
         CAST(CAST(floor(o_totalprice) AS BIGINT) % 120 AS INT) AS data_health_score, o_orderdate AS created_at
  FROM orders)"""
ANALYSES = f"""analyses AS (
  SELECT o_orderkey + {V.ANALYSIS_ID_BASE} AS analysis_id, o_orderkey AS upload_id, o_custkey AS user_id,
         sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS revenue,
         CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'up'
              WHEN sum(CAST(l_extendedprice AS DECIMAL(12,2))) FILTER (l_returnflag = 'R') * 2
                   > sum(CAST(l_extendedprice AS DECIMAL(12,2))) THEN 'down' ELSE 'flat' END AS trend,
         CAST(count(*) AS INT) AS total, CAST(count(*) FILTER (l_quantity > 40) AS INT) AS high,
         CAST(min(l_shipdate) AS DATE) AS period_start, CAST(max(l_shipdate) AS DATE) AS period_end,
         max(l_shipdate) AS created_at, min(l_partkey) AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey)"""
CLIENTS = """clients AS (
  SELECT c_custkey AS client_id, c_nationkey AS owner_id, c_name AS client_name, c_acctbal > 0 AS active FROM customer),
per_client AS (SELECT client_id, count(*) AS upload_count, max(created_at) AS last_upload_at,
    avg(data_health_score) AS avg_health_score, max(data_health_score) AS latest_health_score,
    arg_max(data_health_score, (created_at, upload_id)) AS last_health_score FROM uploads GROUP BY client_id),
client_stats AS (SELECT c.*, coalesce(upload_count, 0) AS upload_count, p.* EXCLUDE (client_id, upload_count)
  FROM clients c LEFT JOIN per_client p ON p.client_id = c.client_id)"""
add("portfolio_dashboard", f"{UPLOADS}, {CLIENTS}", f"""
SELECT owner_id, count(*) AS total_clients, count(*) FILTER (active) AS active_clients,
       CAST(coalesce(sum(upload_count), 0) AS BIGINT) AS total_uploads,
       count(*) FILTER (last_upload_at < TIMESTAMP '{V.AS_OF}' - INTERVAL 30 DAY OR last_upload_at IS NULL)
         AS clients_at_risk, CAST(round(avg(avg_health_score)) AS INT) AS portfolio_health_score
FROM client_stats GROUP BY owner_id""")
add("recent_alert_clients", f"{UPLOADS}, {ANALYSES}, {CLIENTS}", """
SELECT owner_id, client_id, client_name, high_alerts, period_end,
       row_number() OVER (PARTITION BY owner_id ORDER BY high_alerts DESC, client_id, period_end DESC) AS position
FROM (SELECT DISTINCT owner_id, c.client_id, client_name, high AS high_alerts, period_end
      FROM clients c JOIN uploads u ON u.client_id = c.client_id JOIN analyses a ON a.upload_id = u.upload_id
      WHERE high > 0 AND a.created_at > TIMESTAMP '2001-09-01' - INTERVAL 7 DAY) QUALIFY position <= 5""")
add("client_list", f"{UPLOADS}, {CLIENTS}", """
SELECT client_id, owner_id, client_name, active, upload_count, last_upload_at, latest_health_score, last_health_score,
       row_number() OVER (PARTITION BY owner_id ORDER BY client_name, client_id) AS position
FROM client_stats WHERE active QUALIFY position BETWEEN 6 AND 25""")
add("client_detail", f"{UPLOADS}, {CLIENTS}", """
SELECT client_id, client_name, upload_count, latest_health_score, last_health_score FROM client_stats
WHERE client_id = 7""")
add("upload_counts", UPLOADS, "SELECT user_id, count(*) AS total FROM uploads GROUP BY user_id")
add("upload_history", f"{UPLOADS}, {ANALYSES}", """
SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY u.created_at DESC, u.upload_id DESC) AS position,
       u.upload_id, file_type, status, analysis_id, CAST(revenue AS DOUBLE) AS revenue, trend
FROM uploads u LEFT JOIN analyses a ON a.upload_id = u.upload_id QUALIFY position BETWEEN 2 AND 6""")
add("analysis_history", f"{UPLOADS}, {ANALYSES}", """
SELECT a.user_id, a.analysis_id, a.upload_id, file_name, file_type, data_health_score, a.created_at,
       CAST(revenue AS DOUBLE) AS current_revenue, trend, total AS anomaly_count,
       row_number() OVER (PARTITION BY a.user_id ORDER BY a.created_at DESC, a.analysis_id DESC) AS position
FROM analyses a JOIN uploads u ON u.upload_id = a.upload_id QUALIFY position <= 5""")
add("one_analysis", ANALYSES, "SELECT analysis_id, upload_id, period_start, period_end FROM analyses WHERE upload_id = 3")
add("upload_status", f"{UPLOADS}, {ANALYSES}", """
SELECT u.upload_id, status, data_health_score, analysis_id FROM uploads u
LEFT JOIN analyses a ON a.upload_id = u.upload_id""")
REPORTS = f"""reports AS (
  SELECT o_orderkey AS report_id, o_orderkey + {V.ANALYSIS_ID_BASE} AS analysis_id, o_custkey AS user_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'hi' ELSE 'en' END AS language, o_orderdate AS created_at,
         'Revenue ₹' || format('{{:,}}', CAST(round_even(o_totalprice, 0) AS BIGINT)) AS content
  FROM orders WHERE o_orderstatus = 'F')"""
add("report_list", f"{ANALYSES}, {REPORTS}", """
SELECT r.user_id, row_number() OVER (PARTITION BY r.user_id ORDER BY r.created_at DESC, report_id DESC) AS position,
       report_id, language, period_start, period_end
FROM reports r JOIN analyses a ON a.analysis_id = r.analysis_id QUALIFY position <= 3""")
add("one_report", f"{ANALYSES}, {REPORTS}", """
SELECT r.analysis_id, content FROM reports r JOIN analyses a ON a.analysis_id = r.analysis_id
WHERE report_id % 50 = 7""")
add("analysis_by_any_id", ANALYSES, f"""
SELECT analysis_id, upload_id FROM analyses WHERE analysis_id = {V.ANALYSIS_ID_BASE + 3}
OR upload_id = {V.ANALYSIS_ID_BASE + 3}""")
add("owned_lookups", f"{UPLOADS}, {ANALYSES}, {REPORTS}, {CLIENTS}", f"""
SELECT lookup, 'own' AS asked_by, CAST(id AS BIGINT) AS id FROM (
  SELECT 'report' AS lookup, min(report_id) AS id FROM reports
  UNION ALL SELECT 'analysis', min(report_id) + {V.ANALYSIS_ID_BASE} FROM reports
  UNION ALL SELECT 'by_analysis_id', min(report_id) FROM reports
  UNION ALL SELECT 'by_upload_id', min(report_id) + {V.ANALYSIS_ID_BASE} FROM reports
  UNION ALL SELECT 'client', upload_count FROM client_stats WHERE client_id = (SELECT min(client_id) FROM clients))""")
LATEST = """latest AS (
  SELECT * FROM analyses WHERE created_at > TIMESTAMP '2001-09-01' - INTERVAL 60 DAY
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, analysis_id DESC) = 1)"""
add("latest_analyses", f"{ANALYSES}, {LATEST}", "SELECT user_id, analysis_id, created_at FROM latest")
add("owner_scope", UPLOADS, "SELECT upload_id, user_id, status FROM uploads WHERE user_id = 7")
add("value_checks", UPLOADS, """
SELECT 'file_type' AS column_name, count(*) FILTER (file_type NOT IN ('tally_xml','excel','csv','image')) AS violations
FROM uploads UNION ALL
SELECT 'status', count(*) FILTER (status NOT IN ('pending','processing','done','error')) FROM uploads UNION ALL
SELECT 'data_health_score', count(*) FILTER (data_health_score NOT BETWEEN 0 AND 100) FROM uploads""")

# --- Accounts ---
add("report_recipients", USERS, "SELECT user_id, phone FROM users WHERE opted AND coalesce(phone, '') <> '' AND weekly")
MESSAGES = """messages AS (
  SELECT printf('%08d-%04d', conv_id, turn) AS message_id, conv_id, turn,
         CASE WHEN turn % 3 <> 2 THEN conv_id END AS user_id, '91' || lpad(CAST(conv_id AS VARCHAR), 10, '0') AS phone,
         CASE role WHEN 'user' THEN 'inbound' WHEN 'assistant' THEN 'outbound' ELSE 'internal' END AS direction,
         text FROM conversations)"""
add("last_messages", MESSAGES, """
SELECT conv_id AS contact_id, CAST(count(*) AS INT) AS n,
       string_agg(CASE direction WHEN 'inbound' THEN 'user' ELSE 'assistant' END, '|' ORDER BY turn, message_id) AS roles,
       sha256(string_agg(text, '|' ORDER BY turn, message_id)) AS digest
FROM (SELECT * FROM messages WHERE direction <> 'internal'
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, message_id DESC) <= 4) GROUP BY conv_id""")
add("upserted_users", USERS + """, logins AS (
  SELECT printf('customer#%09d@example.com', s_suppkey * 40) AS email,
         CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' again' ELSE s_name END AS name FROM supplier)""", f"""
SELECT coalesce(u.email, l.email) AS email, coalesce(l.name, u.name) AS name, coalesce(u.user_type, 'ca_firm') AS user_type,
       CASE WHEN l.email IS NOT NULL THEN TIMESTAMP '{V.AS_OF}' END AS updated_at
FROM users u FULL OUTER JOIN logins l ON l.email = u.email""")
add("versioned_accounts", USERS + f""", logins AS (SELECT s_suppkey * 16 AS user_id, s_name AS name FROM supplier),
first AS (SELECT user_id, name, user_type, CAST(NULL AS TIMESTAMP) AS updated_at FROM users),
second AS (SELECT coalesce(u.user_id, l.user_id) AS user_id, coalesce(l.name, u.name) AS name, coalesce(u.user_type, 'ca_firm') AS user_type,
           CASE WHEN l.user_id IS NOT NULL THEN TIMESTAMP '{V.AS_OF}' END AS updated_at FROM users u FULL OUTER JOIN logins l ON l.user_id = u.user_id)""", """
SELECT *, 0 AS version FROM first UNION ALL SELECT *, 1 FROM second
UNION ALL SELECT *, 2 FROM second WHERE user_id NOT IN (SELECT user_id FROM first WHERE user_id % 10 = 3)""")
WAITLIST = """waitlist AS (
  SELECT '+91' || lpad(CAST(c_custkey AS VARCHAR), 10, '9') AS phone, c_name AS name, c_custkey % 4 <> 0 AS approved
  FROM customer WHERE c_custkey % 3 <> 0)"""
add("joined_waitlist", WAITLIST + """, incoming AS (
  SELECT '+91' || lpad(CAST(c_custkey * 2 AS VARCHAR), 10, '9') AS phone, c_name AS name FROM customer
  QUALIFY row_number() OVER (PARTITION BY phone ORDER BY c_custkey) = 1)""", """
SELECT * FROM waitlist UNION ALL
SELECT phone, name, true FROM incoming WHERE phone NOT IN (SELECT phone FROM waitlist)""")
ORACLES["deactivated_clients"] = f"""
SELECT c_custkey AS client_id, c_nationkey AS owner_id, c_name AS client_name,
       CASE WHEN c_custkey % 5 = 0 THEN false ELSE c_acctbal > 0 END AS active,
       CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '{V.AS_OF}' END AS updated_at FROM customer"""
GONE = "(SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0 OR c_custkey = 3)"
add("cascade_delete", f"{UPLOADS}, {ANALYSES}, {REPORTS}, {CLIENTS}, {MESSAGES}", f"""
SELECT 'users' AS table_name, count(*) AS n_rows, count(*) AS n_linked FROM customer WHERE c_custkey NOT IN {GONE}
UNION ALL SELECT 'clients', count(*), count(*) FROM clients WHERE owner_id NOT IN {GONE}
UNION ALL SELECT 'uploads', count(*), count(CASE WHEN client_id NOT IN
  (SELECT client_id FROM clients WHERE owner_id IN {GONE}) THEN client_id END) FROM uploads WHERE user_id NOT IN {GONE}
UNION ALL SELECT 'analyses', count(*), count(*) FROM analyses WHERE user_id NOT IN {GONE}
UNION ALL SELECT 'reports', count(*), count(*) FROM reports WHERE user_id NOT IN {GONE}
UNION ALL SELECT 'messages', count(*), count(CASE WHEN user_id NOT IN {GONE} THEN user_id END) FROM messages""")
add("retained_uploads", UPLOADS, f"""
SELECT upload_id, created_at + INTERVAL 30 DAY AS delete_after FROM uploads
WHERE created_at + INTERVAL 30 DAY > TIMESTAMP '{V.AS_OF}'""")
add("whitelist_gate", f"{USERS}, {WAITLIST}", """
SELECT user_id, coalesce(phone IN (SELECT phone FROM waitlist WHERE approved), false) AS whitelisted FROM users""")

def shown(amount: str) -> str:
    return f"'₹' || format('{{:,}}', CAST(round_even(CAST({amount} AS DOUBLE), 0) AS BIGINT))"


add("chat_summary_parts", f"{revenue_ctes()}, {TOP}, {idle('product')}, dead AS (SELECT *, row_number() OVER (PARTITION BY tenant "
    f"ORDER BY days DESC, product) AS no, count(*) OVER (PARTITION BY tenant) AS n_dead FROM idle WHERE days > 14)", f"""
SELECT r.tenant, strftime(period_start, '%Y-%m-%d') || ' → ' || strftime(period_end, '%Y-%m-%d') AS period,
  {shown('cur')} || ' ' || coalesce('(' || CASE WHEN change_pct >= 0 THEN '+' ELSE '' END || printf('%.1f', change_pct) || '%)', '') || ' '
    || CASE {trend('change_pct')} WHEN 'up' THEN '📈' WHEN 'down' THEN '📉' ELSE '➡️' END AS revenue,
  coalesce(products, '   N/A') AS products, customers, high_alerts, coalesce(dead, '') AS dead_stock
FROM rev2 r LEFT JOIN (
  SELECT tenant, string_agg('   ' || rank || '. ' || product || ' — ' || {shown('revenue')}, chr(10) ORDER BY rank) AS products FROM top GROUP BY tenant) USING (tenant)
LEFT JOIN (SELECT tenant, count(*) FILTER (no <= 5) || ' items):*' || chr(10) || string_agg('   • ' || product, chr(10) ORDER BY no) FILTER (no <= 5)
    || CASE WHEN any_value(n_dead) > 5 THEN chr(10) || '   ...और ' || (any_value(n_dead) - 5) || ' items' ELSE '' END AS dead FROM dead GROUP BY tenant) USING (tenant)
LEFT JOIN (SELECT tenant, count(DISTINCT customer) AS customers FROM ledger GROUP BY tenant) USING (tenant)
LEFT JOIN (WITH {REPORT} SELECT tenant, count(*) FILTER (severity = 'HIGH') AS high_alerts FROM report GROUP BY tenant) USING (tenant)""")
# --- Reports ---


def grouped(whole: str) -> str:
    digits = f"CAST(abs({whole}) AS VARCHAR)"
    head = f"left({digits}, length({digits}) - 3)"
    pairs = f"ltrim(reverse(regexp_replace(reverse({head}), '(..)', '\\1,', 'g')), ',')"
    return f"CASE WHEN length({digits}) > 3 THEN {pairs} || ',' || right({digits}, 3) ELSE {digits} END"


INR = f"'₹' || {grouped('CAST(round(revenue) AS BIGINT)')}"
add("weekly_reports", f"{USERS}, {ANALYSES}, {LATEST}, ready AS (SELECT u.*, l.* EXCLUDE (user_id), {INR} AS inr, "
    "CASE trend WHEN 'up' THEN '12.5%' WHEN 'down' THEN '20.2%' ELSE '0.0%' END AS size FROM users u "
    "JOIN latest l ON l.user_id = u.user_id WHERE opted AND coalesce(phone, '') <> '' AND weekly)", """
SELECT analysis_id, user_id, 'weekly' AS report_type, lang AS language, phone,
  CASE WHEN lang = 'hi' THEN 'नमस्ते ' || name || E' जी! 🙏\\n\\nइस हफ्ते की रिपोर्ट:\\n• Revenue: ' || inr || ' (' || size || ' '
    || CASE trend WHEN 'up' THEN 'बढ़ी है 📈' WHEN 'down' THEN 'घटी है ⚠️' ELSE 'स्थिर है' END
    || E')\\n• सबसे अच्छा product: Part ' || part || E'\\n\\n3 काम करें:\\n1. अपने top customers को call करें\\n'
    || E'2. Dead stock को check करें\\n3. इस हफ्ते का target set करें\\n\\n— आपका digital सलाहकार'
    WHEN lang = 'hinglish' THEN en END AS content_hindi,
  CASE WHEN lang = 'en' THEN en END AS content_english
FROM (SELECT *, 'Hello ' || name || E'!\\n\\nThis week''s summary:\\n• Revenue: ' || inr || ' (' || size || ' '
    || CASE trend WHEN 'up' THEN 'up 📈' WHEN 'down' THEN 'down ⚠️' ELSE 'stable' END
    || E')\\n• Best product: Part ' || part || E'\\n\\n3 actions for this week:\\n1. Call your top customers\\n'
    || E'2. Review dead stock items\\n3. Set a revenue target for next week\\n\\n— Your Digital Business Advisor' AS en
  FROM ready)""")
ORACLES["amount_audit"] = """
SELECT o_orderkey, o_orderkey % 2 = 0 AND length(CAST(CAST(round_even(o_totalprice, 0) AS BIGINT) AS VARCHAR)) >= 1 AS warn,
       CASE WHEN o_orderkey % 2 = 0 THEN '₹' || format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) ELSE '' END
       AS amounts FROM orders"""
add("whole_analysis", f"{LEDGER}, {bounds()}, sold AS (SELECT tenant, count(*) AS n FROM ledger GROUP BY tenant)", """
SELECT tenant, 'ledger' AS table_name, n AS n_rows FROM sold
UNION ALL SELECT tenant, 'revenue', 1 FROM sold UNION ALL SELECT tenant, 'customer_split', 1 FROM sold
UNION ALL SELECT tenant, 'bundle', 1 FROM sold
UNION ALL SELECT tenant, 'segments', count(DISTINCT customer) FROM ledger GROUP BY tenant""")

# --- Sources ---
TYPED = """typed AS (
  SELECT tenant, row_id, voucher_id, date, quantity, amount,
         CASE WHEN voucher_id % 9 = 0 THEN 'Walk-in Customer' ELSE customer END AS customer,
         CASE WHEN voucher_id % 7 = 0 THEN 'General' ELSE product END AS product FROM ledger)"""
add("csv_ledger", f"{LEDGER}, {TYPED}", """
SELECT tenant, customer, count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS amount, sum(quantity) AS quantity,
       min(date) AS first_date, count(*) FILTER (product = 'General') AS n_general
FROM typed WHERE quantity <> 1 AND amount <> 0 GROUP BY tenant, customer""")
ORACLES["csv_quoted"] = """
SELECT 'Ram "R", Sons ' || doc_id AS customer, md5('say "' || text || '",' || chr(10) || 'end') AS product_md5,
       CAST(n_chars AS DOUBLE) AS amount, TIMESTAMP '2026-01-02 10:00:00' AS date FROM documents"""
ORACLES["csv_mixed_headers"] = """
SELECT 'C' || o_custkey AS customer, o_orderpriority AS product, count(*) AS n_rows,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, min(date_trunc('day', o_orderdate)) AS first_date
FROM orders GROUP BY ALL"""
ORACLES["csv_column_override"] = """
SELECT 'C' || o_custkey AS customer, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) * 2) AS DOUBLE) AS net,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) * 2) AS DOUBLE) AS computed FROM orders GROUP BY ALL"""
ORACLES["registered_tables"] = """
SELECT n_name, count(*) AS clients FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
ORACLES["csv_bad_cells"] = """
SELECT 'shop' AS tenant, count(*) AS rows_read, count(*) FILTER (o_orderkey % 7 = 0) AS failed_dates, 0 AS zero_amounts,
       count(*) FILTER (o_orderkey % 5 = 0) AS bad_amounts, count(*) FILTER (o_orderkey % 11 = 0) AS malformed_rows,
       count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0) AS rows_dropped, true AS good_result, true AS good_columns
FROM orders"""
ORACLES["xml_company"] = """
SELECT CASE WHEN c_nationkey % 3 < 2 THEN 'Firm ' || c_nationkey ELSE 'c_nationkey=' || c_nationkey END AS company,
       'Goods' AS product, count(*) AS n_rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
add("outlier_weeks_by_median", f"""{LEDGER}, {weekly('ledger')},
far AS (SELECT *, abs(revenue - quantile_cont(revenue, 0.5) OVER t) AS gap, count(*) OVER t AS n FROM weekly WINDOW t AS (PARTITION BY tenant)),
scaled AS (SELECT *, 1.4826 * quantile_cont(gap, 0.5) OVER (PARTITION BY tenant) AS scale FROM far),
scored AS (SELECT *, CASE WHEN gap = 0 THEN 0.0 ELSE -gap / (gap + scale) END AS score FROM scaled),
cut AS (SELECT *, quantile_cont(score, 0.1) OVER (PARTITION BY tenant) AS low FROM scored)""", """
SELECT tenant, week_end, revenue, round(score, 6) AS anomaly_score FROM cut WHERE n >= 4 AND score < low""")
add("csv_ingest_stats", LEDGER, """
SELECT tenant, count(*) AS rows_read, 0 AS failed_dates, count(*) FILTER (quantity = 1 OR amount = 0) AS zero_amounts,
       count(*) FILTER (quantity = 1 OR amount = 0) AS rows_dropped,
       min(date) FILTER (quantity <> 1 AND amount <> 0) AS first_date,
       max(date) FILTER (quantity <> 1 AND amount <> 0) AS last_date FROM ledger GROUP BY tenant""")
VOUCHERS = """vouchers AS (
  SELECT tenant, voucher_id, date, customer, abs(sum(amount)) AS total FROM ledger GROUP BY ALL),
lines AS (
  SELECT tenant, voucher_id, date, CASE WHEN voucher_id % 9 <> 0 THEN customer ELSE 'Walk-in Customer' END AS customer,
         amount FROM ledger WHERE voucher_id % 13 <> 0 AND voucher_id % 11 <> 0
  UNION ALL SELECT tenant, voucher_id, date, 'Walk-in Customer', -total_signed FROM (
    SELECT tenant, voucher_id, date, sum(amount) AS total_signed FROM ledger GROUP BY ALL)
    WHERE voucher_id % 13 <> 0 AND voucher_id % 11 <> 0 AND voucher_id % 9 = 0
  UNION ALL SELECT tenant, voucher_id, date, CASE WHEN voucher_id % 9 <> 0 THEN customer ELSE 'Walk-in Customer' END, total
    FROM vouchers WHERE voucher_id % 13 = 0 AND voucher_id % 11 <> 0)"""
add("xml_ledger", f"{LEDGER}, {VOUCHERS}", """
SELECT tenant, customer, count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS amount, min(date) AS first_date,
       count(DISTINCT voucher_id) AS n_vouchers FROM lines WHERE amount <> 0 GROUP BY tenant, customer""")
add("xml_ingest_stats", f"{LEDGER}, {VOUCHERS}", """
SELECT v.tenant, count(*) AS vouchers_found, count(*) FILTER (voucher_id % 11 = 0) AS skipped_non_sales,
       any_value(sales_extracted) AS sales_extracted, any_value(skipped_zero) AS skipped_zero,
       0 AS unreadable, 0 AS bad_amounts, 0 AS bad_dates
FROM vouchers v JOIN (SELECT tenant, count(DISTINCT voucher_id) FILTER (amount <> 0) AS sales_extracted,
    count(*) FILTER (amount = 0) AS skipped_zero FROM lines GROUP BY tenant) l ON l.tenant = v.tenant
GROUP BY v.tenant""")
NESTED = """WITH rows AS (
  SELECT l_orderkey % 3 AS kind, l_linenumber AS number, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, date_trunc('day', l_shipdate) AS date,
         l_linenumber <> 7 AS readable, l_orderkey % 29 <> 0 AS dated FROM lineitem)"""
ORACLES["xml_nested"] = f"""{NESTED}
SELECT product, count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS amount, min(date) AS first_date, max(date) AS last_date FROM (
  SELECT 'Salt & Rock' AS product, price AS amount, date, readable, dated FROM rows WHERE kind = 0
  UNION ALL SELECT 'Soap & Oil', price, date, readable, dated FROM rows WHERE kind = 1
  UNION ALL SELECT 'Tax & <Duty>', number, date, readable, dated FROM rows WHERE kind = 1
  UNION ALL SELECT 'General Sales', 5, date, readable, dated FROM rows WHERE kind = 2
) WHERE readable AND dated AND amount <> 0 GROUP BY product"""
ORACLES["xml_nested_stats"] = f"""{NESTED}
SELECT count(*) AS vouchers_found, 0 AS skipped_non_sales, count(*) FILTER (readable AND dated) AS sales_extracted, 0 AS skipped_zero,
       count(*) FILTER (NOT readable) AS unreadable, 0 AS bad_amounts,
       sum(CASE WHEN dated OR NOT readable THEN 0 WHEN kind = 1 THEN 2 ELSE 1 END) AS bad_dates FROM rows"""
ORACLES["file_types"] = """
WITH files AS (SELECT page_id, html AS text, url AS name FROM pages
  UNION ALL SELECT -1 - doc_id, text, 'upload.' || lang FROM documents),
bytes AS (SELECT *, hex(encode(text)) AS h, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext FROM files)
SELECT page_id, CASE WHEN h LIKE 'FFD8FF%' OR h LIKE '89504E47%' THEN 'image'
  WHEN left(text, 5) IN ('<?xml', '<ENVE', '<TALL') THEN 'tally_xml' WHEN left(text, 4) = E'PK\\x03\\x04' THEN 'excel'
  WHEN contains(left(h, 4000), hex('<ENVELOPE')) OR contains(left(h, 4000), hex('<TALLYMESSAGE')) THEN 'tally_xml'
  WHEN ext = 'xml' THEN 'tally_xml' WHEN ext IN ('xlsx', 'xls') THEN 'excel' WHEN ext = 'csv' THEN 'csv'
  WHEN len(list_filter(regexp_extract_all(left(h, 2000), '..'), lambda b: b = '2C')) > 3
    OR len(list_filter(regexp_extract_all(left(h, 2000), '..'), lambda b: b = '09')) > 3 THEN 'csv'
  ELSE 'unknown' END AS type FROM bytes"""

# --- Scalar functions ---
ORACLES["date_parsing"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 16 = 7 THEN NULL
  WHEN o_orderkey % 16 = 6 AND day(o_orderdate) <= 12
    THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))
  ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders"""
ORACLES["amount_expressions"] = """
SELECT printf('%012d-%d-%010d-%08d-%s', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                strftime(l_shipdate, '%Y%m%d')) AS row_id,
       CAST((CAST(l_quantity AS INT) + l_linenumber) * CAST(l_discount AS DECIMAL(4,2)) AS DOUBLE) AS left_to_right,
       CAST(CAST(l_quantity AS INT) - l_linenumber AS DOUBLE) AS credit_less_debit,
       CAST(CAST(l_quantity AS INT) * CAST(l_discount AS DECIMAL(4,2)) AS DOUBLE) AS qty_times_price,
       CAST(0 AS DOUBLE) AS by_zero FROM lineitem"""
ORACLES["rupee_texts"] = f"""
WITH scaled AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2))
  * (CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 100 WHEN 2 THEN -10 ELSE 0 END) AS v FROM orders),
whole AS (SELECT o_orderkey, v, CAST(round(v) AS BIGINT) AS w, CAST(floor(abs(v)) AS DOUBLE) AS c FROM scaled)
SELECT o_orderkey, (CASE WHEN w < 0 THEN '−' ELSE '' END) || '₹' || ({grouped('w')}) AS "full",
  CASE WHEN c >= 1e7 THEN '₹' || printf('%.1f', c / 1e7 + (CASE WHEN c / 1e7 * 4 = floor(c / 1e7 * 4) THEN 0.001 ELSE 0 END)) || ' Cr' WHEN c >= 1e5 THEN '₹' || printf('%.1f', c / 1e5 + (CASE WHEN c / 1e5 * 4 = floor(c / 1e5 * 4) THEN 0.001 ELSE 0 END)) || ' L'
       WHEN c >= 1e3 THEN '₹' || printf('%.1f', c / 1e3 + (CASE WHEN c / 1e3 * 4 = floor(c / 1e3 * 4) THEN 0.001 ELSE 0 END)) || ' K' ELSE '₹' || ({grouped('CAST(c AS BIGINT)')}) END AS compact
FROM whole"""
ORACLES["trend_texts"] = f"""
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 10 = 1 THEN NULL
    ELSE CAST(o_orderkey % 200 - 100 AS DOUBLE) / 4 END AS pct,
  date_diff('day', o_orderdate, TIMESTAMP '{V.AS_OF}') AS days FROM orders)
SELECT o_orderkey, CASE WHEN pct IS NULL THEN '—' WHEN pct > 0 THEN '+' || t || '%' WHEN pct < 0 THEN '-' || t || '%'
  ELSE '0%' END AS trend_text, CASE WHEN days >= 1 THEN days || 'd ago' ELSE 'just now' END AS age
FROM (SELECT *, printf('%.1f', round(abs(CAST(pct AS DECIMAL(18,4))), 1)) AS t FROM p)"""
ORACLES["phone_checks"] = r"""
WITH p AS (SELECT c_custkey, regexp_replace(
    CASE WHEN c_custkey % 2 = 0 THEN '91(98)' ELSE '+44' END || lpad(CAST(c_custkey AS VARCHAR), 8, '7')
    || CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '' END, '[()]', '', 'g') AS d FROM customer),
q AS (SELECT c_custkey, CASE WHEN d LIKE '+%' THEN d ELSE '+' || d END AS phone FROM p)
SELECT c_custkey, phone, CASE WHEN phone LIKE '+91%' THEN regexp_full_match(phone, '\+91\d{10}')
  ELSE regexp_full_match(phone, '\+\d{10,15}') END AS phone_valid, left(sha256(phone), 12) AS digest FROM q"""
ORACLES["printable_names"] = r"""
SELECT doc_id, trim(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g')) AS safe FROM documents"""
ORACLES["json_paths"] = """
SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) AS k, CAST(NULL AS VARCHAR) AS missing
FROM events"""


# --- Messages ---
def any_of(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(t, {quoted(w)})" for w in words) + ")"


INTENT = "CASE" + "".join(f" WHEN {any_of(w)} THEN '{n}'" for n, w in INTENT_TOKENS) + " ELSE 'ai_generated' END"
add("message_intents", MESSAGES, f"""
SELECT message_id, left(sha256(phone), 12) AS phone_hash, direction,
       CASE WHEN direction = 'inbound' THEN {INTENT} END AS intent_detected, length(trim(text)) AS n_chars
FROM (SELECT *, lower(trim(text)) AS t FROM messages) WHERE t <> ''""")
add("message_routes", MESSAGES, f"""
SELECT message_id, CASE WHEN t IN ({', '.join(quoted(g) for g in GREETINGS)}) THEN 'help'
  WHEN length(text) % 2 <> 0 THEN 'not_whitelisted' WHEN {any_of(UPLOAD_WORDS)} THEN 'upload_link'
  ELSE 'ai_generated' END AS route
FROM (SELECT *, lower(trim(text)) AS t FROM messages) WHERE direction = 'inbound'""")
ORACLES["messages_without_retries"] = "SELECT CAST(event_id AS VARCHAR) AS message_id, event_type FROM events"
add("arriving_files", revenue_ctes().replace(
    "p_name\n  FROM", "p_name\n  FROM").replace("ledger AS (", "whole AS (", 1).replace(
    "JOIN part ON l_partkey = p_partkey)",
    "JOIN part ON l_partkey = p_partkey), ledger AS (SELECT * FROM whole WHERE quantity <> 1 AND amount <> 0)", 1),
    f"""SELECT tenant, CAST(cur AS DOUBLE) AS current_revenue, CAST(prev AS DOUBLE) AS previous_revenue, change_pct,
  {trend('change_pct')} AS trend FROM rev2""")
TYPED_ONLY = revenue_ctes().replace("ledger AS (", "whole AS (", 1).replace(
    "JOIN part ON l_partkey = p_partkey)", f"""JOIN part ON l_partkey = p_partkey),
ledger AS (SELECT * REPLACE (CASE WHEN voucher_id % 7 = 0 THEN 'General' ELSE product END AS product) FROM whole WHERE quantity <> 1 AND amount <> 0)""", 1)
add("arriving_rows", f"{TYPED_ONLY}, {TOP}", f"""
SELECT r.tenant, CAST(cur AS DOUBLE) AS current_revenue, CAST(prev AS DOUBLE) AS previous_revenue, r.change_pct,
       {trend('r.change_pct')} AS trend, product AS best, CAST(revenue AS DOUBLE) AS best_revenue
FROM rev2 r LEFT JOIN top t ON t.tenant = r.tenant AND rank = 1""")
add("arriving_vouchers", f"{LEDGER}, {VOUCHERS}, sold AS (SELECT * FROM lines WHERE amount <> 0), {bounds('sold')}, " + revenue_ctes().split(
    f"{bounds()}, ", 1)[1].replace("ledger l", "sold l"), f"""
SELECT tenant, CAST(cur AS DOUBLE) AS current_revenue, CAST(prev AS DOUBLE) AS previous_revenue, change_pct,
       {trend('change_pct')} AS trend, n_days, period_end FROM rev2""")
