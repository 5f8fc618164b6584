"""Named queries over the given tables, one or more per operator. Money leaves as double, moments as they are."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import testviews as V
from ledgerloom.fixed_values import SEVERITIES
from ledgerloom.functions import amounts, dates, text
from ledgerloom.ledger import conform, read_table, row_key, staged_ledger
from ledgerloom.operators import accounts, anomalies, calendar, cleaning, health, metrics, periods, portfolio
from ledgerloom.operators import name_words
from ledgerloom.operators import product_names as names
from ledgerloom.operators import reports, segments
from ledgerloom.operators.outliers import outlier_weeks
from ledgerloom.plans.analyze import analyze
from ledgerloom.plans.joins import top_per_group
from ledgerloom.plans.shared import SMALL_FILES, already_staged, new_folder, over_all_cores, removing_shuffles, staged
from ledgerloom.sources import catalog, delimited, tables, versions, voucher_xml
from ledgerloom.streaming import arrivals, incremental
from ledgerloom.streaming import messages as inbox

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles."""
    return df.select(*[
        F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes
    ])


def wide_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with amounts multiplied by quantity: a long tail with large and extreme amounts."""
    product = F.col("amount") * F.col("quantity").cast("decimal(6,0)")
    return conform(staged_ledger(spark, sf_dir).withColumn("amount", product))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned wide ledger: written once, since several queries read it."""
    ready = already_staged(spark, "flagged", sf_dir)
    if ready is not None:
        return ready
    return staged(cleaning.normalise(wide_amounts(spark, sf_dir), V.AS_OF_FLAGS), "flagged", sf_dir, SMALL_FILES)


def found_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = already_staged(spark, "found", sf_dir)
    if ready is not None:
        return ready
    found = anomalies.detect(wide_amounts(spark, sf_dir), calendar.seasonal_calendar(spark))
    return staged(found, "found", sf_dir)


def rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = already_staged(spark, "rfm", sf_dir)
    return ready if ready is not None else staged(
        segments.customer_segments(staged_ledger(spark, sf_dir)), "rfm", sf_dir
    )


# --- KPIs -----------------------------------------------------------------------------------------------------------


@query
def period_bounds(spark, sf_dir):
    stats = periods.tenant_stats(staged_ledger(spark, sf_dir))
    both = periods.period_bounds(stats).withColumn("variant", F.lit("all rows")).unionByName(
        periods.period_bounds(stats, sales_span=True).withColumn("variant", F.lit("sales"))
    )
    return both


@query
def revenue(spark, sf_dir):
    return plain(metrics.revenue(staged_ledger(spark, sf_dir)))


@query
def revenue_at_date(spark, sf_dir):
    return plain(metrics.revenue(staged_ledger(spark, sf_dir), reference_date="2000-06-30"))


@query
def top_products(spark, sf_dir):
    return plain(metrics.top_products(staged_ledger(spark, sf_dir)))


@query
def dead_stock(spark, sf_dir):
    return plain(metrics.dead_stock(staged_ledger(spark, sf_dir)))


@query
def customer_split(spark, sf_dir):
    return plain(metrics.customer_split(staged_ledger(spark, sf_dir)))


@query
def daily_revenue(spark, sf_dir):
    return plain(metrics.daily_revenue(staged_ledger(spark, sf_dir)))


@query
def chart_revenue(spark, sf_dir):
    return plain(metrics.chart_revenue(staged_ledger(spark, sf_dir)))


@query
def insights(spark, sf_dir):
    ledger = staged_ledger(spark, sf_dir)
    stats = periods.tenant_stats(ledger)
    made = metrics.insights(
        metrics.revenue(ledger, stats=stats), metrics.dead_stock(ledger, stats=stats),
        metrics.top_products(ledger, stats=stats),
    )
    return made.select("tenant", "type", "title", "priority")


@query
def metrics_summary(spark, sf_dir):
    made = metrics.summary(metrics.kpis(staged_ledger(spark, sf_dir)))
    number = lambda path: text.json_number(F.col("metrics_json"), path)
    return made.select(
        "tenant", number("$.current_revenue").alias("current_revenue"),
        F.get_json_object("metrics_json", "$.trend").alias("trend"),
        F.get_json_object("metrics_json", "$.top_products[0].name").alias("best"),
        number("$.dead_stock_count").alias("dead_stock_count"),
        number("$.customer_split.repeat").alias("repeat_customers"),
    )


# --- Cleaning and health --------------------------------------------------------------------------------------------


@query
def row_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("tenant", "row_id", *cleaning.FLAGS)


@query
def duplicate_flags(spark, sf_dir):
    marked = cleaning.flag_duplicates(staged_ledger(spark, sf_dir), ("customer", "product"))
    return marked.select("tenant", "row_id", "flag_duplicate")


@query
def flag_summary(spark, sf_dir):
    return cleaning.flag_summary(flagged(spark, sf_dir))


@query
def name_normalisation(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(
        F.lit("t").alias("tenant"), F.col("doc_id").cast("string").alias("row_id"),
        F.concat(F.lit("  o'BRIEN-"), "source", F.lit("   3m  "), F.col("doc_id").cast("string")).alias("customer"),
        F.col("text").alias("product"),
    )
    return cleaning.normalise_names(docs).select("row_id", "customer", F.sha2("product", 256).alias("product_digest"))


@query
def health_scores(spark, sf_dir):
    report = health.health(flagged(spark, sf_dir))
    return report.withColumns({c: F.array_join(c, "|") for c in ("issues", "suggestions")})


@query
def health_copies(spark, sf_dir):
    """Health of the ledger with every third order entered twice."""
    ledger = staged_ledger(spark, sf_dir)
    copies = ledger.filter(F.col("voucher_id").cast("long") % 3 == 0).withColumn(
        "row_id", F.concat("row_id", F.lit("-copy"))
    )
    marked = cleaning.flag_duplicates(ledger.unionByName(copies)).withColumns(
        {"flag_future_date": F.lit(False), "flag_extreme_amount": F.lit(False)}
    )
    return health.health(marked).select(
        "tenant", "score", "uniqueness_score", "total_rows", "usable_rows", "grade", "can_analyze"
    )


@query
def analysis_gate(spark, sf_dir):
    ledger = flagged(spark, sf_dir)
    return health.analysable(ledger, health.health(ledger)).groupBy("tenant").agg(F.count("*").alias("n_rows"))


@query
def similar_names(spark, sf_dir):
    counts = names.name_counts(staged_ledger(spark, sf_dir)).filter("n >= 2")
    return names.similar_pairs(counts).withColumn("similarity", F.round("similarity", 6))


@query
def canonical_names(spark, sf_dir):
    spelled = staged_ledger(spark, sf_dir).withColumn("product", F.regexp_replace("product", r"^Brand#\d+ ", ""))
    return names.canonical_names(names.name_counts(spelled))


@query
def merged_products(spark, sf_dir):
    spelled = staged_ledger(spark, sf_dir).withColumn("product", F.regexp_replace("product", r"^Brand#\d+ ", ""))
    merged, _ = names.merge_product_names(spelled)
    return plain(merged.groupBy("tenant", "product").agg(
        F.count("*").alias("n_rows"), F.sum("amount").alias("amount")
    ))


@query
def products_by_words(spark, sf_dir):
    """Names written in other orders, spacings and with additions are one product."""
    name, key = F.regexp_replace("product", r"^Brand#\d+ ", ""), F.col("voucher_id").cast("long")
    turned = F.array_join(F.reverse(F.split(name, " ")), " ")
    spelled = F.when(key % 4 == 0, F.upper(turned)).when(key % 4 == 1, F.concat(name, F.lit(" 1kg"))).when(
        key % 4 == 2, F.concat(F.lit("1 KG, "), turned)).otherwise(name)
    merged, mapping = name_words.merge_by_words(staged_ledger(spark, sf_dir).withColumn("product", spelled))
    groups = mapping.groupBy("tenant", "canonical").agg(F.count("*").alias("n_names"))
    sums = merged.groupBy("tenant", F.col("product").alias("canonical")).agg(F.sum("amount").alias("amount"))
    return plain(groups.join(sums, ["tenant", "canonical"]))


@query
def sampled_ledger(spark, sf_dir):
    sampled = cleaning.sample_ledger(staged_ledger(spark, sf_dir), 0.25)
    return plain(sampled.groupBy("tenant").agg(F.count("*").alias("n_rows"), F.sum("amount").alias("amount")))


# --- Anomalies ------------------------------------------------------------------------------------------------------

ANOMALY_COLUMNS = ("tenant", "anomaly_type", "severity", "confidence", "entity", "title")


def short(found: DataFrame) -> DataFrame:
    return found.select(*ANOMALY_COLUMNS).withColumn("confidence", F.round("confidence", 6))


@query
def slow_moving_stock(spark, sf_dir):
    return short(anomalies.slow_moving_stock(staged_ledger(spark, sf_dir)))


@query
def churn_risk(spark, sf_dir):
    return short(anomalies.churn_risk(staged_ledger(spark, sf_dir)))


@query
def large_transactions(spark, sf_dir):
    rows = anomalies.large_transactions(wide_amounts(spark, sf_dir))
    return plain(rows.select("tenant", "row_id", "customer", "amount"))


@query
def first_large_transactions(spark, sf_dir):
    found = anomalies.first_large_transactions(wide_amounts(spark, sf_dir))
    return found.select("tenant", "entity", F.col("metadata")["date"].alias("day"), "severity", "confidence")


@query
def revenue_drop(spark, sf_dir):
    found = anomalies.revenue_drop(staged_ledger(spark, sf_dir))
    pct = F.col("metadata")["drop_pct"].cast("double")
    return found.select("tenant", "severity", "confidence", "entity", F.round(pct, 4).alias("drop_pct"))


@query
def weekly_revenue(spark, sf_dir):
    return anomalies.weekly_revenue(staged_ledger(spark, sf_dir))


@query
def zscore_weeks(spark, sf_dir):
    found = anomalies.zscore_weeks(anomalies.weekly_revenue(wide_amounts(spark, sf_dir)))
    return found.select("tenant", "week_end", "revenue", F.round("zscore", 6).alias("zscore"))


@query
def outlier_weeks_by_median(spark, sf_dir):
    found = outlier_weeks(anomalies.weekly_revenue(staged_ledger(spark, sf_dir)))
    return found.withColumn("anomaly_score", F.round("anomaly_score", 6))


@query
def anomaly_report(spark, sf_dir):
    """All anomalies but the outlier weeks, which outlier_weeks_by_median compares."""
    found = found_anomalies(spark, sf_dir).filter(F.col("anomaly_type") != "revenue_anomaly_ml")
    return found.select(
        "tenant", "anomaly_type", "severity", F.round("confidence", 6).alias("confidence"), "entity"
    )


@query
def anomalies_in_season(spark, sf_dir):
    """The ledger moved into the years of the calendar, so that tenants' last days fall into a season."""
    moved = wide_amounts(spark, sf_dir).withColumn("date", F.col("date") + F.make_ym_interval(F.lit(24)))
    found = anomalies.detect(staged(moved, "moved", sf_dir), calendar.seasonal_calendar(spark))
    return found.filter(~F.col("anomaly_type").isin("revenue_anomaly_ml", "large_transaction")).select(
        "tenant", "anomaly_type", "severity", "entity", F.array_join("context_notes", "|").alias("notes")
    )


@query
def top_anomalies(spark, sf_dir):
    ranked = anomalies.top_anomalies(found_anomalies(spark, sf_dir))
    return ranked.select("tenant", "rank", "anomaly_type", "severity", "entity")


@query
def severity_counts(spark, sf_dir):
    found = found_anomalies(spark, sf_dir).filter(F.col("anomaly_type") != "revenue_anomaly_ml")
    return anomalies.severity_counts(found)


@query
def high_anomalies(spark, sf_dir):
    high = anomalies.with_severity(found_anomalies(spark, sf_dir), SEVERITIES[0])
    return high.groupBy("tenant", "anomaly_type").agg(F.count("*").alias("n"))


@query
def high_alerts(spark, sf_dir):
    return anomalies.alerts(found_anomalies(spark, sf_dir), V.users(spark, sf_dir)).select(
        "user_id", "tenant", "anomaly_type", "title"
    )


# --- Segments -------------------------------------------------------------------------------------------------------


@query
def rfm_segments(spark, sf_dir):
    return rfm(spark, sf_dir)


@query
def rfm_by_firm(spark, sf_dir):
    """Segments of tenants with few distinct values: the ledger by order priority and nation."""
    events = read_table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit("-"), (F.col("user_id") % 40).cast("string")).alias("tenant"),
        F.col("event_id").cast("string").alias("row_id"), F.date_trunc("month", "ts").cast("timestamp_ntz").alias("date"),
        F.col("user_id").cast("string").alias("customer"), F.col("value").cast("decimal(18,2)").alias("amount"),
    )
    return segments.customer_segments(conform(events)).drop("description", "action")


@query
def segment_counts(spark, sf_dir):
    return segments.segment_counts(rfm(spark, sf_dir))


@query
def top_customers(spark, sf_dir):
    return segments.top_customers(rfm(spark, sf_dir)).select("tenant", "rank", "customer", "segment", "rfm_score")


@query
def champions(spark, sf_dir):
    return segments.in_segment(rfm(spark, sf_dir), "CHAMPION").select("tenant", "customer", "rfm_score")


# --- Calendar -------------------------------------------------------------------------------------------------------


def order_spans(spark, sf_dir) -> DataFrame:
    """A week around every order, moved into the years the calendar covers."""
    day = F.to_date(F.add_months(F.to_date("o_orderdate"), 288))
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tenant"), F.date_sub(day, 3).alias("start"), F.date_add(day, 3).alias("end"),
        day.alias("ref"),
    )


@query
def seasonal_events(spark, sf_dir):
    hits = calendar.overlapping_events(order_spans(spark, sf_dir), calendar.seasonal_calendar(spark))
    return hits.select("tenant", "event_no", "name", "impact")


@query
def seasonal_context(spark, sf_dir):
    context = calendar.seasonal_context(order_spans(spark, sf_dir), calendar.seasonal_calendar(spark))
    return context.withColumns({c: F.array_join(c, "|") for c in ("events", "notes")})


@query
def seasonal_context_for_industry(spark, sf_dir):
    context = calendar.seasonal_context(order_spans(spark, sf_dir), calendar.seasonal_calendar(spark), "Clothing")
    return context.select("tenant", "in_season", "severity_modifier", F.array_join("events", "|").alias("events"))


@query
def season_around_orders(spark, sf_dir):
    around = calendar.season_around(order_spans(spark, sf_dir), calendar.seasonal_calendar(spark))
    return around.select("tenant", "in_season", F.size("events").alias("n_events"))


# --- Portfolio ------------------------------------------------------------------------------------------------------


@query
def portfolio_dashboard(spark, sf_dir):
    return portfolio.dashboard(V.clients(spark, sf_dir), V.uploads(spark, sf_dir), V.AS_OF)


@query
def recent_alert_clients(spark, sf_dir):
    return portfolio.recent_alerts(
        V.clients(spark, sf_dir), V.uploads(spark, sf_dir), V.analyses(spark, sf_dir), "2001-09-01"
    )


@query
def client_list(spark, sf_dir):
    made = portfolio.client_list(V.clients(spark, sf_dir), V.uploads(spark, sf_dir), limit=20, offset=5)
    return made.drop("updated_at", "avg_health_score")


@query
def client_detail(spark, sf_dir):
    made = portfolio.client_detail(
        V.clients(spark, sf_dir).withColumn("owner_id", F.lit(0)), V.uploads(spark, sf_dir), 0, 7
    )
    return made.select("client_id", "client_name", "upload_count", "latest_health_score", "last_health_score")


@query
def upload_counts(spark, sf_dir):
    return portfolio.row_counts(V.uploads(spark, sf_dir), "user_id")


@query
def upload_history(spark, sf_dir):
    made = portfolio.upload_history(V.uploads(spark, sf_dir), V.analyses(spark, sf_dir), limit=5, offset=1)
    return made.select("client_id", "position", "upload_id", "file_type", "status", "analysis_id", "revenue", "trend")


@query
def analysis_history(spark, sf_dir):
    return plain(portfolio.analysis_history(V.analyses(spark, sf_dir), V.uploads(spark, sf_dir), limit=5)).drop(
        "period_start", "period_end"
    )


@query
def one_analysis(spark, sf_dir):
    made = portfolio.fetch_analysis(
        V.analyses(spark, sf_dir).withColumn("user_id", F.lit(1)), V.uploads(spark, sf_dir), 3, 1
    )
    return made.select("analysis_id", "upload_id", "period_start", "period_end")


@query
def upload_status(spark, sf_dir):
    return portfolio.upload_status(V.uploads(spark, sf_dir), V.analyses(spark, sf_dir)).select(
        "upload_id", "status", "data_health_score", "analysis_id"
    )


@query
def report_list(spark, sf_dir):
    made = portfolio.report_list(V.reports(spark, sf_dir), V.analyses(spark, sf_dir), limit=3)
    return made.select("user_id", "position", "report_id", "language", "period_start", "period_end")


@query
def one_report(spark, sf_dir):
    made = portfolio.fetch_report(
        V.reports(spark, sf_dir).withColumn("user_id", F.lit(1)).withColumn("report_id", F.col("report_id") % 50),
        V.analyses(spark, sf_dir), 7, 1,
    )
    return made.select("analysis_id", "content")


@query
def analysis_by_any_id(spark, sf_dir):
    made = portfolio.analysis_by_any_id(
        V.analyses(spark, sf_dir).withColumn("user_id", F.lit(1)), V.uploads(spark, sf_dir),
        V.ANALYSIS_ID_BASE + 3, 1,
    )
    return made.select("analysis_id", "upload_id")


@query
def owned_lookups(spark, sf_dir):
    """The first stored report, its analysis by every id, and a client, each asked for by its owner and by somebody else, who gets nothing."""
    analyses, uploads, reports, clients = (t(spark, sf_dir) for t in (V.analyses, V.uploads, V.reports, V.clients))
    report = reports.orderBy("report_id").select("report_id", "analysis_id", "user_id").first()
    client = clients.orderBy("client_id").select("client_id", "owner_id").first()
    upload = report["analysis_id"] - V.ANALYSIS_ID_BASE
    found = None
    for owner, shift in (("own", 0), ("alien", 1)):
        user = report["user_id"] + shift
        answers = {
            "report": portfolio.fetch_report(reports, analyses, report["report_id"], user).select(F.col("report_id").alias("id")),
            "analysis": portfolio.fetch_analysis(analyses, uploads, upload, user).select(F.col("analysis_id").alias("id")),
            "by_analysis_id": portfolio.analysis_by_any_id(analyses, uploads, report["analysis_id"], user).select(F.col("upload_id").alias("id")),
            "by_upload_id": portfolio.analysis_by_any_id(analyses, uploads, upload, user).select(F.col("analysis_id").alias("id")),
            "client": portfolio.client_detail(clients, uploads, client["owner_id"] + shift, client["client_id"]).select(F.col("upload_count").alias("id")),
        }
        for name, answer in answers.items():
            rows = answer.select(F.lit(name).alias("lookup"), F.lit(owner).alias("asked_by"), F.col("id").cast("long").alias("id"))
            found = rows if found is None else found.unionByName(rows)
    return found


@query
def latest_analyses(spark, sf_dir):
    return portfolio.latest_analyses(V.analyses(spark, sf_dir), "2001-09-01").select(
        "user_id", "analysis_id", "created_at"
    )


@query
def owner_scope(spark, sf_dir):
    return tables.scoped(V.uploads(spark, sf_dir), 7).select("upload_id", "user_id", "status")


@query
def value_checks(spark, sf_dir):
    return tables.check_values(V.uploads(spark, sf_dir), "uploads")


# --- Accounts -------------------------------------------------------------------------------------------------------


@query
def report_recipients(spark, sf_dir):
    return accounts.recipients(V.users(spark, sf_dir), "notify_weekly").select("user_id", "phone")


@query
def last_messages(spark, sf_dir):
    made = accounts.message_history(V.contacts(spark, sf_dir), V.messages(spark, sf_dir), 4)
    return made.select(
        "contact_id", F.size("history").alias("n"), F.array_join(F.col("history.role"), "|").alias("roles"),
        F.sha2(F.array_join(F.col("history.text"), "|"), 256).alias("digest"),
    )


@query
def upserted_users(spark, sf_dir):
    """Customers of every fourth supplier's key sign in again under a new name, some of them twice, some new."""
    target = V.users(spark, sf_dir).select("email", "name", "user_type", "updated_at")
    supplier = read_table(spark, sf_dir, "supplier")
    logins = supplier.select(
        F.format_string("customer#%09d@example.com", F.col("s_suppkey") * 40).alias("email"),
        F.col("s_name").alias("name"), F.lit("ca_firm").alias("user_type"), F.col("s_suppkey").alias("seq"),
    )
    again = logins.withColumn("name", F.concat("name", F.lit(" again"))).withColumn("seq", F.col("seq") + 1_000_000)
    incoming = logins.unionByName(again.filter(F.col("seq") % 2 == 0))
    return accounts.upsert(target, incoming, "email", ["name"], V.AS_OF)


@query
def versioned_accounts(spark, sf_dir):
    """Users are stored, signed in again, and deleted; each change rewrites the buckets of its keys. Old and new versions are read."""
    users = V.users(spark, sf_dir).select("user_id", "name", "user_type", "updated_at")
    stored = versions.VersionedTable(new_folder(spark, "versioned-users"), "user_id", 16)
    stored.create(users)
    supplier = read_table(spark, sf_dir, "supplier")
    logins = supplier.select((F.col("s_suppkey") * 16).cast("long").alias("user_id"), F.col("s_name").alias("name"), F.lit("ca_firm").alias("user_type"),
                             F.col("s_suppkey").alias("seq"))
    stored.change(logins, lambda old: accounts.upsert(old, logins, "user_id", ["name"], V.AS_OF))
    gone = users.filter(F.col("user_id") % 10 == 3).select("user_id")
    stored.change(gone, lambda old: old.join(gone, "user_id", "left_anti"))
    kept = None
    for version in range(3):
        rows = stored.read(spark, version).withColumn("version", F.lit(version))
        kept = rows if kept is None else kept.unionByName(rows)
    return kept


@query
def joined_waitlist(spark, sf_dir):
    key = F.col("c_custkey")
    incoming = read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("+91"), F.lpad((key * 2).cast("string"), 10, "9")).alias("phone"),
        F.col("c_name").alias("name"), F.lit(True).alias("approved"), key.alias("seq"),
    )
    return accounts.insert_absent(V.waitlist(spark, sf_dir), incoming, "phone")


@query
def deactivated_clients(spark, sf_dir):
    return accounts.deactivate_clients(V.clients(spark, sf_dir), F.col("client_id") % 5 == 0, V.AS_OF)


@query
def cascade_delete(spark, sf_dir):
    """Rows left per table after every tenth customer and the owner of nation 3 are deleted."""
    gone = V.users(spark, sf_dir).filter((F.col("user_id") % 10 == 0) | (F.col("user_id") == 3)).select("user_id")
    left = accounts.cascade_delete(
        {t: getattr(V, t)(spark, sf_dir) for t in ("users", "clients", "uploads", "analyses", "reports", "messages")},
        gone,
    )
    made = None
    for name, key in (("users", "user_id"), ("clients", "client_id"), ("uploads", "client_id"),
                      ("analyses", "upload_id"), ("reports", "analysis_id"), ("messages", "user_id")):
        row = left[name].agg(F.count("*").alias("n_rows"), F.count(key).alias("n_linked")).withColumn(
            "table_name", F.lit(name)
        )
        made = row if made is None else made.unionByName(row)
    return made


@query
def retained_uploads(spark, sf_dir):
    return accounts.retained(V.uploads(spark, sf_dir), V.AS_OF).select("upload_id", "delete_after")


@query
def whitelist_gate(spark, sf_dir):
    return accounts.with_access(V.users(spark, sf_dir), V.waitlist(spark, sf_dir)).select("user_id", "whitelisted")


# --- Reports --------------------------------------------------------------------------------------------------------


@query
def weekly_reports(spark, sf_dir):
    return reports.batch_reports(V.users(spark, sf_dir), V.analyses(spark, sf_dir), "weekly", "2001-09-01")


@query
def amount_audit(spark, sf_dir):
    """Report texts against a revenue that is a fifteenth of the quoted one for every second order."""
    rows = read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("Revenue ₹"), F.format_number("o_totalprice", 0), F.lit(" in 12 days")).alias("content"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 15).otherwise(F.col("o_totalprice")).alias(
            "revenue"
        ),
    )
    made = reports.audit_amounts(rows, "content", "revenue")
    return made.select("o_orderkey", "warn", F.array_join("suspicious_amounts", "|").alias("amounts"))


@query
def chat_summary(spark, sf_dir):
    ledger = staged_ledger(spark, sf_dir)
    made = metrics.kpis(ledger)
    found = found_anomalies(spark, sf_dir)
    counts = anomalies.severity_counts(found).join(
        segments.segment_counts(rfm(spark, sf_dir)).select("tenant", F.col("total").alias("customers")), "tenant"
    )
    report = health.health(flagged(spark, sf_dir))
    return reports.chat_summary(made, report, counts, anomalies.top_anomalies(found, 1))


@query
def chat_summary_parts(spark, sf_dir):
    """The message of every tenant taken apart again: period, revenue, products, customers, number of alerts, dead stock."""
    message = F.col("message")
    part = lambda pattern: F.regexp_extract(message, pattern, 1)
    return chat_summary(spark, sf_dir).select(
        "tenant", part(r"📅 (\S+ → \S+) \|").alias("period"), part(r"\*Revenue\*\n(.*)\n").alias("revenue"),
        part(r"(?s)\*Top Products\*\n(.*?)\n\n👥").alias("products"), part(r"Customers:\* (\d+)").cast("long").alias("customers"),
        F.coalesce(part(r"⚠️ \*(\d+) High").try_cast("long"), F.lit(0)).alias("high_alerts"), part(r"(?s)\*Dead Stock \((.*)$").alias("dead_stock"),
    )


@query
def whole_analysis(spark, sf_dir):
    """Every step for all tenants; the row counts of the result tables per tenant."""
    made = analyze(staged_ledger(spark, sf_dir), V.AS_OF_FLAGS)
    counted = None
    for name in ("ledger", "revenue", "customer_split", "segments", "bundle"):
        rows = made[name].groupBy("tenant").agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(name))
        counted = rows if counted is None else counted.unionByName(rows)
    return counted


# --- Sources --------------------------------------------------------------------------------------------------------

CSV_COLUMNS = ["Branch", "Invoice Date", "Party Name", "Item Name", "Net Amount", "Qty"]


def messy_rows(spark, sf_dir) -> DataFrame:
    """The ledger as shopkeepers type it: several date and amount styles, blanks for missing names."""
    kind = F.abs(F.hash("row_id").cast("long")) % 5  # as an int, one hash in 2^32 has no absolute value and ends the query
    value = F.col("amount")
    size = F.abs(value).cast("string")
    date = F.col("date")
    return staged_ledger(spark, sf_dir).select(
        F.col("tenant").alias("Branch"),
        F.when(kind == 0, F.date_format(date, "dd/MM/yyyy")).when(kind == 1, F.date_format(date, "d-MMM-yyyy"))
        .when(kind == 2, F.date_format(date, "yyyy-MM-dd HH:mm:ss")).when(kind == 3, F.date_format(date, "dd.MM.yyyy"))
        .otherwise(F.date_format(date, "MMMM d, yyyy")).alias("Invoice Date"),
        F.when(F.col("voucher_id").cast("long") % 9 == 0, " ").otherwise(F.col("customer")).alias("Party Name"),
        F.when(F.col("voucher_id").cast("long") % 7 == 0, "nan").otherwise(F.col("product")).alias("Item Name"),
        F.when(F.col("quantity") == 1, "0.00")
        .when((kind == 0) & (value < 0), F.concat(F.lit("("), size, F.lit(")")))
        .when((kind == 1) & (value < 0), F.concat(size, F.lit(" CR")))
        .when((kind == 1), F.concat(F.lit("₹"), size, F.lit(" DR")))
        .when((kind == 2) & (value > 0), F.concat(F.lit("₹ "), F.format_number(value, 2)))
        .otherwise(value.cast("string")).alias("Net Amount"),
        F.col("quantity").cast("int").cast("string").alias("Qty"),
    )


_files: dict[tuple, str] = {}


def made_once(spark, sf_dir: str, label: str, write: Callable[[str], None]) -> str:
    """Folder of input files made from `sf_dir`, written once per application so that queries time the reading alone."""
    key = (spark.sparkContext.applicationId, label, sf_dir)
    if key not in _files:
        path = new_folder(spark, label)
        with removing_shuffles(spark):
            write(path)
        _files[key] = path
    return _files[key]


def messy_csv(spark, sf_dir) -> str:
    return made_once(spark, sf_dir, "csv", lambda path: messy_rows(spark, sf_dir).write.option("header", True).csv(path))


@query
def csv_ledger(spark, sf_dir):
    ledger, _ = delimited.read_ledger_csv(spark, messy_csv(spark, sf_dir), CSV_COLUMNS, F.col("Branch"))
    return plain(ledger.groupBy("tenant", "customer").agg(
        F.count("*").alias("n_rows"), F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity"),
        F.min("date").alias("first_date"), F.count_if(F.col("product") == "General").alias("n_general"),
    ))


@query
def csv_quoted(spark, sf_dir):
    """Whole documents as cells, with doubled quotes, separators and line breaks: no row is lost and no cell shifts."""
    path = new_folder(spark, "csv-quoted")
    read_table(spark, sf_dir, "documents").select(
        F.lit("2026-01-02T10:00:00").alias("Date"), F.concat(F.lit('Ram "R", Sons '), F.col("doc_id").cast("string")).alias("Party"),
        F.concat(F.lit('say "'), "text", F.lit('",\nend')).alias("Item"), F.col("n_chars").cast("string").alias("Amount"),
    ).write.options(header=True, escape='"', quoteAll=True).csv(path)
    ledger, _ = delimited.read_ledger_csv(spark, path, ["Date", "Party", "Item", "Amount"], F.lit("shop"))
    return plain(ledger.select("customer", F.md5(F.encode("product", "UTF-8")).alias("product_md5"), "amount", "date"))


@query
def csv_mixed_headers(spark, sf_dir):
    """Files of one folder whose columns stand in different order and under different names."""
    path = new_folder(spark, "csv-mixed")
    order = read_table(spark, sf_dir, "orders")
    day, total = F.date_format("o_orderdate", "yyyy/MM/dd"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    party, item = F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.col("o_orderpriority")
    odd = F.col("o_orderkey") % 2 == 1
    order.filter(odd).select(day.alias("Date"), party.alias("Party"), item.alias("Item"), total.alias("Amount")).write.option(
        "header", True).csv(f"{path}/part=a")
    order.filter(~odd).select(item.alias("Product"), party.alias("Customer Name"), total.alias("Net Amount"), day.alias("Bill Date")).write.option(
        "header", True).csv(f"{path}/part=b")
    ledger, _ = delimited.read_ledger_mixed(spark, [f"{path}/part=a", f"{path}/part=b"], F.lit("shop"))
    return plain(ledger.groupBy("customer", "product").agg(
        F.count("*").alias("n_rows"), F.sum("amount").alias("amount"), F.min("date").alias("first_date")
    ))


@query
def csv_column_override(spark, sf_dir):
    """A caller's column map wins over the header patterns, for plain columns and for an expression over columns."""
    path = new_folder(spark, "csv-override")
    money = lambda factor: (F.col("o_totalprice").cast("decimal(18,2)") * factor).cast("string")
    columns = ["Date", "Gross", "Net", "Tax", "Who"]
    read_table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), money(3).alias("Gross"), money(2).alias("Net"), money(1).alias("Tax"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("Who"),
    ).write.option("header", True).csv(path)
    read = lambda given: delimited.read_ledger_csv(spark, path, columns, F.lit("shop"), given)[0]
    plain_map, formula = read({"amount": "Net", "customer": "Who"}), read({"expression": "Gross - Tax", "customer": "Who"})
    sums = lambda ledger, name: ledger.groupBy("customer").agg(F.sum("amount").alias(name))
    return plain(sums(plain_map, "net").join(sums(formula, "computed"), "customer"))


@query
def registered_tables(spark, sf_dir):
    """Stored tables read by name and joined as views."""
    path = new_folder(spark, "tables")
    for name in ("nation", "customer"):
        read_table(spark, sf_dir, name).write.parquet(f"{path}/{name}")
    tables.register_tables(spark, path, ["nation", "customer"])
    return spark.sql("SELECT n_name, count(*) AS clients FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query
def csv_bad_cells(spark, sf_dir):
    """Amounts too large to hold, words for dates and rows with a missing cell are counted and stop nothing."""
    path = new_folder(spark, "csv-bad")
    key = F.col("o_orderkey")
    cells = [
        F.when(key % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "d MMMM yyyy")),
        F.when(key % 5 == 0, "8901234567890123456789").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
        F.when(key % 11 != 0, F.col("o_orderpriority")),
    ]
    lines = read_table(spark, sf_dir, "orders").select(F.concat_ws(",", *cells).alias("value"))
    lines.write.text(f"{path}/data")
    _, stats = delimited.read_ledger_csv(spark, f"{path}/data", ["Date", "Amount", "Item"], F.lit("shop"), header=False)
    return stats.groupBy("tenant").agg(
        *[F.sum(c).alias(c) for c in ("rows_read", "failed_dates", "zero_amounts", "bad_amounts", "malformed_rows", "rows_dropped")],
        F.bool_and("good_result").alias("good_result"), F.bool_and("good_columns").alias("good_columns"),
    )


@query
def csv_ingest_stats(spark, sf_dir):
    _, stats = delimited.read_ledger_csv(spark, messy_csv(spark, sf_dir), CSV_COLUMNS, F.col("Branch"))
    return stats.groupBy("tenant").agg(
        F.sum("rows_read").alias("rows_read"), F.sum("failed_dates").alias("failed_dates"),
        F.sum("zero_amounts").alias("zero_amounts"), F.sum("rows_dropped").alias("rows_dropped"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
    )


def voucher_files(spark, sf_dir) -> str:
    """Orders as accounting XML: one voucher each, the party line mirrored, one folder of compressed files per tenant."""
    ledger = staged_ledger(spark, sf_dir)
    line = F.struct(F.col("product").alias("LEDGERNAME"), (-F.col("amount")).cast("string").alias("AMOUNT"))
    vouchers = ledger.groupBy("tenant", "voucher_id", "customer", "date").agg(
        F.collect_list(line).alias("lines"), F.sum("amount").cast("string").alias("total")
    )
    mirror = F.array(F.struct(F.col("customer").alias("LEDGERNAME"), F.col("total").alias("AMOUNT")))
    number = F.col("voucher_id").cast("long")
    bare = number % 13 == 0
    made = (
        vouchers.select(
            "tenant", F.when(number % 11 == 0, "Purchase").when(number % 2 == 0, "Sales").otherwise(" Tax Invoice")
            .alias("_VCHTYPE"),
            F.date_format("date", "yyyyMMdd").alias("DATE"), F.col("voucher_id").alias("VOUCHERNUMBER"),
            F.when(number % 9 != 0, F.col("customer")).alias("PARTYLEDGERNAME"),
            F.when(bare, F.concat(F.lit("-"), F.abs(F.col("total").cast("decimal(18,2)")).cast("string")))
            .alias("AMOUNT"),
            F.when(~bare & (number % 2 == 0), F.concat(mirror, "lines")).alias("ALLLEDGERENTRIES.LIST"),
            F.when(~bare & (number % 2 != 0), F.concat(mirror, "lines")).alias("LEDGERENTRIES.LIST"),
        )
        .write.partitionBy("tenant").format("xml").options(rowTag="VOUCHER", rootTag="ENVELOPE", compression="gzip")
    )
    return made_once(spark, sf_dir, "xml", made.save)


@query
def xml_ledger(spark, sf_dir):
    folder_tenant = F.regexp_extract("source", "tenant=([^/]+)", 1)
    ledger, _ = voucher_xml.read_ledger_xml(spark, voucher_files(spark, sf_dir), V.AS_OF, folder_tenant)
    return plain(ledger.groupBy("tenant", "customer").agg(
        F.count("*").alias("n_rows"), F.sum("amount").alias("amount"), F.min("date").alias("first_date"),
        F.count_distinct("voucher_id").alias("n_vouchers"),
    ))


@query
def xml_ingest_stats(spark, sf_dir):
    folder_tenant = F.regexp_extract("source", "tenant=([^/]+)", 1)
    _, stats = voucher_xml.read_ledger_xml(spark, voucher_files(spark, sf_dir), V.AS_OF, folder_tenant)
    return stats.withColumn("tenant", folder_tenant).groupBy("tenant").agg(
        *[F.sum(c).alias(c) for c in (
            "vouchers_found", "skipped_non_sales", "sales_extracted", "skipped_zero", "unreadable", "bad_amounts", "bad_dates")]
    )


def nested_vouchers(spark, sf_dir) -> str:
    """Order lines as vouchers without numbers whose lines hold further lines, ahead of their own amounts; some are broken."""
    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    line = lambda tag, name, amount, more="": F.concat(
        F.lit(f"<{tag}.LIST><LEDGERNAME TYPE='x'>"), F.lit(name), F.lit("</LEDGERNAME>"), F.lit(more) if isinstance(more, str) else more,
        F.lit("<AMOUNT>-"), amount, F.lit(f"</AMOUNT></{tag}.LIST>"))
    inner = F.concat(F.lit("<BATCH>"), line("ALLLEDGERENTRIES", "<![CDATA[Tax & <Duty>]]>", number.cast("string")), F.lit("</BATCH>"))
    nested = line("ALLLEDGERENTRIES", "Soap &amp; Oil&#4;", price, inner)
    older = F.concat(F.lit("<UDF:PART><X>"), line("LEDGERENTRIES", "Salt & Rock", price), F.lit("</X></UDF:PART>"))
    body = F.when(key % 3 == 0, older).when(key % 3 == 1, F.concat(nested, older)).otherwise(F.lit("<AMOUNT>-5</AMOUNT>"))
    date = F.when(key % 29 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
    voucher = F.concat(F.lit("<VOUCHER VCHTYPE='Sales'><DATE>"), date, F.lit("</DATE>"), F.when(number == 7, F.lit("<BROKEN>")).otherwise(F.lit("")),
                       body, F.lit("</VOUCHER>"))
    lines = over_all_cores(read_table(spark, sf_dir, "lineitem")).select(voucher.alias("value"))
    return made_once(spark, sf_dir, "xml-nested", lines.write.text)


@query
def xml_nested(spark, sf_dir):
    """Lines inside lines have amounts of their own; names hold entities, sections and forbidden characters."""
    ledger, _ = voucher_xml.read_ledger_xml(spark, nested_vouchers(spark, sf_dir), V.AS_OF, F.lit("shop"))
    return plain(ledger.groupBy("product").agg(
        F.count("*").alias("n_rows"), F.sum("amount").alias("amount"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    ))


@query
def xml_nested_stats(spark, sf_dir):
    _, stats = voucher_xml.read_ledger_xml(spark, nested_vouchers(spark, sf_dir), V.AS_OF, F.lit("shop"))
    return stats.agg(*[F.sum(c).alias(c) for c in (
        "vouchers_found", "skipped_non_sales", "sales_extracted", "skipped_zero", "unreadable", "bad_amounts", "bad_dates")])


@query
def xml_company(spark, sf_dir):
    """One file per nation: the company below a data element, below the header, or nowhere; half of the lines lie deeper."""
    order = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    company = F.concat(F.lit("Firm "), F.col("c_nationkey").cast("string"))
    total = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    line = F.concat(
        F.lit("<ALLLEDGERENTRIES.LIST><LEDGERNAME>Goods</LEDGERNAME><AMOUNT>-"), total, F.lit("</AMOUNT></ALLLEDGERENTRIES.LIST>")
    )
    deep = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<BATCH><PART>"), line, F.lit("</PART></BATCH>"))).otherwise(line)
    voucher = F.concat(
        F.lit('<VOUCHER VCHTYPE="Sales"><DATE>'), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("</DATE><VOUCHERNUMBER>"),
        F.col("o_orderkey").cast("string"), F.lit("</VOUCHERNUMBER>"), deep, F.lit("</VOUCHER>"),
    )
    request = F.lit("<ENVELOPE><HEADER><TALLYREQUEST>Export</TALLYREQUEST></HEADER><BODY>")
    kind = F.col("c_nationkey") % 3
    named = F.when(kind == 0, F.concat(F.lit("<DATA><COMPANYNAME>"), company, F.lit("</COMPANYNAME></DATA>"))).when(
        kind == 1, F.concat(F.lit("<X><BASICCOMPANYNAME>"), company, F.lit("</BASICCOMPANYNAME></X>"))
    ).otherwise("")
    nation = order.select("c_nationkey").distinct()
    lines = order.select("c_nationkey", F.lit(1).alias("place"), voucher.alias("value")).unionByName(
        nation.select("c_nationkey", F.lit(0).alias("place"), F.concat(request, named).alias("value"))
    ).unionByName(nation.select("c_nationkey", F.lit(2).alias("place"), F.lit("</BODY></ENVELOPE>").alias("value")))
    path = new_folder(spark, "xml-company")
    placed = lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "place")
    placed.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    ledger, _ = voucher_xml.read_ledger_xml(spark, path, V.AS_OF)
    firm = F.when(F.col("tenant").startswith("Firm "), F.col("tenant")).otherwise(F.regexp_extract("tenant", r"^(Unknown Company ).*(c_nationkey=\d+)", 2))
    return plain(ledger.groupBy(firm.alias("company"), "product").agg(F.count("*").alias("n_rows"), F.sum("amount").alias("amount")))


@query
def file_types(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select(
        "page_id", F.encode("html", "UTF-8").alias("content"), F.col("url").alias("name")
    )
    docs = read_table(spark, sf_dir, "documents").select(
        (-1 - F.col("doc_id")).alias("page_id"), F.encode("text", "UTF-8").alias("content"),
        F.concat(F.lit("upload."), "lang").alias("name"),
    )
    both = pages.unionByName(docs)
    return both.select("page_id", catalog.file_type(F.col("content"), F.col("name")).alias("type"))


@query
def stored_results(spark, sf_dir):
    path = new_folder(spark, "results")
    tables.write_results(metrics.daily_revenue(staged_ledger(spark, sf_dir)), path)
    return plain(tables.read_results(spark, path))


# --- Scalar functions -----------------------------------------------------------------------------------------------


@query
def date_parsing(spark, sf_dir):
    """Order dates written in many formats and read back; month-first dates come back day-first where they can."""
    date, style = F.col("o_orderdate"), F.col("o_orderkey") % 16
    patterns = ("dd/MM/yyyy", "dd-MM-yy", "yyyy-MM-dd HH:mm", "yyyyMMdd", "d MMM yyyy", "d.M.yy", "M/d/yyyy", "'n/a'",
                "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "dd-MMM-yyyy", "dd-MM-yyyy HH:mm", "yyyy-MM-dd HH:mm:ss.S", "d MMMM yyyy",
                "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy/MM/dd HH:mm:ss")
    written = F.lit("none")
    for number, pattern in enumerate(patterns):
        written = F.when(style == number, F.date_format(date, pattern)).otherwise(written)
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", written.alias("raw"))
    return rows.select("o_orderkey", F.to_date(dates.parse_date(F.col("raw"))).alias("parsed"))


@query
def amount_expressions(spark, sf_dir):
    columns = ["qty", "line", "rate"]
    rows = read_table(spark, sf_dir, "lineitem").select(
        row_key().alias("row_id"),
        F.col("l_quantity").cast("int").cast("string").alias("qty"), F.col("l_linenumber").cast("string").alias("line"),
        F.col("l_discount").cast("decimal(4,2)").cast("string").alias("rate"),
    )
    sums = rows.select(
        "row_id", amounts.amount_expression("qty + line * rate", columns).alias("left_to_right"),
        amounts.ledger_amount({"credit": "qty", "debit": "line"}, columns).alias("credit_less_debit"),
        amounts.ledger_amount({"quantity": "qty", "unit_price": "rate"}, columns).alias("qty_times_price"),
        amounts.amount_expression("qty / nothing", columns).alias("by_zero"),
    )
    return plain(sums)


@query
def rupee_texts(spark, sf_dir):
    scaled = F.col("o_totalprice").cast("decimal(18,2)") * F.element_at(
        F.array(*[F.lit(x) for x in (1, 100, -10, 0)]), (F.col("o_orderkey") % 4 + 1).cast("int")
    )
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", amounts.format_inr(scaled).alias("full"),
        amounts.format_inr_compact(F.floor(F.abs(scaled))).alias("compact"),
    )


@query
def trend_texts(spark, sf_dir):
    pct = F.when(F.col("o_orderkey") % 10 == 0, 0).when(F.col("o_orderkey") % 10 == 1, None).otherwise(
        (F.col("o_orderkey") % 200 - 100) / F.lit(4.0)
    )
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", text.signed_percent(pct).alias("trend_text"),
        text.relative_time(F.col("o_orderdate"), dates.as_moment(V.AS_OF)).alias("age"),
    )


@query
def phone_checks(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    raw = F.concat(F.when(F.col("c_custkey") % 2 == 0, " 91-(98) ").otherwise("+44 "), F.lpad(key, 8, "7"),
                   F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(""))
    phone = text.clean_phone(raw)
    return read_table(spark, sf_dir, "customer").select(
        "c_custkey", phone.alias("phone"), text.phone_is_valid(phone).alias("phone_valid"),
        text.phone_digest(phone).alias("digest"),
    )


@query
def printable_names(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", text.printable(F.concat(F.lit("\t"), F.col("text"))).alias("safe")
    )


@query
def json_paths(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select(
        "event_id", text.json_number(F.col("props"), "$.k", "int").alias("k"),
        F.get_json_object("props", "$.missing").alias("missing"),
    )


# --- Messages -------------------------------------------------------------------------------------------------------


@query
def message_intents(spark, sf_dir):
    return inbox.log_rows(V.messages(spark, sf_dir)).select(
        "message_id", "phone_hash", "direction", "intent_detected", F.length("message_text").alias("n_chars")
    )


@query
def message_routes(spark, sf_dir):
    rows = V.messages(spark, sf_dir).filter("direction = 'inbound'")
    return rows.select(
        "message_id", inbox.route(F.col("message_text"), F.length("message_text") % 2 == 0).alias("route")
    )


@query
def messages_without_retries(spark, sf_dir):
    """Every event is delivered twice; the stream keeps one of each."""
    schema = read_table(spark, sf_dir, "events").schema
    arriving = lambda: (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        .select(F.col("event_id").cast("string").alias("message_id"), "event_type",
                F.col("ts").cast("timestamp").alias("created_at"))
    )
    path, checkpoint = new_folder(spark, "messages"), new_folder(spark, "messages-state")
    kept = inbox.drop_retries(arriving().union(arriving()))
    stream = kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()
    stream.awaitTermination()
    return spark.read.schema("message_id string, event_type string").parquet(path)


@query
def arriving_files(spark, sf_dir):
    """Ledger files arrive as a stream; the revenue of the touched tenants is computed again."""
    base = new_folder(spark, "arrivals")

    def analyse(ledger: DataFrame, batch_id: int) -> None:
        metrics.revenue(ledger).write.mode("overwrite").parquet(f"{base}/revenue/batch={batch_id}")

    stream = arrivals.on_arrival(
        arrivals.csv_arrivals(spark, messy_csv(spark, sf_dir), CSV_COLUMNS), CSV_COLUMNS, F.col("Branch"),
        f"{base}/ledger", analyse, f"{base}/state",
    )
    stream.awaitTermination()
    latest = spark.read.option("basePath", f"{base}/revenue").parquet(f"{base}/revenue")
    newest = top_per_group(latest, ["tenant"], [F.desc("batch")], 1).drop("rank", "batch")
    return plain(newest.select("tenant", "current_revenue", "previous_revenue", "change_pct", "trend"))


def newest_results(spark, arriving: incremental.Arrivals, label: str) -> dict[str, DataFrame]:
    """Feed files to an incremental analysis batch by batch; what the last batch that touched a tenant found for it."""
    base = new_folder(spark, label)

    def publish(results: dict[str, DataFrame], batch: int) -> None:
        for name, table in results.items():
            table.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")

    incremental.follow(arriving, f"{base}/store", publish, f"{base}/state").awaitTermination()
    newest = {}
    for name in ("revenue", "top_products"):
        found = spark.read.option("basePath", f"{base}/{name}").parquet(f"{base}/{name}")
        last = found.groupBy("tenant").agg(F.max("batch").alias("batch"))
        newest[name] = found.join(last, ["tenant", "batch"]).drop("batch")
    return newest


@query
def arriving_rows(spark, sf_dir):
    """Delimited files come in batches; revenue and best products from recent totals equal those of the whole ledger."""
    arriving = incremental.csv_arrivals(spark, messy_csv(spark, sf_dir), delimited.named_cell("Branch"), maxFilesPerTrigger=4)
    newest = newest_results(spark, arriving, "arriving-rows")
    best = newest["top_products"].filter("rank = 1").select("tenant", F.col("product").alias("best"), F.col("revenue").alias("best_revenue"))
    columns = ["tenant", "current_revenue", "previous_revenue", "change_pct", "trend"]
    return plain(newest["revenue"].select(*columns).join(best, "tenant", "left"))


@query
def arriving_vouchers(spark, sf_dir):
    """Accounting XML comes in batches of files."""
    folder_tenant = F.regexp_extract("source", "tenant=([^/]+)", 1)
    arriving = incremental.xml_arrivals(spark, voucher_files(spark, sf_dir), V.AS_OF, folder_tenant, maxFilesPerTrigger=60)
    newest = newest_results(spark, arriving, "arriving-vouchers")["revenue"]
    return plain(newest.select("tenant", "current_revenue", "previous_revenue", "change_pct", "trend", "n_days", "period_end"))
