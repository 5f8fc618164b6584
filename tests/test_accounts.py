import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import accounts, portfolio, reports

NOW = "2026-03-01"


def test_upsert_changes_only_named_columns(spark):
    target = spark.createDataFrame(
        [("a@x", "Old", "owner", None), ("b@x", "Bea", "owner", None)], "email string, name string, kind string, updated_at timestamp_ntz")
    incoming = spark.createDataFrame(
        [("a@x", "New", "firm", 1), ("a@x", "Newer", "firm", 2), ("c@x", "Cy", "firm", 1)],
        "email string, name string, kind string, seq int")
    got = {r["email"]: (r["name"], r["kind"], r["updated_at"]) for r in accounts.upsert(
        target, incoming, "email", ["name"], NOW).collect()}
    stamp = datetime.datetime(2026, 3, 1)
    assert got == {"a@x": ("Newer", "owner", stamp), "b@x": ("Bea", "owner", None), "c@x": ("Cy", "firm", stamp)}


def test_insert_if_absent(spark):
    target = spark.createDataFrame([("1", "a")], "phone string, name string")
    incoming = spark.createDataFrame([("1", "z", 1), ("2", "b", 1), ("2", "c", 2)], "phone string, name string, seq int")
    assert sorted(map(tuple, accounts.insert_absent(target, incoming, "phone").collect())) == [("1", "a"), ("2", "b")]


def test_history_by_user_or_phone(spark):
    messages = spark.createDataFrame(
        [(f"m{i}", 1 if i % 2 else None, "9", "inbound" if i % 3 else "outbound", f"t{i}", i) for i in range(30)]
        + [("x", 2, "8", "inbound", "other", 99)],
        "message_id string, user_id int, phone_number string, direction string, message_text string, n int",
    ).withColumn("created_at", F.timestamp_seconds("n")).drop("n")
    contacts = spark.createDataFrame([(1, 1, "9"), (2, 2, None), (3, None, "7")], "contact_id int, user_id int, phone string")
    got = {r["contact_id"]: [t["text"] for t in r["history"]] for r in accounts.message_history(contacts, messages).collect()}
    assert got == {1: [f"t{i}" for i in range(20, 30)], 2: ["other"]}


def test_alert_clients_are_in_numeric_order(spark):
    clients = spark.createDataFrame([(i, 1, f"c{i}") for i in range(8)], "client_id int, owner_id int, client_name string")
    uploads = spark.createDataFrame([(i, i) for i in range(8)], "upload_id int, client_id int")
    analyses = spark.createDataFrame(
        [(i, f'{{"high_count": {i + 5}}}', datetime.date(2026, 2, 1), datetime.datetime(2026, 2, 27)) for i in range(7)]
        + [(7, '{"high_count": 99}', datetime.date(2026, 2, 1), datetime.datetime(2026, 1, 27))],
        "upload_id int, anomalies string, period_end date, created_at timestamp_ntz")
    rows = portfolio.recent_alerts(clients, uploads, analyses, NOW).orderBy("position").collect()
    assert [r["high_alerts"] for r in rows] == [11, 10, 9, 8, 7]


def test_latest_analysis_has_an_age_limit(spark):
    analyses = spark.createDataFrame(
        [(1, 1, datetime.datetime(2026, 2, 1)), (1, 2, datetime.datetime(2026, 2, 9)), (2, 3, datetime.datetime(2025, 1, 1))],
        "user_id int, analysis_id int, created_at timestamp_ntz")
    assert [(r["user_id"], r["analysis_id"]) for r in portfolio.latest_analyses(analyses, NOW).collect()] == [(1, 2)]
    assert portfolio.latest_analyses(analyses, max_age_days=None).count() == 2


def test_reports_by_language(spark):
    people = [("hi", 10), ("en", 10), ("hinglish", 10)]
    users = spark.createDataFrame(
        [(i, n, lang, "+91", True, True) for i, (lang, _) in enumerate(people) for n in ["Asha"]]
        + [(9, "No", "en", "", True, True), (8, "No", "en", "1", False, True)],
        "user_id int, name string, language_preference string, phone string, whatsapp_opted_in boolean, notify_weekly boolean")
    metrics = '{"current_revenue": 150000, "change_pct": -12.25, "top_products": [{"name": "Salt"}]}'
    analyses = spark.createDataFrame(
        [(u, u + 100, metrics, datetime.datetime(2026, 2, 20)) for u in (0, 1, 2, 8, 9)],
        "user_id int, analysis_id int, metrics string, created_at timestamp_ntz")
    rows = {r["user_id"]: r for r in reports.batch_reports(users, analyses, "weekly", NOW).collect()}
    assert set(rows) == {0, 1, 2}
    assert "₹1,50,000 (12.2% घटी है" in rows[0]["content_hindi"] and rows[0]["content_english"] is None
    assert "₹1,50,000 (12.2% down" in rows[1]["content_english"] and rows[1]["content_hindi"] is None
    assert rows[2]["content_hindi"].startswith("Hello Asha!")


def test_audit_finds_invented_amounts(spark):
    df = spark.createDataFrame([("₹1,24,300 and 99,99,999", 1000.0), ("₹9,000", 1000.0), ("₹5,00,000", 0.0), ("12 ₹,", 1.0)],
                               "text string, revenue double")
    got = [r["suspicious_amounts"] for r in reports.audit_amounts(df, "text", "revenue").collect()]
    assert got == [["₹1,24,300", "99,99,999"], [], [], []]
