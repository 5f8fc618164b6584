import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import anomalies, calendar, metrics, periods


def test_periods(clean_sales):
    row = periods.period_bounds(periods.tenant_stats(clean_sales)).first()
    assert row["n_days"] == 30
    days = [row[c].date().isoformat() for c in ("start", "ref", "prev_start", "prev_end")]
    assert days == ["2026-02-13", "2026-03-14", "2026-01-14", "2026-02-12"]


def test_revenue(clean_sales):
    row = metrics.revenue(clean_sales).first()
    assert (row["current_revenue"], row["previous_revenue"]) == (411900, 709800)
    assert float(row["change_pct"]) == -41.97 and row["trend"] == "down"
    assert row["period_label"] == "This month vs last month"


def test_top_products(clean_sales):
    rows = metrics.top_products(clean_sales).orderBy("rank").collect()
    assert [(r["product"], int(r["revenue"]), int(r["previous_revenue"]), float(r["change_pct"])) for r in rows] == [
        ("Jute Rope", 137460, 141960, -3.17), ("Candle Box", 93260, 97760, -4.60),
        ("Floor Wax", 72860, 230360, -68.37), ("Tin Pail", 59260, 186160, -68.17),
        ("Lamp Oil", 49060, 53560, -8.40),
    ]


def test_dead_stock_and_split(clean_sales):
    dead = metrics.dead_stock(clean_sales).collect()
    assert {(r["product"], r["days_since_sale"]) for r in dead} == {("Tin Pail", 21), ("Floor Wax", 21)}
    split = metrics.customer_split(clean_sales).first()
    assert (split["new_customers"], split["repeat_customers"]) == (0, 5)


def test_without_earlier_revenue(make_ledger):
    row = metrics.revenue(make_ledger([("a", "2026-01-01", "c", "p", 10)])).first()
    assert row["change_pct"] is None and row["trend"] == "new" and row["n_days"] == 7


def test_only_returns_gives_zero_revenue(make_ledger):
    ledger = make_ledger([("a", "2026-01-01", "c", "p", -10), ("a", "2026-01-02", "c", "p", -5)])
    row = metrics.revenue(ledger).first()
    assert (row["current_revenue"], row["trend"]) == (0, "new")
    assert metrics.customer_split(ledger).first()["new_revenue_pct"] == 0


def test_time_of_day_uses_whole_days(make_ledger):
    ledger = make_ledger([
        ("a", "2026-01-01 18:00:00", "c", "old", 10), ("a", "2026-01-16 06:00:00", "c", "new", 10),
    ])
    assert metrics.dead_stock(ledger).count() == 0  # 14 days and 12 hours are 14 whole days


def test_missing_columns_are_reported(clean_sales):
    with pytest.raises(ValueError):
        metrics.revenue(clean_sales.drop("amount"))


def test_anomalies_of_clean_sales(spark, clean_sales):
    found = anomalies.detect(clean_sales, calendar.seasonal_calendar(spark))
    kinds = {r["anomaly_type"]: r["severity"] for r in found.collect()}
    assert "customer_churn_risk" not in kinds and "large_transaction" not in kinds
    assert "revenue_anomaly_zscore" not in kinds
    assert kinds["revenue_drop"] == "MEDIUM"  # HIGH before the calendar
    drop = found.filter("anomaly_type = 'revenue_drop'").first()
    assert "down 42% from ₹709,800 last month" in drop["explanation"] and drop["context_notes"]


def test_outside_the_calendar_a_drop_stays_high(spark, clean_sales):
    moved = clean_sales.withColumn("date", F.col("date") - F.expr("interval 1000 days"))
    found = anomalies.detect(moved, calendar.seasonal_calendar(spark))
    assert found.filter("anomaly_type = 'revenue_drop'").first()["severity"] == "HIGH"


def test_weekly_series_fills_gaps_like_pandas(make_ledger):
    import pandas as pd

    dates = ["2026-01-04", "2026-01-05", "2026-01-11", "2026-02-03"]
    ledger = make_ledger([("a", d, "c", "p", 5 + i) for i, d in enumerate(dates)])
    got = {r["week_end"].isoformat(): r["revenue"] for r in anomalies.weekly_revenue(ledger).collect()}
    series = pd.Series([5.0, 6, 7, 8], index=pd.to_datetime(dates)).resample("W").sum()
    assert got == {d.date().isoformat(): v for d, v in series.items()}


def test_large_transaction_is_kept_once_per_customer(make_ledger):
    rows = [("a", f"2026-01-{d:02d}", "small", "p", 10) for d in range(1, 29)]
    rows += [("a", "2026-01-20", "big", "p", 900), ("a", "2026-01-10", "big", "p", 800)]
    found = anomalies.first_large_transactions(make_ledger(rows)).collect()
    assert [(r["entity"], r["metadata"]["date"]) for r in found] == [("big", "2026-01-10")]


def test_calendar(spark):
    table = calendar.seasonal_calendar(spark)
    assert table.count() == 46
    days = {"2025-10-20": True, "2026-11-10": True, "2026-03-04": True, "2026-05-20": True, "2026-01-26": True,
            "2026-03-25": True, "2026-02-12": False, "2023-07-01": False}
    spans = spark.createDataFrame(
        [(d, datetime.date.fromisoformat(d), datetime.date.fromisoformat(d)) for d in days],
        "tenant string, start date, end date",
    )
    got = {r["tenant"]: r["in_season"] for r in calendar.seasonal_context(spans, table).collect()}
    assert all(got[d] for d, expected in days.items() if expected)
    assert not got["2023-07-01"]


def test_long_span_meets_each_event_once(spark):
    spans = spark.createDataFrame(
        [("all", datetime.date(2024, 1, 1), datetime.date(2027, 12, 31))], "tenant string, start date, end date"
    )
    hits = calendar.overlapping_events(spans, calendar.seasonal_calendar(spark))
    assert hits.count() == 46 and hits.select("event_no").distinct().count() == 46


def test_period_bounds_reach_the_scan(spark, clean_sales, tmp_path):
    clean_sales.write.parquet(str(tmp_path / "ledger"))
    stored = spark.read.parquet(str(tmp_path / "ledger"))
    for table in (metrics.revenue(stored), metrics.top_products(stored)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(date,2026-01-14" in plan
    assert metrics.revenue(stored).first()["current_revenue"] == 411900
