"""The whole analysis of every tenant's ledger in one application."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.anomalies import detect, severity_counts, top_anomalies
from ledgerloom.operators.calendar import seasonal_calendar, seasonal_context
from ledgerloom.operators.cleaning import flag_summary, normalise
from ledgerloom.operators.grains import ledger_grains
from ledgerloom.operators.health import analysable, health
from ledgerloom.operators.metrics import insights, kpis, summary
from ledgerloom.operators.periods import period_bounds
from ledgerloom.operators.product_names import merge_product_names
from ledgerloom.operators.segments import customer_segments, segment_counts, top_customers
from ledgerloom.plans.shared import staged
from ledgerloom.sources.tables import write_results


def analyze(
    ledger: DataFrame,
    as_of,
    calendar: DataFrame | None = None,
    reference_date=None,
    industry: str | None = None,
    merge_names: bool = True,
) -> dict[str, DataFrame]:
    """Every result table: cleaning, health, KPIs, anomalies, segments, season and a nested bundle.

    Product names are merged before text clean-up. The cleaned ledger is written once to the shared folder and read four
    times: for the health report, the flag counts, the sums that everything else derives from, and the large transactions.
    """
    calendar = seasonal_calendar(ledger.sparkSession) if calendar is None else calendar
    merged, mapping = merge_product_names(ledger) if merge_names else (ledger, None)
    cleaned = staged(normalise(merged, as_of), "cleaned")
    report = staged(health(cleaned), "health")
    passed = cleaned if report.filter(~F.col("can_analyze")).isEmpty() else analysable(cleaned, report)
    grains = ledger_grains(passed)
    tables = kpis(passed, reference_date, grains=grains)
    bounds = period_bounds(grains.stats, reference_date)
    anomalies = staged(detect(passed, calendar, reference_date, industry=industry, grains=grains), "anomalies")
    segments = staged(customer_segments(grains.by_customer, reference_date, grains.stats), "segments")
    tables = {k: staged(t, k) for k, t in tables.items()}
    season = seasonal_context(bounds.withColumnRenamed("ref", "end"), calendar, industry)
    result = tables | {
        "ledger": passed,
        "flag_summary": flag_summary(cleaned),
        "health": report,
        "anomalies": anomalies,
        "top_anomalies": top_anomalies(anomalies),
        "severity_counts": severity_counts(anomalies),
        "segments": segments,
        "segment_counts": segment_counts(segments),
        "top_customers": top_customers(segments),
        "season": season,
        "insights": insights(tables["revenue"], tables["dead_stock"], tables["top_products"]),
    }
    if mapping is not None:
        result["product_names"] = mapping
    result["bundle"] = bundle(result)
    return result


def bundle(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per analysed tenant with the stored JSON documents: metrics, anomalies, customers, season."""
    listed = F.struct("rank", F.struct(
        F.col("anomaly_type").alias("type"), "severity", "confidence", "title", "explanation", "action"
    ).alias("a"))
    anomalies = tables["severity_counts"].join(
        tables["top_anomalies"].groupBy("tenant").agg(
            F.transform(F.array_sort(F.collect_list(listed)), lambda x: x["a"]).alias("anomalies")
        ),
        "tenant", "left",
    )
    anomalies = anomalies.select(
        "tenant", F.to_json(F.struct(*[c for c in anomalies.columns if c != "tenant"])).alias("anomalies_json")
    )
    best = F.struct("rank", F.struct(F.col("customer").alias("name"), "segment", "rfm_score").alias("c"))
    counts = tables["segment_counts"]
    customers = counts.select("tenant", "total", F.struct(*counts.columns[2:]).alias("segments")).join(
        tables["top_customers"].groupBy("tenant").agg(
            F.transform(F.array_sort(F.collect_list(best)), lambda x: x["c"]).alias("top_customers")
        ),
        "tenant", "left",
    ).select("tenant", F.to_json(F.struct("total", "segments", "top_customers")).alias("customers_json"))
    season = tables["season"].select("tenant", F.to_json(F.struct("events", "notes")).alias("season_json"))
    rows = summary(tables).drop("metrics")
    for table in (anomalies, customers, season):
        rows = rows.join(table, "tenant", "left")
    return rows


def store(tables: dict[str, DataFrame], path: str) -> None:
    """Write every result table under `path`."""
    for name, table in tables.items():
        write_results(table, f"{path}/{name}")
