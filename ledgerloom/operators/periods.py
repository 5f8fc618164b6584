"""Comparison periods: the reference date of each tenant and the two windows that end there."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.fixed_values import LONGEST_PERIOD_DAYS, PERIOD_STEPS
from ledgerloom.functions.dates import as_moment, day_shift, whole_days
from ledgerloom.ledger import require
from ledgerloom.plans.joins import lookup_join, pinned


def stats_columns() -> list[Column]:
    value = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    sale = F.col("amount") > 0
    return [
        F.count("*").alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.avg(value).alias("mean_amount"),
        F.stddev_samp(value).alias("std_amount"),
        F.count_if(sale).alias("n_sales"),
        F.avg(F.when(sale, value)).alias("mean_sale"),
        F.min(F.when(sale, F.col("date"))).alias("first_sale"),
        F.max(F.when(sale, F.col("date"))).alias("last_sale"),
    ]


def tenant_stats(ledger: DataFrame) -> DataFrame:
    """Everything the operators need to know about a tenant as a whole, in one pass with map-side aggregation."""
    require(ledger, "tenant", "date", "amount")
    return pinned(ledger.groupBy("tenant").agg(*stats_columns()))


def period_length(first: Column, last: Column) -> Column:
    """7, 30 or 90 days, by the span of the data."""
    span = F.coalesce(whole_days(last, first), F.lit(0))
    length = F.lit(LONGEST_PERIOD_DAYS)
    for longest_span, days in reversed(PERIOD_STEPS):
        length = F.when(span <= longest_span, days).otherwise(length)
    return length


def period_bounds(stats: DataFrame, reference_date=None, sales_span: bool = False) -> DataFrame:
    """One row per tenant: tenant, ref, n_days, start, prev_start, prev_end; all bounds are inclusive.

    The reference date is the latest date of all rows unless given. KPIs size the window by the span of all rows, the
    revenue-drop detector by the span of sales only.
    """
    first, last = ("first_sale", "last_sale") if sales_span else ("first_date", "last_date")
    ref = F.col("last_date") if reference_date is None else as_moment(reference_date)
    return (
        stats.select("tenant", ref.alias("ref"), period_length(F.col(first), F.col(last)).alias("n_days"))
        .withColumn("start", day_shift(F.col("ref"), 1 - F.col("n_days")))
        .withColumn("prev_start", day_shift(F.col("start"), -F.col("n_days")))
        .withColumn("prev_end", day_shift(F.col("start"), F.lit(-1)))
    )


def is_current() -> Column:
    return F.col("date").between(F.col("start"), F.col("ref"))


def is_previous() -> Column:
    return F.col("date").between(F.col("prev_start"), F.col("prev_end"))


def with_periods(
    rows: DataFrame, bounds: DataFrame, spread_by: list[str] | None = None, within: bool = False
) -> DataFrame:
    """Rows together with the period bounds of their tenant.

    With `within`, rows before the earliest period of any tenant are left out by a literal bound, which reaches the scan.
    """
    if within:
        earliest = bounds.agg(F.min("prev_start")).first()[0]
        rows = rows if earliest is None else rows.filter(F.col("date") >= as_moment(earliest))
    return lookup_join(rows, bounds, ["tenant"], spread_by=spread_by)
