"""The seasonal calendar and its overlap join with tenants' periods."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.fixed_values import (
    EVENTS_AFTER_TAX,
    EVENTS_BEFORE_TAX,
    SEASONAL_WINDOW_DAYS,
    TAX_DEADLINE_DAYS,
    TAX_DEADLINE_LOCAL,
    TAX_DEADLINE_NAME,
    TAX_DEADLINE_NOTE,
    TAX_DEADLINE_YEARS,
)

CALENDAR_SCHEMA = (
    "event_no int, name string, local_name string, event_start date, event_end date, impact string, "
    "industries array<string>, note string"
)


def seasonal_calendar(spark: SparkSession) -> DataFrame:
    """The 46 known events in calendar order: 22 listed ones and a tax deadline in each month of two years."""
    before, after = len(EVENTS_BEFORE_TAX), len(EVENTS_AFTER_TAX)
    listed = [(i, *e[:5], list(e[5]), e[6]) for i, e in enumerate(EVENTS_BEFORE_TAX)]
    months = 12 * len(TAX_DEADLINE_YEARS)
    listed += [(before + months + i, *e[:5], list(e[5]), e[6]) for i, e in enumerate(EVENTS_AFTER_TAX)]
    first_year = TAX_DEADLINE_YEARS[0]
    month_start = F.add_months(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.col("id").cast("int"))
    first, last = TAX_DEADLINE_DAYS
    deadlines = spark.range(months).select(
        (F.col("id") + before).cast("int").alias("event_no"),
        F.format_string(TAX_DEADLINE_NAME, F.month(month_start), F.year(month_start)).alias("name"),
        F.lit(TAX_DEADLINE_LOCAL).alias("local_name"),
        F.date_add(month_start, first - 1).alias("event_start"),
        F.date_add(month_start, last - 1).alias("event_end"),
        F.lit("dip").alias("impact"),
        F.array().cast("array<string>").alias("industries"),
        F.lit(TAX_DEADLINE_NOTE).alias("note"),
    )
    return spark.createDataFrame(listed, CALENDAR_SCHEMA).unionByName(deadlines)


def _months(first: Column, last: Column) -> Column:
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))


def industry_matches(industry: str | None, industries: Column) -> Column:
    """True without an industry or for events open to all; else a substring match in either direction."""
    if not industry:
        return F.lit(True)
    wanted = F.lit(industry.lower())
    return (F.size(industries) == 0) | F.exists(
        industries, lambda tag: F.contains(F.lower(tag), wanted) | F.contains(wanted, F.lower(tag))
    )


def overlapping_events(
    spans: DataFrame, calendar: DataFrame, industry: str | None = None, start: str = "start", end: str = "end"
) -> DataFrame:
    """Every (span, event) pair whose date ranges share a day, bounds included.

    Both sides are exploded into the months they touch and meet in an equi-join on the month; the pair is kept only
    in the month where the later of the two begins, so no pair comes twice and nothing is compared all against all.
    """
    first, last = F.to_date(start), F.to_date(end)
    left = spans.withColumn("_month", F.explode(_months(first, last)))
    # The calendar is a fixed list of a few dozen events: it is what travels, never the spans.
    right = F.broadcast(calendar.filter(industry_matches(industry, F.col("industries"))).withColumn(
        "_month", F.explode(_months(F.col("event_start"), F.col("event_end")))
    ))
    both_begin = F.trunc(F.greatest(first, F.col("event_start")), "month")
    return (
        left.join(right, "_month")
        .filter((first <= F.col("event_end")) & (F.col("event_start") <= last) & (F.col("_month") == both_begin))
        .drop("_month")
    )


def seasonal_context(
    spans: DataFrame, calendar: DataFrame, industry: str | None = None, start: str = "start", end: str = "end"
) -> DataFrame:
    """Per tenant span: in season or not, the severity modifier, event names and notes in calendar order."""
    hits = overlapping_events(spans, calendar, industry, start, end)
    ordered = F.array_sort(F.collect_list(F.struct("event_no", "name", "note")))
    found = hits.groupBy("tenant").agg(
        F.bool_or(F.col("impact") == "dip").alias("_dip"),
        F.bool_or(F.col("impact") == "spike").alias("_spike"),
        ordered.alias("_events"),
    )
    empty = F.array().cast("array<string>")
    return spans.select("tenant").join(found, "tenant", "left").select(
        "tenant",
        F.col("_events").isNotNull().alias("in_season"),
        F.when(F.col("_events").isNull(), "none")
        .when(F.col("_dip"), "downgrade")
        .when(F.col("_spike"), "upgrade")
        .otherwise("downgrade").alias("severity_modifier"),
        F.coalesce(F.transform("_events", lambda e: e["name"]), empty).alias("events"),
        F.coalesce(F.transform("_events", lambda e: e["note"]), empty).alias("notes"),
    )


def season_around(
    refs: DataFrame, calendar: DataFrame, industry: str | None = None, window_days: int = SEASONAL_WINDOW_DAYS
) -> DataFrame:
    """Season of the days around each tenant's reference date `ref`."""
    day = F.to_date("ref")
    spans = refs.select(
        "tenant", F.date_sub(day, window_days).alias("start"), F.date_add(day, window_days).alias("end")
    )
    return seasonal_context(spans, calendar, industry)
