"""RFM customer segments."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.fixed_values import SEGMENT_ACTIONS, SEGMENT_DESCRIPTIONS, SEGMENTS, TOP_CUSTOMERS
from ledgerloom.functions.dates import as_moment, whole_days
from ledgerloom.ledger import require
from ledgerloom.operators.periods import tenant_stats
from ledgerloom.plans.joins import lookup_join, pinned, rank_in_group, top_per_group

METRICS = {"recency_days": "r_score", "frequency": "f_score", "monetary": "m_score"}
FEW_VALUES = 5
QUINTILES = 5


def rfm_base(ledger: DataFrame, reference_date=None, stats: DataFrame | None = None) -> DataFrame:
    """Per customer: days since the last row, number of rows (returns included), sum of positive amounts.

    Also over sums of rows, which say in `n_rows` how many they hold.
    """
    stats = tenant_stats(ledger) if stats is None else stats
    frequency = F.sum(F.when(F.col("date").isNotNull(), F.col("n_rows"))) if "n_rows" in ledger.columns else F.count("date")
    per_customer = ledger.filter(F.col("customer").isNotNull()).groupBy("tenant", "customer").agg(
        F.max("date").alias("last_purchase"),
        frequency.alias("frequency"),
        F.coalesce(F.sum(F.when(F.col("amount") > 0, F.col("amount"))), F.lit(0)).cast("double").alias("monetary"),
    )
    ref = F.col("last_date") if reference_date is None else as_moment(reference_date)
    refs = stats.select("tenant", ref.alias("ref"))
    return (
        lookup_join(per_customer, refs, ["tenant"], spread_by=["customer"])
        .withColumn("recency_days", whole_days(F.col("ref"), F.col("last_purchase")))
        .drop("ref", "last_purchase")
    )


def _sizes(base: DataFrame) -> DataFrame:
    """Customers and distinct metric values per tenant; Spark pre-aggregates the distinct counts per value."""
    return base.groupBy("tenant").agg(
        F.count("*").alias("_n"), *[F.count_distinct(m).alias(f"_distinct_{m}") for m in METRICS]
    )


def _edges(ranked: DataFrame) -> DataFrame:
    """Quintile edges and medians per tenant, linearly interpolated between the neighbouring order statistics.

    Only the rows whose rank is one of those few order statistics are kept, so at most 14 values per tenant and metric
    come together.
    """
    last = F.col("_n") - 1
    positions = [last * k / QUINTILES for k in range(QUINTILES + 1)] + [last / 2]
    wanted = F.array(*[(edge(p) + 1).cast("long") for p in positions for edge in (F.floor, F.ceil)])
    picked = {m: F.array_contains(wanted, F.col(f"_rank_{m}")) for m in METRICS}
    any_picked = F.lit(False)
    for hit in picked.values():
        any_picked = any_picked | hit
    collected = ranked.filter(any_picked).groupBy("tenant", "_n").agg(*[
        F.map_from_entries(F.collect_list(F.when(
            picked[m], F.struct(F.col(f"_rank_{m}"), F.col(m).cast("double"))
        ))).alias(f"_at_{m}")
        for m in METRICS
    ])

    def at(metric: str, position: Column) -> Column:
        below = F.floor(position)
        low = F.element_at(f"_at_{metric}", (below + 1).cast("long"))
        high = F.element_at(f"_at_{metric}", (F.ceil(position) + 1).cast("long"))
        return low + (high - low) * (position - below)

    return collected.select("tenant", *[
        column
        for m in METRICS
        for column in (
            F.array(*[at(m, p) for p in positions[:-1]]).alias(f"_edges_{m}"),
            at(m, positions[-1]).alias(f"_median_{m}"),
        )
    ])


def _score(metric: str, low_is_good: bool) -> Column:
    value, edges = F.col(metric).cast("double"), F.col(f"_edges_{metric}")
    bucket = F.lit(QUINTILES)
    for k in range(QUINTILES - 1, 0, -1):
        bucket = F.when(value <= edges[k], k).otherwise(bucket)
    by_quintile = (QUINTILES + 1 - bucket) if low_is_good else bucket
    median = F.col(f"_median_{metric}")
    better, worse = (value < median, value > median) if low_is_good else (value > median, value < median)
    by_median = F.when(better, 5).when(worse, 1).otherwise(3)

    # Few distinct values: five equal-width bins over the rank, in the order the ranking was made.
    n = F.col("_n")
    position = F.col(f"_rank_{metric}") if not low_is_good else F.col(f"_rank_desc_{metric}")
    binned = F.when(n == 1, 3).otherwise(
        F.greatest(F.lit(1), F.ceil(F.round(5 * (position - 1) / (n - 1), 9)).cast("int"))
    )
    tied = F.size(F.array_distinct(edges)) < QUINTILES + 1
    return (
        F.when(F.col(f"_distinct_{metric}") < FEW_VALUES, binned)
        .when(tied, by_median)
        .otherwise(by_quintile)
        .cast("int")
    )


def segment_of(r: Column, f: Column, m: Column) -> Column:
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champion")
        .when((r >= 3) & (f >= 3), "Loyal")
        .when((r >= 4) & (f <= 2), "Potential")
        .when((r <= 2) & (f >= 3), "At Risk")
        .when((r <= 2) & (f <= 2) & (m <= 2), "Lost")
        .when((f == 1) & (r >= 4), "New")
        .otherwise("Average")
    )


def score_customers(base: DataFrame, window_rows: int | None = None) -> DataFrame:
    """Scores 1 to 5 for each metric within the tenant.

    Quintile edges are exact order statistics read off an exact rank, so no tenant's customers have to fit in one
    task. The descending recency rank (ties by name) exists for the few-values rule only.
    """
    base = pinned(base)
    sizes = pinned(_sizes(base))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    ranked = lookup_join(base, sizes, ["tenant"], spread_by=["customer"]).withColumn(
        "_minus_recency", -F.col("recency_days")
    )
    rankings = {f"_rank_{m}": m for m in METRICS} | {"_rank_desc_recency_days": "_minus_recency"}
    for rank, metric in rankings.items():
        ranked = rank_in_group(ranked, ["tenant"], [metric, "customer"], rank, window_rows, largest)
    ranked = pinned(ranked)
    scored = lookup_join(ranked, _edges(ranked), ["tenant"], spread_by=["customer"])
    for metric, score in METRICS.items():
        scored = scored.withColumn(score, _score(metric, low_is_good=metric == "recency_days"))
    return scored.select("tenant", "customer", *METRICS, *METRICS.values())


def segment_texts(spark: SparkSession) -> DataFrame:
    rows = [(s, SEGMENT_DESCRIPTIONS[s], SEGMENT_ACTIONS[s]) for s in SEGMENTS]
    return spark.createDataFrame(rows, "segment string, description string, action string")


def customer_segments(
    ledger: DataFrame, reference_date=None, stats: DataFrame | None = None, window_rows: int | None = None
) -> DataFrame:
    """All customers with their scores, segment, description and action."""
    require(ledger, "tenant", "customer", "date", "amount")
    scored = score_customers(rfm_base(ledger, reference_date, stats), window_rows)
    r, f, m = (F.col(c) for c in METRICS.values())
    labelled = scored.withColumn("rfm_score", F.concat(*METRICS.values())).withColumn("segment", segment_of(r, f, m))
    return labelled.join(F.broadcast(segment_texts(ledger.sparkSession)), "segment")  # seven fixed rows


def top_customers(segments: DataFrame, n: int = TOP_CUSTOMERS) -> DataFrame:
    return top_per_group(segments, ["tenant"], [F.desc("monetary"), F.asc("customer")], n)


def segment_counts(segments: DataFrame) -> DataFrame:
    """Customers per segment, one zero-filled column each, and in total."""
    return segments.groupBy("tenant").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("segment") == s).alias(s.lower().replace(" ", "_")) for s in SEGMENTS],
    )


def in_segment(segments: DataFrame, segment: str) -> DataFrame:
    return segments.filter(F.lower("segment") == segment.lower())
