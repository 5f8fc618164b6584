"""Outlier weeks by a robust score: distance from the tenant's median week in units of the median distance."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.fixed_values import MIN_WEEKS_OUTLIER, OUTLIER_SHARE

# Makes the median distance comparable to a standard deviation of normal data.
NORMAL_SCALE = 1.4826


def outlier_weeks(weekly: DataFrame) -> DataFrame:
    """The most unusual tenth of the weeks of each tenant, with scores in [-1, 0]: the lower, the more unusual.

    A window holds one tenant's weekly series, whose length is bounded by the calendar, not by the number of sales.
    """
    own = Window.partitionBy("tenant")
    revenue = F.col("revenue").cast("double")
    middled = weekly.select("tenant", "week_end", "revenue").withColumns({
        "_weeks": F.count("*").over(own), "_gap": F.abs(revenue - F.percentile(revenue, F.lit(0.5)).over(own)),
    })
    scaled = middled.withColumn("_scale", F.percentile("_gap", F.lit(0.5)).over(own) * NORMAL_SCALE)
    size = F.when(F.col("_gap") == 0, 0.0).otherwise(F.col("_gap") / (F.col("_gap") + F.col("_scale")))
    scored = scaled.withColumn("anomaly_score", -size)
    scored = scored.withColumn("_limit", F.percentile("anomaly_score", F.lit(OUTLIER_SHARE)).over(own))
    return scored.filter((F.col("_weeks") >= MIN_WEEKS_OUTLIER) & (F.col("anomaly_score") < F.col("_limit"))).select(
        "tenant", "week_end", "revenue", "anomaly_score"
    )
