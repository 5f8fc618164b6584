import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.joins import lookup_join, rank_in_group, top_per_group


def skewed(spark):
    """A third of the rows under one key."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.col("id"), (F.col("id") * 7919 % 101).alias("v"),
    )


def test_lookup_join_is_the_same_with_and_without_broadcast(spark):
    rows = skewed(spark)
    lookup = rows.groupBy("k").agg(F.max("id").alias("top")).filter("k != 'k7'")
    for how in ("inner", "left"):
        small = lookup_join(rows, lookup, ["k"], how).collect()
        large = lookup_join(rows, lookup, ["k"], how, spread_by=["id"], broadcast_rows=0).collect()
        assert sorted(small) == sorted(large)


def test_salted_join_spreads_a_hot_key(spark):
    rows = skewed(spark)
    lookup = rows.groupBy("k").agg(F.max("id").alias("top"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(rows, lookup, ["k"], spread_by=["id"], broadcast_rows=0)
        tasks = joined.filter("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks > 4


def test_rank_is_the_same_in_slices(spark):
    rows = skewed(spark)
    window = rank_in_group(rows, ["k"], ["v", "id"], "r")
    slices = rank_in_group(rows, ["k"], ["v", "id"], "r", window_rows=10)
    assert sorted(window.collect()) == sorted(slices.select(window.columns).collect())


def test_top_per_group_limits_before_the_shuffle(spark):
    top = top_per_group(skewed(spark), ["k"], [F.desc("v"), F.asc("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert top.filter("k = 'hot'").count() == 2


@pytest.mark.parametrize("salts", [1, 32])
def test_copies_of_a_large_lookup_side_are_not_broadcast(spark, salts):
    """Spark takes them to be as small as the table that they are copies of."""
    left, right = (spark.range(n).select((F.col("id") % 50).alias("k"), F.col("id").alias(c)) for n, c in ((1000, "v"), (50, "w")))
    joined = lookup_join(left, right, ["k"], broadcast_rows=0, salts=salts)
    assert joined.count() == 1000
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
