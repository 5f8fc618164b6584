"""The given tables seen as the operational tables of the product: clients, uploads, analyses, users, messages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.ledger import read_table

AS_OF = "2001-08-02"
AS_OF_FLAGS = "2001-03-01"
ANALYSIS_ID_BASE = 1_000_000_000_000


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"), F.col("c_nationkey").alias("owner_id"),
        F.col("c_name").alias("client_name"), (F.col("c_acctbal") > 0).alias("active"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("upload_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_custkey").alias("client_id"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("file_name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "excel").when(F.col("o_orderpriority") == "5-LOW", "pdf")
        .otherwise("csv").alias("file_type"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending")
        .otherwise("processing").alias("status"),
        (F.floor("o_totalprice") % 120).cast("int").alias("data_health_score"),
        F.col("o_orderdate").alias("created_at"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis per order with lines, its numbers packed into JSON as they are stored."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    per_order = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(price).alias("revenue"), F.sum(F.when(F.col("l_returnflag") == "R", price)).alias("returned"),
        F.count("*").alias("lines"), F.count_if(F.col("l_quantity") > 40).alias("high"),
        F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"),
        F.min("l_partkey").alias("part"),
    )
    trend = F.when(F.col("returned").isNull(), "up").when(F.col("returned") * 2 > F.col("revenue"), "down").otherwise(
        "flat"
    )
    change = F.when(trend == "up", 12.5).when(trend == "down", -20.25).otherwise(0.0)
    order = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    name = F.concat(F.lit("Part "), F.col("part").cast("string"))
    return per_order.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_orderkey") + ANALYSIS_ID_BASE).alias("analysis_id"), F.col("o_orderkey").alias("upload_id"),
        F.col("o_custkey").alias("user_id"), F.to_date("first").alias("period_start"),
        F.to_date("last").alias("period_end"),
        F.to_json(F.struct(
            F.col("revenue").alias("current_revenue"), change.alias("change_pct"), trend.alias("trend"),
            F.array(F.struct(name.alias("name"))).alias("top_products"),
        )).alias("metrics"),
        F.to_json(F.struct(F.col("lines").alias("total"), F.col("high").alias("high_count"))).alias("anomalies"),
        F.col("last").alias("created_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").join(
        F.broadcast(read_table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        key.alias("user_id"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("name"),
        F.when(key % 7 == 0, "").when(key % 11 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("+91"), F.lpad(key.cast("string"), 10, "9"))).alias("phone"),
        F.when(F.col("c_mktsegment") == "BUILDING", "ca_firm").otherwise("smb_owner").alias("user_type"),
        F.when(key % 3 == 0, "hi").when(key % 3 == 1, "en").otherwise("hinglish").alias("language_preference"),
        (F.col("c_acctbal") > 0).alias("whatsapp_opted_in"), (key % 2 == 0).alias("notify_weekly"),
        (key % 5 == 0).alias("notify_monthly"), (key % 4 != 0).alias("notify_on_anomaly"),
        F.col("n_name").alias("tenant"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored report per finished order."""
    order = read_table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    hindi = F.col("o_orderkey") % 2 == 0
    text = F.concat(F.lit("Revenue ₹"), F.format_number("o_totalprice", 0))
    return order.select(
        F.col("o_orderkey").alias("report_id"), (F.col("o_orderkey") + ANALYSIS_ID_BASE).alias("analysis_id"),
        F.col("o_custkey").alias("user_id"), F.lit("weekly").alias("report_type"),
        F.when(hindi, "hi").otherwise("en").alias("language"), F.when(hindi, text).alias("content_hindi"),
        F.when(~hindi, text).alias("content_english"), F.col("o_orderdate").alias("created_at"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as the message log; every third turn is known only by its phone."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return read_table(spark, sf_dir, "conversations").select(
        F.format_string("%08d-%04d", "conv_id", "turn").alias("message_id"),
        F.when(turn % 3 != 2, conv).alias("user_id"),
        F.concat(F.lit("91"), F.lpad(conv.cast("string"), 10, "0")).alias("phone_number"),
        F.when(F.col("role") == "user", "inbound").when(F.col("role") == "assistant", "outbound")
        .otherwise("internal").alias("direction"),
        F.col("text").alias("message_text"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), turn.cast("int"))).alias(
            "created_at"
        ),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return read_table(spark, sf_dir, "conversations").select(conv).distinct().select(
        conv.alias("contact_id"), conv.alias("user_id"),
        F.concat(F.lit("91"), F.lpad(conv.cast("string"), 10, "0")).alias("phone"),
    )


def waitlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").filter(key % 3 != 0).select(
        F.concat(F.lit("+91"), F.lpad(key.cast("string"), 10, "9")).alias("phone"), F.col("c_name").alias("name"),
        (key % 4 != 0).alias("approved"),
    )
