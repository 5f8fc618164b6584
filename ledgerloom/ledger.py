"""The ledger: one row per sold or returned line, for all tenants together."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.shared import SMALL_FILES, already_staged, over_all_cores, staged

LEDGER_SCHEMA = T.StructType([
    T.StructField("tenant", T.StringType()),
    T.StructField("row_id", T.StringType()),
    T.StructField("voucher_id", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("customer", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("amount", T.DecimalType(18, 2)),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("vch_type", T.StringType()),
    T.StructField("source", T.StringType()),
])
"""`row_id` comes from the data, is unique within a tenant, and sorts in the order of the source rows."""


def conform(df: DataFrame) -> DataFrame:
    """Project onto the ledger schema; columns that are absent, and amounts too large to hold, become null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in LEDGER_SCHEMA
    ])


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"ledger lacks the columns {missing}")


def sales(ledger: DataFrame) -> DataFrame:
    """Positive amounts only: returns do not count towards KPIs and anomalies."""
    return ledger.filter(F.col("amount") > 0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> Column:
    return F.format_string(
        "%012d-%d-%010d-%08d-%s", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.date_format("l_shipdate", "yyyyMMdd"),
    )


def ledger_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order tables seen as the ledgers of 25 businesses, one per customer nation; returned lines are negative.

    Orders get their customers and lines their products before the two meet, so that lines are shuffled twice at most.
    """
    line, order, customer, part, nation = (
        read_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part", "nation")
    )
    price, discount = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    value = F.round(price * (1 - discount), 2).cast("decimal(18,2)")
    owned = (
        order.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    named = part.select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("product"))
    return conform(
        over_all_cores(line).join(named, F.col("l_partkey") == F.col("p_partkey"))
        .join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("n_name").alias("tenant"),
            row_key().alias("row_id"),
            F.col("l_orderkey").cast("string").alias("voucher_id"),
            F.col("o_orderdate").alias("date"),
            F.col("c_name").alias("customer"),
            "product",
            F.when(F.col("l_returnflag") == "R", -value).otherwise(value).alias("amount"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_returnflag").alias("vch_type"),
            F.lit("orders").alias("source"),
        )
    )


def staged_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of `sf_dir`, joined once per application and kept as a table in the shared folder."""
    ready = already_staged(spark, "ledger", sf_dir)
    return ready if ready is not None else staged(ledger_from_orders(spark, sf_dir), "ledger", sf_dir, SMALL_FILES)
