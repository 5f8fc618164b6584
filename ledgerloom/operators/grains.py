"""One pass over the ledger at several grains; KPIs, most anomalies and segments are derived from its sums.

A grain table looks like a ledger to the operators that sum sales: `amount` and `quantity` are those of the sales, `n_sales` and
`n_rows` say how many sales and rows were summed. Moments are kept as they are, so periods that start at some time of a day
stay exact.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.ledger import require
from ledgerloom.operators.periods import stats_columns
from ledgerloom.plans.joins import pinned
from ledgerloom.plans.shared import staged


class Grains(NamedTuple):
    by_product: DataFrame
    by_customer: DataFrame
    by_date: DataFrame
    stats: DataFrame


def ledger_grains(ledger: DataFrame) -> Grains:
    """Sums per tenant, product and moment, per tenant, customer and moment, per tenant and moment, and the statistics per tenant.

    GROUPING SETS sum all of them while the ledger is read once; rows are combined ahead of the one shuffle, whose keys
    spread a large tenant over its products, customers and moments.
    """
    require(ledger, "tenant", "date", "customer", "product", "amount", "quantity")
    sale = F.col("amount") > 0
    sets = {
        "by_product": ["tenant", "product", "moment"], "by_customer": ["tenant", "customer", "moment"], "stats": ["tenant"],
    }
    keys = ["tenant", "product", "customer", "moment"]
    # `date` is both a key and an argument of the statistics, which must see it where it is not grouped by.
    grouped = ledger.withColumn("moment", F.col("date")).groupingSets([[F.col(k) for k in s] for s in sets.values()], *keys)
    marks = {name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s) for name, s in sets.items()}
    summed = staged(grouped.agg(
        F.grouping_id().alias("grain"),
        F.coalesce(F.sum(F.when(sale, F.col("amount"))), F.lit(0)).cast("decimal(38,2)").alias("amount"),
        F.sum(F.when(sale, F.col("quantity"))).alias("quantity"), *stats_columns(),
    ), "grains")
    part = lambda name, *columns: summed.filter(F.col("grain") == marks[name]).select(*sets[name], *columns)
    sums = ("amount", "quantity", "n_sales", "n_rows")
    by_product, by_customer = (part(n, *sums).withColumnRenamed("moment", "date") for n in ("by_product", "by_customer"))
    by_date = by_customer.groupBy("tenant", "date").agg(
        F.sum("amount").cast("decimal(38,2)").alias("amount"), *[F.sum(c).alias(c) for c in sums[1:]])
    stats = part("stats", *[c for c in summed.columns if c not in (*keys, "grain", "amount", "quantity")])
    return Grains(by_product, by_customer, staged(by_date, "by-date"), pinned(stats))
