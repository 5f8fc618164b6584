"""KPIs per tenant: revenue, top products, dead stock, customer split, trends, insights."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_texts as T
from ledgerloom.fixed_values import (
    CHART_DAYS,
    DEAD_STOCK_DAYS,
    INSIGHT_PCT,
    PERIOD_LABELS,
    TOP_PRODUCTS,
    TREND_PCT,
)
from ledgerloom.functions.amounts import format_inr, rupees
from ledgerloom.functions.dates import whole_days
from ledgerloom.functions.text import fill, fixed
from ledgerloom.ledger import require, sales
from ledgerloom.operators.grains import Grains
from ledgerloom.operators.periods import is_current, is_previous, period_bounds, tenant_stats, with_periods
from ledgerloom.plans.joins import lookup_join, top_per_group

MONEY = "decimal(38,2)"


def money_sum(condition: Column | None = None) -> Column:
    """Exact decimal sum, 0 over no rows."""
    value = F.col("amount") if condition is None else F.when(condition, F.col("amount"))
    return F.coalesce(F.sum(value), F.lit(0)).cast(MONEY)


def change_pct(current: Column, previous: Column) -> Column:
    """Change in percent, half up to two places; null without earlier revenue."""
    return F.when(previous != 0, percent_of(current - previous, previous))


def percent_of(part: Column, whole: Column) -> Column:
    """part / whole in percent; narrow enough types that the quotient keeps 12 places before it is rounded to two."""
    hundredfold = part.cast("decimal(22,2)") * F.lit(100)
    return F.round(F.try_divide(hundredfold, whole.cast("decimal(22,2)")), 2).cast("decimal(20,2)")


def trend(pct: Column) -> Column:
    return (
        F.when(pct.isNull(), "new").when(pct > TREND_PCT, "up").when(pct < -TREND_PCT, "down").otherwise("flat")
    )


def _bounds(ledger: DataFrame, stats: DataFrame | None, reference_date) -> DataFrame:
    return period_bounds(tenant_stats(ledger) if stats is None else stats, reference_date)


def revenue(ledger: DataFrame, reference_date=None, stats: DataFrame | None = None) -> DataFrame:
    """Revenue of the current and the previous period, one row per tenant."""
    require(ledger, "tenant", "date", "amount")
    bounds = _bounds(ledger, stats, reference_date)
    sums = (
        with_periods(sales(ledger).select("tenant", "date", "amount"), bounds, within=True)
        .filter(is_current() | is_previous())
        .groupBy("tenant")
        .agg(money_sum(is_current()).alias("current_revenue"), money_sum(is_previous()).alias("previous_revenue"))
    )
    label = F.create_map(*[F.lit(x) for pair in PERIOD_LABELS.items() for x in pair])
    zero = F.lit(0).cast(MONEY)
    return (
        bounds.join(sums, "tenant", "left")
        .withColumn("current_revenue", F.coalesce("current_revenue", zero))
        .withColumn("previous_revenue", F.coalesce("previous_revenue", zero))
        .withColumn("change_amount", (F.col("current_revenue") - F.col("previous_revenue")).cast(MONEY))
        .withColumn("change_pct", change_pct(F.col("current_revenue"), F.col("previous_revenue")))
        .withColumn("trend", trend(F.col("change_pct")))
        .select(
            "tenant", F.col("start").alias("period_start"), F.col("ref").alias("period_end"), "n_days",
            "current_revenue", "previous_revenue", "change_amount", "change_pct", "trend",
            label[F.col("n_days")].alias("period_label"),
        )
    )


def top_products(
    ledger: DataFrame, n: int = TOP_PRODUCTS, reference_date=None, stats: DataFrame | None = None
) -> DataFrame:
    """The best sellers of the current period against the previous one; ties go by product name."""
    bounds = _bounds(ledger, stats, reference_date)
    columns = ["tenant", "date", "product", "amount", "quantity"]
    rows = with_periods(sales(ledger).select(*columns), bounds, ["product", "date"], within=True)
    per_product = (
        rows.filter(is_current() | is_previous())
        .groupBy("tenant", "product")
        .agg(
            money_sum(is_current()).alias("revenue"),
            money_sum(is_previous()).alias("previous_revenue"),
            F.count_if(is_current()).alias("_lines"),
            F.coalesce(F.sum(F.when(is_current(), F.col("quantity"))), F.lit(0)).cast("long").alias("units_sold"),
        )
        .filter((F.col("_lines") > 0) & F.col("product").isNotNull())
        .drop("_lines")
    )
    pct = change_pct(F.col("revenue"), F.col("previous_revenue"))
    return (
        top_per_group(per_product, ["tenant"], [F.desc("revenue"), F.asc("product")], n)
        .withColumn("change_pct", pct)
        .withColumn("trend", trend(F.col("change_pct")))
    )


def last_sales(ledger: DataFrame, entity: str, reference_date=None, stats: DataFrame | None = None) -> DataFrame:
    """Per tenant and product (or customer): last sale, days since, total and number of sales.

    Also over sums of sales, which say in `n_sales` how many they hold.
    """
    n_sales = F.sum("n_sales") if "n_sales" in ledger.columns else F.count("*")
    per_entity = (
        sales(ledger).filter(F.col(entity).isNotNull())
        .groupBy("tenant", entity)
        .agg(F.max("date").alias("last_sale_date"), money_sum().alias("total"), n_sales.alias("n_sales"))
    )
    refs = _bounds(ledger, stats, reference_date).select("tenant", "ref")
    return (
        lookup_join(per_entity, refs, ["tenant"], spread_by=[entity])
        .withColumn("days_since_sale", whole_days(F.col("ref"), F.col("last_sale_date")))
        .drop("ref")
    )


def dead_stock(ledger: DataFrame, reference_date=None, stats: DataFrame | None = None) -> DataFrame:
    """Products once sold but not in the last 14 days, with their whole historical revenue."""
    return (
        last_sales(ledger, "product", reference_date, stats)
        .filter(F.col("days_since_sale") > DEAD_STOCK_DAYS)
        .select("tenant", "product", "days_since_sale", "last_sale_date", F.col("total").alias("locked_value"))
    )


def customer_split(ledger: DataFrame, reference_date=None, stats: DataFrame | None = None) -> DataFrame:
    """New and repeat customers of the current period, one row per tenant."""
    bounds = _bounds(ledger, stats, reference_date)
    rows = with_periods(
        sales(ledger).select("tenant", "date", "customer", "amount"), bounds, ["customer", "date"]
    ).filter(F.col("customer").isNotNull())
    per_customer = (
        rows.groupBy("tenant", "customer")
        .agg(
            F.min("date").alias("_first"),
            F.max("start").alias("_start"),
            F.count_if(is_current()).alias("_lines"),
            money_sum(is_current()).alias("amount"),
        )
        .filter(F.col("_lines") > 0)
    )
    is_new = F.col("_first") >= F.col("_start")
    split = per_customer.groupBy("tenant").agg(
        F.count_if(is_new).alias("new_customers"),
        F.count_if(~is_new).alias("repeat_customers"),
        money_sum(is_new).alias("new_revenue"),
        money_sum(~is_new).alias("repeat_revenue"),
    )
    total = F.col("new_revenue") + F.col("repeat_revenue")
    share = percent_of(F.col("new_revenue"), total)
    filled = bounds.select("tenant").join(split, "tenant", "left").na.fill(
        0, ["new_customers", "repeat_customers"]
    )
    for column in ("new_revenue", "repeat_revenue"):
        filled = filled.withColumn(column, F.coalesce(column, F.lit(0).cast(MONEY)))
    return filled.withColumn(
        "new_revenue_pct", F.when(total > 0, share).otherwise(F.lit(0)).cast("decimal(20,2)")
    )


def daily_revenue(ledger: DataFrame) -> DataFrame:
    """Positive sales per calendar day."""
    return (
        sales(ledger).groupBy("tenant", F.to_date("date").alias("day")).agg(money_sum().alias("revenue"))
    )


def chart_revenue(ledger: DataFrame, n: int = CHART_DAYS) -> DataFrame:
    """All amounts, returns included, for the last 60 dates of each tenant."""
    per_date = ledger.groupBy("tenant", "date").agg(money_sum().alias("revenue"))
    return top_per_group(per_date, ["tenant"], [F.desc("date")], n).drop("rank")


def kpis(ledger: DataFrame, reference_date=None, stats: DataFrame | None = None, grains: Grains | None = None) -> dict[str, DataFrame]:
    """The KPI tables together; they share one pass for the tenant statistics, and with `grains` do not read the ledger at all."""
    require(ledger, "tenant", "date", "amount", "customer", "product")
    if grains is None:
        stats = tenant_stats(ledger) if stats is None else stats
        grains = Grains(ledger, ledger, ledger, stats)
    stats = grains.stats
    return {
        "revenue": revenue(grains.by_date, reference_date, stats),
        "top_products": top_products(grains.by_product, TOP_PRODUCTS, reference_date, stats),
        "dead_stock": dead_stock(grains.by_product, reference_date, stats),
        "customer_split": customer_split(grains.by_customer, reference_date, stats),
        "daily_revenue": daily_revenue(grains.by_date),
    }


def insights(revenue_table: DataFrame, dead: DataFrame, top: DataFrame) -> DataFrame:
    """Rule-based insights per tenant: growth or decline (1), slow products (2), top seller (3)."""
    dead_counts = dead.groupBy("tenant").agg(F.count("*").alias("n_dead"))
    best = top.filter("rank = 1").select("tenant", F.col("product").alias("best"), F.col("revenue").alias("best_rev"))
    facts = (
        revenue_table.select("tenant", "change_pct")
        .join(dead_counts, "tenant", "left")
        .join(best, "tenant", "left")
    )
    pct = F.col("change_pct").cast("double")

    def insight(condition: Column, kind: str, texts: tuple[str, str], priority: int, **values: Column) -> Column:
        title, text = (fill(t, **values) for t in texts)
        return F.when(
            condition,
            F.struct(
                F.lit(kind).alias("type"),
                title.alias("title"),
                text.alias("insight"),
                F.lit(priority).alias("priority"),
            ),
        )

    rules = F.array(
        insight(pct >= INSIGHT_PCT, "celebration", T.GROWTH, 1, pct=fixed(pct)),
        insight(pct <= -INSIGHT_PCT, "warning", T.DECLINE, 1, pct=fixed(F.abs(pct))),
        insight(F.col("n_dead") > 0, "action", T.SLOW_PRODUCTS, 2, n=F.col("n_dead")),
        insight(F.col("best").isNotNull(), "opportunity", T.TOP_SELLER, 3, product=F.col("best"), revenue=rupees(F.col("best_rev"))),
    )
    return facts.select("tenant", F.explode(F.array_compact(rules)).alias("i")).select("tenant", "i.*")


def summary(tables: dict[str, DataFrame], dead_items: int = 5) -> DataFrame:
    """One compact nested row per tenant: revenue, best products, dead stock and customer split, plus its JSON."""
    rev, top, dead, split = (tables[t] for t in ("revenue", "top_products", "dead_stock", "customer_split"))
    products = top.groupBy("tenant").agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", F.col("product").alias("name"), F.col("revenue").cast("double").alias("revenue"),
            format_inr(F.col("revenue")).alias("revenue_text"), "trend",
        ))).alias("top_products")
    )
    order = [F.desc("days_since_sale"), F.asc("product")]
    items = top_per_group(dead, ["tenant"], order, dead_items).groupBy("tenant").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "product", "days_since_sale"))),
            lambda item: F.struct(item["product"].alias("product"), item["days_since_sale"].alias("days_since_sale")),
        ).alias("dead_stock")
    )
    counts = dead.groupBy("tenant").agg(F.count("*").alias("dead_stock_count"))
    joined = rev
    for table in (products, items, counts, split):
        joined = joined.join(table, "tenant", "left")
    body = F.struct(
        F.col("current_revenue").cast("double").alias("current_revenue"),
        format_inr(F.col("current_revenue")).alias("current_revenue_text"),
        F.col("previous_revenue").cast("double").alias("previous_revenue"),
        F.col("change_amount").cast("double").alias("change_amount"),
        F.col("change_pct").cast("double").alias("change_pct"),
        "trend", "period_label", "top_products",
        F.coalesce("dead_stock_count", F.lit(0)).alias("dead_stock_count"), "dead_stock",
        F.struct(
            F.col("new_customers").alias("new"), F.col("repeat_customers").alias("repeat"),
            F.col("new_revenue_pct").cast("double").alias("new_revenue_pct"),
        ).alias("customer_split"),
    )
    return joined.select("tenant", "period_start", "period_end", body.alias("metrics")).withColumn(
        "metrics_json", F.to_json("metrics")
    )
