"""Portfolio and history queries over the operational tables, for all owners in one job.

Tables and the columns used: clients(client_id, owner_id, client_name, active, ...), uploads(upload_id, user_id,
client_id, data_health_score, created_at, ...), analyses(analysis_id, upload_id, user_id, period_start, period_end,
metrics, anomalies, created_at) with JSON text in metrics and anomalies, reports(report_id, analysis_id, user_id, ...).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.fixed_values import ALERT_CLIENTS, ANALYSIS_MAX_AGE_DAYS, AT_RISK_DAYS, RECENT_ALERT_DAYS
from ledgerloom.functions.dates import as_moment, day_shift
from ledgerloom.functions.text import json_number
from ledgerloom.plans.joins import lookup_join, top_per_group


def days_before(as_of, days: int) -> Column:
    return day_shift(as_moment(as_of), F.lit(-days))


def page(df: DataFrame, group: list[str], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset+1 to offset+limit of every group."""
    return top_per_group(df, group, order, offset + limit, "position").filter(F.col("position") > offset)


def client_stats(clients: DataFrame, uploads: DataFrame) -> DataFrame:
    """Each client with number, time and scores of its uploads; clients without uploads stay."""
    per_client = uploads.filter(F.col("client_id").isNotNull()).groupBy("client_id").agg(
        F.count("*").alias("upload_count"),
        F.max("created_at").alias("last_upload_at"),
        F.avg("data_health_score").alias("avg_health_score"),
        F.max("data_health_score").alias("latest_health_score"),
        F.max_by("data_health_score", F.struct("created_at", "upload_id")).alias("last_health_score"),
    )
    return clients.join(per_client, "client_id", "left").na.fill(0, ["upload_count"])


def dashboard(clients: DataFrame, uploads: DataFrame, as_of) -> DataFrame:
    """Per owner: clients, active clients, uploads, clients silent for 30 days, mean health score."""
    silent = F.col("last_upload_at").isNull() | (F.col("last_upload_at") < days_before(as_of, AT_RISK_DAYS))
    return client_stats(clients, uploads).groupBy("owner_id").agg(
        F.count("*").alias("total_clients"),
        F.count_if("active").alias("active_clients"),
        F.coalesce(F.sum("upload_count"), F.lit(0)).alias("total_uploads"),
        F.count_if(silent).alias("clients_at_risk"),
        F.round(F.avg("avg_health_score")).cast("int").alias("portfolio_health_score"),
    )


def recent_alerts(
    clients: DataFrame, uploads: DataFrame, analyses: DataFrame, as_of, n: int = ALERT_CLIENTS
) -> DataFrame:
    """Per owner: clients with HIGH anomalies in the last 7 days, most alerts first (numeric order)."""
    high = json_number(F.col("anomalies"), "$.high_count", "int")
    recent = (
        analyses.filter(F.col("created_at") > days_before(as_of, RECENT_ALERT_DAYS))
        .select("upload_id", high.alias("high_alerts"), "period_end")
        .filter(F.col("high_alerts") > 0)
    )
    owned = recent.join(uploads.select("upload_id", "client_id"), "upload_id")
    named = lookup_join(
        owned, clients.select("client_id", "owner_id", "client_name"), ["client_id"], spread_by=["upload_id"]
    ).select("owner_id", "client_id", "client_name", "high_alerts", "period_end").distinct()
    order = [F.desc("high_alerts"), F.asc("client_id"), F.desc("period_end")]
    return top_per_group(named, ["owner_id"], order, n, "position")


def client_list(
    clients: DataFrame, uploads: DataFrame, active_only: bool = True, limit: int = 50, offset: int = 0
) -> DataFrame:
    """A page of every owner's clients by name, with upload counts and scores."""
    shown = clients.filter("active") if active_only else clients
    return page(
        client_stats(shown, uploads), ["owner_id"], [F.asc("client_name"), F.asc("client_id")], limit, offset
    )


def client_detail(clients: DataFrame, uploads: DataFrame, owner_id, client_id) -> DataFrame:
    own = clients.filter((F.col("owner_id") == F.lit(owner_id)) & (F.col("client_id") == F.lit(client_id)))
    return client_stats(own, uploads.filter(F.col("client_id") == F.lit(client_id)))


def row_counts(table: DataFrame, owner_column: str) -> DataFrame:
    """Rows per owner, for paging."""
    return table.groupBy(owner_column).agg(F.count("*").alias("total"))


def _analysis_facts(analyses: DataFrame) -> DataFrame:
    return analyses.select(
        "analysis_id", "upload_id",
        json_number(F.col("metrics"), "$.current_revenue").alias("revenue"),
        F.get_json_object("metrics", "$.trend").alias("trend"),
    )


def upload_history(uploads: DataFrame, analyses: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of every client's uploads, newest first, with revenue and trend where an analysis exists."""
    joined = uploads.filter(F.col("client_id").isNotNull()).join(_analysis_facts(analyses), "upload_id", "left")
    order = [F.desc("created_at"), F.desc("upload_id"), F.desc("analysis_id")]
    return page(joined, ["client_id"], order, limit, offset)


def analysis_history(
    analyses: DataFrame, uploads: DataFrame, limit: int = 20, offset: int = 0
) -> DataFrame:
    """A page of every user's analyses, newest first, with file facts and headline numbers."""
    files = uploads.select("upload_id", "file_name", "file_type", "data_health_score")
    rows = analyses.join(files, "upload_id").select(
        "user_id", "analysis_id", "upload_id", "file_name", "file_type", "data_health_score", "period_start",
        "period_end", "created_at",
        json_number(F.col("metrics"), "$.current_revenue", "decimal(38,2)").alias("current_revenue"),
        F.get_json_object("metrics", "$.trend").alias("trend"),
        F.coalesce(json_number(F.col("anomalies"), "$.total", "int"), F.lit(0)).alias("anomaly_count"),
    )
    return page(rows, ["user_id"], [F.desc("created_at"), F.desc("analysis_id")], limit, offset)


def fetch_analysis(analyses: DataFrame, uploads: DataFrame, upload_id, user_id) -> DataFrame:
    own = analyses.filter((F.col("upload_id") == F.lit(upload_id)) & (F.col("user_id") == F.lit(user_id)))
    return own.join(uploads.select("upload_id"), "upload_id")


def upload_status(uploads: DataFrame, analyses: DataFrame) -> DataFrame:
    """Every upload with its processing state and, once there is one, its analysis."""
    return uploads.join(analyses.select("upload_id", "analysis_id"), "upload_id", "left")


def report_list(reports: DataFrame, analyses: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of every user's reports, newest first, with the period analysed."""
    joined = reports.join(analyses.select("analysis_id", "period_start", "period_end"), "analysis_id")
    return page(joined, ["user_id"], [F.desc("created_at"), F.desc("report_id")], limit, offset)


def fetch_report(reports: DataFrame, analyses: DataFrame, report_id, user_id) -> DataFrame:
    own = reports.filter((F.col("report_id") == F.lit(report_id)) & (F.col("user_id") == F.lit(user_id)))
    content = F.coalesce(
        F.nullif("content_hindi", F.lit("")), F.nullif("content_english", F.lit("")), F.lit("")
    )
    return own.join(analyses.select("analysis_id", "period_start", "period_end"), "analysis_id").withColumn(
        "content", content
    )


def analysis_by_any_id(analyses: DataFrame, uploads: DataFrame, some_id, user_id) -> DataFrame:
    """The analysis whose own id or upload id is `some_id`."""
    wanted = F.lit(some_id)
    own = analyses.filter(
        (F.col("user_id") == F.lit(user_id)) & ((F.col("analysis_id") == wanted) | (F.col("upload_id") == wanted))
    )
    return own.join(uploads.select("upload_id"), "upload_id")


def latest_analyses(analyses: DataFrame, as_of=None, max_age_days: int | None = ANALYSIS_MAX_AGE_DAYS) -> DataFrame:
    """The newest analysis of every user, if not older than `max_age_days`: a maximum, found map-side first."""
    recent = analyses
    if max_age_days is not None:
        recent = analyses.filter(F.col("created_at") > days_before(as_of, max_age_days))
    rest = [c for c in analyses.columns if c != "user_id"]
    return (
        recent.groupBy("user_id")
        .agg(F.max_by(F.struct(*rest), F.struct("created_at", "analysis_id")).alias("_latest"))
        .select("user_id", "_latest.*")
    )
