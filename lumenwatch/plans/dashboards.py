"""Operational queries over logs, analyses and alerts.

``as_of`` is a timestamp column (usually a literal) in place of the wall clock. Time predicates reach the
scan, and each query reads a table once: several figures of one table come from one conditional aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenwatch.functions.columns import confidence_bucket, is_error, iso8601, since

# Default and greatest limits of the three listings, and the columns of the second.
LOG_LIMITS, ANALYSIS_LIMITS, ALERT_LIMITS = (100, 1000), (20, 200), (50, 500)
ANALYSIS_COLUMNS = (
    "id", "analyzed_at", "service_name", "anomaly_id", "anomaly_score", "severity", "root_cause", "confidence",
    "recommended_action", "affected_services", "escalate_to", "success",
)


def newest(table: DataFrame, ts: str, limit: int, greatest: int, **equals: str | None) -> DataFrame:
    """Newest rows first under optional equality filters (F1-F3, T1); the id breaks ties."""
    if not 1 <= limit <= greatest:
        raise ValueError(f"limit must be between 1 and {greatest}")
    for name, value in equals.items():
        if value:
            table = table.where(F.col(name) == value)
    return table.orderBy(F.desc(ts), F.desc("id")).limit(limit)


def list_logs(logs: DataFrame, service_name: str | None = None, level: str | None = None, limit: int = LOG_LIMITS[0]) -> DataFrame:
    return newest(logs, "timestamp", limit, LOG_LIMITS[1], service_name=service_name, level=level)


def list_analyses(
    analyses: DataFrame, service_name: str | None = None, severity: str | None = None, limit: int = ANALYSIS_LIMITS[0]
) -> DataFrame:
    shown = analyses.select(*[c for c in ANALYSIS_COLUMNS if c in analyses.columns])
    return newest(shown, "analyzed_at", limit, ANALYSIS_LIMITS[1], service_name=service_name, severity=severity)


def list_alerts(
    alerts: DataFrame, service_name: str | None = None, severity: str | None = None, status: str | None = None,
    limit: int = ALERT_LIMITS[0],
) -> DataFrame:
    return newest(alerts, "created_at", limit, ALERT_LIMITS[1], service_name=service_name, severity=severity, status=status)


# ---- logs --------------------------------------------------------------------------------------


def log_volume(logs: DataFrame, as_of: Column) -> DataFrame:
    """Logs of the last 24 h per level, with the overall total (A3)."""
    by_level = logs.where(since(F.col("timestamp"), as_of, "24 HOURS")).groupBy("level").agg(F.count("*").alias("cnt"))
    # At most one row per level reaches this window.
    return by_level.withColumn("total", F.sum("cnt").over(Window.partitionBy()))


def error_rate_percent(level: Column) -> Column:
    """Share of error logs in percent, 2 digits; null without logs."""
    return F.round(F.try_divide(F.count_if(is_error(level)), F.count("*")) * 100, 2)


def error_rate_last_hour(logs: DataFrame, as_of: Column) -> DataFrame:
    """One row; 0 when there are no logs (A4)."""
    recent = logs.where(since(F.col("timestamp"), as_of, "1 HOUR"))
    return recent.agg(F.coalesce(error_rate_percent(F.col("level")), F.lit(0.0)).alias("error_rate_last_1h_pct"))


def busiest_services(logs: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """Most logs in 24 h."""
    recent = logs.where(since(F.col("timestamp"), as_of, "24 HOURS"))
    counts = recent.groupBy("service_name").agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "service_name").limit(limit)


def known_services(logs: DataFrame, as_of: Column) -> DataFrame:
    """Services seen in 7 days, sorted (A5)."""
    recent = logs.where(since(F.col("timestamp"), as_of, "7 DAYS"))
    return recent.select("service_name").distinct().orderBy("service_name")


# ---- analyses ----------------------------------------------------------------------------------


def anomaly_totals(analyses: DataFrame, as_of: Column) -> DataFrame:
    return analyses.agg(
        F.count("*").alias("total_analyzed"),
        F.count_if(since(F.col("analyzed_at"), as_of, "24 HOURS")).alias("last_24h"),
    )


def anomalies_by_severity(analyses: DataFrame, as_of: Column) -> DataFrame:
    """Count, last 24 h and mean confidence per severity, with the grand totals on each row."""
    per = analyses.groupBy("severity").agg(
        F.count("*").alias("cnt"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"),
        F.count_if(since(F.col("analyzed_at"), as_of, "24 HOURS")).alias("__day"),
    )
    # At most one row per severity reaches this window.
    every = Window.partitionBy()
    return per.select(
        "severity", "cnt", "avg_confidence",
        F.sum("cnt").over(every).alias("total_analyzed"), F.sum("__day").over(every).alias("last_24h"),
    )


def most_affected_services(analyses: DataFrame, as_of: Column, limit: int = 5) -> DataFrame:
    """Most analyses in 7 days."""
    recent = analyses.where(since(F.col("analyzed_at"), as_of, "7 DAYS"))
    counts = recent.groupBy("service_name").agg(F.count("*").alias("anomaly_count"))
    return counts.orderBy(F.desc("anomaly_count"), "service_name").limit(limit)


def confidence_histogram(analyses: DataFrame) -> DataFrame:
    """Analyses per confidence bucket, lowest first."""
    per = analyses.groupBy(confidence_bucket(F.col("confidence")).alias("bucket")).agg(
        F.count("*").alias("cnt"), F.round(F.avg("confidence"), 3).alias("avg_confidence")
    )
    return per.orderBy("avg_confidence")


def confidence_overall(analyses: DataFrame) -> DataFrame:
    """Analyses and their mean confidence."""
    return analyses.agg(
        F.count("*").alias("total_analyses"),
        F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("average_confidence"),
    )


def service_trend(analyses: DataFrame, service_name: str, as_of: Column, hours: int = 6) -> DataFrame:
    """Scores of one service over some hours, oldest first."""
    if not 1 <= hours <= 72:
        raise ValueError("hours must be between 1 and 72")
    rows = analyses.where(
        (F.col("service_name") == service_name) & since(F.col("analyzed_at"), as_of, f"{hours} HOURS")
    )
    return rows.select(
        iso8601(F.col("analyzed_at")).alias("timestamp"),
        F.round("anomaly_score", 4).alias("score"),
        "severity",
        F.round("confidence", 3).alias("confidence"),
    ).orderBy("timestamp")


def sparklines(scores: DataFrame, ts: str, score: str, points: int = 20) -> DataFrame:
    """The last ``points`` scores per service scaled to their maximum.

    ``row_number() <= points`` keeps at most that many rows per service and task before the shuffle.
    """
    last = Window.partitionBy("service_name").orderBy(F.desc(ts), F.desc("id"))
    kept = scores.withColumn("back", F.row_number().over(last)).where(F.col("back") <= points)
    peak = F.max(score).over(Window.partitionBy("service_name"))
    return kept.select(
        "service_name", "id", ts, "back", (F.col(score) / F.greatest(peak, F.lit(0.01))).alias("height")
    )


# ---- alerts ------------------------------------------------------------------------------------


def alert_stats(alerts: DataFrame) -> DataFrame:
    """One row: total, sent, suppressed as total minus sent, and counts by severity."""
    per = alerts.groupBy("severity").agg(
        F.count("*").alias("cnt"), F.count_if(F.col("status") == "sent").alias("sent")
    )
    # One row per severity is left here.
    return per.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"),
        F.coalesce(F.sum("cnt") - F.sum("sent"), F.lit(0)).alias("suppressed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "cnt")))).alias("by_severity"),
    )


# ---- all tables --------------------------------------------------------------------------------


def system_summary(logs: DataFrame, analyses: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """Nine figures in one row (A10); one pass over the last day of each table."""
    day = "24 HOURS"
    recent_logs = logs.where(since(F.col("timestamp"), as_of, day))
    hour = since(F.col("timestamp"), as_of, "1 HOUR")
    failed = F.count_if(hour & is_error(F.col("level")))
    ingestion = recent_logs.agg(
        F.struct(
            F.count_if(hour).alias("logs_last_1h"),
            F.count("*").alias("logs_last_24h"),
            F.coalesce(F.round(F.try_divide(failed, F.count_if(hour)) * 100, 2), F.lit(0.0)).alias("error_rate_1h_pct"),
        )
    )
    detection = analyses.where(since(F.col("analyzed_at"), as_of, day)).agg(
        F.struct(
            F.count("*").alias("anomalies_last_24h"),
            F.count_if(F.col("severity") == "critical").alias("critical_last_24h"),
            F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("avg_confidence"),
            F.coalesce(F.round(F.avg("analysis_duration_ms"), 1), F.lit(0.0)).alias("avg_analysis_ms"),
        )
    )
    alerting = alerts.where(since(F.col("created_at"), as_of, day)).agg(
        F.count_if(F.col("status") == "sent").alias("sent_last_24h"),
        F.count_if(F.col("status") == "suppressed").alias("suppressed_last_24h"),
    )
    joined = alerting.select(ingestion.scalar().alias("i"), detection.scalar().alias("d"), "*")
    return joined.select("i.*", "d.*", "sent_last_24h", "suppressed_last_24h")


def stage_health(logs: DataFrame, analyses: DataFrame, as_of: Column) -> DataFrame:
    """ok or degraded per stage from recent activity (A11); two stages report ok always."""
    last_logs = logs.where(since(F.col("timestamp"), as_of, "5 MINUTES")).agg(F.count("*").alias("n"))
    last_analyses = analyses.where(since(F.col("analyzed_at"), as_of, "1 HOUR")).agg(F.count("*").alias("n"))
    counted = last_logs.select(F.col("n").alias("logs_last_5m"), last_analyses.scalar().alias("analyses_last_1h"))

    def state(count: str) -> Column:
        return F.when(F.col(count) > 0, "ok").otherwise("degraded")

    return counted.select(
        state("logs_last_5m").alias("ingestion"),
        "logs_last_5m",
        F.lit("ok").alias("detection"),
        state("analyses_last_1h").alias("analysis"),
        "analyses_last_1h",
        F.lit("ok").alias("alerting"),
    )


def live_snapshot(logs: DataFrame, analyses: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """Newest 10 anomalies, newest 5 alerts and the logs of the last hour in one row."""

    def listed(rows: DataFrame, ts: str) -> DataFrame:
        # At most 10 rows: the limit runs before the list is collected. Times are shown in ISO form.
        shown = rows.select("id", iso8601(F.col(ts)).alias(ts), "service_name", "severity")
        newest_first = F.sort_array(F.collect_list(F.struct(ts, "id", "service_name", "severity")), asc=False)
        return shown.agg(newest_first.alias("rows"))

    anomalies = listed(list_analyses(analyses, limit=10), "analyzed_at")
    newest_alerts = listed(list_alerts(alerts, limit=5), "created_at")
    counted = logs.where(since(F.col("timestamp"), as_of, "1 HOUR")).agg(F.count("*").alias("logs_last_1h"))
    return counted.select(
        F.lit("live_update").alias("type"),
        iso8601(as_of).alias("timestamp"),
        anomalies.scalar().alias("anomalies"),
        newest_alerts.scalar().alias("alerts"),
        "logs_last_1h",
    )
