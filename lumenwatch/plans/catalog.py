"""Every operator as a named query over the derived tables, with checking SQL where SQL can say it.

A query takes ``Tables`` and returns a DataFrame. Times are shown as text and doubles rounded, so that two
engines can be compared value by value. All queries run over whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.functions import columns as fx
from lumenwatch.operators import context, ensemble, features, forest, graph, metrics, normalise, payloads, rootcause, routing
from lumenwatch.operators import statistical as stat
from lumenwatch.operators import suppression
from lumenwatch.plans import dashboards, incidents
from lumenwatch.plans.bindings import ANALYSES, ANALYSES_WHERE, AS_OF, EVENTS, LOGS, TTL_SECONDS, WINDOW_SECONDS, Tables, sql_views
from lumenwatch.schemas import ALERTS
from lumenwatch.schemas import LOGS as TABLE_LOGS
from lumenwatch.session import scratch_path, settle
from lumenwatch.sources import records, streams, tables
from lumenwatch.streaming import anomalies as anomaly_jobs
from lumenwatch.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_landed: dict[tuple, DataFrame] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def landed(t: Tables, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that several queries read, written once per session and data folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _landed:
        _landed[key] = settle(build(), name)
    return _landed[key]


def forget_landed() -> None:
    _landed.clear()


# ---- presentation in both dialects ---------------------------------------------------------------


def at(ts, name: str | None = None) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or ts)


def sql_at(ts: str, name: str | None = None) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f') AS {name or ts}"


def r(column: str, digits: int = 6) -> Column:
    return F.round(column, digits).alias(column)


# Means of short decimals often fall on a rounding tie, where the last bit of a sum decides. Both sides are
# moved off the tie by this much before rounding.
NUDGE = 1e-9


def rn(column: str, digits: int = 6) -> Column:
    return F.round(F.col(column) + NUDGE, digits).alias(column)


def hun(value: str, digits: int) -> str:
    return hu(f"({value} + CAST({NUDGE} AS DOUBLE))", digits)


def hu(value: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal form, as Spark rounds doubles."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def joined(array, separator: str = "|") -> Column:
    return F.array_join(array, separator)


def log_shown() -> list:
    return ["id", at("timestamp"), "service_name", "level", "message", "trace_id", "span_id", "host", "environment", "latency_ms"]


LOG_SQL = f"id, {sql_at('timestamp')}, service_name, level, message, trace_id, span_id, host, environment, latency_ms"
def analysis_shown() -> list:
    return ["id", at("analyzed_at"), "service_name", "anomaly_id", r("anomaly_score"), "severity", "root_cause", r("confidence"), "recommended_action", "escalate_to", "success"]


ANALYSIS_SQL = f"id, {sql_at('analyzed_at')}, service_name, anomaly_id, {hu('anomaly_score', 6)} AS anomaly_score, severity, root_cause, {hu('confidence', 6)} AS confidence, recommended_action, escalate_to, success"
def alert_shown() -> list:
    return ["id", at("created_at"), "analysis_id", "anomaly_id", "service_name", "severity", r("confidence"), "status"]


ALERT_SQL = f"id, {sql_at('created_at')}, analysis_id, anomaly_id, service_name, severity, {hu('confidence', 6)} AS confidence, status"

# ---- sources and sinks -----------------------------------------------------------------------------


@query("s1_scan_logs", f"{sql_views('logs')} SELECT {LOG_SQL} FROM logs")
def _(t):
    return t.logs.select(*log_shown())


@query("s1_scan_analyses", f"{sql_views('analyses')} SELECT {ANALYSIS_SQL} FROM analyses")
def _(t):
    return t.analyses.select(*analysis_shown())


@query("s1_scan_alerts", f"{sql_views('alerts')} SELECT {ALERT_SQL} FROM alerts")
def _(t):
    return t.alerts.select(*alert_shown())


@query("s2_stream_source", f"{sql_views('logs')} SELECT {LOG_SQL} FROM logs")
def _(t):
    out = scratch_path(t.spark, "s2")
    writer = event_stream(t, repeats=False).writeStream.format("parquet").option("checkpointLocation", f"{out}/progress")
    writer.trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return t.spark.read.schema(t.logs.schema).parquet(f"{out}/rows").select(*log_shown())


def messages(t: Tables) -> DataFrame:
    """Encoded logs; for every eighth id a raw text or a record with an unknown level instead."""
    good = records.as_messages(t.logs).select(F.get_json_object("value", "$.id").alias("id"), "value")
    bad = t.raw_records.where("CAST(id AS BIGINT) % 8 IN (0, 2, 5, 6)")
    return good.where("CAST(id AS BIGINT) % 8 NOT IN (0, 2, 5, 6)").unionByName(bad.select("id", F.col("raw").alias("value")))


@query(
    "s3_decode_records",
    f"""{sql_views('logs')}
    SELECT CASE WHEN m IN (0, 2, 5, 6) THEN NULL ELSE id END AS id,
           CASE WHEN m IN (0, 2, 5, 6) THEN NULL ELSE strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') END AS timestamp,
           CASE WHEN m IN (0, 2, 5, 6) THEN NULL ELSE service_name END AS service_name,
           CASE m WHEN 0 THEN 'bad_level' WHEN 2 THEN 'malformed_json' WHEN 5 THEN 'empty_service' WHEN 6 THEN 'malformed_json' END AS decode_error,
           count(*) AS n
    FROM (SELECT *, CAST(id AS BIGINT) % 8 AS m FROM logs) GROUP BY ALL""",
)
def _(t):
    decoded = records.decode_records(messages(t))
    good = F.col("decode_error").isNull()
    return (
        decoded.select(
            F.when(good, F.col("id")).alias("id"),
            F.when(good, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("timestamp"),
            F.when(good, F.col("service_name")).alias("service_name"),
            "decode_error",
        )
        .groupBy("id", "timestamp", "service_name", "decode_error")
        .agg(F.count("*").alias("n"))
    )


@query(
    "s4_append_new",
    f"""{sql_views('logs')},
    batch AS (SELECT id, timestamp, message FROM logs UNION ALL
              SELECT id, timestamp + INTERVAL '1 day', concat('repeat ', message) FROM logs),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp, message) AS n FROM batch)
    SELECT id, {sql_at('timestamp')}, message FROM ranked
    WHERE n = 1 AND id NOT IN (SELECT id FROM logs WHERE level = 'INFO')""",
)
def _(t):
    logs = t.logs.select("id", "timestamp", "message")
    again = logs.select("id", (F.col("timestamp") + F.expr("INTERVAL 1 DAY")).alias("timestamp"), F.concat(F.lit("repeat "), "message").alias("message"))
    stored = t.logs.where("level = 'INFO'")
    return tables.new_rows(logs.unionByName(again), stored, ["timestamp", "message"]).select("id", at("timestamp"), "message")


@query(
    "s5_messages",
    f"""{sql_views('logs')}
    SELECT service_name AS key,
           concat('{{"id":"', id, '","timestamp":"', strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), 'Z","service_name":"', service_name,
                  '","level":"', level, '","message":"', message, '","trace_id":"', trace_id, '","span_id":"', span_id,
                  '","host":"', host, '","environment":"', environment, '"}}') AS value,
           concat('content-type=application/json|log-level=', level, '|environment=', environment) AS headers
    FROM logs""",
)
def _(t):
    shown = F.transform("headers", lambda h: F.concat_ws("=", h["key"], F.decode(h["value"], "UTF-8")))
    return records.as_messages(t.logs).select("key", "value", joined(shown).alias("headers"))


@query(
    "s6_dead_letters",
    f"""{sql_views('raw_records')}
    SELECT raw, CASE CAST(id AS BIGINT) % 8 WHEN 5 THEN 'empty_service' WHEN 6 THEN 'malformed_json' ELSE 'empty_message' END AS reason
    FROM raw_records WHERE CAST(id AS BIGINT) % 8 IN (5, 6, 7)""",
)
def _(t):
    path = scratch_path(t.spark, "dead-letters")
    rejects = normalise.rejected_records(t.raw_records)
    records.write_dead_letters(rejects.select("raw", F.col("reject_reason").alias("reason")), path)
    return records.replay_dead_letters(t.spark, path)


@query(
    "s7_save_analyses",
    f"{sql_views('analyses')} SELECT id, service_name, {hu('confidence', 6)} AS confidence, id AS stored_id, root_cause AS stored_cause, severity AS stored_severity FROM analyses",
)
def _(t):
    path = scratch_path(t.spark, "analyses")
    schema = "id STRING, analyzed_at TIMESTAMP, service_name STRING, anomaly_id STRING, severity STRING, root_cause STRING, confidence DOUBLE, raw_result STRING"
    rows = t.analyses.select("id", "analyzed_at", "service_name", "anomaly_id", "severity", "root_cause", "confidence")
    saved = tables.save_analyses(rows, path, schema)
    return saved.select(
        "id", "service_name", r("confidence"),
        *[F.get_json_object("raw_result", f"$.{f}").alias(n) for f, n in (("id", "stored_id"), ("root_cause", "stored_cause"), ("severity", "stored_severity"))],
    )


def full_alerts(t: Tables) -> DataFrame:
    """The alert table with all its columns."""
    rows = t.alerts.withColumns(
        {
            "sent_at": F.when(F.col("status") == "sent", F.col("created_at")),
            "title": F.concat_ws(" ", F.upper("severity"), "service_name"),
            "root_cause": F.lit("error"),
            "recommended_action": F.concat(F.lit("Inspect "), "service_name"),
            "affected_services": F.array("service_name"),
            "remediation_steps": F.array(F.lit("Check logs"), F.lit("Roll back")),
            "escalate_to": F.when(F.col("severity") == "critical", "on-call").otherwise(""),
            "channels_attempted": F.array(F.lit("slack")),
            "channels_succeeded": F.when(F.col("status") == "sent", F.array(F.lit("slack"))).otherwise(F.array().cast("array<string>")),
            "error_messages": F.array().cast("array<string>"),
        }
    )
    return rows.select(*[f.split()[0] for f in ALERTS.split(", ")])


@query(
    "s8_upsert_alerts",
    f"""{sql_views('alerts')},
    stored AS (SELECT *, concat(upper(severity), ' ', service_name) AS title FROM alerts WHERE severity <> 'medium'),
    batch AS (SELECT * FROM alerts WHERE status <> 'sent')
    SELECT coalesce(s.id, b.id) AS id, CASE WHEN b.id IS NOT NULL THEN 'sent' ELSE s.status END AS status,
           coalesce(s.title, concat('retry ', upper(b.severity), ' ', b.service_name)) AS title,
           CASE WHEN b.id IS NOT NULL THEN 'pagerduty' WHEN s.status = 'sent' THEN 'slack' ELSE '' END AS channels_succeeded,
           CASE WHEN b.id IS NOT NULL THEN 'slack: timeout' ELSE '' END AS error_messages,
           strftime(CASE WHEN b.id IS NOT NULL THEN b.created_at + INTERVAL '1 minute' WHEN s.status = 'sent' THEN s.created_at END, '%Y-%m-%d %H:%M:%S.%f') AS sent_at
    FROM stored s FULL OUTER JOIN batch b ON s.id = b.id""",
)
def _(t):
    stored = full_alerts(t).where("severity <> 'medium'")
    batch = full_alerts(t).where("status <> 'sent'").withColumns(
        {
            "status": F.lit("sent"), "sent_at": F.col("created_at") + F.expr("INTERVAL 1 MINUTE"),
            "title": F.concat(F.lit("retry "), "title"),
            "channels_succeeded": F.array(F.lit("pagerduty")), "error_messages": F.array(F.lit("slack: timeout")),
        }
    )
    path = scratch_path(t.spark, "alerts")
    tables.upsert_alerts(stored, path)
    tables.upsert_alerts(batch, path)
    merged = tables.read_alerts(t.spark, path)
    return merged.select("id", "status", "title", joined("channels_succeeded").alias("channels_succeeded"), joined("error_messages").alias("error_messages"), at("sent_at"))


@query("s9_log_by_id", f"{sql_views('logs')} SELECT {LOG_SQL} FROM logs WHERE id = '77'")
def _(t):
    return tables.by_id(t.logs, "77").select(*log_shown())


@query("s9_alert_by_id", f"{sql_views('alerts')} SELECT {ALERT_SQL} FROM alerts WHERE id = (SELECT max(id) FROM alerts)")
def _(t):
    newest = t.alerts.agg(F.max("id")).scalar()
    return t.alerts.where(F.col("id") == newest).select(*alert_shown())


@query(
    "s9_analysis_by_id",
    f"{sql_views('analyses')} SELECT id, service_name, severity, root_cause, {hu('confidence', 6)} AS confidence FROM analyses WHERE id = (SELECT min(id) FROM analyses)",
)
def _(t):
    stored = tables.with_raw_result(t.analyses.select("id", "service_name", "severity", "root_cause", "confidence"))
    least = t.analyses.agg(F.min("id")).scalar()
    found = tables.analysis_by_id(stored, least, "id STRING, service_name STRING, severity STRING, root_cause STRING, confidence DOUBLE")
    return found.withColumn("confidence", F.round("confidence", 6))


# ---- normalisation ---------------------------------------------------------------------------------

INGESTED = "TIMESTAMP '2024-02-01 00:00:00'"


def normalised(t: Tables) -> DataFrame:
    return normalise.normalise_logs(t.raw_records, ingested_at=F.expr(INGESTED), position=("id",))


_K = "CAST(k AS VARCHAR)"
_NORMAL = f"""{sql_views('logs')},
    src AS (SELECT *, CAST(id AS BIGINT) % 8 AS m FROM logs),
    normal AS (
      SELECT id AS position, m,
        CASE WHEN m = 3 THEN 'unknown' ELSE service_name END AS service_name,
        CASE m WHEN 0 THEN level WHEN 1 THEN 'WARNING' WHEN 2 THEN 'CRITICAL' ELSE 'INFO' END AS level,
        message,
        CASE WHEN m = 4 THEN 'staging' ELSE 'production' END AS environment,
        CASE m WHEN 0 THEN timestamp WHEN 2 THEN TIMESTAMP '2024-01-15 12:00:00'
               WHEN 4 THEN make_timestamp((1705300000 + k) * CAST(1000000 AS BIGINT)) ELSE {INGESTED} END AS timestamp,
        m IN (0, 2, 4) AS ts_parsed,
        CASE m WHEN 0 THEN 'latency_ms=' || {_K} WHEN 1 THEN 'body=' || message || ';duration_ms=' || {_K}
               WHEN 4 THEN 'elapsed_ms=' || {_K} || ';region=us' ELSE '' END AS attributes,
        CASE WHEN m IN (0, 1, 4) THEN CAST(k AS DOUBLE) END AS latency
      FROM src WHERE m < 5)"""


def shown_map(column: str) -> Column:
    entries = F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.array_join(entries, ";").alias(column)


@query("p1_field_fallback", f"{_NORMAL} SELECT service_name, level, message, environment FROM normal")
def _(t):
    return normalised(t).select("service_name", "level", "message", "environment")


@query(
    "p2_resource_service",
    f"{sql_views('logs')} SELECT CASE CAST(id AS BIGINT) % 8 WHEN 1 THEN service_name WHEN 4 THEN service_name WHEN 0 THEN concat('  ', upper(service_name), ' ') WHEN 5 THEN '  ' END AS service, count(*) AS n "
    "FROM logs WHERE CAST(id AS BIGINT) % 8 IN (0, 1, 4, 5) GROUP BY ALL",
)
def _(t):
    objects = t.raw_records.select(F.from_json("raw", "map<string,string>").alias("m"), "raw").where("raw LIKE '{%' AND m IS NOT NULL")
    return objects.select(normalise.service_field(F.from_json(F.col("m")["resource"], "map<string,string>"), "unknown").alias("service")).groupBy("service").agg(F.count("*").alias("n"))


@query("p3_attributes", f"{_NORMAL} SELECT message, attributes FROM normal")
def _(t):
    return normalised(t).select("message", shown_map("attributes"))


@query(
    "p4_text_lines",
    f"{_NORMAL} SELECT {sql_at('timestamp')}, level, service_name, message FROM normal WHERE m IN (2, 3)",
)
def _(t):
    lines = t.raw_records.where("raw NOT LIKE '{%'")
    rows = normalise.normalise_logs(lines, ingested_at=F.expr(INGESTED), position=("id",))
    return rows.select(at("timestamp"), "level", "service_name", "message")


@query(
    "p5_levels",
    f"""{sql_views('logs')}
    SELECT raw, CASE WHEN upper(raw) = 'WARN' THEN 'WARNING' WHEN upper(raw) = 'FATAL' THEN 'CRITICAL'
                     WHEN upper(raw) IN ('DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL') THEN upper(raw) ELSE 'INFO' END AS level, count(*) AS n
    FROM (SELECT CASE k % 5 WHEN 0 THEN lower(level) WHEN 1 THEN level WHEN 2 THEN substr(level, 1, 4) WHEN 3 THEN 'fatal' ELSE message END AS raw FROM logs)
    GROUP BY ALL""",
)
def _(t):
    raw = "CASE k % 5 WHEN 0 THEN lower(level) WHEN 1 THEN level WHEN 2 THEN substr(level, 1, 4) WHEN 3 THEN 'fatal' ELSE message END AS raw"
    rows = t.logs.selectExpr(raw).withColumn("level", fx.canonical_level(F.col("raw")))
    return rows.groupBy("raw", "level").agg(F.count("*").alias("n"))


_TIMES = """CASE CAST(id AS BIGINT) % 7
    WHEN 0 THEN cast(1704067200 + CAST(id AS BIGINT) AS string)
    WHEN 1 THEN cast(1704067200123 + CAST(id AS BIGINT) AS string)
    WHEN 2 THEN concat(replace(substr(cast(timestamp AS string), 1, 19), ' ', 'T'), '.25Z')
    WHEN 3 THEN concat(substr(cast(timestamp AS string), 1, 19), '.5')
    WHEN 4 THEN concat(replace(substr(cast(timestamp AS string), 1, 19), ' ', 'T'), '+0200')
    WHEN 5 THEN substr(cast(timestamp AS string), 1, 19)
    ELSE 'yesterday' END"""


@query(
    "p6_timestamps",
    f"""{sql_views('logs')}
    SELECT raw, strftime(CASE CAST(id AS BIGINT) % 7
        WHEN 0 THEN make_timestamp((1704067200 + CAST(id AS BIGINT)) * 1000000)
        WHEN 1 THEN make_timestamp((1704067200123 + CAST(id AS BIGINT)) * 1000)
        WHEN 2 THEN date_trunc('second', timestamp) + INTERVAL '250 milliseconds'
        WHEN 3 THEN date_trunc('second', timestamp) + INTERVAL '500 milliseconds'
        WHEN 4 THEN date_trunc('second', timestamp) - INTERVAL '2 hours'
        WHEN 5 THEN date_trunc('second', timestamp) END, '%Y-%m-%d %H:%M:%S.%f') AS parsed
    FROM (SELECT id, timestamp, {_TIMES} AS raw FROM logs)""",
)
def _(t):
    rows = t.logs.selectExpr(f"{_TIMES} AS raw")
    return rows.select("raw", at(fx.parse_timestamp(F.col("raw")), "parsed"))


@query(
    "p7_validation",
    f"""{sql_views('logs')}
    SELECT CASE CAST(id AS BIGINT) % 8 WHEN 5 THEN 'empty_service' WHEN 6 THEN 'malformed_json' WHEN 7 THEN 'empty_message' ELSE 'valid' END AS outcome,
           count(*) AS n FROM logs GROUP BY ALL""",
)
def _(t):
    parsed = normalise.parse_records(t.raw_records)
    return parsed.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "p8_default_ids",
    f"""{_NORMAL} SELECT substr(sha256(concat('log|', position)), 1, 36) AS id, substr(sha256(concat('trace|', position)), 1, 36) AS trace_id,
           substr(sha256(concat('span|', position)), 1, 16) AS span_id, message FROM normal""",
)
def _(t):
    return normalised(t).select("id", "trace_id", "span_id", "message")


@query(
    "p9_normalise",
    f"{_NORMAL} SELECT {sql_at('timestamp')}, service_name, level, message, environment, attributes, ts_parsed FROM normal",
)
def _(t):
    return normalised(t).select(at("timestamp"), "service_name", "level", "message", "environment", shown_map("attributes"), "ts_parsed")


@query("p10_latency", f"{_NORMAL} SELECT message, latency FROM normal")
def _(t):
    return normalised(t).select("message", fx.latency_ms(F.col("attributes")).alias("latency"))


@query("p12_log_lines", f"{sql_views('logs')} SELECT id, concat('[', strftime(timestamp, '%H:%M:%S'), '] ', level, ' ', message) AS line FROM logs")
def _(t):
    return t.logs.select("id", fx.log_line(F.col("timestamp"), F.col("level"), F.col("message")).alias("line"))


@query("p13_iso_times", f"{sql_views('logs')} SELECT id, concat(strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), '+00:00') AS iso FROM logs")
def _(t):
    return t.logs.select("id", fx.iso8601(F.col("timestamp")).alias("iso"))


# ---- filters, limits, aggregates ---------------------------------------------------------------------


@query("f1_logs_filtered", f"{sql_views('logs')} SELECT {LOG_SQL} FROM logs WHERE service_name = 'payment-service' AND level = 'ERROR' ORDER BY logs.timestamp DESC, id DESC LIMIT 100")
def _(t):
    return dashboards.list_logs(t.logs, "payment-service", "ERROR").select(*log_shown())


@query("f2_analyses_filtered", f"{sql_views('analyses')} SELECT {ANALYSIS_SQL} FROM analyses WHERE service_name = 'order-service' AND severity = 'critical' ORDER BY analyses.analyzed_at DESC, id DESC LIMIT 20")
def _(t):
    return dashboards.list_analyses(t.analyses, "order-service", "critical").select(*analysis_shown())


@query("f3_alerts_filtered", f"{sql_views('alerts')} SELECT {ALERT_SQL} FROM alerts WHERE severity = 'low' AND status = 'sent' ORDER BY alerts.created_at DESC, id DESC LIMIT 50")
def _(t):
    return dashboards.list_alerts(t.alerts, severity="low", status="sent").select(*alert_shown())


_BACK = {"m5": ("5 MINUTES", "5 minutes"), "h1": ("1 HOUR", "1 hour"), "h24": ("24 HOURS", "24 hours"), "d7": ("7 DAYS", "7 days"), "h72": ("72 HOURS", "72 hours")}


@query(
    "f4_look_backs",
    f"{sql_views('logs')} SELECT "
    + ", ".join(f"count(*) FILTER (WHERE timestamp > {AS_OF} - INTERVAL '{sql}') AS {n}" for n, (_, sql) in _BACK.items())
    + " FROM logs",
)
def _(t):
    ts = F.col("timestamp")
    return t.logs.agg(*[F.count_if(fx.since(ts, t.as_of, interval)).alias(n) for n, (interval, _) in _BACK.items()])


@query("f5_errors_only", f"{sql_views('logs')} SELECT {LOG_SQL} FROM logs WHERE level IN ('ERROR', 'CRITICAL')")
def _(t):
    return t.logs.where(fx.is_error(F.col("level"))).select(*log_shown())


@query("t1_newest_logs", f"{sql_views('logs')} SELECT {LOG_SQL} FROM logs ORDER BY logs.timestamp DESC, id DESC LIMIT 100")
def _(t):
    return dashboards.list_logs(t.logs).select(*log_shown())


@query("t1_newest_analyses", f"{sql_views('analyses')} SELECT {ANALYSIS_SQL} FROM analyses ORDER BY analyses.analyzed_at DESC, id DESC LIMIT 20")
def _(t):
    return dashboards.list_analyses(t.analyses).select(*analysis_shown())


@query("t1_newest_alerts", f"{sql_views('alerts')} SELECT {ALERT_SQL} FROM alerts ORDER BY alerts.created_at DESC, id DESC LIMIT 50")
def _(t):
    return dashboards.list_alerts(t.alerts).select(*alert_shown())


_DAY = f"> {AS_OF} - INTERVAL '24 hours'"
_HOUR = f"> {AS_OF} - INTERVAL '1 hour'"
_WEEK = f"> {AS_OF} - INTERVAL '7 days'"
_IS_ERROR = "level IN ('ERROR', 'CRITICAL')"


@query(
    "a3_log_volume",
    f"{sql_views('logs')} SELECT level, count(*) AS cnt, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM logs WHERE timestamp {_DAY} GROUP BY level",
)
def _(t):
    return dashboards.log_volume(t.logs, t.as_of)


@query(
    "a4_error_rate",
    f"{sql_views('logs')} SELECT coalesce({hu(f'count(*) FILTER (WHERE {_IS_ERROR}) / nullif(count(*), 0) * 100', 2)}, 0) AS error_rate_last_1h_pct FROM logs WHERE timestamp {_HOUR}",
)
def _(t):
    return dashboards.error_rate_last_hour(t.logs, t.as_of)


@query("a5_services", f"{sql_views('logs')} SELECT DISTINCT service_name FROM logs WHERE timestamp {_WEEK} ORDER BY 1")
def _(t):
    return dashboards.known_services(t.logs, t.as_of)


@query(
    "a6_anomaly_summary",
    f"""{sql_views('analyses')}
    SELECT severity, count(*) AS cnt, {hu('avg(confidence)', 3)} AS avg_confidence, (SELECT count(*) FROM analyses) AS total_analyzed,
           (SELECT count(*) FROM analyses WHERE analyzed_at {_DAY}) AS last_24h
    FROM analyses GROUP BY severity""",
)
def _(t):
    return dashboards.anomalies_by_severity(t.analyses, t.as_of)


_BUCKET = "CASE WHEN confidence < 0.3 THEN 'low (< 0.3)' WHEN confidence < 0.6 THEN 'medium (0.3-0.6)' WHEN confidence < 0.8 THEN 'high (0.6-0.8)' ELSE 'very_high (>= 0.8)' END"


@query(
    "a7_confidence_histogram",
    f"{sql_views('analyses')} SELECT {_BUCKET} AS bucket, count(*) AS cnt, {hu('avg(confidence)', 3)} AS avg_confidence FROM analyses GROUP BY 1 ORDER BY 3",
)
def _(t):
    return dashboards.confidence_histogram(t.analyses)


@query("a8_confidence_overall", f"{sql_views('analyses')} SELECT count(*) AS total_analyses, coalesce({hu('avg(confidence)', 3)}, 0) AS average_confidence FROM analyses")
def _(t):
    return dashboards.confidence_overall(t.analyses)


@query(
    "a9_alert_stats",
    f"""{sql_views('alerts')}
    SELECT count(*) AS total, count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER (WHERE status <> 'sent') AS suppressed,
           (SELECT string_agg(severity || '=' || n, ';' ORDER BY severity) FROM (SELECT severity, count(*) AS n FROM alerts GROUP BY 1)) AS by_severity
    FROM alerts""",
)
def _(t):
    return dashboards.alert_stats(t.alerts).withColumn(
        "by_severity", F.array_join(F.transform(F.map_entries("by_severity"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    )


@query(
    "a10_system_summary",
    f"""{sql_views('alerts')}
    SELECT (SELECT count(*) FROM logs WHERE timestamp {_HOUR}) AS logs_last_1h,
           (SELECT count(*) FROM logs WHERE timestamp {_DAY}) AS logs_last_24h,
           coalesce((SELECT {hu(f'count(*) FILTER (WHERE {_IS_ERROR}) / nullif(count(*), 0) * 100', 2)} FROM logs WHERE timestamp {_HOUR}), 0) AS error_rate_1h_pct,
           (SELECT count(*) FROM analyses WHERE analyzed_at {_DAY}) AS anomalies_last_24h,
           (SELECT count(*) FROM analyses WHERE severity = 'critical' AND analyzed_at {_DAY}) AS critical_last_24h,
           coalesce((SELECT {hu('avg(confidence)', 3)} FROM analyses WHERE analyzed_at {_DAY}), 0) AS avg_confidence,
           coalesce((SELECT {hu('avg(analysis_duration_ms)', 1)} FROM analyses WHERE analyzed_at {_DAY}), 0) AS avg_analysis_ms,
           (SELECT count(*) FROM alerts WHERE status = 'sent' AND created_at {_DAY}) AS sent_last_24h,
           (SELECT count(*) FROM alerts WHERE status = 'suppressed' AND created_at {_DAY}) AS suppressed_last_24h""",
)
def _(t):
    return dashboards.system_summary(t.logs, t.analyses, t.alerts, t.as_of)


@query(
    "a11_stage_health",
    f"""{sql_views('analyses')},
    n AS (SELECT (SELECT count(*) FROM logs WHERE timestamp > {AS_OF} - INTERVAL '5 minutes') AS logs_last_5m,
                 (SELECT count(*) FROM analyses WHERE analyzed_at {_HOUR}) AS analyses_last_1h)
    SELECT CASE WHEN logs_last_5m > 0 THEN 'ok' ELSE 'degraded' END AS ingestion, logs_last_5m, 'ok' AS detection,
           CASE WHEN analyses_last_1h > 0 THEN 'ok' ELSE 'degraded' END AS analysis, analyses_last_1h, 'ok' AS alerting FROM n""",
)
def _(t):
    return dashboards.stage_health(t.logs, t.analyses, t.as_of)


@query(
    "a15_live_snapshot",
    f"""{sql_views('alerts')},
    a AS (SELECT *, concat(strftime(analyzed_at, '%Y-%m-%dT%H:%M:%S.%f'), '+00:00') AS iso FROM analyses ORDER BY analyzed_at DESC, id DESC LIMIT 10),
    b AS (SELECT *, concat(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '+00:00') AS iso FROM alerts ORDER BY created_at DESC, id DESC LIMIT 5)
    SELECT 'live_update' AS type, '2024-01-31T00:00:00.000000+00:00' AS timestamp,
           (SELECT string_agg(concat_ws(' ', iso, id, service_name, severity), '|' ORDER BY iso DESC, id DESC) FROM a) AS anomalies,
           (SELECT string_agg(concat_ws(' ', iso, id, service_name, severity), '|' ORDER BY iso DESC, id DESC) FROM b) AS alerts,
           (SELECT count(*) FROM logs WHERE timestamp {_HOUR}) AS logs_last_1h""",
)
def _(t):
    def flat(name: str, ts: str) -> Column:
        return joined(F.transform(name, lambda x: F.concat_ws(" ", x[ts], x["id"], x["service_name"], x["severity"]))).alias(name)

    one = dashboards.live_snapshot(t.logs, t.analyses, t.alerts, t.as_of)
    return one.select("type", "timestamp", flat("anomalies", "analyzed_at"), flat("alerts", "created_at"), "logs_last_1h")


@query("t2_busiest_services", f"{sql_views('logs')} SELECT service_name, count(*) AS cnt FROM logs WHERE timestamp {_DAY} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return dashboards.busiest_services(t.logs, t.as_of)


@query("t3_most_affected", f"{sql_views('analyses')} SELECT service_name, count(*) AS anomaly_count FROM analyses WHERE analyzed_at {_WEEK} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return dashboards.most_affected_services(t.analyses, t.as_of)


@query(
    "w16_service_trend",
    f"""{sql_views('analyses')} SELECT concat(strftime(analyzed_at, '%Y-%m-%dT%H:%M:%S.%f'), '+00:00') AS timestamp, {hu('anomaly_score', 4)} AS score, severity, {hu('confidence', 3)} AS confidence
    FROM analyses WHERE service_name = 'auth-service' AND analyzed_at > {AS_OF} - INTERVAL '72 hours' ORDER BY 1""",
)
def _(t):
    return dashboards.service_trend(t.analyses, "auth-service", t.as_of, hours=72)


@query(
    "w17_sparklines",
    f"""{sql_views('analyses')},
    last AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY analyzed_at DESC, id DESC) AS back FROM analyses)
    SELECT service_name, id, back, {hu('anomaly_score / greatest(max(anomaly_score) OVER (PARTITION BY service_name), 0.01)', 6)} AS height
    FROM last WHERE back <= 20""",
)
def _(t):
    return dashboards.sparklines(t.analyses, "analyzed_at", "anomaly_score").select("service_name", "id", F.col("back").cast("bigint").alias("back"), r("height"))


@query(
    "w18_display_bands",
    f"""{sql_views('analyses')}
    SELECT id, CASE WHEN anomaly_score >= 0.8 THEN 'red' WHEN anomaly_score >= 0.6 THEN 'amber' WHEN anomaly_score >= 0.4 THEN 'indigo' ELSE 'green' END AS score_band,
           CASE WHEN k > 10 THEN 'red' WHEN k > 3 THEN 'amber' ELSE 'green' END AS rate_band, CASE WHEN confidence > 0.7 THEN 'green' ELSE 'amber' END AS confidence_band
    FROM analyses""",
)
def _(t):
    return t.analyses.select(
        "id", fx.score_band(F.col("anomaly_score")).alias("score_band"), fx.error_rate_band(F.col("k")).alias("rate_band"),
        fx.confidence_band(F.col("confidence")).alias("confidence_band"),
    )


# ---- feature windows ---------------------------------------------------------------------------------

FEATURE_COLUMNS = (
    "total_logs", "logs_per_second", "error_count", "critical_count", "error_rate", "latency_p50", "latency_p95",
    "latency_p99", "latency_mean", "unique_traces",
)
_DOUBLES = {"logs_per_second", "error_rate", "latency_p50", "latency_p95", "latency_p99", "latency_mean"}


def _features_sql(keys: str, group: str) -> str:
    return f"""SELECT {keys}, count(*) AS total_logs,
        count(*) / greatest((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0, 1.0) AS logs_per_second,
        count(*) FILTER (WHERE level = 'ERROR') AS error_count, count(*) FILTER (WHERE level = 'CRITICAL') AS critical_count,
        count(*) FILTER (WHERE {_IS_ERROR}) / count(*) AS error_rate,
        quantile_cont(latency_ms, 0.5) AS latency_p50, quantile_cont(latency_ms, 0.95) AS latency_p95,
        quantile_cont(latency_ms, 0.99) AS latency_p99, avg(latency_ms) AS latency_mean, count(DISTINCT trace_id) AS unique_traces,
        min(timestamp) AS first_log, max(timestamp) AS last_log
        FROM logs GROUP BY {group}"""


_SLOT = f"time_bucket(INTERVAL '{WINDOW_SECONDS} seconds', timestamp)"
_FEAT = f"{sql_views('logs')}, feat AS ({_features_sql(f'service_name, {_SLOT} AS window_start', f'service_name, {_SLOT}')})"
_FEATURES_SHOWN_SQL = ", ".join(f"{hun(c, 6)} AS {c}" if c in _DOUBLES else c for c in FEATURE_COLUMNS)


def features_shown() -> list:
    return [rn(c) if c in _DOUBLES else c for c in FEATURE_COLUMNS]


def feature_table(t: Tables) -> DataFrame:
    return landed(t, "features", lambda: features.window_features(t.logs, WINDOW_SECONDS, rounded=False))


@query("a1_window_features", f"{_FEAT} SELECT service_name, {sql_at('window_start')}, {_FEATURES_SHOWN_SQL} FROM feat")
def _(t):
    rows = features.window_features(t.logs, WINDOW_SECONDS, rounded=False)
    return rows.select("service_name", at("window_start"), *features_shown())


@query(
    "a1_minute_windows",
    f"""{sql_views('logs')}, feat AS ({_features_sql("service_name, date_trunc('minute', timestamp) AS window_start", "service_name, date_trunc('minute', timestamp)")})
    SELECT service_name, {sql_at('window_start')}, {_FEATURES_SHOWN_SQL} FROM feat""",
)
def _(t):
    rows = features.window_features(t.logs, rounded=False)
    return rows.select("service_name", at("window_start"), *features_shown())


@query(
    "a2_batch_features",
    f"{sql_views('logs')}, feat AS ({_features_sql('service_name', 'service_name')}) SELECT service_name, {_FEATURES_SHOWN_SQL} FROM feat",
)
def _(t):
    return features.batch_features(t.logs, rounded=False).select("service_name", *features_shown())


@query("t5_window_bounds", f"{_FEAT} SELECT service_name, {sql_at('window_start')}, {sql_at('first_log')}, {sql_at('last_log')} FROM feat")
def _(t):
    return feature_table(t).select("service_name", at("window_start"), at("first_log"), at("last_log"))


# ---- statistical detector ----------------------------------------------------------------------------

_W = stat.WEIGHTS
_NUM = f"{_FEAT}, num AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY window_start) AS rn FROM feat)"
_FRAME = "(PARTITION BY service_name ORDER BY rn ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)"


def _roll(source: str, partition: str = "service_name") -> str:
    frame = _FRAME.replace("service_name", partition)
    stats = ", ".join(
        f"avg({c}) OVER w AS {c}__mean, stddev_pop({c}) OVER w AS {c}__std, quantile_cont({c}, 0.25) OVER w AS {c}__q1, quantile_cont({c}, 0.75) OVER w AS {c}__q3"
        for c in _W
    )
    return f"roll AS (SELECT *, least(rn - 1, 200) AS history_size, {stats} FROM {source} WINDOW w AS {frame})"


def _z(c: str) -> str:
    return f"CASE WHEN {c}__std < 1e-9 THEN 0 ELSE least(abs(({c} - {c}__mean) / {c}__std) / 3, 1) END"


def _iqr(c: str) -> str:
    iqr = f"({c}__q3 - {c}__q1)"
    return f"CASE WHEN {iqr} < 1e-9 THEN 0 WHEN {c} > {c}__q3 + 1.5 * {iqr} THEN least(({c} - {c}__q3 - 1.5 * {iqr}) / ({iqr} + 1e-9), 1) WHEN {c} < {c}__q1 - 1.5 * {iqr} THEN least(({c}__q1 - 1.5 * {iqr} - {c}) / ({iqr} + 1e-9), 1) ELSE 0 END"


def _cusum(keys: str = "service_name") -> str:
    """The recursion itself, window by window."""
    names = keys.split(", ")
    on = " AND ".join(f"r.{n} = p.{n}" for n in names)
    on_target = " AND ".join(f"r.{n} = g.{n}" for n in names)
    scale = {c: f"(CASE WHEN r.{c}__std < 1e-9 THEN 1.0 ELSE r.{c}__std END)" for c in _W}
    start = ", ".join(f"CAST(0 AS DOUBLE) AS {c}__pos, CAST(0 AS DOUBLE) AS {c}__neg, CAST(0 AS DOUBLE) AS {c}__cusum" for c in _W)
    pos = {c: f"greatest(0.0, p.{c}__pos + (r.{c} - g.{c}__target) - 0.5 * {scale[c]})" for c in _W}
    neg = {c: f"greatest(0.0, p.{c}__neg - (r.{c} - g.{c}__target) - 0.5 * {scale[c]})" for c in _W}
    step = ", ".join(f"{pos[c]}, {neg[c]}, least(greatest({pos[c]}, {neg[c]}) / (5 * {scale[c]} + 1e-9), 1)" for c in _W)
    return f"""target AS (SELECT {keys}, {', '.join(f'avg({c}) AS {c}__target' for c in _W)} FROM roll WHERE rn <= 15 GROUP BY {keys}),
    cusum AS (SELECT {keys}, CAST(15 AS BIGINT) AS rn, {start} FROM target
              UNION ALL
              SELECT {', '.join(f'r.{n}' for n in names)}, r.rn, {step} FROM cusum p JOIN roll r ON {on} AND r.rn = p.rn + 1 JOIN target g ON {on_target})"""


def _fused(keys: str = "service_name") -> str:
    names = keys.split(", ")
    weighted = {c: f"greatest({_z(c)}, {_iqr(c)}, {c}__cusum) * {w}" for c, w in _W.items()}
    on = ", ".join(f"{n}" for n in names)
    total = " + ".join(f"w_{c}" for c in _W)
    triggered = ", ".join(f"CASE WHEN rn > 15 AND w_{c} > 0.15 THEN '{c}' END" for c in _W)
    return f"""weighted AS (SELECT roll.*, {', '.join(f'CAST({e} AS DOUBLE) AS w_{c}' for c, e in weighted.items())} FROM roll LEFT JOIN cusum USING ({on}, rn)),
    scored AS (SELECT *, rn <= 15 AS stat_warming, CASE WHEN rn > 15 THEN {hu(f'least({total}, 1.0)', 4)} ELSE 0 END AS stat_score,
                      concat_ws('|', {triggered}) AS stat_triggered FROM weighted)"""


_STAT = f"{_NUM}, {_roll('num')}, {_cusum()}, {_fused()}"


@query("w1_rolling_history", f"{_NUM}, {_roll('num')} SELECT service_name, {sql_at('window_start')}, CAST(history_size AS BIGINT) AS history_size, " + ", ".join(f"{hun(f'{c}__mean', 6)} AS {c}__mean" for c in _W) + " FROM roll")
def _(t):
    rolled = stat.rolling_history(stat.numbered(feature_table(t)), list(_W))
    return rolled.select("service_name", at("window_start"), "history_size", *[rn(f"{c}__mean") for c in _W])


@query("w2_warm_up", f"{_STAT} SELECT service_name, {sql_at('window_start')}, rn, stat_warming FROM scored")
def _(t):
    return score_table(t).select("service_name", at("window_start"), "rn", "stat_warming")


@query("w3_z_scores", f"{_NUM}, {_roll('num')} SELECT service_name, rn, " + ", ".join(f"{hu(f'CAST({_z(c)} AS DOUBLE)', 6)} AS {c}" for c in _W) + " FROM roll WHERE rn > 15")
def _(t):
    rolled = stat.rolling_history(stat.numbered(feature_table(t)), list(_W)).where("rn > 15")
    return rolled.select("service_name", "rn", *[F.expr(f"round({stat.z_score(c)}, 6) AS {c}") for c in _W])


@query("w4_iqr_scores", f"{_NUM}, {_roll('num')} SELECT service_name, rn, " + ", ".join(f"{hu(f'CAST({_iqr(c)} AS DOUBLE)', 6)} AS {c}" for c in _W) + " FROM roll WHERE rn > 15")
def _(t):
    rolled = stat.rolling_history(stat.numbered(feature_table(t)), list(_W)).where("rn > 15")
    return rolled.select("service_name", "rn", *[F.expr(f"round({stat.iqr_score(c)}, 6) AS {c}") for c in _W])


@query("w5_cusum_scores", f"{_NUM}, {_roll('num')}, {_cusum()} SELECT service_name, rn, " + ", ".join(f"{hu(f'{c}__cusum', 6)} AS {c}" for c in _W) + " FROM cusum WHERE rn > 15")
def _(t):
    rolled = settle(stat.rolling_history(stat.numbered(feature_table(t)), list(_W)), "rolled")
    return stat.add_cusum(rolled, list(_W)).where("rn > 15").select("service_name", "rn", *[F.round(f"{c}__cusum", 6).alias(c) for c in _W])


def score_table(t: Tables) -> DataFrame:
    return landed(t, "scores", lambda: stat.statistical_scores(feature_table(t)))


@query("w6_statistical_scores", f"{_STAT} SELECT service_name, {sql_at('window_start')}, stat_score, stat_triggered FROM scored")
def _(t):
    scored = stat.statistical_scores(feature_table(t))
    return scored.select("service_name", at("window_start"), "stat_score", joined("stat_triggered").alias("stat_triggered"))


_RESET_AT = "TIMESTAMP '2024-01-16 00:00:00'"


@query(
    "w7_reset_scores",
    f"""{_FEAT}, seg AS (SELECT *, CASE WHEN window_start >= {_RESET_AT} AND service_name LIKE '%-service' THEN 1 ELSE 0 END AS segment FROM feat),
    num AS (SELECT *, row_number() OVER (PARTITION BY service_name, segment ORDER BY window_start) AS rn FROM seg),
    {_roll('num', 'service_name, segment')}, {_cusum('service_name, segment')}, {_fused('service_name, segment')}
    SELECT service_name, {sql_at('window_start')}, CAST(segment AS BIGINT) AS segment, rn, stat_score FROM scored""",
)
def _(t):
    resets = t.logs.where("service_name LIKE '%-service'").select("service_name", F.expr(_RESET_AT).alias("reset_at")).distinct()
    scored = stat.statistical_scores(feature_table(t), resets=resets)
    return scored.select("service_name", at("window_start"), "segment", "rn", "stat_score")


# ---- forest and ensemble -----------------------------------------------------------------------------


def schedule(t: Tables) -> DataFrame:
    return forest.with_schedule(score_table(t))


@query(
    "w8_fit_schedule",
    f"""{_NUM} SELECT service_name, rn, CASE WHEN rn >= 50 THEN CAST(floor((rn - 50) / 200.0) AS BIGINT) END AS epoch,
    CASE WHEN rn >= 50 THEN 50 + 200 * CAST(floor((rn - 50) / 200.0) AS BIGINT) END AS train_end FROM num""",
)
def _(t):
    return schedule(t).select("service_name", "rn", "epoch", "train_end")


_V = list(forest.VECTOR)
_SCALER = ", ".join(f"avg(x.{c}) AS {c}__m, CASE WHEN stddev_pop(x.{c}) < 1e-12 THEN 1 ELSE stddev_pop(x.{c}) END AS {c}__s" for c in _V)


@query(
    "w9_standardised_vectors",
    f"""{_NUM}, sched AS (SELECT *, CAST(floor((rn - 50) / 200.0) AS BIGINT) AS epoch FROM num WHERE rn >= 50),
    fits AS (SELECT DISTINCT service_name, epoch, 50 + 200 * epoch AS train_end FROM sched),
    scaler AS (SELECT f.service_name, f.epoch, {_SCALER} FROM fits f JOIN num x ON x.service_name = f.service_name AND x.rn <= f.train_end GROUP BY ALL)
    SELECT service_name, rn, epoch, {', '.join(f"{hu(f'({c} - {c}__m) / {c}__s', 5)} AS {c}_scaled" for c in _V)} FROM sched JOIN scaler USING (service_name, epoch)""",
)
def _(t):
    scaled = forest.standardised(schedule(t))
    return scaled.select("service_name", "rn", "epoch", *[F.round(f"{c}_scaled", 5).alias(f"{c}_scaled") for c in _V])


def _forest_sql(trees: int = 100) -> str:
    """The forests of all fits, restated row by row from the CTE ``num``: a sample's rows go down from the root, a level a
    round (``g``); ``nodes`` has each node's split or path; ``iso`` follows every row that a fit has trained on or scores."""
    unit = lambda text, at: f"CAST('0x' || substr({text}, {at}, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
    low = ", ".join(f"min(v[{k}]) OVER w" for k in range(1, 8))
    high = low.replace("min", "max")
    length = lambda n: f"(CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} END)"
    return f"""fits AS (SELECT service_name, unnest(range(0, CAST(floor((max(rn) - 50) / 200.0) AS BIGINT) + 1)) AS epoch FROM num GROUP BY 1 HAVING max(rn) >= 50),
    trees AS (SELECT *, 50 + 200 * epoch AS n, tree, concat_ws('|', '42', service_name, '0', epoch, tree) AS tk FROM fits, range({trees}) t(tree)),
    draws AS (SELECT tk, rn FROM (SELECT tk, CAST(floor({unit("md5(tk || '|draw|' || i)", 1)} * n) AS BIGINT) + 1 AS rn, min(i) AS i
                FROM trees, range(1, 1025) d(i) WHERE n > 256 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY tk ORDER BY i) <= 256
              UNION ALL SELECT tk, unnest(range(1, n + 1)) FROM trees WHERE n <= 256),
    vec AS (SELECT service_name, rn, [{', '.join(f'CAST({c} AS DOUBLE)' for c in _V)}] AS v FROM num),
    g AS (SELECT t.tk, t.n, d.rn, v, CAST(1 AS BIGINT) AS node, 0 AS depth FROM trees t JOIN draws d USING (tk) JOIN vec USING (service_name, rn)
      UNION ALL
      SELECT tk, n, rn, v, node * 2 + CASE WHEN v[pick] > cut THEN 1 ELSE 0 END, depth + 1 FROM (
        SELECT *, lo[pick] + {unit('h', 1)} * (hi[pick] - lo[pick]) AS c, CASE WHEN c < hi[pick] THEN c ELSE lo[pick] END AS cut FROM (
          SELECT *, md5(tk || '|' || node) AS h, list_filter(range(1, 8), lambda k: hi[k] > lo[k]) AS varying,
                 varying[CAST(floor({unit('h', 17)} * len(varying)) AS BIGINT) + 1] AS pick
          FROM (SELECT *, [{low}] AS lo, [{high}] AS hi FROM g WINDOW w AS (PARTITION BY tk, node)))
        WHERE len(varying) > 0 AND depth < ceil(log2(least(n, 256))))),
    nodes AS (SELECT *, list_filter(range(1, 8), lambda k: hi[k] > lo[k]) AS varying, md5(tk || '|' || node) AS h,
                     len(varying) > 0 AND depth < ceil(log2(least(n, 256))) AS splits,
                     CASE WHEN splits THEN varying[CAST(floor({unit('h', 17)} * len(varying)) AS BIGINT) + 1] END AS pick,
                     lo[pick] + {unit('h', 1)} * (hi[pick] - lo[pick]) AS c, CASE WHEN c < hi[pick] THEN c ELSE lo[pick] END AS cut,
                     CASE WHEN NOT splits THEN depth + {length('held')} END AS path
              FROM (SELECT tk, n, node, depth, count(*) AS held, [{low.replace(' OVER w', '')}] AS lo, [{high.replace(' OVER w', '')}] AS hi FROM g GROUP BY tk, n, node, depth)),
    fall AS (SELECT t.tk, x.rn, x.v, CAST(1 AS BIGINT) AS node, CAST(NULL AS DOUBLE) AS path, 0 AS step FROM trees t JOIN vec x ON x.service_name = t.service_name AND x.rn < t.n + 200
      UNION ALL
      SELECT f.tk, f.rn, f.v, CASE WHEN m.splits THEN f.node * 2 + CASE WHEN f.v[m.pick] > m.cut THEN 1 ELSE 0 END ELSE f.node END, m.path, f.step + 1
      FROM fall f JOIN nodes m ON m.tk = f.tk AND m.node = f.node WHERE f.path IS NULL),
    iso AS (SELECT t.service_name, t.epoch, t.n, f.rn, pow(2.0, -avg(f.path) / any_value({length('least(t.n, 256)')})) AS isolation
            FROM fall f JOIN trees t USING (tk) WHERE f.path IS NOT NULL GROUP BY ALL),
    zero AS (SELECT service_name, epoch, quantile_cont(isolation, 0.95) AS q FROM iso WHERE rn <= n GROUP BY ALL),
    fraw AS (SELECT s.*, s.rn < 50 AS forest_warming, greatest(0.0, least(1.0, 2.0 * (isolation - q))) AS raw,
                    CASE WHEN s.rn < 50 THEN 0.0 ELSE {hu('greatest(0.0, least(1.0, 2.0 * (isolation - q)))', 4)} END AS forest_score
             FROM num s LEFT JOIN iso i ON i.service_name = s.service_name AND i.rn = s.rn AND i.epoch = floor((s.rn - 50) / 200.0)
             LEFT JOIN zero z ON z.service_name = i.service_name AND z.epoch = i.epoch)"""


_MODEL_SQL = f"""SELECT service_name, epoch, CAST(tree AS INTEGER) AS tree, CAST(least(t.n, 256) AS INTEGER) AS sample_size, CAST(count(*) AS INTEGER) AS nodes,
    concat_ws(',', {', '.join(f'count(*) FILTER (pick = {k})' for k in range(1, 8))}) AS splits, {hu('sum(path)', 5)} AS paths, {hu('coalesce(max(cut), 0.0)', 4)} AS highest_cut
    FROM nodes m JOIN trees t USING (tk) GROUP BY service_name, epoch, tree, t.n"""


def model_shown(model: DataFrame) -> DataFrame:
    """A tree by the number of its nodes, its splits by feature, the sum of its leaves' paths and its highest cut."""
    splits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.size(F.filter("feature", lambda f: f == k)).cast("string")), ",")
    cuts = F.filter("threshold", lambda x, i: F.get("feature", i) >= 0)
    return model.select(
        "service_name", "epoch", "tree", "sample_size", F.size("feature").alias("nodes"), splits.alias("splits"),
        F.round(F.aggregate("path", F.lit(0.0), lambda a, b: a + b), 5).alias("paths"), F.round(F.coalesce(F.array_max(cuts), F.lit(0.0)), 4).alias("highest_cut"),
    )


@query("w10_forest_model", f"{_NUM}, {_forest_sql()} {_MODEL_SQL}")
def _(t):
    return model_shown(forest.fit_forest(schedule(t)))


@query("w11_forest_scores", f"{_NUM}, {_forest_sql()} SELECT service_name, {sql_at('window_start')}, forest_warming, forest_score FROM fraw")
def _(t):
    return forest.forest_scores(schedule(t)).select("service_name", at("window_start"), "forest_warming", "forest_score")


_GROWING = ", ".join(f"CASE WHEN abs(({c} - avg({c}) OVER g) / (stddev_pop({c}) OVER g + 1e-9)) > 2 THEN '{c}' END" for c in _V)


@query(
    "w12_drivers",
    f"{_NUM} SELECT service_name, rn, concat_ws('|', {_GROWING}) AS drivers FROM num WINDOW g AS (PARTITION BY service_name ORDER BY rn ROWS UNBOUNDED PRECEDING)",
)
def _(t):
    return forest.drivers(schedule(t)).select("service_name", "rn", joined("driver_candidates").alias("drivers"))


# ---- the same over minutes: long histories with refits, full frames and chunk borders ------------------


def _minutes(sql: str) -> str:
    return sql.replace(f"INTERVAL '{WINDOW_SECONDS} seconds', timestamp", "INTERVAL '60 seconds', timestamp")


SMALL_CHUNKS = stat.StatisticalConfig(chunk_rows=300)  # so that a service's history crosses borders


def minute_table(t: Tables) -> DataFrame:
    return landed(t, "minute-features", lambda: features.window_features(t.logs, rounded=False))


@query("w1_minute_history", _minutes(ORACLES["w1_rolling_history"]))
def _(t):
    rolled = stat.rolling_history(stat.numbered(minute_table(t)), list(_W), SMALL_CHUNKS)
    return rolled.select("service_name", at("window_start"), "history_size", *[rn(f"{c}__mean") for c in _W])


@query("w5_minute_cusum", _minutes(ORACLES["w5_cusum_scores"]))
def _(t):
    rolled = settle(stat.rolling_history(stat.numbered(minute_table(t)), list(_W), SMALL_CHUNKS), "rolled")
    return stat.add_cusum(rolled, list(_W), SMALL_CHUNKS).where("rn > 15").select("service_name", "rn", *[F.round(f"{c}__cusum", 6).alias(c) for c in _W])


@query("w8_minute_schedule", _minutes(ORACLES["w8_fit_schedule"]))
def _(t):
    return forest.with_schedule(stat.numbered(minute_table(t))).select("service_name", "rn", "epoch", "train_end")


@query("w9_minute_vectors", _minutes(ORACLES["w9_standardised_vectors"]))
def _(t):
    scaled = forest.standardised(forest.with_schedule(stat.numbered(minute_table(t))))
    return scaled.select("service_name", "rn", "epoch", *[F.round(f"{c}_scaled", 5).alias(f"{c}_scaled") for c in _V])


@query("w12_minute_drivers", _minutes(ORACLES["w12_drivers"]))
def _(t):
    return forest.drivers(forest.with_schedule(stat.numbered(minute_table(t)))).select("service_name", "rn", joined("driver_candidates").alias("drivers"))


@query("w11_minute_forest", _minutes(f"{_NUM}, {_forest_sql(10)} SELECT service_name, {sql_at('window_start')}, forest_warming, forest_score FROM fraw"))
def _(t):
    """Histories of many fits, whose samples are drawn; forests of ten trees."""
    scored = forest.forest_scores(settle(forest.with_schedule(stat.numbered(minute_table(t))), "minute-schedule"), trees=10)
    return scored.select("service_name", at("window_start"), "forest_warming", "forest_score")


_FUSE = "least(CASE WHEN k < 20 THEN anomaly_score ELSE anomaly_score * 0.6 + confidence * 0.4 END, 1.0)"


@query("w13_fusion", f"{sql_views('analyses')} SELECT id, {hu(_FUSE, 4)} AS fused FROM analyses")
def _(t):
    fused = ensemble.fuse(F.col("anomaly_score"), F.col("confidence"), F.col("k") < 20)
    return t.analyses.select("id", F.round(fused, 4).alias("fused"))


def _bands(score: str) -> str:
    return f"CASE WHEN {score} < 0.30 THEN 'normal' WHEN {score} < 0.50 THEN 'low' WHEN {score} < 0.70 THEN 'medium' WHEN {score} < 0.85 THEN 'high' ELSE 'critical' END"


_ACTION = """CASE severity WHEN 'normal' THEN 'No action required.' WHEN 'low' THEN 'Monitor closely over the next 5 minutes.'
    WHEN 'medium' THEN 'Investigate logs; consider scaling or alerting on-call.' WHEN 'high' THEN 'Immediate investigation required — check dependent services.'
    WHEN 'critical' THEN 'Page on-call immediately — potential service outage.' END"""
_ANOM = f"""{_STAT}, anom AS (
    SELECT substr(sha256(concat(service_name, '@', strftime(window_start, '%Y-%m-%dT%H:%M:%S.%f'))), 1, 32) AS id,
           window_start + INTERVAL '{WINDOW_SECONDS} seconds' AS detected_at, service_name, stat_score AS anomaly_score, stat_score >= 0.5 AS is_anomaly,
           {_bands('stat_score')} AS severity, stat_triggered, total_logs, error_rate FROM scored)"""


def anomaly_table(t: Tables) -> DataFrame:
    """Scored windows of the statistical detector alone, which SQL can restate in full."""
    return landed(t, "anomalies", lambda: ensemble.detect_anomalies(feature_table(t), use_forest=False))


@query("w14_severity", f"{_ANOM} SELECT id, {sql_at('detected_at')}, service_name, anomaly_score, is_anomaly, severity, {_ACTION} AS recommended_action FROM anom")
def _(t):
    return anomaly_table(t).select("id", at("detected_at"), "service_name", "anomaly_score", "is_anomaly", "severity", "recommended_action")


@query("w15_detect_all_services", f"{_ANOM} SELECT service_name, severity, count(*) AS windows, {hu('max(anomaly_score)', 4)} AS worst FROM anom GROUP BY 1, 2")
def _(t):
    found = ensemble.detect_anomalies(feature_table(t), use_forest=False)
    return found.groupBy("service_name", "severity").agg(F.count("*").alias("windows"), F.max("anomaly_score").alias("worst"))


def _quantile(p: float) -> str:
    """Linear interpolation in the operator's own order of steps: here a last bit decides a rounding."""
    values, rank = "list(latency_ms ORDER BY latency_ms)", f"((count(latency_ms) - 1) * CAST({p} AS DOUBLE))"
    low, high = (f"{values}[CAST({f}({rank}) AS BIGINT) + 1]" for f in ("floor", "ceil"))
    return f"({low} + ({high} - {low}) * ({rank} - floor({rank})))"


_ROUNDED = re.sub(r"quantile_cont\(latency_ms, ([0-9.]+)\)", lambda m: _quantile(float(m[1])), _FEAT).replace("feat AS (", "exact AS (") + f""", feat AS (SELECT * REPLACE (
    {hu('logs_per_second', 2)} AS logs_per_second, {hu('error_rate', 4)} AS error_rate,
    {', '.join(f"{hu(f'coalesce({c}, 0.0)', 2)} AS {c}" for c in ('latency_p50', 'latency_p95', 'latency_p99', 'latency_mean'))}) FROM exact)"""
#: Both detectors over rounded features, as the whole chain has them, fused and judged.
_BOTH = f"""{_NUM.replace(_FEAT, _ROUNDED)}, {_roll('num')}, {_cusum()}, {_fused()}, {_forest_sql()},
    mixed AS (SELECT s.service_name, s.window_start, least(CASE WHEN f.forest_warming THEN s.stat_score ELSE s.stat_score * 0.6 + f.forest_score * 0.4 END, 1.0) AS m
              FROM scored s JOIN fraw f USING (service_name, rn)),
    anom AS (SELECT substr(sha256(concat(service_name, '@', strftime(window_start, '%Y-%m-%dT%H:%M:%S.%f'))), 1, 32) AS id,
             window_start + INTERVAL '{WINDOW_SECONDS} seconds' AS detected_at, service_name, {hu('m', 4)} AS anomaly_score, m >= 0.5 AS is_anomaly, {_bands('m')} AS severity FROM mixed)"""


@query("w15_detect_with_forest", f"{_BOTH} SELECT id, {sql_at('detected_at')}, service_name, anomaly_score, is_anomaly, severity FROM anom")
def _(t):
    found = incidents.anomalies_from_logs(t.logs, WINDOW_SECONDS)
    return found.select("id", at("detected_at"), "service_name", "anomaly_score", "is_anomaly", "severity")


@query(
    "a12_detector_stats",
    f"""{_ANOM} SELECT count(*) AS total_windows_analyzed, count(*) FILTER (WHERE is_anomaly) AS anomalies_detected,
    {hu('count(*) FILTER (WHERE is_anomaly) / count(*)', 4)} AS anomaly_rate, count(DISTINCT service_name) AS tracked_services FROM anom""",
)
def _(t):
    return ensemble.detector_stats(anomaly_table(t))


@query("f6_recent_anomalies", f"{_ANOM} SELECT id, {sql_at('detected_at')}, anomaly_score FROM (SELECT * FROM anom WHERE is_anomaly ORDER BY detected_at DESC, id DESC LIMIT 20)")
def _(t):
    return ensemble.recent_anomalies(anomaly_table(t)).select("id", at("detected_at"), "anomaly_score")


_ELIGIBLE = "is_anomaly AND severity NOT IN ('normal', 'low')"


@query("f7_eligible", f"{_ANOM} SELECT id, service_name, severity FROM anom WHERE {_ELIGIBLE}")
def _(t):
    return suppression.eligible(anomaly_table(t)).select("id", "service_name", "severity")


@query(
    "t6_triage_order",
    f"{_ANOM} SELECT id, severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS priority FROM anom ORDER BY priority DESC, detected_at, id",
)
def _(t):
    return suppression.triage_order(anomaly_table(t)).select("id", "severity", "priority")


@query(
    "p11_requests",
    f"{_ANOM} SELECT id AS anomaly_id, service_name, anomaly_score, severity, total_logs, {hu('error_rate', 6)} AS error_rate, stat_triggered AS triggered_on FROM anom",
)
def _(t):
    requests = context.as_requests(anomaly_table(t))
    return requests.select(
        "anomaly_id", "service_name", "anomaly_score", "severity", "window_features.total_logs",
        F.round("window_features.error_rate", 6).alias("error_rate"), joined(F.col("detector_results")[0]["triggered_on"]).alias("triggered_on"),
    )


# ---- suppression and routing -------------------------------------------------------------------------


def _fold(source: str, ts: str, ttl: str) -> str:
    """Keep if the last kept event of the key is at least a ttl old, event by event."""
    return f"""ord AS (SELECT *, row_number() OVER (PARTITION BY service_name, severity ORDER BY {ts}, id) AS n FROM {source}),
    fold AS (SELECT id, service_name, severity, {ts} AS event_at, n, true AS accepted, {ts} AS last FROM ord WHERE n = 1
             UNION ALL
             SELECT o.id, o.service_name, o.severity, o.{ts}, o.n, epoch_us(o.{ts}) - epoch_us(f.last) >= {ttl} * CAST(1000000 AS BIGINT),
                    CASE WHEN epoch_us(o.{ts}) - epoch_us(f.last) >= {ttl} * CAST(1000000 AS BIGINT) THEN o.{ts} ELSE f.last END
             FROM fold f JOIN ord o ON o.service_name = f.service_name AND o.severity = f.severity AND o.n = f.n + 1)"""


_ST4 = f"{_ANOM}, elig AS (SELECT * FROM anom WHERE {_ELIGIBLE}), {_fold('elig', 'detected_at', str(TTL_SECONDS))}"


def suppressed(t: Tables) -> DataFrame:
    return landed(t, "suppressed", lambda: suppression.suppress_anomalies(anomaly_table(t), TTL_SECONDS))


@query("st4_suppression", f"{_ST4} SELECT id, service_name, severity, {sql_at('event_at', 'detected_at')}, accepted FROM fold")
def _(t):
    marked = suppression.suppress_anomalies(anomaly_table(t), TTL_SECONDS)
    return marked.select("id", "service_name", "severity", at("detected_at"), "accepted")


@query(
    "st4_suppression_of_errors",
    f"{sql_views('analyses')}, {_fold('analyses', 'analyzed_at', '3600')} SELECT id, service_name, severity, accepted FROM fold",
)
def _(t):
    marked = suppression.mark_accepted(t.analyses, ["service_name", "severity"], "analyzed_at", "id", 3600)
    return marked.select("id", "service_name", "severity", "accepted")


@query("st6_admission", f"{sql_views('analyses')} SELECT id, row_number() OVER (ORDER BY analyzed_at, id) <= 1000 AS admitted FROM analyses")
def _(t):
    return suppression.admit(t.analyses, 1000, "analyzed_at").select("id", "admitted")


@query(
    "a14_active_locks",
    f"""{_ST4} SELECT service_name, severity, {sql_at('max(event_at)', 'last_accepted')} FROM fold WHERE accepted AND event_at <= {AS_OF}
    GROUP BY 1, 2 HAVING max(event_at) + INTERVAL '259200 seconds' > {AS_OF}""",
)
def _(t):
    locks = suppression.active_locks(suppressed(t), t.as_of, 259_200)
    return locks.select("service_name", "severity", at("last_accepted"))


@query("a13_queue_counts", f"{_ST4} SELECT count(*) FILTER (WHERE accepted) AS pushed, count(*) FILTER (WHERE NOT accepted) AS deduplicated FROM fold")
def _(t):
    return suppression.queue_counts(suppressed(t))


@query(
    "a13_decode_counts",
    f"{sql_views('logs')} SELECT count(*) FILTER (WHERE CAST(id AS BIGINT) % 8 NOT IN (0, 2, 5, 6)) AS processed, count(*) FILTER (WHERE CAST(id AS BIGINT) % 8 IN (0, 2, 5, 6)) AS errors FROM logs",
)
def _(t):
    return records.decode_counts(records.decode_records(messages(t)))


@query(
    "a13_publish_counts",
    f"{sql_views('logs')} SELECT count(*) FILTER (WHERE CAST(id AS BIGINT) % 11 <> 0) AS sent, count(*) FILTER (WHERE CAST(id AS BIGINT) % 11 = 0) AS failed, "
    "count(*) FILTER (WHERE CAST(id AS BIGINT) % 11 = 0) AS kept_aside, count(*) FILTER (WHERE CAST(id AS BIGINT) % 11 <> 0) AS on_target FROM logs",
)
def _(t):
    """Every eleventh log has no service, hence no key."""
    out = scratch_path(t.spark, "published")
    totals = records.publish(t.logs.withColumn("service_name", F.expr("if(CAST(id AS BIGINT) % 11 = 0, '', service_name)")), f"{out}/topic", dead_letters=f"{out}/letters")
    letters = records.replay_dead_letters(t.spark, f"{out}/letters").where("reason = 'no key'").agg(F.count("*").alias("kept_aside"))
    return totals.crossJoin(letters).crossJoin(t.spark.read.schema("key STRING, value STRING").json(f"{out}/topic").agg(F.count("*").alias("on_target")))


@query(
    "a13_analysis_counts",
    f"{sql_views('analyses')} SELECT count(*) FILTER (WHERE success) AS processed, count(*) FILTER (WHERE NOT success) AS failed FROM analyses",
)
def _(t):
    return t.analyses.agg(F.count_if("success").alias("processed"), F.count_if(~F.col("success")).alias("failed"))


def routable(t: Tables) -> DataFrame:
    """Analyses with the list columns of the full table; one severity in seven is unknown text."""
    return t.analyses.withColumns(
        {
            "severity": F.expr("CASE WHEN k % 7 = 0 THEN 'Catastrophic' WHEN k % 7 = 1 THEN upper(severity) ELSE severity END"),
            "affected_services": F.array("service_name", F.lit("api-gateway")),
            "remediation_steps": F.transform(F.sequence(F.lit(1), F.col("k") % 8 + 1), lambda i: F.concat(F.lit("step "), i.cast("string"))),
        }
    )


_ROUTABLE = f"""{sql_views('analyses', 'rules')},
    routable AS (SELECT * REPLACE (CASE WHEN k % 7 = 0 THEN 'Catastrophic' WHEN k % 7 = 1 THEN upper(severity) ELSE severity END AS severity) FROM analyses),
    coerced AS (SELECT concat('al-', substr(sha256(id), 1, 32)) AS id, id AS analysis_id, anomaly_id, analyzed_at AS created_at, service_name, confidence, anomaly_score, k, escalate_to,
                       concat('[', upper(severity), '] Anomaly detected on ', service_name, ' (score=', printf('%.2f', {hu('anomaly_score', 2)}), ')') AS title,
                       CASE WHEN lower(severity) IN ('low', 'medium', 'high', 'critical') THEN lower(severity) ELSE 'medium' END AS severity,
                       recommended_action, root_cause FROM routable),
    ruled AS (SELECT c.*, r.channels, r.require_confidence_above, r.cooldown_seconds, coalesce(c.confidence >= r.require_confidence_above, false) AS passes
              FROM coerced c LEFT JOIN rules r USING (severity))"""


def alerts_built(t: Tables) -> DataFrame:
    return routing.build_alerts(routable(t))


def rules(t: Tables) -> DataFrame:
    return routing.default_rules(t.spark)


@query("r1_build_alerts", f"{_ROUTABLE} SELECT id, analysis_id, {sql_at('created_at')}, title, {hu('confidence', 6)} AS confidence, 'pending' AS status FROM coerced")
def _(t):
    return alerts_built(t).select("id", "analysis_id", at("created_at"), "title", r("confidence"), "status")


@query("r2_severity_coercion", f"{_ROUTABLE} SELECT severity, count(*) AS n FROM coerced GROUP BY 1")
def _(t):
    return alerts_built(t).groupBy("severity").agg(F.count("*").alias("n"))


@query("j6_rule_lookup", f"{_ROUTABLE} SELECT id, severity, channels, require_confidence_above, cooldown_seconds FROM ruled")
def _(t):
    ruled = routing.with_rules(alerts_built(t), rules(t))
    return ruled.select("id", "severity", joined("channels", ",").alias("channels"), "require_confidence_above", "cooldown_seconds")


@query("r3_confidence_gate", f"{_ROUTABLE} SELECT id, passes FROM ruled")
def _(t):
    return routing.gate(routing.with_rules(alerts_built(t), rules(t))).select("id", "passes")


# The checking SQL's own statement of the constants.
_EMOJI = "CASE severity WHEN 'low' THEN ':information_source:' WHEN 'medium' THEN ':warning:' WHEN 'high' THEN ':rotating_light:' WHEN 'critical' THEN ':fire:' END"
_COLOUR = "CASE severity WHEN 'low' THEN '#36a64f' WHEN 'medium' THEN '#f0a500' WHEN 'high' THEN '#e01e5a' WHEN 'critical' THEN '#800000' END"
_PAGER = "CASE severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'info' END"


@query(
    "j7_constant_lookups",
    f"""{_ROUTABLE} SELECT id, {_EMOJI} AS emoji, {_COLOUR} AS color,
    {_PAGER} AS pager, {_ACTION} AS action FROM coerced""",
)
def _(t):
    severity = F.col("severity")
    return alerts_built(t).select(
        "id", fx.lookup(severity, fx.SEVERITY_EMOJI).alias("emoji"), fx.lookup(severity, fx.SEVERITY_COLOR).alias("color"),
        fx.lookup(severity, fx.PAGER_SEVERITY).alias("pager"), fx.lookup(severity, fx.SEVERITY_ACTION).alias("action"),
    )


_COOL = f"{_ROUTABLE}, pass AS (SELECT * FROM ruled WHERE passes), {_fold('pass', 'created_at', '(20 * o.cooldown_seconds)')}"
_ROUTED = f"""{_COOL},
    routed AS (SELECT a.*, CASE WHEN coalesce(f.accepted, false) THEN 'pending' ELSE 'suppressed' END AS status,
                      CASE WHEN coalesce(f.accepted, false) THEN a.channels ELSE '' END AS channels_attempted
               FROM ruled a LEFT JOIN fold f USING (id))"""


def cool_rules(t: Tables) -> DataFrame:
    """Cooldowns twenty times as long, so that repeats occur at the pace of the data."""
    return rules(t).withColumn("cooldown_seconds", F.col("cooldown_seconds") * 20)


def routed(t: Tables) -> DataFrame:
    return landed(t, "routed", lambda: routing.route_alerts(routable(t), cool_rules(t)))


@query("st5_cooldown", f"{_COOL} SELECT id, service_name, severity, accepted FROM fold")
def _(t):
    gated = routing.gate(routing.with_rules(alerts_built(t), cool_rules(t))).where("passes")
    marked = suppression.mark_accepted(gated, ["service_name", "severity"], "created_at", "id", F.col("cooldown_seconds"))
    return marked.select("id", "service_name", "severity", "accepted")


@query("r4_channels", f"{_ROUTED} SELECT channels_attempted, severity, count(*) AS n FROM routed GROUP BY 1, 2")
def _(t):
    return routed(t).groupBy(joined("channels_attempted", ",").alias("channels_attempted"), "severity").agg(F.count("*").alias("n"))


@query("r5_route_alerts", f"{_ROUTED} SELECT id, service_name, severity, status, title, channels_attempted FROM routed")
def _(t):
    alerts = routing.route_alerts(routable(t), cool_rules(t))
    return alerts.select("id", "service_name", "severity", "status", "title", joined("channels_attempted", ",").alias("channels_attempted"))


@query("r6_deliveries", f"{_ROUTED} SELECT id AS alert_id, unnest(string_split(channels_attempted, ',')) AS channel FROM routed WHERE channels_attempted <> ''")
def _(t):
    return routing.deliveries(routed(t)).select("alert_id", "channel")


def outcomes(t: Tables) -> DataFrame:
    """What each delivery came to; derived from the alert id."""
    tone = F.conv(F.substring("alert_id", 4, 2), 16, 10).cast("int")
    return routing.deliveries(routed(t)).select(
        "alert_id", "channel",
        F.when(F.col("channel") == "slack", tone % 3 != 0).otherwise(tone % 2 == 0).alias("success"),
        F.lit("connection refused").alias("error"),
        (F.col("created_at") + F.expr("INTERVAL 1 SECOND")).alias("finished_at"),
    )


_OUTCOMES = f"""{_ROUTED},
    tried AS (SELECT id, created_at, unnest(string_split(channels_attempted, ',')) AS channel, CAST(concat('0x', substr(id, 4, 2)) AS INT) AS tone FROM routed WHERE channels_attempted <> ''),
    outcome AS (SELECT *, CASE WHEN channel = 'slack' THEN tone % 3 <> 0 ELSE tone % 2 = 0 END AS success FROM tried),
    folded AS (SELECT id, string_agg(channel, ',' ORDER BY channel) FILTER (WHERE success) AS ok,
                      string_agg(channel || ': connection refused', ',' ORDER BY channel) FILTER (WHERE NOT success) AS errors, bool_or(success) AS any_ok FROM outcome GROUP BY id),
    settled AS (SELECT r.id, r.created_at, CASE WHEN f.any_ok THEN 'sent' WHEN f.id IS NOT NULL THEN 'failed' ELSE r.status END AS status,
                       coalesce(f.ok, '') AS channels_succeeded, coalesce(f.errors, '') AS error_messages,
                       CASE WHEN f.any_ok THEN r.created_at + INTERVAL '1 second' END AS sent_at FROM routed r LEFT JOIN folded f USING (id))"""


@query("r7_fold_outcomes", f"{_OUTCOMES} SELECT id, status, channels_succeeded, error_messages, {sql_at('sent_at')} FROM settled")
def _(t):
    done = routing.fold_outcomes(routed(t), outcomes(t))
    return done.select("id", "status", joined("channels_succeeded", ",").alias("channels_succeeded"), joined("error_messages", ",").alias("error_messages"), at("sent_at"))


@query(
    "a13_alert_counts",
    f"""{_OUTCOMES} SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER (WHERE status = 'suppressed') AS suppressed,
    count(*) FILTER (WHERE status NOT IN ('sent', 'suppressed')) AS failed, count(*) FILTER (WHERE status = 'pending') AS pending FROM settled""",
)
def _(t):
    return routing.alert_outcome_counts(routing.fold_outcomes(routed(t), outcomes(t)))


_STEPS = "list_transform(range(1, least(k % 8 + 1, 5) + 1), lambda i: concat(i, '. step ', i))"


@query("t4_top_steps", f"{_ROUTABLE} SELECT id, array_to_string({_STEPS}, chr(10)) AS steps FROM coerced")
def _(t):
    return alerts_built(t).select("id", payloads.numbered_steps(F.col("remediation_steps")).alias("steps"))


@query(
    "r8_chat_messages",
    f"""{_ROUTABLE} SELECT id, {_COLOUR} AS color, concat({_EMOJI}, ' ', title) AS header,
    concat('*What happened*', chr(10), root_cause, chr(10), '*Certainty* ', k, '%, *call* ', CASE WHEN escalate_to = '' THEN '_nobody named_' ELSE concat('*', escalate_to, '*') END) AS cause,
    concat('*Also touched*', chr(10), '`', service_name, '`, `api-gateway`') AS affected, 'divider' AS fourth,
    concat('*Then*', chr(10), array_to_string({_STEPS}, chr(10))) AS steps,
    concat('Lumenwatch | ', strftime(created_at, '%Y-%m-%d %H:%M:%S'), ' UTC | for anomaly `', substr(anomaly_id, 1, 8), '`') AS footer FROM coerced""",
)
def _(t):
    message = payloads.with_chat_message(alerts_built(t))

    def part(path: str, name: str) -> Column:
        return F.get_json_object("chat_message", f"$.attachments[0].{path}").alias(name)

    return message.select(
        "id", part("color", "color"), part("blocks[0].text.text", "header"), part("blocks[1].text.text", "cause"),
        part("blocks[2].fields[1].text", "affected"), part("blocks[3].type", "fourth"), part("blocks[4].text.text", "steps"),
        part("blocks[5].elements[0].text", "footer"),
    )


@query(
    "r9_pager_events",
    f"""{_ROUTABLE} SELECT id, 'trigger' AS event_action, id AS dedup_key, title AS summary, service_name AS source, {_PAGER} AS severity,
    concat(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '+00:00') AS timestamp, concat(k, '%') AS confidence, analysis_id FROM coerced""",
)
def _(t):
    events = payloads.with_pager_event(alerts_built(t), "key")
    paths = {
        "event_action": "event_action", "dedup_key": "dedup_key", "summary": "payload.summary", "source": "payload.source", "severity": "payload.severity",
        "timestamp": "payload.timestamp", "confidence": "payload.custom_details.confidence", "analysis_id": "payload.custom_details.analysis_id",
    }
    return events.select("id", *[F.get_json_object("pager_event", f"$.{p}").alias(n) for n, p in paths.items()])


# ---- context and graph ---------------------------------------------------------------------------------

LOOKBACK = 21_600


def error_requests(t: Tables) -> DataFrame:
    """Every analysed error as a request for context."""
    return t.analyses.select("anomaly_id", "service_name", F.col("analyzed_at").alias("detected_at"), "anomaly_score", "severity")


def _nearby_sql(name: str, limit: int, where: str = "TRUE", source: str = "analyses", at_column: str = "analyzed_at", key: str = "anomaly_id") -> str:
    return f"""{name} AS (SELECT * FROM (
        SELECT a.{key} AS anomaly_id, l.id, l.timestamp, l.level, concat('[', strftime(l.timestamp, '%H:%M:%S'), '] ', l.level, ' ', l.message) AS line,
               row_number() OVER (PARTITION BY a.{key} ORDER BY l.timestamp DESC, l.id DESC) AS position
        FROM {source} a JOIN logs l ON l.service_name = a.service_name AND l.timestamp BETWEEN a.{at_column} - INTERVAL '{LOOKBACK} seconds' AND a.{at_column}
        WHERE {where}) WHERE position <= {limit})"""


_NEARBY = f"{sql_views('analyses')}, {_nearby_sql('near', 50)}"
_NEARBY_ERRORS = f"{sql_views('analyses')}, {_nearby_sql('near', 30, 'l.' + _IS_ERROR)}"


@query("j1_context_logs", f"{_NEARBY} SELECT anomaly_id, position, id, line FROM near")
def _(t):
    near = context.nearby_logs(error_requests(t), t.logs, LOOKBACK)
    return near.select("anomaly_id", F.col("position").cast("bigint").alias("position"), "id", "line")


@query(
    "j2_context_errors",
    f"{_NEARBY_ERRORS} SELECT anomaly_id, string_agg(line, '|' ORDER BY position) AS lines, count(*) AS total, count(*) FILTER (WHERE {_IS_ERROR}) AS error_count FROM near GROUP BY 1",
)
def _(t):
    near = context.nearby_logs(error_requests(t), t.logs, LOOKBACK, context.ERROR_LOGS, errors_only=True)
    return context.log_lists(near).select("anomaly_id", joined("logs").alias("lines"), "total", "error_count")


@query(
    "j3_dependencies",
    f"{sql_views('logs', 'edges')} SELECT s.service_name, e.callee FROM (SELECT DISTINCT service_name FROM logs) s LEFT JOIN edges e ON e.caller = s.service_name",
)
def _(t):
    return context.dependencies(t.logs, t.edges)


@query(
    "j4_dependency_degrees",
    f"""{sql_views('table_graph')}, ends AS (SELECT caller AS service_name, 1 AS o, 0 AS i FROM table_graph UNION ALL SELECT callee, 0, 1 FROM table_graph)
    SELECT service_name, CAST(sum(o) AS BIGINT) AS dependency_count, CAST(sum(i) AS BIGINT) AS dependent_count, CAST(sum(i) AS BIGINT) AS impact_radius FROM ends GROUP BY 1""",
)
def _(t):
    return context.dependency_degrees(t.table_graph)


@query(
    "g1_hops_from_gateway",
    f"""{sql_views('table_graph')}, walk AS (SELECT 'api-gateway' AS service_name, 0 AS hops
        UNION SELECT g.callee, w.hops + 1 FROM walk w JOIN table_graph g ON g.caller = w.service_name),
    named AS (SELECT caller AS service_name FROM table_graph UNION SELECT callee FROM table_graph)
    SELECT n.service_name, min(w.hops) AS hops FROM named n LEFT JOIN walk w USING (service_name) GROUP BY 1""",
)
def _(t):
    return graph.hops_from(t.table_graph)


_GRAPH_LISTS = """outs AS (SELECT caller AS service_name, string_agg(callee, ',' ORDER BY callee) AS dependencies FROM edges GROUP BY 1),
    ins AS (SELECT callee AS service_name, string_agg(caller, ',' ORDER BY caller) AS dependents FROM edges GROUP BY 1)"""


@query(
    "j5_context",
    f"""{sql_views('analyses', 'edges', 'request_samples')}, {_nearby_sql('near', 50)}, {_nearby_sql('errs', 30, 'l.' + _IS_ERROR)}, {_GRAPH_LISTS},
    inc AS (SELECT *, make_timestamp(CAST(ceil(epoch_us(ts) / {LOOKBACK}000000.0) AS BIGINT) * {LOOKBACK}000000) AS eval_at FROM request_samples),
    per AS (SELECT service_name, status, eval_at, coalesce(sum(d), 0) / {LOOKBACK}.0 AS rate FROM
            (SELECT *, value - lag(value) OVER (PARTITION BY service_name, status, eval_at ORDER BY ts, value) AS d FROM inc) GROUP BY ALL),
    rate AS (SELECT service_name, eval_at, sum(rate) AS request_rate FROM per GROUP BY ALL)
    SELECT a.anomaly_id, (SELECT count(*) FROM near n WHERE n.anomaly_id = a.anomaly_id) AS logs, (SELECT count(*) FROM errs n WHERE n.anomaly_id = a.anomaly_id) AS errors,
           (SELECT line FROM near n WHERE n.anomaly_id = a.anomaly_id AND position = 1) AS newest, coalesce(o.dependencies, '') AS dependencies, coalesce(i.dependents, '') AS dependents,
           {hu('r.request_rate', 6)} AS request_rate
    FROM analyses a LEFT JOIN outs o USING (service_name) LEFT JOIN ins i USING (service_name)
    LEFT JOIN rate r ON r.service_name = a.service_name AND r.eval_at = make_timestamp(CAST(floor(epoch_us(a.analyzed_at) / {LOOKBACK}000000.0) AS BIGINT) * {LOOKBACK}000000)""",
)
def _(t):
    values = metrics.metric_values(t.request_samples, t.bucket_samples, window_seconds=LOOKBACK)
    full = context.assemble_context(error_requests(t), t.logs, t.edges, metrics.service_metrics(values), LOOKBACK, LOOKBACK)
    return full.select(
        "anomaly_id", F.size("recent_logs").cast("bigint").alias("logs"), F.size("error_logs").cast("bigint").alias("errors"),
        F.get("recent_logs", F.lit(0)).alias("newest"), joined("dependencies", ",").alias("dependencies"), joined("dependents", ",").alias("dependents"),
        F.round(F.col("metrics")["request_rate_5m"], 6).alias("request_rate"),
    )


# ---- service metrics -----------------------------------------------------------------------------------


def _eval(ts: str) -> str:
    return f"make_timestamp(CAST(ceil(epoch_us({ts}) / {LOOKBACK}000000.0) AS BIGINT) * {LOOKBACK}000000)"


def _rates(source: str, series: str, name: str) -> str:
    return f"""{name} AS (SELECT {series}, eval_at, coalesce(sum(CASE WHEN value >= prior THEN value - prior WHEN value < prior THEN value END), 0) / {LOOKBACK}.0 AS rate
        FROM (SELECT *, lag(value) OVER (PARTITION BY {series}, eval_at ORDER BY ts, value) AS prior FROM (SELECT *, {_eval('ts')} AS eval_at FROM {source})) GROUP BY {series}, eval_at)"""


_RATE = _rates("request_samples", "service_name, status", "rates")


@query("m1_counter_rates", f"{sql_views('request_samples')}, {_RATE} SELECT service_name, status, {sql_at('eval_at')}, {hu('rate', 8)} AS rate FROM rates")
def _(t):
    rates = metrics.counter_rate(t.request_samples, ["service_name", "status"], LOOKBACK)
    return rates.select("service_name", "status", at("eval_at"), r("rate", 8))


@query(
    "m2_error_share",
    f"""{sql_views('request_samples')}, {_RATE} SELECT service_name, {sql_at('eval_at')}, {hu('sum(rate)', 8)} AS request_rate,
    {hu("CASE WHEN sum(rate) <> 0 THEN coalesce(sum(rate) FILTER (WHERE status LIKE '5%'), 0) / sum(rate) END", 6)} AS error_rate FROM rates GROUP BY service_name, eval_at""",
)
def _(t):
    return metrics.error_share(t.request_samples, LOOKBACK).select("service_name", at("eval_at"), r("request_rate", 8), r("error_rate"))


def _quantile_sql(name: str, q: float) -> str:
    return f"""{name} AS (SELECT service_name, eval_at, CASE WHEN is_open THEN lower_le ELSE lower_le + (le - lower_le) * (total * {q} - below) / nullif(upto - below, 0) END AS {name}
        FROM (SELECT *, row_number() OVER (PARTITION BY service_name, eval_at ORDER BY le) AS n FROM placed WHERE total > 0 AND upto >= total * {q}) WHERE n = 1)"""


_QUANTILES_SQL = f"""{_rates('bucket_samples', 'service_name, le', 'brates')},
    placed AS (SELECT *, coalesce(lag(le) OVER u, 0) AS lower_le, coalesce(lag(upto) OVER u, 0) AS below, max(upto) OVER g AS total, le = max(le) OVER g AS is_open
               FROM (SELECT service_name, eval_at, le, sum(rate) AS upto FROM brates GROUP BY ALL)
               WINDOW u AS (PARTITION BY service_name, eval_at ORDER BY le), g AS (PARTITION BY service_name, eval_at)),
    {_quantile_sql('p95', 0.95)}, {_quantile_sql('p99', 0.99)}"""


@query(
    "m3_histogram_quantiles",
    f"""{sql_views('bucket_samples')}, {_QUANTILES_SQL}
    SELECT c.service_name, {sql_at('c.eval_at', 'eval_at')}, {hu('p95', 4)} AS p95, {hu('p99', 4)} AS p99 FROM (SELECT DISTINCT service_name, eval_at FROM placed) c
    LEFT JOIN p95 ON p95.service_name = c.service_name AND p95.eval_at = c.eval_at LEFT JOIN p99 ON p99.service_name = c.service_name AND p99.eval_at = c.eval_at""",
)
def _(t):
    found = metrics.histogram_quantiles(t.bucket_samples, {"p95": 0.95, "p99": 0.99}, LOOKBACK)
    return found.select("service_name", at("eval_at"), r("p95", 4), r("p99", 4))


_GAUGE = f"""newest AS (SELECT *, row_number() OVER (PARTITION BY service_name, pod, eval_at ORDER BY ts DESC, value DESC) AS n FROM
    (SELECT g.*, s.service_name, {_eval('ts')} AS eval_at FROM gauge_samples g JOIN (SELECT DISTINCT service_name FROM logs) s ON starts_with(g.pod, concat(s.service_name, '-')))),
    gauge AS (SELECT service_name, eval_at, avg(value) / 1048576 AS memory_usage_mb FROM newest WHERE n = 1 GROUP BY ALL)"""


@query("m4_memory_of_pods", f"{sql_views('gauge_samples')}, {_GAUGE} SELECT service_name, {sql_at('eval_at')}, {hu('memory_usage_mb', 5)} AS memory_usage_mb FROM gauge")
def _(t):
    pods = metrics.pods_of_services(t.gauge_samples, t.logs)
    used = metrics.gauge_average(pods, ["pod"], LOOKBACK, 1 / 1_048_576)
    return used.select("service_name", at("eval_at"), F.round("value", 5).alias("memory_usage_mb"))


@query(
    "m5_service_metrics",
    f"""{sql_views('request_samples', 'bucket_samples', 'gauge_samples')}, {_RATE}, {_QUANTILES_SQL}, {_GAUGE},
    shares AS (SELECT service_name, eval_at, sum(rate) AS request_rate, CASE WHEN sum(rate) <> 0 THEN coalesce(sum(rate) FILTER (WHERE status LIKE '5%'), 0) / sum(rate) END AS error_rate FROM rates GROUP BY ALL),
    wide AS (SELECT service_name, eval_at, coalesce(error_rate, -1) AS error_rate_5m, coalesce(request_rate, -1) AS request_rate_5m, coalesce(p95, -1) AS latency_p95_5m, coalesce(p99, -1) AS latency_p99_5m,
                    -1 AS cpu_usage_pct, coalesce(memory_usage_mb, -1) AS memory_usage_mb, -1 AS active_connections
             FROM shares FULL JOIN p95 USING (service_name, eval_at) FULL JOIN p99 USING (service_name, eval_at) FULL JOIN gauge USING (service_name, eval_at))
    SELECT service_name, {sql_at('eval_at')}, {', '.join(f"{hun(f'CAST({n} AS DOUBLE)', 4)} AS {n}" for n in metrics.METRIC_NAMES)},
           CAST({' + '.join(f'CASE WHEN {n} >= 0 THEN 1 ELSE 0 END' for n in metrics.METRIC_NAMES)} AS INT) AS available FROM wide""",
)
def _(t):
    memory = metrics.pods_of_services(t.gauge_samples, t.logs)
    values = metrics.metric_values(t.request_samples, t.bucket_samples, memory=memory, window_seconds=LOOKBACK)
    wide = metrics.service_metrics(values)
    return wide.select("service_name", at("eval_at"), *[F.round(F.col("metrics")[n] + NUDGE, 4).alias(n) for n in metrics.METRIC_NAMES], "available")


# ---- root cause ----------------------------------------------------------------------------------------


def queued(t: Tables) -> DataFrame:
    """Eligible anomalies, their feature values cut to the digits in which two engines agree."""
    found = suppression.eligible(anomaly_table(t))
    rounded = [F.round(F.col(f"features.{c}") + NUDGE, 6).alias(c) if c in _DOUBLES else F.col(f"features.{c}") for c in feature_table(t).columns]
    return found.withColumn("features", F.struct(*rounded))


_QUEUED = f"{_ANOM}, elig AS (SELECT a.*, f.* EXCLUDE (service_name, window_start, total_logs, error_rate), f.error_rate AS err FROM anom a JOIN feat f ON f.service_name = a.service_name AND f.window_start = a.detected_at - INTERVAL '{WINDOW_SECONDS} seconds' WHERE {_ELIGIBLE})"
_EDGE_VIEW = sql_views("edges")[len("WITH RECURSIVE "):]
_CONTEXT = f"{_QUEUED}, {_EDGE_VIEW}, {_nearby_sql('near', 50, source='elig', at_column='detected_at', key='id')}, {_nearby_sql('errs', 30, 'l.' + _IS_ERROR, 'elig', 'detected_at', 'id')}, {_GRAPH_LISTS}"


def _listed_sql(source: str, limit: int) -> str:
    return f"(SELECT string_agg('- ' || line, chr(10) ORDER BY position) FROM {source} n WHERE n.anomaly_id = e.id AND position <= {limit})"


def _pf(fmt: str, value: str, digits: int) -> str:
    return f"printf('{fmt}', {hu(value if value == 'anomaly_score' else hun(value, 6), digits)})"


_PROMPT = f"""concat_ws(chr(10) || chr(10),
    concat('Incident in ', e.service_name, chr(10), '- anomaly score ', {_pf('%.3f', 'anomaly_score', 3)}, ' of 1', chr(10), '- judged ', severity, chr(10), '- seen in a window of {WINDOW_SECONDS} seconds'),
    concat('What the window shows', chr(10), '- failed logs ', printf('%.1f', {hu(hun('err', 6) + ' * 100', 1)}), '% (', error_count, ' errors, ', critical_count, ' critical)', chr(10),
           '- latency in ms: median ', {_pf('%.1f', 'latency_p50', 1)}, ', 95th ', {_pf('%.1f', 'latency_p95', 1)}, ', 99th ', {_pf('%.1f', 'latency_p99', 1)}, chr(10), '- ', {_pf('%.1f', 'logs_per_second', 1)}, ' logs each second'),
    concat('Detectors', chr(10), '- statistical gives ', {_pf('%.3f', 'anomaly_score', 3)}, ', raised by ', CASE WHEN stat_triggered = '' THEN 'nothing' ELSE replace(stat_triggered, '|', ', ') END, chr(10), '- isolation_forest gives 0.000, raised by nothing'),
    coalesce('Errors before it, newest first' || chr(10) || {_listed_sql('errs', 15)}, 'Errors before it: none captured'),
    'Any logs before it, newest first' || chr(10) || {_listed_sql('near', 10)},
    concat('Neighbours', chr(10), '- it calls ', coalesce(replace(o.dependencies, ',', ', '), 'nothing'), chr(10), '- it is called by ', coalesce(replace(i.dependents, ',', ', '), 'nothing')),
    'Weigh this evidence and answer with the JSON object alone.')"""


def prompts(t: Tables) -> DataFrame:
    requests = context.as_requests(queued(t))
    return rootcause.with_prompt(context.assemble_context(requests, t.logs, t.edges, lookback_seconds=LOOKBACK))


@query("u1_prompts", f"{_CONTEXT} SELECT e.id AS anomaly_id, {_PROMPT} AS prompt FROM elig e LEFT JOIN outs o USING (service_name) LEFT JOIN ins i USING (service_name)")
def _(t):
    return prompts(t).select("anomaly_id", "prompt")


_EVIDENCE = f"(SELECT line FROM errs n WHERE n.anomaly_id = e.id AND position = 1)"


@query(
    "u2_inference",
    f"""{_CONTEXT} SELECT e.id AS anomaly_id, coalesce('Errors before the anomaly: ' || {_EVIDENCE}, 'Insufficient evidence for ' || e.service_name) AS root_cause,
    CASE WHEN {_EVIDENCE} IS NULL THEN 0.3 ELSE {hu('0.4 + 0.5 * anomaly_score', 6)} END AS confidence, '' AS response_error, 'rules' AS llm_model,
    len(list_filter(string_split_regex({_PROMPT}, '\\s+'), lambda x: x <> '')) AS prompt_tokens FROM elig e LEFT JOIN outs o USING (service_name) LEFT JOIN ins i USING (service_name)""",
)
def _(t):
    answered = rootcause.infer(prompts(t))
    return answered.select(
        "anomaly_id", F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.get_json_object("response", "$.root_cause").alias("root_cause"),
        F.round(F.get_json_object("response", "$.confidence").cast("double"), 6).alias("confidence"), "response_error", "llm_model",
    )


_ANSWERS = """CASE k % 6
    WHEN 0 THEN concat('{"root_cause":"disk full","confidence":1.5,"severity":"', severity, '","recommended_action":"free space","affected_services":["', service_name, '"]}')
    WHEN 1 THEN '{"root_cause":"leak","confidence":-0.3,"severity":"Catastrophic","recommended_action":"restart","remediation_steps":["a","b"]}'
    WHEN 2 THEN 'not json at all'
    WHEN 3 THEN '{"root_cause":"no action given","confidence":0.5,"severity":"high"}'
    WHEN 4 THEN concat('{"root_cause":"', message, '","confidence":', cast(k AS string), ',"severity":"HIGH","recommended_action":"look","escalate_to":"on-call"}')
    ELSE NULL END"""


@query(
    "u3_response_check",
    f"""{sql_views('analyses')}, src AS (SELECT *, root_cause AS message FROM analyses)
    SELECT id, CASE k % 6 WHEN 0 THEN 'disk full' WHEN 1 THEN 'leak' WHEN 4 THEN message END AS root_cause,
           CASE k % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 4 THEN CAST(least(k, 1) AS DOUBLE) END AS confidence,
           CASE k % 6 WHEN 0 THEN severity WHEN 1 THEN 'medium' ELSE 'high' END AS severity,
           CASE k % 6 WHEN 0 THEN service_name ELSE '' END AS affected, CASE k % 6 WHEN 1 THEN 'a|b' ELSE '' END AS steps, CASE k % 6 WHEN 4 THEN 'on-call' ELSE '' END AS escalate_to
    FROM src WHERE k % 6 IN (0, 1, 4)""",
)
def _(t):
    return parsed_answers(t).where("success").select(
        "id", "root_cause", "confidence", "severity", joined("affected_services").alias("affected"), joined("remediation_steps").alias("steps"), "escalate_to"
    )


def parsed_answers(t: Tables) -> DataFrame:
    asked = t.analyses.withColumn("message", F.col("root_cause")).selectExpr(
        "id", "service_name", "severity", f"{_ANSWERS} AS response", "CASE WHEN k % 6 = 5 THEN 'timeout' ELSE '' END AS response_error"
    )
    return rootcause.parse_responses(asked)


@query(
    "u4_fallback",
    f"""{sql_views('analyses')},
    src AS (SELECT *, CASE k % 6 WHEN 2 THEN 'JSON parse error' WHEN 3 THEN 'missing fields: recommended_action' ELSE 'timeout' END AS error_message FROM analyses WHERE k % 6 IN (2, 3, 5))
    SELECT id, concat('Analysis unavailable — ', error_message) AS root_cause, CAST(0 AS DOUBLE) AS confidence, severity, service_name AS affected,
           'Manual investigation required.' AS recommended_action, error_message FROM src""",
)
def _(t):
    return parsed_answers(t).where("NOT success").select(
        "id", "root_cause", "confidence", "severity", joined("affected_services").alias("affected"), "recommended_action", "error_message"
    )


@query(
    "u5_analyze_anomalies",
    f"""{_CONTEXT} SELECT concat('an-', e.id) AS id, {sql_at('detected_at', 'analyzed_at')}, e.service_name, severity,
    coalesce('Errors before the anomaly: ' || {_EVIDENCE}, 'Insufficient evidence for ' || e.service_name) AS root_cause,
    CASE WHEN {_EVIDENCE} IS NULL THEN 0.3 ELSE {hu('0.4 + 0.5 * anomaly_score', 6)} END AS confidence, true AS success, concat('an-', e.id) AS stored_id FROM elig e""",
)
def _(t):
    rows = incidents.analyze_anomalies(queued(t), t.logs, t.edges, lookback_seconds=LOOKBACK)
    return rows.select(
        "id", at("analyzed_at"), "service_name", "severity", "root_cause", F.round("confidence", 6).alias("confidence"), "success",
        F.get_json_object("raw_result", "$.id").alias("stored_id"),
    )


# ---- streaming: each job is run to the end of its input and its table is read ---------------------------


def event_stream(t: Tables, repeats: bool = True) -> DataFrame:
    """The events as a stream of logs that takes one of several unordered parts per trigger.

    Events are dealt to four parts by a hash of their ids, so every part has logs that are late against those before it, and
    every tenth event comes again in a part of its own. A part has as many files as tasks write it, so larger tables make larger
    triggers, not more of them.
    """
    folder = scratch_path(t.spark, "events")
    events = t.spark.read.schema(EVENTS).parquet(f"{t.folder}/events.parquet")
    for part in range(4):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part).write.parquet(f"{folder}/part={part}")
    if repeats:
        events.where("event_id % 10 = 3").write.parquet(f"{folder}/part=4")
    files = max(len(t.spark.read.schema(EVENTS).parquet(f"{folder}/part={part}").inputFiles()) for part in range(4))
    stream = streams.file_log_stream(t.spark, f"{folder}/part=*", EVENTS, files_per_trigger=files).selectExpr(*LOGS)
    return stream.withColumn("attributes", F.create_map(F.lit("latency_ms"), F.col("latency_ms").cast("string")))


@query("st1_stream_features", f"{_FEAT} SELECT service_name, {sql_at('window_start')}, {_FEATURES_SHOWN_SQL} FROM feat")
def _(t):
    out = scratch_path(t.spark, "st1")
    jobs.stream_features(event_stream(t), out, f"{out}/progress", WINDOW_SECONDS, rounded=False).awaitTermination()
    return jobs.read_features(t.spark, f"{out}/windows").select("service_name", at("window_start"), *features_shown())


def landed_features(t: Tables, out: str) -> DataFrame:
    """The feature table as a stream job leaves it, read as a stream."""
    feature_table(t).write.parquet(f"{out}/features/batch_id=0")
    return jobs.feature_stream(t.spark, f"{out}/features")


@query("st2_stream_scores", f"{_STAT} SELECT service_name, {sql_at('window_start')}, stat_warming, stat_score, replace(stat_triggered, '|', ',') AS stat_triggered FROM scored")
def _(t):
    """Logs to windows to scores; windows are closed, and scored, in three steps."""
    out = scratch_path(t.spark, "st2")
    jobs.stream_features(event_stream(t), f"{out}/features", f"{out}/progress-f", WINDOW_SECONDS, rounded=False).awaitTermination()
    for step, upto in enumerate(("TIMESTAMP '2024-01-08 00:00:00'", "TIMESTAMP '2024-01-19 06:00:00'", None)):
        jobs.close_windows(t.spark, f"{out}/features/windows", f"{out}/closed", step, None if upto is None else F.expr(upto))
        jobs.stream_scores(jobs.feature_stream(t.spark, f"{out}/closed"), f"{out}/rows", f"{out}/progress").awaitTermination()
    rows = t.spark.read.schema(jobs.SCORES).parquet(f"{out}/rows")
    return rows.select("service_name", at("window_start"), "stat_warming", "stat_score", "stat_triggered")


@query("st3_stream_forest", f"{_NUM}, {_forest_sql()} SELECT service_name, {sql_at('window_start')}, rn, forest_warming, forest_score FROM fraw")
def _(t):
    out = scratch_path(t.spark, "st3")
    jobs.stream_forest_scores(landed_features(t, out), f"{out}/rows", f"{out}/progress").awaitTermination()
    return t.spark.read.parquet(f"{out}/rows/scores").select("service_name", at("window_start"), "rn", "forest_warming", "forest_score")


_COOL_ALERTS = f"""{_BOTH}, elig AS (SELECT * FROM anom WHERE {_ELIGIBLE}), {_fold('elig', 'detected_at', str(TTL_SECONDS))},
    made AS (SELECT e.*, concat('al-', substr(sha256(concat('an-', e.id)), 1, 32)) AS alert_id, e.anomaly_score * 0.55 AS confidence FROM elig e JOIN fold f USING (id) WHERE f.accepted),
    gated AS (SELECT alert_id AS id, service_name, severity, detected_at, CASE severity WHEN 'medium' THEN 60000 ELSE 30000 END AS cooldown
              FROM made WHERE confidence >= CASE severity WHEN 'critical' THEN 0.5 WHEN 'high' THEN 0.4 ELSE 0.3 END),
    {re.sub(r'\b(ord|fold)\b', r'\1_2', _fold('gated', 'detected_at', 'o.cooldown'))}"""


def scored_analyses(kept: DataFrame) -> DataFrame:
    """Analyses whose confidence follows from the score alone."""
    none = F.array().cast("array<string>")
    return kept.select(
        F.concat(F.lit("an-"), "id").alias("id"), F.col("detected_at").alias("analyzed_at"), "service_name", F.col("id").alias("anomaly_id"), "anomaly_score", "severity",
        F.lit("").alias("root_cause"), (F.col("anomaly_score") * 0.55).alias("confidence"), "recommended_action", none.alias("affected_services"),
        none.alias("remediation_steps"), F.lit("").alias("escalate_to"),
    )


@query(
    "st_anomalies",
    f"""{_COOL_ALERTS} SELECT a.id, {sql_at('a.detected_at', 'detected_at')}, a.service_name, a.anomaly_score, a.is_anomaly, a.severity, coalesce(f.accepted, false) AS kept,
    CASE WHEN NOT coalesce(f.accepted, false) THEN 'none' WHEN g.accepted THEN 'pending' ELSE 'suppressed' END AS alert
    FROM anom a LEFT JOIN fold f USING (id) LEFT JOIN made m USING (id) LEFT JOIN fold_2 g ON g.id = m.alert_id""",
)
def _(t):
    """Unordered files of logs to windows, scores of both detectors, kept anomalies and routed alerts, each stage a stream."""
    out = scratch_path(t.spark, "st-anomalies")
    jobs.stream_features(event_stream(t), f"{out}/features", f"{out}/progress-f", WINDOW_SECONDS).awaitTermination()
    versions = anomaly_jobs.window_versions(t.spark, f"{out}/features/windows", files_per_trigger=1)
    slow = rules(t).withColumn("cooldown_seconds", F.col("cooldown_seconds") * 100)
    anomaly_jobs.stream_anomalies(versions, f"{out}/rows", f"{out}/progress", slow, scored_analyses, ttl_seconds=TTL_SECONDS).awaitTermination()
    kept = anomaly_jobs.read_kept(t.spark, f"{out}/rows").select("id", F.col("accepted").alias("kept"))
    alerts = anomaly_jobs.read_alerts_routed(t.spark, f"{out}/rows").select(F.col("anomaly_id").alias("id"), F.col("status").alias("alert"))
    found = anomaly_jobs.read_anomalies(t.spark, f"{out}/rows").join(kept, "id", "left").join(alerts, "id", "left")
    return found.select("id", at("detected_at"), "service_name", "anomaly_score", "is_anomaly", "severity", F.coalesce("kept", F.lit(False)).alias("kept"), F.coalesce("alert", F.lit("none")).alias("alert"))


@query("st4_stream_suppression", f"{sql_views('analyses')}, {_fold('analyses', 'analyzed_at', '3600')} SELECT id, service_name, severity, accepted FROM fold")
def _(t):
    out = scratch_path(t.spark, "st4")
    events = event_stream(t).where(ANALYSES_WHERE).selectExpr(*ANALYSES).select("id", "service_name", "severity", F.col("analyzed_at").alias("detected_at"))
    jobs.stream_suppression(events, f"{out}/rows", f"{out}/progress", ttl_seconds=3600).awaitTermination()
    return jobs.read_decisions(t.spark, f"{out}/rows").select("id", "service_name", "severity", "accepted")


@query("st7_landing", f"{sql_views('logs')} SELECT id, {sql_at('timestamp')}, service_name, level, message FROM logs")
def _(t):
    out = scratch_path(t.spark, "st7")
    jobs.land_logs(records.as_messages(event_stream(t)), f"{out}/logs", f"{out}/progress").awaitTermination()
    return tables.read_batches(t.spark, f"{out}/logs", TABLE_LOGS).select("id", at("timestamp"), "service_name", "level", "message")


@query("st7_landing_at_once", ORACLES["st7_landing"])
def _(t):
    """The default of the source: a trigger takes all files there are."""
    out = scratch_path(t.spark, "st7")
    events = streams.file_log_stream(t.spark, f"{t.folder}/events*.parquet", EVENTS).selectExpr(*LOGS)
    jobs.land_logs(records.as_messages(events), f"{out}/logs", f"{out}/progress").awaitTermination()
    return tables.read_batches(t.spark, f"{out}/logs", TABLE_LOGS).select("id", at("timestamp"), "service_name", "level", "message")


@query("st8_land_then_detect", f"{_FEAT} SELECT service_name, {sql_at('window_start')}, {_FEATURES_SHOWN_SQL} FROM feat")
def _(t):
    out = scratch_path(t.spark, "st8")

    def on_batch(logs: DataFrame, batch_id: int) -> None:
        jobs.refresh_features(logs, f"{out}/features", batch_id, WINDOW_SECONDS, rounded=False)

    jobs.land_logs(records.as_messages(event_stream(t)), f"{out}/logs", f"{out}/progress", on_batch=on_batch).awaitTermination()
    return jobs.read_features(t.spark, f"{out}/features").select("service_name", at("window_start"), *features_shown())


@query("st9_without_repeats", f"{sql_views('logs')} SELECT id, service_name FROM logs")
def _(t):
    out = scratch_path(t.spark, "st9")
    repeated = event_stream(t).select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    writer = jobs.without_repeats(repeated).select("id", "service_name").writeStream.format("parquet")
    writer.option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return t.spark.read.schema("id STRING, service_name STRING").parquet(f"{out}/rows")


@query(
    "st10_landing_counts",
    f"{sql_views('logs')} SELECT CAST(count(*) + count(*) FILTER (CAST(id AS BIGINT) % 10 = 3) AS BIGINT) AS processed, CAST(count(*) FILTER (CAST(id AS BIGINT) % 7 = 2) AS BIGINT) AS errors, "
    "CAST(count(*) FILTER (CAST(id AS BIGINT) % 7 = 2) AS BIGINT) AS kept_aside FROM logs",
)
def _(t):
    """A job that is stopped after each trigger and started again from its checkpoint, with records that cannot be decoded."""
    out = scratch_path(t.spark, "st10")
    good = records.as_messages(event_stream(t)).select("value")
    bad = streams.file_log_stream(t.spark, f"{t.folder}/events*.parquet", EVENTS).where("event_id % 7 = 2").select(F.concat(F.lit("broken "), F.col("event_id").cast("string")).alias("value"))
    for _ in range(2):
        jobs.land_logs(good.unionByName(bad), f"{out}/logs", f"{out}/progress", f"{out}/rejected").awaitTermination()
    totals = t.spark.read.schema("processed BIGINT, errors BIGINT").json(f"{out}/rejected/counts/*").agg(F.sum("processed").alias("processed"), F.sum("errors").alias("errors"))
    aside = t.spark.read.schema("raw STRING, reason STRING").json(f"{out}/rejected/rows/*").agg(F.count("*").alias("kept_aside"))
    return totals.crossJoin(aside)
