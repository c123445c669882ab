"""Context of an anomaly: nearby logs, dependencies, metrics, and their assembly."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenwatch.functions.columns import is_error, log_line
from lumenwatch.operators.metrics import RATE_SECONDS, last_instant
from lumenwatch.operators.running import ranged_totals
from lumenwatch.session import settle

LOOKBACK_SECONDS = 600
RECENT_LOGS = 50
ERROR_LOGS = 30


class NumberedLogs(NamedTuple):
    """Logs around anomalies, numbered once for all limits.

    ``logs`` has ``n``, a log's number within its service in time order, and ``e``, its number among the errors; ``ends`` has for each
    anomaly the numbers it has come to, so its newest k logs are those numbered n - k + 1 to n.
    """

    logs: DataFrame
    ends: DataFrame

    def newest(self, limit: int, errors_only: bool = False) -> DataFrame:
        """The newest ``limit`` logs of each anomaly within its look-back, one row each with ``position`` 1 for the newest.

        An equi-join on blocks of ``limit`` numbers: an anomaly's logs lie in two blocks at most, however many its service writes. Both
        sides grow with the logs, so they are merged: landed tables are estimated by their packed size, too small to trust for a broadcast.
        """
        number = "e" if errors_only else "n"
        logs = self.logs.where(is_error(F.col("level"))) if errors_only else self.logs
        first, last = F.greatest(F.col(number) - limit + 1, F.lit(1)), F.col(number)
        wanted = self.ends.where(F.col(number) > 0).select(
            "anomaly_id", "service_name", "since", first.alias("first"), last.alias("last"),
            F.explode(F.sequence(F.floor(first / limit), F.floor(last / limit))).alias("block"),
        )
        rows = logs.select("service_name", "id", "timestamp", "level", "message", F.col(number).alias("number"), F.floor(F.col(number) / limit).alias("block"))
        pairs = wanted.join(rows.hint("merge"), ["service_name", "block"]).where(F.col("number").between(F.col("first"), F.col("last")) & (F.col("timestamp") >= F.col("since")))
        return pairs.select(
            "anomaly_id", "service_name", (F.col("last") - F.col("number") + 1).cast("int").alias("position"), "id", "timestamp", "level", "message",
            log_line(F.col("timestamp"), F.col("level"), F.col("message")).alias("line"),
        )


def number_logs(anomalies: DataFrame, logs: DataFrame, lookback_seconds: int = LOOKBACK_SECONDS) -> NumberedLogs:
    """Number the logs that may be in a look-back. ``anomalies(anomaly_id, service_name, detected_at)``.

    Logs in no stretch of a look-back's length that an anomaly's own touches are left out first. Logs and anomalies then
    go in time order through one pass over ranges of bounded row counts, which carries both running counts.
    """
    wanted = anomalies.select("anomaly_id", "service_name", "detected_at", (F.col("detected_at") - F.expr(f"INTERVAL {lookback_seconds} SECONDS")).alias("since"))
    wanted = settle(wanted, "look-backs")
    ends = [_cell(F.col(c), max(lookback_seconds, 1)) for c in ("since", "detected_at")]
    touched = wanted.select("service_name", F.explode(F.array(*ends)).alias("cell")).distinct()
    near = _logs_around(wanted, logs, lookback_seconds).select("service_name", "timestamp", "id", "level", "message", _cell(F.col("timestamp"), max(lookback_seconds, 1)).alias("cell"))
    near = near.join(touched, ["service_name", "cell"], "left_semi").drop("cell")
    none = F.lit(None)
    both = near.select("*", F.lit(0).alias("kind"), none.cast("string").alias("anomaly_id"), none.cast("timestamp").alias("since")).unionByName(
        # At an instant the anomaly comes after the logs: both ends of the look-back are included.
        wanted.select("service_name", F.col("detected_at").alias("timestamp"), F.lit(1).alias("kind"), "anomaly_id", "since"), allowMissingColumns=True
    )
    is_log = F.when(F.col("kind") == 0, 1).otherwise(0).cast("bigint")
    counts = {"n": is_log, "e": F.when(is_error(F.col("level")), is_log).otherwise(0).cast("bigint")}
    numbered = settle(ranged_totals(both, ["service_name"], ["timestamp", "kind", "id"], counts), "numbered-logs")
    return NumberedLogs(
        numbered.where("kind = 0").select("service_name", "timestamp", "id", "level", "message", "n", "e"),
        numbered.where("kind = 1").select("anomaly_id", "service_name", "since", "n", "e"),
    )


def nearby_logs(
    anomalies: DataFrame,
    logs: DataFrame,
    lookback_seconds: int = LOOKBACK_SECONDS,
    limit: int = RECENT_LOGS,
    errors_only: bool = False,
) -> DataFrame:
    """The newest ``limit`` logs of each anomaly's service within the look-back before it, both ends included."""
    return number_logs(anomalies, logs, lookback_seconds).newest(limit, errors_only)


def _logs_around(anomalies: DataFrame, logs: DataFrame, lookback_seconds: int) -> DataFrame:
    """Logs in the time range of all anomalies; two scalar bounds that reach the scan, and its day partitions."""
    ends = anomalies.agg(
        (F.min("detected_at") - F.expr(f"INTERVAL {lookback_seconds} SECONDS")).alias("low"), F.max("detected_at").alias("high")
    )
    low, high = ends.select("low"), ends.select("high")
    logs = logs.where((F.col("timestamp") >= low.scalar()) & (F.col("timestamp") <= high.scalar()))
    if "event_date" in logs.columns:
        days = [end.select(F.to_date(end.columns[0])).scalar() for end in (low, high)]
        logs = logs.where((F.col("event_date") >= days[0]) & (F.col("event_date") <= days[1]))
    return logs


def _cell(ts: Column, width: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / width)


def log_lists(nearby: DataFrame, name: str = "logs") -> DataFrame:
    """Lines per anomaly, newest first, with ``total`` and ``error_count`` (J2); at most ``limit`` each."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "line")))
    return nearby.groupBy("anomaly_id").agg(
        F.transform(ordered, lambda x: x["line"]).alias(name),
        F.count("*").alias("total"),
        F.count_if(is_error(F.col("level"))).alias("error_count"),
    )


def dependencies(services: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per service and service it calls; null callee when it calls none."""
    named = services.select(F.lower("service_name").alias("service_name")).distinct()
    calls = edges.select(F.col("caller").alias("service_name"), "callee").distinct()
    return named.join(calls, "service_name", "left")


def dependency_degrees(edges: DataFrame) -> DataFrame:
    """Direct dependencies and dependents of every service in the graph, and its impact radius."""
    calls = edges.select("caller", "callee").distinct()
    ends = calls.select(
        F.explode(
            F.array(
                F.struct(F.col("caller").alias("service_name"), F.lit(1).alias("out"), F.lit(0).alias("in")),
                F.struct(F.col("callee").alias("service_name"), F.lit(0).alias("out"), F.lit(1).alias("in")),
            )
        ).alias("end")
    ).select("end.*")
    return ends.groupBy("service_name").agg(
        F.sum("out").alias("dependency_count"), F.sum("in").alias("dependent_count")
    ).withColumn("impact_radius", F.col("dependent_count"))


def dependency_lists(edges: DataFrame) -> DataFrame:
    """Sorted callee and caller lists per service, as a context row carries them."""
    calls = edges.select("caller", "callee").distinct()
    out = calls.groupBy(F.col("caller").alias("service_name")).agg(F.sort_array(F.collect_list("callee")).alias("dependencies"))
    into = calls.groupBy(F.col("callee").alias("service_name")).agg(F.sort_array(F.collect_list("caller")).alias("dependents"))
    return out.join(into, "service_name", "full_outer")


def as_requests(anomalies: DataFrame) -> DataFrame:
    """Anomaly rows as analysis requests."""
    return anomalies.select(
        F.col("id").alias("anomaly_id"),
        "service_name",
        "anomaly_score",
        "severity",
        F.col("features").alias("window_features"),
        "detector_results",
        "detected_at",
    )


def assemble_context(
    requests: DataFrame,
    logs: DataFrame,
    edges: DataFrame,
    metrics: DataFrame | None = None,
    lookback_seconds: int = LOOKBACK_SECONDS,
    metrics_seconds: int = RATE_SECONDS,
) -> DataFrame:
    """Requests with their context; a missing part is an empty list or map.

    ``metrics(service_name, eval_at, metrics, available)`` as ``service_metrics`` makes it; a request
    takes the last instant of the evaluation grid at or before it.
    """
    around = number_logs(requests, logs, lookback_seconds)
    recent = log_lists(around.newest(RECENT_LOGS), "recent_logs")
    errors = log_lists(around.newest(ERROR_LOGS, errors_only=True), "error_logs")
    graph = dependency_lists(edges)
    joined = (
        requests.join(recent.select("anomaly_id", "recent_logs"), "anomaly_id", "left")
        .join(errors.select("anomaly_id", "error_logs"), "anomaly_id", "left")
        .join(graph, "service_name", "left")
    )
    no_text, no_metrics = F.array().cast("array<string>"), F.expr("CAST(map() AS MAP<STRING,DOUBLE>)")
    if metrics is None:
        joined = joined.withColumn("metrics", no_metrics)
    else:
        joined = joined.withColumn("eval_at", last_instant(F.col("detected_at"), metrics_seconds)).join(
            metrics.select("service_name", "eval_at", "metrics"), ["service_name", "eval_at"], "left"
        )
    return joined.select(
        *requests.columns,
        *[F.coalesce(c, no_text).alias(c) for c in ("recent_logs", "error_logs", "dependencies", "dependents")],
        F.coalesce("metrics", no_metrics).alias("metrics"),
    )
