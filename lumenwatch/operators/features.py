"""Per-service feature windows (A1, A2, T5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenwatch.functions.columns import latency_ms, present
from lumenwatch.operators.percentiles import group_percentiles

WINDOW_SECONDS = 60
_PERCENTILES = {"latency_p50": 0.50, "latency_p95": 0.95, "latency_p99": 0.99}


def window_features(
    logs: DataFrame, window_seconds: int = WINDOW_SECONDS, rounded: bool = True, approximate: bool = False
) -> DataFrame:
    """One row per (service, event-time window): volume, errors, latency percentiles, traces.

    ``logs`` needs ``service_name, timestamp, level, trace_id`` and either ``latency_ms`` or ``attributes``.
    Percentiles and trace counts are exact; ``approximate`` swaps in one-pass sketches. ``rounded`` gives
    the presentation digits (rate and latency 2, error rate 4).
    """
    slot = F.window("timestamp", f"{window_seconds} seconds")
    keyed = _measured(logs).withColumn("slot_start", slot.start).withColumn("slot_end", slot.end)
    features = _aggregate(keyed, ["service_name", "slot_start", "slot_end"], approximate)
    return _finish(features, "slot_start", "slot_end", window_seconds, rounded)


def batch_features(
    logs: DataFrame, window_seconds: int = WINDOW_SECONDS, rounded: bool = True, approximate: bool = False
) -> DataFrame:
    """One row per service over the whole input; the window bounds are the first and last log."""
    features = _aggregate(_measured(logs), ["service_name"], approximate)
    return _finish(features, "first_log", "last_log", window_seconds, rounded)


def _measured(logs: DataFrame) -> DataFrame:
    latency = F.col("latency_ms") if "latency_ms" in logs.columns else latency_ms(F.col("attributes"))
    return logs.select("service_name", "timestamp", "level", "trace_id", latency.cast("double").alias("latency"))


def _aggregate(rows: DataFrame, keys: list[str], approximate: bool) -> DataFrame:
    if approximate:
        fractions = list(_PERCENTILES.values())
        return rows.groupBy(*keys).agg(
            *_counts(),
            F.percentile_approx("latency", fractions, 10_000).alias("__p"),
            F.avg("latency").alias("latency_mean"),
            F.approx_count_distinct(present(F.col("trace_id"))).alias("unique_traces"),
        ).select("*", *[F.col("__p")[i].alias(n) for i, n in enumerate(_PERCENTILES)]).drop("__p")

    traces = (
        rows.select(*keys, present(F.col("trace_id")).alias("trace"))
        .where(F.col("trace").isNotNull())
        .groupBy(*keys)
        .agg(F.count_distinct("trace").alias("unique_traces"))
    )
    weighted = rows.select(
        *keys, "latency", "level", F.lit(1).cast("bigint").alias("n"),
        F.col("timestamp").alias("first_ts"), F.col("timestamp").alias("last_ts"),
    )
    return _combine(weighted, traces, keys)


def fold_logs(logs: DataFrame, window_seconds: int = WINDOW_SECONDS) -> tuple[DataFrame, DataFrame]:
    """What logs add to their windows, in a form that sums up: equal latencies and levels counted, and distinct traces.

    ``(service_name, slot_start, slot_end, latency, level, n, first_ts, last_ts)`` and ``(service_name, slot_start, slot_end, trace)``.
    """
    slot, keys = F.window("timestamp", f"{window_seconds} seconds"), ["service_name", "slot_start", "slot_end"]
    rows = _measured(logs).withColumn("slot_start", slot.start).withColumn("slot_end", slot.end)
    level = F.when(F.col("level").isin("ERROR", "CRITICAL"), F.col("level")).otherwise("").alias("level")
    values = rows.groupBy(*keys, "latency", level).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )
    trace = present(F.col("trace_id")).alias("trace")
    return values, rows.select(*keys, trace).where("trace IS NOT NULL").distinct()


def features_from_folds(values: DataFrame, traces: DataFrame, window_seconds: int, rounded: bool = True) -> DataFrame:
    """Window features from any number of folds of each window."""
    keys = ["service_name", "slot_start", "slot_end"]
    counted = traces.groupBy(*keys).agg(F.count_distinct("trace").alias("unique_traces"))
    return _finish(_combine(values, counted, keys), "slot_start", "slot_end", window_seconds, rounded)


def _combine(weighted: DataFrame, traces: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and percentiles come from one histogram pass; trace counts need their own."""
    features = group_percentiles(
        weighted,
        keys,
        "latency",
        _PERCENTILES,
        weight="n",
        totals={
            "first_log": ("min", "first_ts"),
            "last_log": ("max", "last_ts"),
            "total_logs": ("sum", "n"),
            "error_count": ("sum", "if(level = 'ERROR', n, 0L)"),
            "critical_count": ("sum", "if(level = 'CRITICAL', n, 0L)"),
            "latency_sum": ("sum", "latency * n"),
            "latency_logs": ("sum", "if(latency IS NULL, 0L, n)"),
        },
    )
    return features.withColumn("latency_mean", F.try_divide("latency_sum", "latency_logs")).join(traces, keys, "left")


def _counts() -> list[Column]:
    level = F.col("level")
    return [
        F.min("timestamp").alias("first_log"),
        F.max("timestamp").alias("last_log"),
        F.count("*").alias("total_logs"),
        F.count_if(level == "ERROR").alias("error_count"),
        F.count_if(level == "CRITICAL").alias("critical_count"),
    ]


def _finish(features: DataFrame, start: str, end: str, window_seconds: int, rounded: bool) -> DataFrame:
    def digits(value: str, n: int) -> str:
        return f"round({value}, {n})" if rounded else value

    elapsed = "greatest((unix_micros(last_log) - unix_micros(first_log)) / 1000000D, 1D)"
    return features.selectExpr(
        f"concat_ws('@', service_name, date_format({start}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")) AS window_id",
        "service_name",
        f"{start} AS window_start",
        f"{end} AS window_end",
        f"{window_seconds} AS window_seconds",
        "total_logs",
        f"{digits(f'total_logs / {elapsed}', 2)} AS logs_per_second",
        "error_count",
        "critical_count",
        f"{digits('(error_count + critical_count) / total_logs', 4)} AS error_rate",
        *[f"{digits(f'coalesce({n}, 0D)', 2)} AS {n}" for n in [*_PERCENTILES, "latency_mean"]],
        "coalesce(unique_traces, 0L) AS unique_traces",
        "first_log",
        "last_log",
    )
