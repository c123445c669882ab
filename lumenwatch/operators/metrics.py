"""Service metrics from raw samples (M1-M5).

Samples are evaluated on a grid of instants ``eval_at``, one per ``window_seconds``; an instant sees the
samples of the window that ends there, start excluded. Windows of a series are independent, so a series
with very many samples is spread over its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE_SECONDS = 300
# Metric names, in order.
METRIC_NAMES = (
    "error_rate_5m",
    "request_rate_5m",
    "latency_p95_5m",
    "latency_p99_5m",
    "cpu_usage_pct",
    "memory_usage_mb",
    "active_connections",
)
UNAVAILABLE = -1.0


def evaluation_instant(ts: Column, window_seconds: int) -> Column:
    """End of the window (start, end] that holds a sample."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros + F.pmod(-micros, F.lit(window_seconds * 1_000_000)))


def last_instant(ts: Column, window_seconds: int) -> Column:
    """The newest evaluation instant at or before a time."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(window_seconds * 1_000_000)))


def counter_rate(samples: DataFrame, series: list[str], window_seconds: int = RATE_SECONDS) -> DataFrame:
    """Increase per second of each counter series per window (M1); a fall counts as a restart from 0.

    ``samples`` has the ``series`` columns, ``ts`` and ``value``.
    """
    keys = [*series, "eval_at"]
    cells = samples.select(*series, "ts", "value", evaluation_instant(F.col("ts"), window_seconds).alias("eval_at"))
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy("ts", "value"))
    step = F.when(F.col("value") >= before, F.col("value") - before).when(F.col("value") < before, F.col("value"))
    increases = cells.select(*keys, F.coalesce(step, F.lit(0.0)).alias("increase"))
    return increases.groupBy(*keys).agg((F.sum("increase") / window_seconds).alias("rate"))


def error_share(samples: DataFrame, window_seconds: int = RATE_SECONDS) -> DataFrame:
    """Share of 5xx requests per service and window (M2): summed over series, then divided.

    ``samples(service_name, status, ts, value)``.
    """
    rates = counter_rate(samples, ["service_name", "status"], window_seconds)
    failed = F.sum(F.when(F.col("status").rlike("^5..$"), F.col("rate")).otherwise(0.0))
    return rates.groupBy("service_name", "eval_at").agg(
        F.sum("rate").alias("request_rate"), F.try_divide(failed, F.sum("rate")).alias("error_rate")
    )


def histogram_quantiles(
    samples: DataFrame, quantiles: dict[str, float], window_seconds: int = RATE_SECONDS
) -> DataFrame:
    """Quantiles from cumulative bucket counters (M3), linear inside a bucket.

    ``samples(service_name, le, ts, value)``; the largest ``le`` is the open end and gives the bound below it.
    Null where a window has no requests.
    """
    keys = ["service_name", "eval_at"]
    # Series of one bucket (for example one per pod) add up before the quantile is taken.
    rates = counter_rate(samples, ["service_name", "le"], window_seconds)
    buckets = rates.groupBy(*keys, "le").agg(F.sum("rate").alias("upto"))
    up = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    placed = buckets.select(
        *keys,
        "le",
        "upto",
        F.lag("le", 1, 0.0).over(up).alias("lower"),
        F.lag("upto", 1, 0.0).over(up).alias("below"),
        F.max("upto").over(whole).alias("total"),
        (F.col("le") == F.max("le").over(whole)).alias("is_open"),
    )

    def quantile(q: float) -> Column:
        rank = F.col("total") * q
        inside = F.col("lower") + (F.col("le") - F.col("lower")) * F.try_divide(
            rank - F.col("below"), F.col("upto") - F.col("below")
        )
        value = F.when(F.col("is_open"), F.col("lower")).otherwise(inside)
        reached = (F.col("upto") >= rank) & (F.col("total") > 0)
        return F.min_by(F.when(reached, value), F.when(reached, F.col("le")))

    return placed.groupBy(*keys).agg(*[quantile(q).alias(name) for name, q in quantiles.items()])


def gauge_average(
    samples: DataFrame, series: list[str], window_seconds: int = RATE_SECONDS, scale: float = 1.0
) -> DataFrame:
    """Average over a service's series of the newest sample of each (M4).

    ``samples`` has ``service_name``, the ``series`` columns, ``ts`` and ``value``.
    """
    cells = samples.withColumn("eval_at", evaluation_instant(F.col("ts"), window_seconds))
    newest = cells.groupBy("service_name", "eval_at", *series).agg(
        F.max_by("value", F.struct("ts", "value")).alias("last")
    )
    return newest.groupBy("service_name", "eval_at").agg((F.avg("last") * scale).alias("value"))


def pods_of_services(samples: DataFrame, services: DataFrame) -> DataFrame:
    """Assign pod samples to services whose name, a dash and more make up the pod name.

    Every prefix of a pod name that ends before a dash is tried as a service: an equi-join.
    """
    parts = F.split("pod", "-")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "-")
    )
    candidates = samples.where(F.size(parts) > 1).withColumn("service_name", F.explode(prefixes))
    return candidates.join(services.select("service_name").distinct(), "service_name", "left_semi")


def service_metrics(values: DataFrame) -> DataFrame:
    """Name-to-value map per service and instant, -1 for a metric without samples, and how many are there (M5).

    ``values(service_name, eval_at, name, value)`` with names out of ``METRIC_NAMES``.
    """
    found = values.groupBy("service_name", "eval_at").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in METRIC_NAMES]
    )
    filled = [F.coalesce(F.col(n), F.lit(UNAVAILABLE)) for n in METRIC_NAMES]
    named = F.map_from_arrays(F.array(*[F.lit(n) for n in METRIC_NAMES]), F.array(*filled))
    return found.select("service_name", "eval_at", named.alias("metrics")).withColumn(
        "available", F.size(F.filter(F.map_values("metrics"), lambda v: v >= 0))
    )


def metric_values(
    requests: DataFrame, buckets: DataFrame, cpu: DataFrame | None = None, memory: DataFrame | None = None,
    connections: DataFrame | None = None, window_seconds: int = RATE_SECONDS,
) -> DataFrame:
    """All metrics of all services in long form, ready for ``service_metrics``.

    ``requests(service_name, status, ts, value)``, ``buckets(service_name, le, ts, value)``,
    ``cpu``/``memory(service_name, pod, ts, value)`` in CPU seconds and bytes,
    ``connections(service_name, ts, value)``.
    """
    shares = error_share(requests, window_seconds)
    quantiles = histogram_quantiles(buckets, {"p95": 0.95, "p99": 0.99}, window_seconds)
    parts = [
        _named(shares, "error_rate_5m", "error_rate"),
        _named(shares, "request_rate_5m", "request_rate"),
        _named(quantiles, "latency_p95_5m", "p95"),
        _named(quantiles, "latency_p99_5m", "p99"),
    ]
    if cpu is not None:
        per_pod = counter_rate(cpu, ["service_name", "pod"], window_seconds)
        used = per_pod.groupBy("service_name", "eval_at").agg((F.avg("rate") * 100).alias("value"))
        parts.append(_named(used, "cpu_usage_pct", "value"))
    if memory is not None:
        used = gauge_average(memory, ["pod"], window_seconds, 1 / 1_048_576)
        parts.append(_named(used, "memory_usage_mb", "value"))
    if connections is not None:
        parts.append(_named(gauge_average(connections, [], window_seconds), "active_connections", "value"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.where(F.col("value").isNotNull())


def _named(df: DataFrame, name: str, column: str) -> DataFrame:
    return df.select("service_name", "eval_at", F.lit(name).alias("name"), F.col(column).alias("value"))
