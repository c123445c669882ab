"""Rolling statistical detector (W1-W7): z-score, IQR fence and CUSUM per service and feature.

History is numbered per (service, segment) and cut into chunks with a halo of one history length, so each
task sorts a bounded piece of a service and no service is ever held whole by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenwatch.operators.running import day_cell, number_rows, running_totals, with_halo
from lumenwatch.session import settle

# Feature weights, in order.
WEIGHTS = {"error_rate": 0.40, "latency_p95": 0.30, "latency_p99": 0.15, "logs_per_second": 0.15}
TRIGGER_ABOVE = 0.15
FLAT = 1e-9


@dataclass(frozen=True)
class StatisticalConfig:
    z_threshold: float = 3.0
    min_samples: int = 15
    cusum_k: float = 0.5
    cusum_h: float = 5.0
    history: int = 200
    # A flat history (std below 1e-9) either falls back to std 1 or, with "saturate", makes any
    # deviation count in full, which is what tiny floating-point residue does in a naive computation.
    flat_std: str = "one"
    chunk_rows: int = 5_000


def with_segments(features: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """Number the restarts of each service (W7); a window belongs to the segment it starts in.

    ``resets(service_name, reset_at)``: one row per redeploy. A running count over windows and restarts together, by days.
    """
    if resets is None:
        return features.withColumn("segment", F.lit(0).cast("bigint"))
    restarts = resets.select("service_name", F.col("reset_at").alias("__at")).distinct().withColumn("__kind", F.lit(0))
    windows = features.select("service_name", F.col("window_start").alias("__at"), F.lit(1).alias("__kind"), F.struct(*features.columns).alias("__row"))
    # At one instant a restart comes before the window that starts there.
    is_restart = F.when(F.col("__kind") == 0, 1).otherwise(0).cast("bigint")
    both = windows.unionByName(restarts, allowMissingColumns=True)
    counted = running_totals(both, ["service_name"], ["__at", "__kind"], day_cell("__at"), {"segment": is_restart})
    return counted.where("__kind = 1").select("__row.*", "segment")


def numbered(features: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """Adds ``segment`` and ``rn``, the position of a window in its service's history."""
    parts = with_segments(features, resets)
    return number_rows(parts, ["service_name", "segment"], ["window_start"], day_cell("window_start"))


def rolling_history(
    numbered_features: DataFrame, columns: list[str], config: StatisticalConfig = StatisticalConfig()
) -> DataFrame:
    """Statistics of up to ``history`` previous windows per service, current excluded.

    Adds ``history_size`` and, per column c, ``c__mean``, ``c__std``, ``c__q1``, ``c__q3``.
    """
    haloed = with_halo(numbered_features, "rn", max(config.chunk_rows, config.history), config.history)
    over = f"OVER (PARTITION BY service_name, segment, chunk ORDER BY rn ROWS BETWEEN {config.history} PRECEDING AND 1 PRECEDING)"
    stats = [f"CAST(least(rn - 1, {config.history}) AS BIGINT) AS history_size"]
    for c in columns:
        stats += [
            f"avg({c}) {over} AS {c}__mean",
            f"stddev_pop({c}) {over} AS {c}__std",
            f"percentile({c}, array(0.25, 0.75)) {over} AS {c}__quartiles",
        ]
    rolled = haloed.selectExpr("*", *stats).where("NOT is_halo")
    quartiles = [f"{c}__quartiles[{i}] AS {c}__q{q}" for c in columns for i, q in ((0, 1), (1, 3))]
    return rolled.selectExpr("*", *quartiles).drop("is_halo", *[f"{c}__quartiles" for c in columns])


def z_score(c: str, threshold: float = 3.0) -> str:
    """SQL for the z-score of a column against its rolling mean and std."""
    return f"if({c}__std < {FLAT}D, 0D, least(abs(({c} - {c}__mean) / {c}__std) / {threshold}D, 1D))"


def iqr_score(c: str) -> str:
    """SQL for the distance of a column outside its 1.5 IQR fences, in IQR units, at most 1."""
    iqr = f"({c}__q3 - {c}__q1)"
    outside = f"greatest({c} - ({c}__q3 + 1.5D * {iqr}), ({c}__q1 - 1.5D * {iqr}) - {c}, 0D)"
    return f"if({iqr} < {FLAT}D, 0D, least({outside} / ({iqr} + {FLAT}D), 1D))"


def add_cusum(
    rolled: DataFrame, columns: list[str], config: StatisticalConfig = StatisticalConfig()
) -> DataFrame:
    """Two-sided CUSUM score ``c__cusum`` per column.

    The recursion ``S = max(0, S + x)`` equals ``C - min(0, running minimum of C)`` with C the running
    total of x. C and its minimum are taken inside chunks and shifted by what the earlier chunks add.
    """
    keys = ["service_name", "segment"]
    scored = f"rn > {config.min_samples}"
    targets = rolled.where(f"rn <= {config.min_samples}").groupBy(*keys).agg(
        *[F.expr(f"avg({c}) AS {c}__target") for c in columns]
    )
    flat = 1.0 if config.flat_std == "one" else 0.0
    scales = [f"if({c}__std < {FLAT}D, {flat}D, {c}__std) AS {c}__scale" for c in columns]
    steps, sides = [], []
    for c in columns:
        slack = f"{config.cusum_k}D * {c}__scale"
        for side, drift in (("pos", f"({c} - {c}__target)"), ("neg", f"({c}__target - {c})")):
            sides.append(f"{c}__{side}")
            steps.append(f"if({scored}, {drift} - {slack}, 0D) AS {c}__{side}")
    moved = rolled.join(targets, keys).selectExpr("*", *scales).selectExpr("*", *steps)

    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    inside = f"OVER (PARTITION BY service_name, segment, chunk ORDER BY rn {upto}"
    running = moved.selectExpr("*", *[f"sum({s}) {inside} AS {s}__c" for s in sides])
    running = running.selectExpr("*", *[f"min({s}__c) {inside} AS {s}__low" for s in sides])

    # One row per chunk: its total, its lowest point, and where both stand relative to the whole history.
    before = "OVER (PARTITION BY service_name, segment ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    chunks = running.groupBy(*keys, "chunk").agg(
        *[F.expr(f"sum({s}) AS {s}__sum") for s in sides], *[F.expr(f"min({s}__c) AS {s}__min") for s in sides]
    )
    chunks = chunks.selectExpr("*", *[f"coalesce(sum({s}__sum) {before}, 0D) AS {s}__off" for s in sides])
    offsets = chunks.selectExpr(
        *keys,
        "chunk",
        *[f"{s}__off" for s in sides],
        *[f"coalesce(min({s}__off + {s}__min) {before}, 0D) AS {s}__floor" for s in sides],
    )
    scores = []
    for c in columns:
        peaks = [f"{s}__off + {s}__c - least(0D, {s}__floor, {s}__off + {s}__low)" for s in (f"{c}__pos", f"{c}__neg")]
        limit = f"({config.cusum_h}D * {c}__scale + {FLAT}D)"
        scores.append(f"if({scored}, least(greatest({', '.join(peaks)}) / {limit}, 1D), NULL) AS {c}__cusum")
    return running.join(offsets, [*keys, "chunk"]).selectExpr(*rolled.columns, *scores)


def statistical_scores(
    features: DataFrame, config: StatisticalConfig = StatisticalConfig(), resets: DataFrame | None = None
) -> DataFrame:
    """Weighted fusion of the per-feature maxima (W6); 0 while warming up.

    The rolling history is landed once (one job) because the score and the CUSUM carry both read it.
    Adds ``rn, segment, stat_warming, stat_score, stat_triggered, stat_feature_scores, history_size``.
    """
    columns = list(WEIGHTS)
    rolled = settle(rolling_history(numbered(features, resets), columns, config), "rolling-history")
    scored = add_cusum(rolled, columns, config)
    warm = f"rn > {config.min_samples}"
    weighted = [
        f"if({warm}, greatest({z_score(c, config.z_threshold)}, {iqr_score(c)}, {c}__cusum) * {weight}D, NULL) AS {c}__weighted"
        for c, weight in WEIGHTS.items()
    ]
    parts = {c: f"{c}__weighted" for c in columns}
    triggered = ", ".join(f"if({p} > {TRIGGER_ABOVE}D, '{c}', NULL)" for c, p in parts.items())
    named = ", ".join(f"'{c}', round({p}, 4)" for c, p in parts.items())
    return scored.selectExpr("*", *weighted).selectExpr(
        *features.columns,
        "segment",
        "rn",
        f"least(history_size + 1, {config.history}L) AS history_size",
        f"NOT ({warm}) AS stat_warming",
        f"if({warm}, round(least({' + '.join(parts.values())}, 1D), 4), 0D) AS stat_score",
        f"if({warm}, array_compact(array({triggered})), CAST(array() AS ARRAY<STRING>)) AS stat_triggered",
        f"if({warm}, map({named}), NULL) AS stat_feature_scores",
    )
