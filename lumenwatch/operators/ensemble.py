"""Fusion of the two detectors into anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenwatch.functions.columns import SEVERITY_ACTION, anomaly_severity, lookup
from lumenwatch.operators.forest import forest_scores, with_schedule
from lumenwatch.operators.statistical import StatisticalConfig, statistical_scores
from lumenwatch.schemas import DETECTOR_RESULT
from lumenwatch.session import settle

STATISTICAL_SHARE = 0.60
FOREST_SHARE = 0.40
ANOMALY_AT = 0.50


def fuse(stat: Column, forest: Column, forest_warming: Column) -> Column:
    """The statistical score alone while the forest warms up, else the weighted sum, at most 1."""
    mixed = stat * STATISTICAL_SHARE + forest * FOREST_SHARE
    return F.least(F.when(forest_warming, stat).otherwise(mixed), F.lit(1.0))


def judge(scored: DataFrame, score: Column) -> DataFrame:
    """Adds ``anomaly_score, is_anomaly, severity, recommended_action``; bands use the unrounded score."""
    with_score = scored.withColumn("__score", score)
    severity = anomaly_severity(F.col("__score"))
    return with_score.select(
        *scored.columns,
        F.round("__score", 4).alias("anomaly_score"),
        (F.col("__score") >= ANOMALY_AT).alias("is_anomaly"),
        severity.alias("severity"),
        lookup(severity, SEVERITY_ACTION).alias("recommended_action"),
    )


def detect_anomalies(
    features: DataFrame,
    config: StatisticalConfig = StatisticalConfig(),
    resets: DataFrame | None = None,
    use_forest: bool = True,
) -> DataFrame:
    """Every feature window of every service with its score, severity and detector results.

    ``use_forest=False`` keeps the statistical detector alone, as during the forest's warm-up.
    """
    scored = statistical_scores(features, config, resets)
    if use_forest:
        # Fitting, offsets, drivers and scoring all read the history.
        scored = forest_scores(with_schedule(settle(scored, "statistical-scores")))
    else:
        scored = scored.withColumns(
            {"forest_warming": F.lit(True), "forest_score": F.lit(0.0),
             "forest_triggered": F.array().cast("array<string>")}
        )
    return as_anomalies(scored, features.columns)


def as_anomalies(scored: DataFrame, feature_columns: list[str]) -> DataFrame:
    """Shape scored windows into the anomaly table."""
    judged = judge(scored, fuse(F.col("stat_score"), F.col("forest_score"), F.col("forest_warming")))
    warming = F.create_map(F.lit("status"), F.lit("warming_up"))
    stat_details = F.when(F.col("stat_warming"), warming).otherwise(
        F.create_map(
            F.lit("feature_scores"), F.to_json("stat_feature_scores"),
            F.lit("window_size"), F.col("history_size").cast("string"),
        )
    )
    forest_details = F.when(F.col("forest_warming"), warming).otherwise(
        F.create_map(F.lit("windows_seen"), F.col("rn").cast("string"))
    )
    results = F.array(
        _result("statistical", F.col("stat_score"), F.col("stat_triggered"), stat_details),
        _result("isolation_forest", F.col("forest_score"), F.col("forest_triggered"), forest_details),
    )
    return judged.select(
        F.sha2("window_id", 256).substr(1, 32).alias("id"),
        F.col("window_end").alias("detected_at"),
        "service_name",
        "window_id",
        "anomaly_score",
        "is_anomaly",
        "severity",
        "recommended_action",
        F.struct(*feature_columns).alias("features"),
        results.alias("detector_results"),
    )


def _result(name: str, score: Column, triggered: Column, details: Column) -> Column:
    return F.struct(
        F.lit(name).alias("detector_name"), score.alias("score"), triggered.alias("triggered_on"),
        details.alias("details"),
    ).cast(DETECTOR_RESULT)


def detector_stats(anomalies: DataFrame) -> DataFrame:
    """Windows seen, anomalies found and their share, services tracked."""
    flagged = F.count_if("is_anomaly")
    return anomalies.agg(
        F.count("*").alias("total_windows_analyzed"),
        flagged.alias("anomalies_detected"),
        F.coalesce(F.round(F.try_divide(flagged, F.count("*")), 4), F.lit(0.0)).alias("anomaly_rate"),
        F.count_distinct("service_name").alias("tracked_services"),
    )


def recent_anomalies(anomalies: DataFrame, limit: int = 20) -> DataFrame:
    """The newest flagged windows, shown oldest first."""
    newest = anomalies.where("is_anomaly").orderBy(F.desc("detected_at"), F.desc("id")).limit(limit)
    return newest.orderBy("detected_at", "id")
