"""The whole chain from logs to alerts as DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenwatch.operators.context import LOOKBACK_SECONDS, as_requests, assemble_context
from lumenwatch.operators.ensemble import detect_anomalies
from lumenwatch.operators.features import WINDOW_SECONDS, window_features
from lumenwatch.operators.metrics import RATE_SECONDS
from lumenwatch.operators.rootcause import Analyzer, infer, parse_responses, rule_analyzer, with_prompt
from lumenwatch.operators.routing import route_alerts
from lumenwatch.operators.statistical import StatisticalConfig
from lumenwatch.operators.suppression import SUPPRESS_SECONDS, suppress_anomalies
from lumenwatch.session import settle
from lumenwatch.sources.tables import with_raw_result


def anomalies_from_logs(
    logs: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    config: StatisticalConfig = StatisticalConfig(),
    resets: DataFrame | None = None,
    use_forest: bool = True,
) -> DataFrame:
    """Logs to scored windows. The feature table is landed once: it is small beside the logs, and both
    detectors read it several times."""
    features = settle(window_features(logs, window_seconds), "features")
    return detect_anomalies(features, config, resets, use_forest)


def analyze_anomalies(
    anomalies: DataFrame,
    logs: DataFrame,
    edges: DataFrame,
    metrics: DataFrame | None = None,
    analyzer: Analyzer = rule_analyzer,
    model_name: str = "rules",
    lookback_seconds: int = LOOKBACK_SECONDS,
    metrics_seconds: int = RATE_SECONDS,
    analyzed_at: Column | None = None,
) -> DataFrame:
    """Anomalies to analysis rows: context, prompt, inference, checked response.

    Answers are landed before they are read further, so a model is asked once per anomaly. ``analyzed_at``
    defaults to the anomaly's own time.
    """
    requests = as_requests(anomalies)
    context = assemble_context(requests, logs, edges, metrics, lookback_seconds, metrics_seconds)
    answered = settle(infer(with_prompt(context), analyzer, model_name), "responses")
    checked = parse_responses(answered)
    rows = checked.select(
        F.concat(F.lit("an-"), "anomaly_id").alias("id"),
        (F.col("detected_at") if analyzed_at is None else analyzed_at).alias("analyzed_at"),
        "service_name", "anomaly_id", "anomaly_score", "severity", "root_cause", "confidence", "affected_services",
        "recommended_action", "remediation_steps", "timeline", "contributing_factors", "escalate_to", "llm_model",
        "prompt_tokens", "completion_tokens", "analysis_duration_ms", "success",
        "error_message",
    )
    return with_raw_result(rows)


def alerts_from_logs(
    logs: DataFrame,
    edges: DataFrame,
    rules: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    ttl_seconds: int = SUPPRESS_SECONDS,
    analyzer: Analyzer = rule_analyzer,
    use_forest: bool = True,
) -> DataFrame:
    """Logs to routed alerts: detect, suppress repeats, analyse, route."""
    anomalies = settle(anomalies_from_logs(logs, window_seconds, use_forest=use_forest), "anomalies")
    kept = suppress_anomalies(anomalies, ttl_seconds).where("accepted").drop("accepted")
    analyses = settle(analyze_anomalies(settle(kept, "queued"), logs, edges, analyzer=analyzer), "analyses")
    return route_alerts(analyses, rules)
