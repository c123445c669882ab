"""From analyses to alerts and their delivery state (R1-R7, J6, ST5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.functions.columns import clamp01, coerce_severity
from lumenwatch.operators.suppression import mark_accepted
from lumenwatch.schemas import ALERT_SEVERITIES, CHANNELS, RULES

# Severity, channels, least confidence, cooldown in seconds.
DEFAULT_RULES = (
    ("critical", ["pagerduty", "slack"], 0.50, 300),
    ("high", ["slack"], 0.40, 300),
    ("medium", ["slack"], 0.30, 600),
    ("low", [], 0.0, 3600),
)
DELIVERABLE = ("slack", "pagerduty")
_NO_TEXT = "CAST(array() AS ARRAY<STRING>)"


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_RULES), RULES)


def alert_title(severity: Column, service: Column, score: Column) -> Column:
    return F.format_string("[%s] Anomaly detected on %s (score=%.2f)", F.upper(severity), service, score)


def build_alerts(analyses: DataFrame) -> DataFrame:
    """One pending alert per analysis (R1) with a known severity (R2).

    The alert id is derived from the analysis id, so a replayed analysis updates its alert.
    """
    return analyses.select(
        F.concat(F.lit("al-"), F.sha2("id", 256).substr(1, 32)).alias("id"),
        F.col("analyzed_at").alias("created_at"),
        F.lit(None).cast("timestamp").alias("sent_at"),
        F.col("id").alias("analysis_id"),
        "anomaly_id",
        "service_name",
        coerce_severity(F.col("severity")).alias("severity"),
        F.lit("pending").alias("status"),
        alert_title(F.col("severity"), F.col("service_name"), F.col("anomaly_score")).alias("title"),
        "root_cause",
        clamp01(F.col("confidence")).alias("confidence"),
        "recommended_action",
        "affected_services",
        "remediation_steps",
        "escalate_to",
        *[F.expr(_NO_TEXT).alias(c) for c in ("channels_attempted", "channels_succeeded", "error_messages")],
    )


def with_rules(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule columns by severity (J6); null where no rule exists. Four rules at most are broadcast. Two rules of one
    severity are an error: a table has no last one."""
    others = [c for c in rules.columns if c != "severity"]
    single = F.when(F.count("*") > 1, F.raise_error("more than one rule for a severity")).otherwise(F.first(F.struct(*others)))
    one_per_severity = rules.where(F.col("severity").isin(*ALERT_SEVERITIES)).groupBy("severity").agg(single.alias("rule"))
    return alerts.join(F.broadcast(one_per_severity.select("severity", "rule.*")), "severity", "left")


def gate(alerts_with_rules: DataFrame) -> DataFrame:
    """Adds ``passes``: a rule exists and the confidence is not below its threshold."""
    enough = F.col("confidence") >= F.col("require_confidence_above")
    return alerts_with_rules.withColumn("passes", F.coalesce(enough, F.lit(False)))


def route_alerts(analyses: DataFrame, rules: DataFrame, cooldown_override: int | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Alerts with status and channels (R5): coercion, gate, cooldown, channels.

    Only alerts past the gate take part in the cooldown, and only kept ones start it (ST5). ``earlier`` has alerts (id,
    service_name, severity, created_at) that were kept before: they count for the cooldown and are not returned.
    """
    alerts = build_alerts(analyses)
    gated = gate(with_rules(alerts, rules))
    cooldown = F.col("cooldown_seconds") if cooldown_override is None else cooldown_override
    passed = gated.where("passes").withColumn("known", F.lit(False))
    if earlier is not None:
        before = with_rules(earlier.select("id", "service_name", "severity", "created_at"), rules).withColumn("known", F.lit(True))
        passed = passed.unionByName(before, allowMissingColumns=True)
    kept = mark_accepted(passed, ["service_name", "severity"], "created_at", "id", cooldown, "kept").where("NOT known").drop("known")
    blocked = gated.where(~F.col("passes")).withColumn("kept", F.lit(False))
    routed = kept.unionByName(blocked)
    return routed.select(
        *[
            F.when(F.col("kept"), F.lit("pending")).otherwise("suppressed").alias(c)
            if c == "status"
            else F.when(F.col("kept"), F.col("channels")).otherwise(F.expr(_NO_TEXT)).alias(c)
            if c == "channels_attempted"
            else F.col(c)
            for c in alerts.columns
        ]
    )


def deliveries(alerts: DataFrame) -> DataFrame:
    """One request per alert and channel it attempts (R6); channels without a sender are skipped."""
    live = alerts.where(F.col("status") != "suppressed")
    return live.select(F.col("id").alias("alert_id"), "created_at", F.explode("channels_attempted").alias("channel")).where(
        F.col("channel").isin(*CHANNELS) & F.col("channel").isin(*DELIVERABLE)
    )


def fold_outcomes(alerts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Alerts with the outcome of their deliveries (R7): sent if any channel succeeded, failed if none.

    ``outcomes(alert_id, channel, success, error, finished_at)``. An alert without outcomes is unchanged.
    A channel that fails once more counts once among the attempted ones.
    """
    failed = ~F.col("success")
    folded = outcomes.groupBy("alert_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("success"), F.col("channel")))).alias("ok"),
        F.sort_array(F.collect_list(F.when(failed, F.concat_ws(": ", "channel", "error")))).alias("errors"),
        F.collect_set("channel").alias("tried"),
        F.bool_or("success").alias("any_ok"),
        F.max(F.when(F.col("success"), F.col("finished_at"))).alias("done_at"),
    )
    joined = alerts.join(folded, alerts["id"] == folded["alert_id"], "left")
    known = F.col("alert_id").isNotNull()
    new = {
        "status": F.when(known & F.col("any_ok"), "sent").when(known, "failed").otherwise(F.col("status")),
        "sent_at": F.coalesce("done_at", "sent_at"),
        "channels_attempted": F.when(known, F.sort_array(F.array_union("channels_attempted", "tried"))).otherwise(
            F.col("channels_attempted")
        ),
        "channels_succeeded": F.when(known, F.col("ok")).otherwise(F.col("channels_succeeded")),
        "error_messages": F.when(known, F.col("errors")).otherwise(F.col("error_messages")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in alerts.columns])


def alert_outcome_counts(alerts: DataFrame) -> DataFrame:
    """Processed, sent, suppressed and failed (A13). Alerts without channels stay pending; they are counted
    apart and also in ``failed``, which holds everything neither sent nor suppressed."""
    status = F.col("status")
    return alerts.agg(
        F.count("*").alias("processed"),
        F.count_if(status == "sent").alias("sent"),
        F.count_if(status == "suppressed").alias("suppressed"),
        F.count_if(~status.isin("sent", "suppressed")).alias("failed"),
        F.count_if(status == "pending").alias("pending"),
    )
