import json

import pytest
from pyspark.sql import functions as F

from conftest import START, at
from lumenwatch.operators import payloads, routing

ANALYSIS = (
    "id STRING, analyzed_at TIMESTAMP, service_name STRING, anomaly_id STRING, anomaly_score DOUBLE, severity STRING, root_cause STRING, "
    "confidence DOUBLE, recommended_action STRING, affected_services ARRAY<STRING>, remediation_steps ARRAY<STRING>, escalate_to STRING"
)


def analyses(spark, *rows):
    """(severity, confidence, seconds[, service]) per analysis."""
    full = []
    for i, (severity, confidence, seconds, *service) in enumerate(rows):
        full.append((
            f"an-{i}", at(seconds), service[0] if service else "payment-service", f"anomaly-{i}", 0.82, severity, "DB pool exhausted",
            confidence, "Restart pool", ["payment-service", "order-service"], [f"step {n}" for n in range(1, 8)], "database-team",
        ))
    return spark.createDataFrame(full, ANALYSIS)


def route(spark, *rows, rules=None):
    rules = routing.default_rules(spark) if rules is None else rules
    return routing.route_alerts(analyses(spark, *rows), rules).orderBy("analysis_id").collect()


@pytest.mark.parametrize("severity,confidence,status,channels", [
    ("critical", 0.9, "pending", ["pagerduty", "slack"]), ("high", 0.9, "pending", ["slack"]), ("medium", 0.9, "pending", ["slack"]),
    ("low", 0.9, "pending", []), ("high", 0.10, "suppressed", []), ("high", 0.40, "pending", ["slack"]), ("weird", 0.9, "pending", ["slack"]),
    ("CRITICAL", 0.49, "suppressed", []),
])
def test_one_alert(spark, severity, confidence, status, channels):
    alert = route(spark, (severity, confidence, 0))[0]
    assert (alert.status, alert.channels_attempted) == (status, channels)


def test_title_and_copied_fields(spark):
    alert = route(spark, ("high", 0.8, 0))[0]
    assert alert.title == "[HIGH] Anomaly detected on payment-service (score=0.82)"
    assert alert.analysis_id == "an-0" and alert.affected_services == ["payment-service", "order-service"]


def test_cooldown_is_per_service_and_severity(spark):
    alerts = route(spark, ("high", 0.9, 0), ("high", 0.9, 100), ("critical", 0.9, 110), ("high", 0.9, 120, "auth-service"), ("high", 0.9, 300), ("high", 0.1, 700), ("high", 0.9, 701))
    assert [a.status for a in alerts] == ["pending", "suppressed", "pending", "pending", "pending", "suppressed", "pending"]


def test_no_rule_suppresses(spark):
    rules = routing.default_rules(spark).where("severity <> 'high'")
    assert route(spark, ("high", 0.9, 0), rules=rules)[0].status == "suppressed"


def test_outcomes(spark):
    alerts = routing.route_alerts(analyses(spark, ("critical", 0.9, 0), ("high", 0.9, 0), ("low", 0.9, 0), ("high", 0.0, 50)), routing.default_rules(spark))
    requests = {(r.alert_id, r.channel) for r in routing.deliveries(alerts).collect()}
    ids = {r.analysis_id: r.id for r in alerts.collect()}
    assert requests == {(ids["an-0"], "pagerduty"), (ids["an-0"], "slack"), (ids["an-1"], "slack")}
    outcomes = spark.createDataFrame(
        [(ids["an-0"], "pagerduty", False, "timeout", at(2)), (ids["an-0"], "slack", True, "", at(3)), (ids["an-1"], "slack", False, "connection refused", at(4))],
        "alert_id STRING, channel STRING, success BOOLEAN, error STRING, finished_at TIMESTAMP",
    )
    done = routing.fold_outcomes(alerts, outcomes)
    rows = {r.analysis_id: r for r in done.collect()}
    assert (rows["an-0"].status, rows["an-0"].sent_at, rows["an-0"].channels_succeeded) == ("sent", at(3), ["slack"])
    assert rows["an-0"].error_messages == ["pagerduty: timeout"] and rows["an-0"].channels_attempted == ["pagerduty", "slack"]
    assert (rows["an-1"].status, rows["an-1"].error_messages, rows["an-1"].sent_at) == ("failed", ["slack: connection refused"], None)
    assert (rows["an-2"].status, rows["an-3"].status) == ("pending", "suppressed")
    assert routing.alert_outcome_counts(done).first().asDict() == {"processed": 4, "sent": 1, "suppressed": 1, "failed": 2, "pending": 1}


def test_two_rules_of_a_severity_are_refused(spark):
    rules = routing.default_rules(spark)
    with pytest.raises(Exception, match="more than one rule"):
        routing.with_rules(routing.build_alerts(analyses(spark, ("high", 0.8, 0))), rules.unionByName(rules)).collect()


def test_chat_message(spark):
    alerts = routing.build_alerts(analyses(spark, ("critical", 0.84, 0)))
    attachment = json.loads(payloads.with_chat_message(alerts).first().chat_message)["attachments"][0]
    blocks = attachment["blocks"]
    assert attachment["color"] == "#800000"
    assert [b["type"] for b in blocks] == ["header", "section", "section", "divider", "section", "context"]
    assert blocks[0]["text"]["text"].startswith(":fire: [CRITICAL]")
    assert "*Certainty* 84%" in blocks[1]["text"]["text"] and "*call* *database-team*" in blocks[1]["text"]["text"]
    assert blocks[2]["fields"][1]["text"] == "*Also touched*\n`payment-service`, `order-service`"
    assert blocks[4]["text"]["text"] == "*Then*\n" + "\n".join(f"{n}. step {n}" for n in range(1, 6))
    assert "2024-01-15 00:00:00 UTC" in blocks[5]["elements"][0]["text"]


def test_chat_message_without_steps_or_team(spark):
    bare = routing.build_alerts(analyses(spark, ("low", 0.5, 0))).withColumns(
        {"remediation_steps": F.array().cast("array<string>"), "affected_services": F.array().cast("array<string>"), "escalate_to": F.lit(""), "root_cause": F.lit('say "hi" 100%\\')}
    )
    text = payloads.with_chat_message(bare).first().chat_message
    blocks = json.loads(text)["attachments"][0]["blocks"]
    assert "_none suggested_" in blocks[4]["text"]["text"] and "_not stated_" in blocks[2]["fields"][1]["text"]
    assert "_nobody named_" in blocks[1]["text"]["text"] and 'say "hi" 100%\\' in blocks[1]["text"]["text"]


@pytest.mark.parametrize("severity,mapped", [("critical", "critical"), ("high", "error"), ("medium", "warning"), ("low", "info")])
def test_pager_event(spark, severity, mapped):
    row = payloads.with_pager_event(routing.build_alerts(analyses(spark, (severity, 0.84, 0))), "key").first()
    event = json.loads(row.pager_event)
    assert (event["event_action"], event["dedup_key"], event["routing_key"]) == ("trigger", row.id, "key")
    assert event["payload"]["severity"] == mapped and event["payload"]["custom_details"]["confidence"] == "84%"
    assert event["payload"]["timestamp"].startswith(START.isoformat())
