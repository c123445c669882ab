import json

from pyspark.sql import functions as F

from conftest import at, feature_rows
from lumenwatch.operators import rootcause
from lumenwatch.operators.ensemble import detect_anomalies
from lumenwatch.operators.statistical import StatisticalConfig
from lumenwatch.plans.bindings import EDGES
from lumenwatch.plans.incidents import alerts_from_logs, analyze_anomalies
from lumenwatch.operators.routing import default_rules

CONTEXT = (
    "anomaly_id STRING, service_name STRING, anomaly_score DOUBLE, severity STRING, recent_logs ARRAY<STRING>, error_logs ARRAY<STRING>, "
    "dependencies ARRAY<STRING>, dependents ARRAY<STRING>, metrics MAP<STRING,DOUBLE>"
)


def contexts(spark, recent=(), errors=(), metrics=None):
    rows = [("a1", "payment-service", 0.87, "high", list(recent), list(errors), ["redis-cache", "postgres-primary"], [], metrics or {})]
    window = "named_struct('window_seconds', 60, 'error_rate', 0.42D, 'error_count', 42L, 'critical_count', 3L, 'latency_p50', 80D, 'latency_p95', 2000D, 'latency_p99', 3000D, 'logs_per_second', 10D)"
    results = "array(named_struct('detector_name', 'statistical', 'score', 0.9D, 'triggered_on', array('error_rate', 'latency_p95')), named_struct('detector_name', 'isolation_forest', 'score', 0D, 'triggered_on', CAST(array() AS ARRAY<STRING>)))"
    return spark.createDataFrame(rows, CONTEXT).withColumns({"window_features": F.expr(window), "detector_results": F.expr(results)})


def test_prompt_sections(spark):
    text = rootcause.with_prompt(contexts(spark, [f"log {i}" for i in range(50)], [f"err {i}" for i in range(30)], {"cpu_usage_pct": 12.5, "error_rate_5m": -1.0})).first().prompt
    assert "anomaly score 0.870 of 1" in text and "judged high" in text and "failed logs 42.0% (42 errors, 3 critical)" in text
    assert "statistical gives 0.900, raised by error_rate, latency_p95" in text and "isolation_forest gives 0.000, raised by nothing" in text
    assert "err 14" in text and "err 15" not in text and "log 9" in text and "log 10" not in text
    assert "error_rate_5m is not available\n- cpu_usage_pct is 12.500" in text
    assert "it calls redis-cache, postgres-primary\n- it is called by nothing" in text
    assert text.endswith("JSON object alone.")


def test_prompt_without_evidence(spark):
    text = rootcause.with_prompt(contexts(spark)).first().prompt
    assert "none captured" in text and "Any logs" not in text and "Service metrics" not in text


def parse(spark, *answers, error=""):
    rows = [(str(i), "payment-service", "high", a, error) for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "id STRING, service_name STRING, severity STRING, response STRING, response_error STRING")
    return rootcause.parse_responses(df).orderBy("id").collect()


GOOD = {"root_cause": "pool exhausted", "confidence": 0.84, "severity": "high", "recommended_action": "restart", "timeline": ["a", "b"], "remediation_steps": ["x"]}


def test_good_answers_are_checked(spark):
    rows = parse(spark, *[json.dumps({**GOOD, **change}) for change in ({}, {"confidence": 1.5}, {"confidence": -0.3}, {"severity": "catastrophic"}, {"severity": "CRITICAL"})])
    assert all(r.success and r.error_message == "" for r in rows)
    assert [r.confidence for r in rows] == [0.84, 1.0, 0.0, 0.84, 0.84]
    assert [r.severity for r in rows] == ["high", "high", "high", "medium", "critical"]
    assert (rows[0].timeline, rows[0].affected_services) == (["a", "b"], [])


def test_bad_answers_fall_back(spark):
    partial = {k: v for k, v in GOOD.items() if k != "confidence"}
    rows = parse(spark, "not json", json.dumps(partial), None)
    assert not any(r.success for r in rows)
    assert all(r.confidence == 0.0 and r.severity == "high" and r.affected_services == ["payment-service"] for r in rows)
    assert rows[0].root_cause == "Analysis unavailable — JSON parse error" and "confidence" in rows[1].error_message
    assert rows[0].recommended_action == "Manual investigation required."


def test_api_error_falls_back(spark):
    row = parse(spark, None, error="rate limited")[0]
    assert row.root_cause == "Analysis unavailable — rate limited" and row.error_message == "rate limited"


def test_one_failing_row_fails_alone(spark):
    def analyzer(batch):
        if (batch["service_name"] == "bad").any():
            raise ValueError("no answer")
        return [json.dumps(GOOD)] * len(batch)

    prompts = rootcause.with_prompt(contexts(spark))
    both = prompts.unionByName(prompts.withColumn("service_name", F.lit("bad"))).coalesce(1)
    rows = {r.service_name: r for r in rootcause.infer(both, analyzer, "test-model").collect()}
    assert rows["bad"].response is None and rows["bad"].response_error == "no answer"
    assert rows["payment-service"].response_error == "" and rows["payment-service"].llm_model == "test-model"


def test_short_answer_lists_are_asked_again_by_row(spark):
    asked = []

    def analyzer(batch):
        asked.append(len(batch))
        return [rootcause.Answer(json.dumps(GOOD), 7, 3)] if len(batch) == 1 else [json.dumps(GOOD)]

    prompts = rootcause.with_prompt(contexts(spark))
    three = prompts.unionByName(prompts).unionByName(prompts).coalesce(1)
    rows = rootcause.infer(three, analyzer).collect()
    assert [(r.response_error, r.prompt_tokens, r.completion_tokens) for r in rows] == [("", 7, 3)] * 3
    short = rootcause.infer(prompts, lambda batch: []).first()
    assert short.response is None and short.response_error == "0 answers for one request"


def logs_with_burst(spark):
    rows, n = [], 0
    for minute in range(80):
        for k in range(20):
            burst = minute == 70
            rows.append((f"{n:06d}", at(minute * 60 + k * 3), "payment-service", "ERROR" if burst or (minute + k) % 19 == 0 else "INFO", "DB timeout" if burst else "ok", f"t{n}", {"latency_ms": str(5000 if burst else 50 + (n * 7) % 13)}))
            n += 1
    return spark.createDataFrame(rows, "id STRING, timestamp TIMESTAMP, service_name STRING, level STRING, message STRING, trace_id STRING, attributes MAP<STRING,STRING>")


def test_logs_to_alerts(spark):
    edges = spark.createDataFrame(list(EDGES), "caller STRING, callee STRING")
    alerts = alerts_from_logs(logs_with_burst(spark), edges, default_rules(spark)).collect()
    assert alerts and all(a.status in ("pending", "suppressed") for a in alerts)
    worst = [a for a in alerts if a.created_at == at(71 * 60)]
    assert worst and "DB timeout" in worst[0].root_cause and worst[0].channels_attempted


def test_analysis_rows_keep_the_whole_result(spark):
    calm = [{"error_rate": 0.02 + 0.001 * (i % 3), "latency_p95": 200.0 + i % 7} for i in range(20)]
    features = feature_rows(spark, calm + [{"error_rate": 0.9, "latency_p95": 5000.0}])
    found = detect_anomalies(features, StatisticalConfig(), use_forest=False).where("is_anomaly")
    edges = spark.createDataFrame(list(EDGES), "caller STRING, callee STRING")
    logs = logs_with_burst(spark)
    row = analyze_anomalies(found, logs, edges).first()
    assert row.success and json.loads(row.raw_result)["id"] == row.id and row.llm_model == "rules"
    failed = analyze_anomalies(found, logs, edges, analyzer=lambda batch: ["{"] * len(batch)).first()
    assert not failed.success and failed.confidence == 0.0
