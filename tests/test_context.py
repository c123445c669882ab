import random

import pytest
from pyspark.sql import functions as F

from conftest import START, at
from lumenwatch.operators import metrics
from lumenwatch.operators.context import (
    assemble_context, dependencies, dependency_degrees, dependency_lists, log_lists, nearby_logs, number_logs,
)
from lumenwatch.operators.graph import hops_from
from lumenwatch.plans.bindings import EDGES

LOG = "id STRING, service_name STRING, timestamp TIMESTAMP, level STRING, message STRING"
ANOMALY = "anomaly_id STRING, service_name STRING, detected_at TIMESTAMP"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(list(EDGES), "caller STRING, callee STRING")


@pytest.fixture(scope="module")
def logs(spark):
    rng = random.Random(2)
    rows = [("b%05d" % i, "busy", at(rng.randrange(0, 900)), rng.choice(["INFO", "ERROR", "CRITICAL"]), f"m{i}") for i in range(4000)]
    rows += [("q%05d" % i, "quiet", at(rng.randrange(0, 9000)), "ERROR", f"m{i}") for i in range(60)]
    return spark.createDataFrame(rows, LOG)


@pytest.fixture(scope="module")
def anomalies(spark):
    times = [("busy", t) for t in (0, 3, 600, 601, 899, 1400)] + [("quiet", t) for t in (0, 4000, 9000)] + [("absent", 5)]
    return spark.createDataFrame([(f"a{i}", s, at(t)) for i, (s, t) in enumerate(times)], ANOMALY)


@pytest.mark.parametrize("errors_only,limit,lookback", [(False, 50, 600), (True, 30, 600), (False, 5, 7), (False, 50, 3000)])
def test_nearby_logs_match_brute_force(logs, anomalies, errors_only, limit, lookback):
    got = {}
    for row in nearby_logs(anomalies, logs, lookback, limit, errors_only).orderBy("anomaly_id", "position").collect():
        got.setdefault(row.anomaly_id, []).append(row.id)
    every = logs.collect()
    for a in anomalies.collect():
        inside = [
            r for r in every
            if r.service_name == a.service_name and 0 <= (a.detected_at - r.timestamp).total_seconds() <= lookback
            and (not errors_only or r.level != "INFO")
        ]
        inside.sort(key=lambda r: (r.timestamp, r.id), reverse=True)
        assert got.get(a.anomaly_id, []) == [r.id for r in inside[:limit]]


def test_a_hot_service_meets_only_the_limit(spark):
    """Every log of the service in one second, with anomalies after it: pairs are counted in the join itself."""
    logs = spark.range(20_000).selectExpr("CAST(id AS STRING) AS id", "'hot' AS service_name", f"TIMESTAMP '{at(0)}' AS timestamp", "'ERROR' AS level", "'m' AS message")
    anomalies = spark.createDataFrame([(f"a{i}", "hot", at(i)) for i in range(20)], ANOMALY)
    around = number_logs(anomalies, logs)
    assert around.logs.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, 20_000, 20_000)
    rows = around.newest(50).collect()
    assert len(rows) == 20 * 50 and {r.id for r in rows} == set(sorted(map(str, range(20_000)))[-50:])
    assert around.newest(30, errors_only=True).groupBy("anomaly_id").count().where("count <> 30").isEmpty()


def test_an_anomaly_is_not_multiplied_by_the_limit(spark, logs, anomalies):
    """What meets the logs has two rows an anomaly at most, and no side of that join goes through the driver."""
    plan = number_logs(anomalies, logs).newest(50)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [service_name" in plan and "BroadcastHashJoin" not in plan
    times = [(f"a{i}", "hot", at(i)) for i in range(120)]
    each = spark.createDataFrame([(i, "hot", t, "ERROR", "m") for i, _, t in times], LOG)
    around = number_logs(spark.createDataFrame(times, ANOMALY), each)
    for limit in (1, 7, 50):  # an anomaly meets the log of its own instant and those before it, over every end of a block
        rows = {(r.anomaly_id, r.position): r.id for r in around.newest(limit).collect()}
        assert rows == {(f"a{i}", k + 1): f"a{i - k}" for i in range(120) for k in range(min(limit, i + 1))}


def test_log_lists_count_errors(logs, anomalies):
    rows = log_lists(nearby_logs(anomalies, logs, 600, 30, True)).collect()
    assert all(r.total == r.error_count == len(r.logs) <= 30 for r in rows)
    assert rows[0].logs[0].startswith("[00:")


def test_dependency_map(spark, edges):
    services = spark.createDataFrame([("Payment-Service",), ("unknown",)], "service_name STRING")
    found = {(r.service_name, r.callee) for r in dependencies(services, edges).collect()}
    assert found == {("payment-service", c) for c in ("postgres-primary", "redis-cache", "fraud-service")} | {("unknown", None)}
    degrees = {r.service_name: r for r in dependency_degrees(edges).collect()}
    assert (degrees["payment-service"].dependency_count, degrees["payment-service"].dependent_count) == (3, 2)
    assert degrees["postgres-primary"].impact_radius == 4
    lists = {r.service_name: r for r in dependency_lists(edges).collect()}
    assert lists["payment-service"].dependents == ["api-gateway", "order-service"]


def test_hops(spark, edges):
    extra = spark.createDataFrame([("island", "shore"), ("ml-model-service", "payment-service")], edges.schema)
    hops = {r.service_name: r.hops for r in hops_from(edges.unionByName(extra)).collect()}
    assert hops["api-gateway"] == 0 and hops["payment-service"] == 1 and hops["fraud-service"] == 2
    assert hops["ml-model-service"] == 3 and hops["postgres-replica"] == 3
    assert hops["island"] is None and hops["shore"] is None


def test_hops_over_a_long_chain(spark):
    chain = spark.createDataFrame([(f"s{i}" if i else "api-gateway", f"s{i + 1}") for i in range(36)], "caller STRING, callee STRING")
    hops = {r.service_name: r.hops for r in hops_from(chain).collect()}
    assert hops == {"api-gateway": 0} | {f"s{i}": i for i in range(1, 37)}


def test_missing_context_is_empty(anomalies, logs, edges):
    row = assemble_context(anomalies, logs, edges).where("service_name = 'absent'").first()
    assert (row.recent_logs, row.error_logs, row.dependencies, row.dependents, row.metrics) == ([], [], [], [], {})


# ---- metrics -------------------------------------------------------------------------------------------


def samples(spark, rows, columns):
    return spark.createDataFrame([(*r[:-2], at(r[-2]), float(r[-1])) for r in rows], columns + ", ts TIMESTAMP, value DOUBLE")


def test_counter_rate_survives_a_restart(spark):
    data = samples(spark, [("s", 10, 100), ("s", 100, 160), ("s", 200, 20), ("s", 300, 50), ("s", 310, 999)], "service_name STRING")
    rates = {r.eval_at: r.rate for r in metrics.counter_rate(data, ["service_name"], 300).collect()}
    assert rates == {at(300): pytest.approx((60 + 20 + 30) / 300), at(600): 0.0}


def test_error_share_sums_series_first(spark):
    rows = [("s", code, t, v) for code, end in (("200", 60), ("500", 10), ("503", 20)) for t, v in ((1, 0), (299, end))]
    row = metrics.error_share(samples(spark, rows, "service_name STRING, status STRING")).first()
    assert row.error_rate == pytest.approx(30 / 90)
    assert row.request_rate == pytest.approx(90 / 300)


def test_histogram_quantiles(spark):
    rows = [("s", le, t, v) for le, end in ((100.0, 50), (200.0, 90), (1000.0, 100)) for t, v in ((1, 0), (299, end))]
    data = samples(spark, rows, "service_name STRING, le DOUBLE")
    row = metrics.histogram_quantiles(data, {"p50": 0.5, "p70": 0.7, "p95": 0.95}).first()
    assert (row.p50, row.p70, row.p95) == (pytest.approx(100.0), pytest.approx(150.0), 200.0)


def test_gauges_of_pods(spark):
    rows = [("auth-service-1", 10, 100), ("auth-service-1", 20, 300), ("auth-service-2", 5, 500), ("auth", 5, 9), ("other-1", 5, 9)]
    services = spark.createDataFrame([("auth-service",), ("auth",)], "service_name STRING")
    pods = metrics.pods_of_services(samples(spark, rows, "pod STRING"), services)
    got = {r.service_name: r.value for r in metrics.gauge_average(pods, ["pod"], 300).collect()}
    assert got == {"auth-service": 400.0, "auth": 400.0}


def test_missing_metrics_are_marked(spark):
    values = spark.createDataFrame([("s", START, "cpu_usage_pct", 12.5)], "service_name STRING, eval_at TIMESTAMP, name STRING, value DOUBLE")
    row = metrics.service_metrics(values).first()
    assert row.available == 1 and row.metrics["cpu_usage_pct"] == 12.5 and row.metrics["error_rate_5m"] == -1.0
    assert set(row.metrics) == set(metrics.METRIC_NAMES)


def test_all_metrics_in_long_form(spark):
    requests = samples(spark, [("s", "200", 1, 0), ("s", "200", 299, 30)], "service_name STRING, status STRING")
    buckets = samples(spark, [("s", 10.0, 1, 0), ("s", 10.0, 299, 30), ("s", 99.0, 1, 0), ("s", 99.0, 299, 30)], "service_name STRING, le DOUBLE")
    cpu = samples(spark, [("s", "p1", 0.5, 0), ("s", "p1", 300, 30)], "service_name STRING, pod STRING")
    memory = samples(spark, [("s", "p1", 5, 2 * 1048576)], "service_name STRING, pod STRING")
    connections = samples(spark, [("s", 5, 17)], "service_name STRING")
    row = metrics.service_metrics(metrics.metric_values(requests, buckets, cpu, memory, connections)).first()
    assert row.available == 7
    assert row.metrics["cpu_usage_pct"] == pytest.approx(10.0)
    assert (row.metrics["memory_usage_mb"], row.metrics["active_connections"]) == (2.0, 17.0)
