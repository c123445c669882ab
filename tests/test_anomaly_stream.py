"""The stream of anomalies against the batch operators: late and changed windows, restarts, withdrawn alerts."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import at, feature_rows
from lumenwatch.operators.ensemble import detect_anomalies
from lumenwatch.operators.routing import default_rules, route_alerts
from lumenwatch.operators.suppression import suppress_anomalies
from lumenwatch.streaming import anomalies as stream


def wild_windows(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        bad = rng.random() < 0.1
        rows.append({"error_rate": round(rng.random() * (0.9 if bad else 0.06), 4), "latency_p50": 80 + rng.random(), "latency_p95": rng.lognormvariate(6 if bad else 5, 0.4),
                     "latency_p99": rng.lognormvariate(7 if bad else 6, 0.4), "logs_per_second": 10 + rng.random(), "unique_traces": rng.randrange(40, 60)})
    return rows


def analyze(kept):
    return kept.select(
        F.concat(F.lit("an-"), "id").alias("id"), F.col("detected_at").alias("analyzed_at"), "service_name", F.col("id").alias("anomaly_id"), "anomaly_score", "severity",
        F.lit("cause").alias("root_cause"), (F.col("anomaly_score") - 0.2).alias("confidence"), "recommended_action", F.array("service_name").alias("affected_services"),
        F.array().cast("array<string>").alias("remediation_steps"), F.lit("").alias("escalate_to"),
    )


def run(spark, folder, out, resets=None):
    versions = stream.window_versions(spark, str(folder))
    known = None if resets is None else spark.readStream.schema("service_name STRING, reset_at TIMESTAMP").parquet(str(resets))
    stream.stream_anomalies(versions, out, f"{out}-progress", default_rules(spark), analyze, known, ttl_seconds=300).awaitTermination()


def land(rows, folder, batch):
    rows.coalesce(1).write.mode("overwrite").parquet(str(folder / f"batch_id={batch}"))


def compare(spark, out, features, resets=None):
    found = detect_anomalies(features, resets=resets)
    shape = lambda df: {r.id: (r.service_name, r.detected_at, pytest.approx(r.anomaly_score, abs=2.01e-4), r.is_anomaly, r.severity, [(d.score > 0, d.triggered_on) for d in r.detector_results]) for r in df.collect()}
    want = {r.id: (r.service_name, r.detected_at, r.anomaly_score, r.is_anomaly, r.severity, [(d.score > 0, d.triggered_on) for d in r.detector_results]) for r in found.collect()}
    assert shape(stream.read_anomalies(spark, out)) == want
    marked = suppress_anomalies(found, 300)
    kept = {r.id for r in marked.where("accepted").collect()}
    assert {r.id for r in stream.read_kept(spark, out).where("accepted").collect()} == kept
    routed = route_alerts(analyze(marked.where("accepted").drop("accepted")), default_rules(spark))
    named = lambda df: {(r.id, r.status, tuple(r.channels_attempted)) for r in df.collect()}
    assert named(stream.read_alerts_routed(spark, out)) == named(routed)
    return len(kept)


def test_stream_equals_batch_with_late_and_changed_windows(spark, tmp_path):
    everything = feature_rows(spark, wild_windows(310, 1), "a").unionByName(feature_rows(spark, wild_windows(90, 2), "b")).cache()
    out, landed = str(tmp_path / "out"), tmp_path / "windows"
    late = (F.col("service_name") == "a") & F.col("window_start").isin([at(60 * i) for i in (3, 57, 120)])
    early = F.col("window_start") < F.lit(at(60 * 140))
    first = everything.where(early & ~late)
    wrong = first.withColumn("error_rate", F.when(F.col("window_start") == F.lit(at(60 * 70)), 0.99).otherwise(F.col("error_rate")))
    land(wrong, landed, 0)
    run(spark, landed, out)
    before = {r.id for r in stream.read_alerts_routed(spark, out).collect()}
    land(everything.where(~early), landed, 1)  # in order: nothing before is touched
    run(spark, landed, out)
    land(first.where(F.col("window_start") == F.lit(at(60 * 70))).unionByName(everything.where(late)), landed, 2)
    run(spark, landed, out)
    assert compare(spark, out, everything) > 5
    versions = spark.read.parquet(f"{out}/anomalies").groupBy("batch_id").count().orderBy("batch_id").collect()
    assert versions[1]["count"] == everything.where(~early).count()
    assert before - {r.id for r in stream.read_alerts_routed(spark, out).collect()}  # what the wrong value raised is withdrawn


def test_restarts_of_a_history(spark, tmp_path):
    everything = feature_rows(spark, wild_windows(200, 5), "a").unionByName(feature_rows(spark, wild_windows(60, 6), "b")).cache()
    out, landed, resets = str(tmp_path / "out"), tmp_path / "windows", tmp_path / "resets"
    schema = "service_name STRING, reset_at TIMESTAMP"
    spark.createDataFrame([("b", at(60 * 20))], schema).coalesce(1).write.parquet(str(resets))
    land(everything.where(F.col("window_start") < F.lit(at(60 * 150))), landed, 0)
    run(spark, landed, out, resets)
    known = [("a", at(60 * 100)), ("a", at(60 * 40 + 30)), ("c", at(0))]  # one of them late, one before its service's first window
    spark.createDataFrame(known, schema).coalesce(1).write.mode("append").parquet(str(resets))
    land(everything.where(F.col("window_start") >= F.lit(at(60 * 150))), landed, 1)
    run(spark, landed, out, resets)
    compare(spark, out, everything, spark.createDataFrame([("b", at(60 * 20)), *known], schema))


def test_steps_of_a_trigger_are_planned_adaptively(spark, tmp_path):
    """A trigger's own tables have as few files as their rows need, not one for each shuffle partition."""
    out, landed = str(tmp_path / "out"), tmp_path / "windows"
    services = [feature_rows(spark, wild_windows(60, i), f"s{i}") for i in range(6)]
    everything = services[0]
    for rows in services[1:]:
        everything = everything.unionByName(rows)
    land(everything, landed, 0)
    run(spark, landed, out)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) > 2
    for table in ("decisions", "alerts"):
        assert len(list((tmp_path / "out" / table / "batch_id=0").glob("*.parquet"))) <= 2
    compare(spark, out, everything)
