import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import at
from lumenwatch.operators.features import batch_features, window_features
from lumenwatch.operators.percentiles import group_percentiles
from lumenwatch.operators.running import number_rows, running_totals, with_halo

LOG = "timestamp TIMESTAMP, service_name STRING, level STRING, trace_id STRING, attributes MAP<STRING,STRING>"


def logs(spark, n, service="s", level=lambda i: "INFO", latency=lambda i: None, trace=lambda i: f"t{i}", gap=0.5):
    rows = [
        (at(i * gap), service, level(i), trace(i), {} if latency(i) is None else {"latency_ms": str(latency(i))}) for i in range(n)
    ]
    return spark.createDataFrame(rows, LOG)


def test_error_counts_and_rate(spark):
    row = batch_features(logs(spark, 100, level=lambda i: "INFO" if i < 80 else "ERROR" if i < 95 else "CRITICAL")).first()
    assert (row.total_logs, row.error_count, row.critical_count, row.error_rate) == (100, 15, 5, 0.20)


def test_latency_percentiles(spark):
    row = batch_features(logs(spark, 100, latency=lambda i: 10 + i)).first()
    assert row.latency_p50 < row.latency_p95 <= row.latency_p99
    assert (row.latency_p50, row.latency_p95, row.latency_mean) == (59.5, 104.05, 59.5)


def test_no_latency_gives_zeros_and_traces_are_counted(spark):
    row = batch_features(logs(spark, 20)).first()
    assert (row.latency_p50, row.latency_p99, row.latency_mean) == (0.0, 0.0, 0.0)
    assert row.unique_traces == 20


def test_rate_uses_at_least_a_second(spark):
    assert batch_features(logs(spark, 10, gap=0.0)).first().logs_per_second == 10.0


def test_services_are_separate(spark):
    both = logs(spark, 30, "a").unionByName(logs(spark, 20, "b"))
    assert {r.service_name: r.total_logs for r in batch_features(both).collect()} == {"a": 30, "b": 20}


def test_latency_names_in_order_and_bad_values(spark):
    rows = [(at(0), "s", "INFO", "t", {"latency_ms": "oops", "elapsed_ms": "7"}), (at(1), "s", "INFO", "t", {"duration_ms": "3", "elapsed_ms": "9"})]
    row = batch_features(spark.createDataFrame(rows, LOG)).first()
    assert row.latency_mean == 5.0


def test_windows_are_tumbling(spark):
    rows = window_features(logs(spark, 240), 60).orderBy("window_start").collect()
    assert [(r.window_start, r.total_logs) for r in rows] == [(at(0), 120), (at(60), 120)]
    assert len({r.window_id for r in rows}) == 2


def test_approximate_mode_is_close(spark):
    data = logs(spark, 2000, latency=lambda i: (i * 37) % 1000)
    exact, rough = batch_features(data).first(), batch_features(data, approximate=True).first()
    assert rough.latency_p95 == pytest.approx(exact.latency_p95, rel=0.01)
    assert rough.unique_traces == pytest.approx(exact.unique_traces, rel=0.1)


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_match_brute_force_with_a_hot_group(spark, seed):
    rng = random.Random(seed)
    groups = {
        "hot": [round(rng.lognormvariate(3, 2), 2) for _ in range(6000)], "few": [rng.uniform(-5, 5) for _ in range(7)],
        "one": [42.0], "same": [3.25] * 500, "signs": [rng.choice([-1e9, -2.5, 0.0, 1e-12, 8.0]) for _ in range(300)], "none": [None] * 4,
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    names = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in group_percentiles(df, ["k"], "v", names, totals={"n": ("sum", "1L")}).collect()}
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        if vs[0] is None:
            assert got[k].p50 is None
            continue
        for name, p in names.items():
            assert got[k][name] == pytest.approx(np.percentile(vs, 100 * p), rel=1e-9, abs=1e-9)


def test_percentiles_take_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 9.0, 6)], "k STRING, v DOUBLE, n BIGINT")
    row = group_percentiles(df, ["k"], "v", {"p50": 0.5, "p30": 0.3}, "n").first()
    expanded = [1.0] * 3 + [2.0] + [9.0] * 6
    assert (row.p50, row.p30) == pytest.approx((np.percentile(expanded, 50), np.percentile(expanded, 30)))


def test_running_totals_cross_cells(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), at(rng.randrange(0, 400_000)), i, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "k STRING, ts TIMESTAMP, id INT, v INT")
    got = running_totals(df, ["k"], ["ts", "id"], F.date_trunc("day", "ts"), {"total": F.col("v"), "n": F.lit(1)}).collect()
    for k in "ab":
        total = 0
        for n, row in enumerate(sorted((r for r in got if r.k == k), key=lambda r: (r.ts, r.id)), 1):
            total += row.v
            assert (row.total, row.n) == (total, n)


def test_halo_repeats_only_chunk_tails(spark):
    df = number_rows(spark.range(25).selectExpr("'k' AS k", "id", "timestamp_seconds(id) AS ts"), ["k"], ["ts"], F.date_trunc("hour", "ts"))
    rows = with_halo(df, "rn", 10, 3).collect()
    assert sorted((r.chunk, r.rn) for r in rows if r.is_halo) == [(1, 8), (1, 9), (1, 10), (2, 18), (2, 19), (2, 20)]
    assert sorted(r.rn for r in rows if not r.is_halo) == list(range(1, 26))
