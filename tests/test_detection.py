import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import at, feature_rows
from lumenwatch.operators import forest
from lumenwatch.operators.ensemble import detect_anomalies, detector_stats, recent_anomalies
from lumenwatch.operators.statistical import WEIGHTS, StatisticalConfig, numbered, statistical_scores

STEADY = {}
SPIKE = {"error_rate": 0.80, "latency_p95": 2000.0, "latency_p99": 2000.0}


def scores(features, config=StatisticalConfig(), resets=None):
    return statistical_scores(features, config, resets).orderBy("service_name", "window_start").collect()


def brute(windows, config):
    """The detector window by window."""
    history = {c: [] for c in WEIGHTS}
    state = {c: [0.0, 0.0, None] for c in WEIGHTS}
    out = []
    for w in windows:
        total = 0.0
        for c, weight in WEIGHTS.items():
            v, h, s = w[c], history[c], state[c]
            if len(h) >= config.min_samples:
                a = np.array(h[-config.history :])
                mean, std = a.mean(), a.std()
                z = 0.0 if std < 1e-9 else min(abs(v - mean) / std / config.z_threshold, 1)
                q1, q3 = np.percentile(a, [25, 75])
                iqr = q3 - q1
                fence = 0.0 if iqr < 1e-9 else min(max(v - q3 - 1.5 * iqr, q1 - 1.5 * iqr - v, 0) / (iqr + 1e-9), 1)
                if s[2] is None:
                    s[2] = a.mean()
                scale = std if std >= 1e-9 else (1.0 if config.flat_std == "one" else 0.0)
                s[0] = max(0.0, s[0] + v - s[2] - config.cusum_k * scale)
                s[1] = max(0.0, s[1] - v + s[2] - config.cusum_k * scale)
                total += weight * max(z, fence, min(max(s[0], s[1]) / (config.cusum_h * scale + 1e-9), 1))
            h.append(v)
        out.append(min(total, 1.0))
    return out


@pytest.mark.parametrize("config", [
    StatisticalConfig(),
    StatisticalConfig(history=20, chunk_rows=20),
    StatisticalConfig(history=30, chunk_rows=50, min_samples=5, flat_std="saturate"),
])
def test_scores_match_the_recursion_across_chunks(spark, config):
    rng = random.Random(7)
    windows = [
        {"error_rate": round(rng.choice([0.02, 0.02, rng.random() * 0.3]), 4), "latency_p95": rng.lognormvariate(5, 0.4),
         "latency_p99": 300.0 if i < 120 else rng.lognormvariate(6, 0.4), "logs_per_second": 10 + i * 0.02 + rng.random()}
        for i in range(260)
    ]
    got = [r.stat_score for r in scores(feature_rows(spark, windows), config)]
    assert got == pytest.approx(brute(windows, config), abs=6e-5)


def test_warm_up_then_steady(spark):
    rows = scores(feature_rows(spark, [STEADY] * 17))
    assert [r.stat_warming for r in rows] == [True] * 15 + [False] * 2
    assert rows[0].stat_score == 0.0 and rows[-1].stat_score < 0.3


def test_error_spike(spark):
    jittered = [{"error_rate": 0.02 + 0.0001 * (i % 3), "latency_p95": 200.0 + i % 5, "latency_p99": 300.0 + i % 5} for i in range(20)]
    last = scores(feature_rows(spark, jittered + [SPIKE]))[-1]
    assert last.stat_score > 0.5
    assert {"error_rate", "latency_p95"} <= set(last.stat_triggered)
    assert "latency_p99" not in last.stat_triggered  # its weight cannot pass the bar


def test_spike_over_a_flat_history_saturates_on_request(spark):
    windows = [{"error_rate": 0.02}] * 16 + [SPIKE]
    flat = scores(feature_rows(spark, windows), StatisticalConfig(flat_std="saturate"))[-1].stat_score
    assert flat > 0.5


def test_bounds_and_isolation(spark):
    wild = [{"error_rate": 0.99 * (i % 2), "latency_p95": 99999.0 * (i % 3)} for i in range(40)]
    both = feature_rows(spark, wild, "a").unionByName(feature_rows(spark, [STEADY] * 40, "b"))
    rows = scores(both)
    assert all(0 <= r.stat_score <= 1 for r in rows)
    assert max(r.stat_score for r in rows if r.service_name == "b") < 0.3


def test_reset_starts_a_new_history(spark):
    features = feature_rows(spark, [STEADY] * 40)
    resets = spark.createDataFrame([("payment-service", at(60 * 20))], "service_name STRING, reset_at TIMESTAMP")
    rows = scores(features, resets=resets)
    assert [r.rn for r in rows] == [*range(1, 21), *range(1, 21)]
    assert rows[20].stat_warming and not rows[36].stat_warming


def noisy(n, seed=5):
    rng = random.Random(seed)
    return [
        {"error_rate": 0.03 + rng.random() * 0.01, "latency_p50": 80 + rng.random(), "latency_p95": 200 + rng.random() * 10,
         "latency_p99": 300 + rng.random() * 10, "logs_per_second": 10 + rng.random(), "unique_traces": 50 + rng.randrange(5)}
        for _ in range(n)
    ]


def forest_rows(spark, windows):
    scheduled = forest.with_schedule(numbered(feature_rows(spark, windows)))
    return forest.forest_scores(scheduled).orderBy("rn").collect()


def test_forest_warms_up_scores_outliers_and_repeats(spark):
    windows = noisy(300) + [{"error_rate": 0.99, "latency_p95": 50000.0, "latency_p99": 60000.0, "critical_count": 40}]
    rows = forest_rows(spark, windows)
    assert all(r.forest_warming and r.forest_score == 0 for r in rows[:49]) and not rows[49].forest_warming
    assert rows[-1].forest_score == max(r.forest_score for r in rows) > 0
    assert all(0 <= r.forest_score <= 1 for r in rows)
    above = sum(r.forest_score > 0 for r in rows[49:250]) / 201
    assert above < 0.15
    assert [r.forest_score for r in rows] == [r.forest_score for r in forest_rows(spark, windows)]


def test_forest_training_share_above_zero(spark):
    scheduled = forest.with_schedule(numbered(feature_rows(spark, noisy(50))))
    model = forest.fit_forest(scheduled)
    quantile = forest.train_quantiles(scheduled, model).first().train_quantile
    pairs = scheduled.select("service_name", "segment", F.lit(0).cast("bigint").alias("epoch"), "rn", forest._vector())
    above = forest.isolation_scores(pairs, model).where(F.col("isolation") > quantile).count()
    assert above in (2, 3)  # 5 % of 50
    assert model.count() == 100


def test_growing_moments_match_numpy(spark):
    rng = random.Random(9)
    values = [1e6 + rng.random() for _ in range(470)]
    scheduled = forest.with_schedule(numbered(feature_rows(spark, [{"latency_p95": v} for v in values])))
    rows = forest.growing_moments(scheduled, ["latency_p95"]).orderBy("rn").collect()
    for i in (0, 1, 49, 50, 51, 249, 250, 251, 469):
        assert rows[i]["latency_p95__mean"] == pytest.approx(np.mean(values[: i + 1]), rel=1e-12)
        assert rows[i]["latency_p95__std"] == pytest.approx(np.std(values[: i + 1]), rel=1e-6, abs=1e-8)


def test_ensemble(spark):
    spike = {"error_rate": 0.90, "latency_p95": 5000.0, "latency_p99": 8000.0}
    found = detect_anomalies(feature_rows(spark, noisy(60) + [spike]))
    rows = found.orderBy("detected_at").collect()
    last = rows[-1]
    assert last.anomaly_score > 0.3 and last.severity != "normal"
    assert rows[0].anomaly_score == 0 and rows[0].severity == "normal" and not rows[0].is_anomaly
    assert [d.detector_name for d in last.detector_results] == ["statistical", "isolation_forest"]
    assert rows[0].detector_results[0].details == {"status": "warming_up"}
    assert last.features.error_rate == 0.90 and last.recommended_action
    stats = detector_stats(found).first()
    assert stats.total_windows_analyzed == 61 and stats.tracked_services == 1
    flagged = [r.id for r in rows if r.is_anomaly]
    assert [r.id for r in recent_anomalies(found, 2).collect()] == flagged[-2:]
