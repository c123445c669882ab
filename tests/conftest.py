import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import check_oracles  # noqa: E402

START = datetime(2024, 1, 15)


@pytest.fixture(scope="session")
def spark():
    return check_oracles.session()


def at(seconds):
    return START + timedelta(seconds=seconds)


FEATURE_DEFAULTS = dict(
    total_logs=600, logs_per_second=10.0, error_count=30, critical_count=0, error_rate=0.05, latency_p50=80.0,
    latency_p95=200.0, latency_p99=300.0, latency_mean=90.0, unique_traces=50,
)


def feature_rows(spark, windows, service="payment-service"):
    """Feature windows of one service, a minute apart; each entry overrides defaults."""
    from lumenwatch.streaming.jobs import FEATURE_TABLE

    names = [f.split()[0] for f in FEATURE_TABLE.split(", ")]
    rows = []
    for i, changes in enumerate(windows):
        values = {**FEATURE_DEFAULTS, **changes}
        values.update(
            window_id=f"{service}@{i}", service_name=service, window_start=at(60 * i), window_end=at(60 * i + 60),
            window_seconds=60, first_log=at(60 * i), last_log=at(60 * i + 59),
        )
        rows.append(tuple(values[n] for n in names))
    return spark.createDataFrame(rows, FEATURE_TABLE)
