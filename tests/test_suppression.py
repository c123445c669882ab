import random

import pytest
from pyspark.sql import functions as F

from conftest import at
from lumenwatch.operators import suppression
from lumenwatch.operators.suppression import active_locks, admit, eligible, mark_accepted, queue_counts

EVENT = "service_name STRING, severity STRING, detected_at TIMESTAMP, id STRING"


def brute(events, ttl):
    kept, last = set(), {}
    for svc, sev, ts, eid in sorted(events, key=lambda e: (e[2], e[3])):
        if (svc, sev) not in last or (ts - last[svc, sev]).total_seconds() >= ttl(sev):
            last[svc, sev] = ts
            kept.add(eid)
    return kept


def random_events(seed):
    rng = random.Random(seed)
    shapes = {"dense": (3000, 6000, None), "sparse": (80, 500_000, None), "grid": (400, 90_000, 60), "exact": (60, 20_000, 300), "one": (1, 10, None)}
    events = []
    for name, (n, span, grid) in shapes.items():
        for i in range(n):
            t = rng.random() * span
            t = round(t / grid) * grid if grid else round(t, 6)
            events.append((name, rng.choice(["high", "critical"]), at(t), f"{name}{i:05d}"))
    return events


@pytest.mark.parametrize("seed,cells", [(1, 256), (2, 4), (3, 1)])
def test_matches_the_recursion(spark, monkeypatch, seed, cells):
    monkeypatch.setattr(suppression, "CELLS_PER_SPAN", cells)
    events = random_events(seed)
    df = spark.createDataFrame(events, EVENT)
    marked = mark_accepted(df, ["service_name", "severity"], "detected_at", "id", 300)
    assert marked.count() == len(events)
    assert {r.id for r in marked.where("accepted").collect()} == brute(events, lambda s: 300)


def test_ttl_can_depend_on_the_key(spark):
    events = random_events(4)
    df = spark.createDataFrame(events, EVENT).withColumn("ttl", F.when(F.col("severity") == "high", 600).otherwise(90))
    kept = mark_accepted(df, ["service_name", "severity"], "detected_at", "id", F.col("ttl")).where("accepted")
    assert {r.id for r in kept.collect()} == brute(events, lambda s: 600 if s == "high" else 90)


def test_boundary_is_inclusive_and_counts(spark):
    df = spark.createDataFrame([("s", "high", at(t), str(t)) for t in (0, 299, 300, 301, 600)], EVENT)
    marked = mark_accepted(df, ["service_name", "severity"], "detected_at", "id", 300)
    assert sorted(r.id for r in marked.where("accepted").collect()) == ["0", "300", "600"]
    assert queue_counts(marked).first().asDict() == {"pushed": 3, "deduplicated": 2}
    as_of = F.lit(at(899.5)).cast("timestamp")
    assert active_locks(marked, as_of, 300).count() == 1
    assert active_locks(marked, F.lit(at(900)).cast("timestamp"), 300).count() == 0


def test_only_worthwhile_anomalies_are_queued(spark):
    rows = [(True, "high"), (True, "low"), (False, "critical"), (True, "normal"), (True, "medium")]
    assert eligible(spark.createDataFrame(rows, "is_anomaly BOOLEAN, severity STRING")).count() == 2


def test_admission_keeps_every_row(spark):
    df = spark.createDataFrame([("s", "high", at(i % 7), f"{i:03d}") for i in range(100)], EVENT)
    rows = admit(df, 30).collect()
    admitted = {r.id for r in rows if r.admitted}
    assert len(rows) == 100
    assert admitted == {r.id for r in sorted(rows, key=lambda r: (r.detected_at, r.id))[:30]}
    assert admit(df, 1000).where("admitted").count() == 100
