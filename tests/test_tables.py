import pytest
from pyspark.sql import functions as F

from conftest import START, at
from lumenwatch.plans.dashboards import list_logs
from lumenwatch.schemas import ALERTS, LOGS
from lumenwatch.sources import records, tables
from lumenwatch.session import shared_dir


def log_rows(spark, *rows):
    full = [(i, at(t), "s", "INFO", m, "t", "p", "h", "production", {}) for i, t, m in rows]
    return spark.createDataFrame(full, LOGS)


def stored(spark, path):
    return {r.id: r.message for r in tables.read_batches(spark, path, LOGS).collect()}


def test_first_write_wins_and_replays_do_not_repeat(spark, tmp_path):
    path = str(tmp_path / "logs")
    order = ["timestamp", "message"]
    tables.append_new(log_rows(spark, ("1", 5, "later"), ("1", 1, "first"), ("2", 0, "x")), path, LOGS, order, "timestamp", 0)
    second = log_rows(spark, ("2", 0, "again"), ("3", 90_000, "new"))
    for _ in range(2):
        assert tables.append_new(second, path, LOGS, order, "timestamp", 1).count() == 1
    assert stored(spark, path) == {"1": "first", "2": "x", "3": "new"}
    days = tables.read_batches(spark, path, LOGS).where(F.col("event_date") == F.lit(START.date()))
    assert days.count() == 2
    assert "PartitionFilters: [isnotnull(event_date" in days._jdf.queryExecution().executedPlan().toString()


def test_a_repeat_days_later_is_left_out(spark, tmp_path):
    path, order = str(tmp_path / "logs"), ["timestamp", "message"]
    tables.append_new(log_rows(spark, ("1", 0, "a"), ("2", 900_000, "b")), path, LOGS, order, "timestamp", 0)
    batch = log_rows(spark, ("1", 10, "again"), ("3", 5, "new"))
    assert tables.append_new(batch, path, LOGS, order, "timestamp", 1).count() == 1
    assert stored(spark, path) == {"1": "a", "2": "b", "3": "new"}


def alert(i, status, day=0, title="old", channels=()):
    return (i, at(day * 86_400), at(9) if status == "sent" else None, "an", "a", "s", "high", status, title, "c", 0.5, "act", [], [], "", ["slack"], list(channels), [])


def test_a_batch_leaves_one_small_file_a_day(spark, tmp_path):
    path, order, days = str(tmp_path / "logs"), ["timestamp", "message"], 6
    rows = spark.range(1200).selectExpr("CAST(id AS STRING) AS id", f"TIMESTAMP '{START}' + make_interval(0, 0, 0, CAST(id % {days} AS INT), 0, 0, id) AS timestamp", "'s' AS service_name", "'INFO' AS level", "concat('m', id) AS message")
    full = rows.selectExpr("*", "'t' AS trace_id", "'p' AS span_id", "'h' AS host", "'production' AS environment", "map('k', 'v') AS attributes")
    twice = full.unionByName(full.withColumn("timestamp", F.expr("CASE WHEN id = '7' THEN NULL ELSE timestamp END")))
    twice = twice.unionByName(full.where("id = '9'").withColumn("id", F.lit("undated")).withColumn("timestamp", F.lit(None).cast("timestamp")))
    small = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "true", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    was = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)  # as many tasks as there are cores, as rows in plenty have
        tables.append_new(twice, path, LOGS, order, "timestamp", 0)
        tables.append_new(full.unionByName(full.withColumn("id", F.concat(F.lit("n"), "id"))), path, LOGS, order, "timestamp", 1)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    for batch in (0, 1):
        folders = [p for p in (tmp_path / "logs" / f"batch_id={batch}").iterdir() if p.is_dir()]
        assert len(folders) >= days and all(len(list(p.glob("*.parquet"))) == 1 for p in folders)
    ids = sorted(r.id for r in tables.read_batches(spark, path, LOGS).collect())
    assert ids == sorted([*map(str, range(1200)), *[f"n{i}" for i in range(1200)], "undated"])


def test_alert_upsert(spark, tmp_path):
    path = str(tmp_path / "alerts")
    tables.upsert_alerts(spark.createDataFrame([alert("1", "pending"), alert("2", "pending", 1)], ALERTS), path)
    tables.upsert_alerts(spark.createDataFrame([alert("1", "sent", 0, "new", ["slack"]), alert("3", "suppressed", 2)], ALERTS), path)
    rows = {r.id: r for r in tables.read_alerts(spark, path).collect()}
    assert {i: r.status for i, r in rows.items()} == {"1": "sent", "2": "pending", "3": "suppressed"}
    assert rows["1"].title == "old" and rows["1"].channels_succeeded == ["slack"] and rows["1"].sent_at == at(9)
    tables.upsert_alerts(spark.createDataFrame([alert("1", "failed")], ALERTS), path)
    again = tables.read_alerts(spark, path).where("id = '1'").first()
    assert (again.status, again.sent_at) == ("failed", None)


def test_last_state_of_an_alert_in_a_batch_and_its_day(spark, tmp_path):
    path = str(tmp_path / "alerts")
    tables.upsert_alerts(spark.createDataFrame([alert("1", "pending"), alert("1", "sent")], ALERTS), path)
    assert [(r.id, r.status) for r in tables.read_alerts(spark, path).collect()] == [("1", "sent")]
    tables.upsert_alerts(spark.createDataFrame([alert("1", "failed", 3), alert("2", "pending", 3)], ALERTS), path)
    rows = {r.id: r for r in tables.read_alerts(spark, path).collect()}
    assert tables.read_alerts(spark, path).count() == 2
    assert rows["1"].status == "failed" and rows["1"].created_at == at(0) and str(rows["1"].created_date) == str(START.date())


def test_lookups(spark):
    logs = log_rows(spark, ("1", 0, "a"), ("2", 1, "b"))
    assert tables.by_id(logs, "2").first().message == "b"
    assert tables.by_id(logs, "9").isEmpty()


def test_dead_letters_replay(spark, tmp_path):
    path = str(tmp_path / "dlq")
    rejects = spark.createDataFrame([("{bad", "malformed_json"), ("  ", "empty_message")], "raw STRING, reason STRING")
    records.write_dead_letters(rejects, path)
    records.write_dead_letters(rejects, path)
    assert records.replay_dead_letters(spark, path).count() == 4


def test_publish_to_files(spark, tmp_path):
    path = str(tmp_path / "topic")
    records.publish(log_rows(spark, ("1", 0, "a")), path)
    assert spark.read.json(path).first().key == "s"


def test_limits_are_checked(spark):
    logs = log_rows(spark, ("1", 0, "a"), ("2", 1, "b"))
    assert [r.id for r in list_logs(logs, limit=1).collect()] == ["2"]
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            list_logs(logs, limit=bad)


def test_shared_folder_is_the_sessions(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or shared_dir(spark) == configured


def test_publish_counts_and_dead_letters(spark, tmp_path, monkeypatch):
    from lumenwatch.sources import records

    rows = [(str(i), None, "" if i == 3 else "svc", "INFO", "x" * (5000 if i == 4 else 5), "t", "s", "h", "e", {}) for i in range(10)]
    from lumenwatch.schemas import LOGS

    logs = spark.createDataFrame(rows, LOGS)
    totals = records.publish(logs, str(tmp_path / "topic"), most_bytes=2000).first()
    assert (totals.sent, totals.failed) == (8, 2)
    letters = records.replay_dead_letters(spark, str(tmp_path / "topic-failed")).collect()
    assert sorted(r.reason for r in letters) == ["no key", "too large"] and spark.read.json(str(tmp_path / "topic")).count() == 8
    assert records.publish(logs.limit(0), str(tmp_path / "none")).first()[:] == (0, 0)

    tries = []

    def broken(messages, target, servers):
        tries.append(1)
        raise OSError("broker down")

    monkeypatch.setattr(records, "_send", broken)
    monkeypatch.setattr(records, "BACK_OFF_SECONDS", 0)
    totals = records.publish(logs, str(tmp_path / "down"), dead_letters=str(tmp_path / "letters")).first()
    assert (totals.sent, totals.failed, len(tries)) == (0, 10, 3)
    assert records.replay_dead_letters(spark, str(tmp_path / "letters")).where("reason LIKE 'OSError%'").count() == 9


def test_a_batch_meets_earlier_ids_without_another_shuffle_of_its_rows(spark):
    schema = "id string, timestamp timestamp, message string"
    stored = spark.createDataFrame([("a", at(0), "x"), (None, at(0), "n")], schema)
    batch = spark.createDataFrame([("b", at(2), "late"), ("b", at(1), "first"), ("a", at(3), "again"), (None, at(4), "none")], schema)
    found = tables.new_rows(batch, stored.hint("merge"), ["timestamp", "message"])
    assert found.columns == batch.columns and sorted(tuple(r)[::2] for r in found.collect() if r.id) == [("b", "first")]
    assert [r.message for r in found.collect() if r.id is None] == ["none"]
    found.collect()
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
