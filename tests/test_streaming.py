"""Streaming jobs against their batch operators, over several micro-batches and restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import at, feature_rows
from lumenwatch.operators import forest
from lumenwatch.operators.features import window_features
from lumenwatch.operators.statistical import numbered, statistical_scores
from lumenwatch.operators.suppression import mark_accepted
from lumenwatch.schemas import LOGS
from lumenwatch.sources import streams, tables
from lumenwatch.streaming import jobs


def log_frame(spark, rows):
    full = [(i, at(t), s, level, "m", trace, "p", "h", "production", {"latency_ms": str(latency)}) for i, t, s, level, trace, latency in rows]
    return spark.createDataFrame(full, LOGS)


def put(df, folder, name):
    """Add one file to a stream's folder."""
    df.coalesce(1).write.mode("append").parquet(str(folder / name))


def log_source(spark, folder):
    return streams.file_log_stream(spark, str(folder / "*"))


def random_logs(n, start, end, seed):
    rng = random.Random(seed)
    return [(f"{seed}-{i}", rng.uniform(start, end), rng.choice("ab"), rng.choice(["INFO", "ERROR", "CRITICAL"]), f"t{rng.randrange(40)}", rng.randrange(1, 500)) for i in range(n)]


def by_window(df):
    return {(r.service_name, r.window_start): (r.total_logs, r.error_count, r.latency_p50, r.latency_p95, r.latency_p99, r.unique_traces, r.logs_per_second) for r in df.collect()}


@pytest.mark.parametrize("files_per_trigger", [1, None])
def test_feature_stream_equals_batch_in_any_order(spark, tmp_path, files_per_trigger):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    parts = [random_logs(300, 300, 620, 2), random_logs(50, 900, 960, 3), random_logs(300, 0, 300, 1)]
    parts.append([("late", 10, "a", "ERROR", "t", 5), *parts[0][:20]])
    for i, part in enumerate(parts):
        put(log_frame(spark, part), source, f"b{i}")
        if i % 2:  # two files wait, so the source cuts them as it likes
            stream = streams.file_log_stream(spark, str(source / "*"), files_per_trigger=files_per_trigger)
            jobs.stream_features(stream, out, progress).awaitTermination()
    expected = by_window(window_features(log_frame(spark, sum(parts, [])).dropDuplicates(["id"])))
    assert expected and by_window(jobs.read_features(spark, f"{out}/windows")) == expected


def test_a_late_log_reads_only_its_own_day(spark, tmp_path):
    out, progress, day = str(tmp_path / "out"), str(tmp_path / "progress"), 86_400
    rows = sum((random_logs(60, d * day, d * day + 300, d + 20) for d in range(12)), [])
    late = [("late", 3 * day + 10.0, "a", "ERROR", "new trace", 7)]
    for i, part in enumerate((rows, late)):
        put(log_frame(spark, part), tmp_path / "in", f"b{i}")
        jobs.stream_features(log_source(spark, tmp_path / "in"), out, progress).awaitTermination()
    assert by_window(jobs.read_features(spark, f"{out}/windows")) == by_window(window_features(log_frame(spark, rows + late)))
    second = spark.read.parquet(f"{out}/windows/batch_id=1").collect()
    assert [(r.service_name, r.window_start) for r in second] == [("a", at(3 * day))]
    read = jobs.window_folds(spark, f"{out}/windows", "values", [f"{at(3 * day):%Y-%m-%d}"], 1)
    assert {f.split("slot_date=")[1][:10] for f in read.inputFiles()} == {"2024-01-18"} and read.count() < len(rows) / 6


def test_folds_of_a_batch_are_one_small_file_a_day(spark, tmp_path):
    out, day = tmp_path / "out", 86_400
    rows = sum((random_logs(200, d * day, d * day + day, d + 40) for d in range(5)), [])
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1")  # as many tasks as there are cores
        jobs.refresh_features(log_frame(spark, rows), str(out), 0, 3600)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", was)
    for kind in ("values", "traces"):
        folders = list((tmp_path / "out-folds" / kind).glob("slot_date=*/batch_id=0"))
        assert len(folders) == 5 and all(len(list(p.glob("*.parquet"))) == 1 for p in folders)
    assert by_window(jobs.read_features(spark, str(out))) == by_window(window_features(log_frame(spark, rows), 3600))


def test_triggers_of_the_event_stream_do_not_grow_with_its_files(spark, tmp_path):
    from lumenwatch.plans.bindings import Tables
    from lumenwatch.plans.catalog import event_stream

    events = spark.range(4000).selectExpr(
        "id AS event_id", "TIMESTAMP '2024-01-15' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "id % 9 AS user_id", "'view' AS event_type", "1D AS value", "'{\"k\": 1}' AS props"
    )
    events.repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    seen, was = {}, spark.conf.get("spark.sql.files.openCostInBytes")

    def keep(batch, batch_id):
        seen[batch_id] = sorted(int(r.id) for r in batch.select("id").collect())

    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # each file is read by a task of its own
        stream = event_stream(Tables(spark, str(tmp_path)))
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)
    assert len(seen) == 5 and seen[4] == [i for i in range(4000) if i % 10 == 3]
    assert sorted(sum((seen[k] for k in range(4)), [])) == list(range(4000))


def test_closed_windows_land_once_and_in_order(spark, tmp_path):
    out, closed = str(tmp_path / "out"), str(tmp_path / "closed")
    put(log_frame(spark, random_logs(200, 0, 600, 6)), tmp_path / "in", "a")
    jobs.stream_features(log_source(spark, tmp_path / "in"), out, str(tmp_path / "progress")).awaitTermination()
    jobs.close_windows(spark, f"{out}/windows", closed, 0, F.lit(at(300)))
    jobs.close_windows(spark, f"{out}/windows", closed, 1)
    rows = spark.read.parquet(closed).collect()
    assert len(rows) == len({r.window_id for r in rows}) == jobs.read_features(spark, f"{out}/windows").count()
    assert max(r.window_end for r in rows if r.batch_id == 0) <= min(r.window_start for r in rows if r.batch_id == 1)


def feature_batches(spark, windows, sizes, folder):
    """Landed feature tables of one service in time order, one folder per batch."""
    everything = feature_rows(spark, windows)
    start = 0
    for i, size in enumerate(sizes):
        part = everything.where((F.col("window_start") >= F.lit(at(60 * start))) & (F.col("window_start") < F.lit(at(60 * (start + size)))))
        part.coalesce(1).write.parquet(str(folder / f"batch_id={i}"))
        start += size
        yield everything


def noisy_windows(n):
    rng = random.Random(11)
    return [{"error_rate": round(rng.random() * 0.1, 4), "latency_p95": rng.lognormvariate(5, 0.5), "latency_p99": rng.lognormvariate(6, 0.5), "logs_per_second": 10 + rng.random(), "unique_traces": rng.randrange(40, 60)} for _ in range(n)]


def test_score_stream_equals_batch_across_restarts(spark, tmp_path):
    windows, out = noisy_windows(250), str(tmp_path / "scores")
    for everything in feature_batches(spark, windows, [10, 30, 210], tmp_path / "features"):
        source = jobs.feature_stream(spark, str(tmp_path / "features"))
        jobs.stream_scores(source, out, str(tmp_path / "progress")).awaitTermination()
    got = {r.window_id: (r.stat_warming, pytest.approx(r.stat_score, abs=1.01e-4), r.stat_triggered) for r in spark.read.parquet(out).collect()}
    batch = {r.window_id: (r.stat_warming, r.stat_score, ",".join(r.stat_triggered)) for r in statistical_scores(everything).collect()}
    assert len(batch) == 250 and got == batch


def test_forest_stream_equals_batch(spark, tmp_path):
    out = str(tmp_path / "forest")
    for everything in feature_batches(spark, noisy_windows(280), [40, 100, 140], tmp_path / "features"):
        source = jobs.feature_stream(spark, str(tmp_path / "features"))
        jobs.stream_forest_scores(source, out, str(tmp_path / "progress")).awaitTermination()
    got = {r.window_id: (r.forest_warming, r.forest_score) for r in spark.read.parquet(f"{out}/scores").collect()}
    batch = forest.forest_scores(forest.with_schedule(numbered(everything)))
    assert got == {r.window_id: (r.forest_warming, r.forest_score) for r in batch.collect()}
    assert spark.read.parquet(f"{out}/model").select("epoch").distinct().count() == 2


def test_suppression_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    events = sorted((rng.uniform(0, 20_000), f"{i:04d}", rng.choice("ab"), rng.choice(["high", "critical"])) for i in range(600))
    schema = "id STRING, service_name STRING, severity STRING, detected_at TIMESTAMP, cooldown INT"
    frame = spark.createDataFrame([(i, s, sev, at(t), 300 if sev == "high" else 900) for t, i, s, sev in events], schema)
    out = str(tmp_path / "out")
    for n in range(4):  # unordered files, and one that comes again
        put(frame.where((F.pmod(F.xxhash64("id"), F.lit(4)) == n) | (F.lit(n == 3) & F.col("id").endswith("7"))), tmp_path / "in", f"b{n}")
        if n != 1:
            source = streams.file_log_stream(spark, str(tmp_path / "in" / "*"), schema, files_per_trigger=1)
            jobs.stream_suppression(source, out, str(tmp_path / "progress"), ttl_seconds="cooldown").awaitTermination()
    batch = mark_accepted(frame, ["service_name", "severity"], "detected_at", "id", F.col("cooldown"))
    assert {r.id: r.accepted for r in jobs.read_decisions(spark, out).collect()} == {r.id: r.accepted for r in batch.collect()}


def record(i, **changes):
    base = {"id": str(i), "timestamp": "2024-01-15T00:00:00Z", "service_name": "s", "level": "INFO", "message": f"m{i}"}
    return json.dumps({**base, **changes})


def write_lines(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_landing_restarts_without_loss_or_repeats(spark, tmp_path):
    source, out, quarantine, progress = tmp_path / "in", str(tmp_path / "logs"), str(tmp_path / "bad"), str(tmp_path / "progress")
    seen, failing = [], [True]

    def on_batch(logs, batch_id):
        if failing[0]:
            raise RuntimeError("detector down")
        seen.append((batch_id, logs.count()))

    def run():
        jobs.land_logs(streams.text_record_stream(spark, str(source)), out, progress, quarantine, on_batch).awaitTermination()

    write_lines(source, "1.txt", [record(1), record(2), record(1, message="repeat"), "garbage"])
    with pytest.raises(Exception, match="detector down"):
        run()
    failing[0] = False
    run()
    write_lines(source, "2.txt", [record(2, message="again"), record(3)])
    run()
    rows = tables.read_batches(spark, out, LOGS).collect()
    assert sorted((r.id, r.message) for r in rows) == [("1", "m1"), ("2", "m2"), ("3", "m3")]
    assert [n for _, n in seen] == [2, 1]
    assert spark.read.json(f"{quarantine}/rows/*").count() == 1
    assert spark.read.json(f"{quarantine}/counts/*").agg(F.sum("processed"), F.sum("errors")).first()[:] == (5, 1)


def test_equal_records_without_ids_stay_apart(spark, tmp_path):
    line = json.dumps({"timestamp": "2024-01-15T00:00:00Z", "service_name": "s", "level": "INFO", "message": "m"})
    write_lines(tmp_path / "in", "1.txt", [line, line, line])
    source, out = streams.text_record_stream(spark, str(tmp_path / "in")), str(tmp_path / "logs")
    jobs.land_logs(source, out, str(tmp_path / "progress")).awaitTermination()
    rows = tables.read_batches(spark, out, LOGS).collect()
    assert len({r.id for r in rows}) == len({r.trace_id for r in rows}) == 3


def test_late_logs_pass_and_repeats_do_not(spark, tmp_path):
    rows, late = random_logs(30, 5000, 5060, 8), random_logs(10, 0, 60, 9)
    put(log_frame(spark, rows + rows[:10]), tmp_path / "in", "a")
    put(log_frame(spark, late + rows[:5]), tmp_path / "in", "b")
    source = streams.file_log_stream(spark, str(tmp_path / "in" / "*"), files_per_trigger=1)
    query = jobs.without_repeats(source).writeStream.format("parquet")
    query.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_admission_counts_what_is_pending(spark, tmp_path):
    for n in range(2):
        put(spark.range(n * 10, n * 10 + 10).selectExpr("CAST(id AS STRING) AS id", "timestamp_seconds(id) AS detected_at"), tmp_path / "in", f"b{n}")
    source = streams.file_log_stream(spark, str(tmp_path / "in" / "*"), "id STRING, detected_at TIMESTAMP", files_per_trigger=1)
    jobs.stream_admission(source, str(tmp_path / "out"), str(tmp_path / "progress"), pending=lambda batch: 5 * batch, capacity=5).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert (rows.count(), rows.where("admitted").count(), rows.where("admitted AND id < 10").count()) == (20, 5, 5)


def test_admission_knows_what_is_pending(spark, tmp_path):
    for n in range(3):
        put(spark.range(n * 10, n * 10 + 10).selectExpr("CAST(id AS STRING) AS id", "timestamp_seconds(id) AS detected_at"), tmp_path / "in", f"b{n}")
    done = lambda: spark.createDataFrame([("0",), ("1",), ("2",)], "id STRING")
    source = streams.file_log_stream(spark, str(tmp_path / "in" / "*"), "id STRING, detected_at TIMESTAMP", files_per_trigger=1)
    jobs.stream_admission(source, str(tmp_path / "out"), str(tmp_path / "progress"), capacity=5, finished=done).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).where("admitted").groupBy("batch_id").count().collect()
    assert sorted((r.batch_id, r["count"]) for r in rows) == [(0, 5), (1, 3)]
