import json
from datetime import datetime

from pyspark.sql import functions as F

from conftest import START, at
from lumenwatch.functions.columns import parse_timestamp
from lumenwatch.operators.normalise import normalise_logs, rejected_records
from lumenwatch.sources.records import as_messages, decode_counts, decode_records, split_decoded

NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def normalise(spark, *records, **options):
    raws = [r if isinstance(r, str) else json.dumps(r) for r in records]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "n INT, raw STRING")
    options.setdefault("ingested_at", F.expr(NOW))
    return normalise_logs(df, position=("n",), **options).orderBy("message").collect()


FULL = {
    "timestamp": "2024-01-15T12:34:56.789Z", "service_name": "payment-service", "level": "ERROR",
    "message": "Connection to DB timed out after 5000ms", "trace_id": "abc123", "span_id": "def456", "host": "pod-42",
    "environment": "production", "attributes": {"db_host": "postgres-primary", "timeout_ms": 5000},
}


def test_full_record(spark):
    with_session = normalise(spark, FULL)[0]
    assert with_session.timestamp == datetime(2024, 1, 15, 12, 34, 56, 789000)
    assert (with_session.trace_id, with_session.span_id, with_session.host) == ("abc123", "def456", "pod-42")
    assert with_session.attributes == {"db_host": "postgres-primary", "timeout_ms": "5000"}


def test_minimal_record_gets_defaults(spark):
    row = normalise(spark, {"service_name": "  PAYMENT-Service  ", "message": " hello\n"})[0]
    assert (row.service_name, row.level, row.message, row.environment) == ("payment-service", "INFO", "hello", "production")
    assert row.timestamp == datetime(2024, 6, 1) and not row.ts_parsed
    assert row.id and row.trace_id and len(row.span_id) == 16


def test_resource_names_the_service(spark):
    row = normalise(spark, {"resource": {"service.name": "auth-service"}, "severity": "WARN", "body": "slow", "attributes": {"a": 1}})[0]
    assert (row.service_name, row.level, row.message) == ("auth-service", "WARNING", "slow")
    assert row.attributes == {"a": "1", "body": "slow"}


def test_attributes_win_over_extra_fields(spark):
    row = normalise(spark, {"service": "s", "msg": "m", "region": "eu", "zone": "z", "attributes": {"region": "us"}})[0]
    assert row.attributes == {"region": "us", "zone": "z"}


def test_text_lines(spark):
    rows = normalise(spark, "2024-01-15T12:00:00Z ERROR my-service Database connection refused", "something odd", default_service="gw")
    assert (rows[0].service_name, rows[0].level, rows[0].message) == ("my-service", "ERROR", "Database connection refused")
    assert rows[0].timestamp == datetime(2024, 1, 15, 12)
    assert (rows[1].service_name, rows[1].level, rows[1].message) == ("gw", "INFO", "something odd")


def test_levels(spark):
    records = [{"service": "s", "message": f"{i}", "level": level} for i, level in enumerate(["WARN", "fatal", "debug", "weird", ""])]
    assert [r.level for r in normalise(spark, *records)] == ["WARNING", "CRITICAL", "DEBUG", "INFO", "INFO"]


def test_long_text_is_kept_whole(spark):
    text = "x" * 200_000
    assert normalise(spark, {"service": "s", "message": text})[0].message == text


def test_rejects_have_reasons(spark):
    raws = ['{"service_name":" ","message":"x"}', '{"service_name":"s","message":"  "}', '{"broken', '{"service":"s","message":"m","resource":"text"}', None, "fine"]
    df = spark.createDataFrame([(r,) for r in raws], "raw STRING")
    reasons = sorted(r.reject_reason for r in rejected_records(df).collect())
    assert reasons == ["bad_resource", "empty_message", "empty_service", "malformed_json", "missing"]


def test_replayed_positions_keep_their_ids(spark):
    first, second = normalise(spark, "a", "a"), normalise(spark, "a", "a")
    assert [r.id for r in first] == [r.id for r in second]
    assert len({r.id for r in first}) == 2


def test_timestamp_forms(spark):
    cases = {
        "1705316096": datetime(2024, 1, 15, 10, 54, 56), "1705316096789": datetime(2024, 1, 15, 10, 54, 56, 789000),
        "2024-01-15T12:00:00Z": datetime(2024, 1, 15, 12), "2024-01-15 12:00:00.5": datetime(2024, 1, 15, 12, 0, 0, 500000),
        "2024-01-15T12:00:00+02:00": datetime(2024, 1, 15, 10), "2024-01-15T12:00:00-0130": datetime(2024, 1, 15, 13, 30),
        "2024-01-15": None, "soon": None, "2024-13-45T99:00:00Z": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "raw STRING")
    got = {r.raw: r.ts for r in df.select("raw", parse_timestamp(F.col("raw")).alias("ts")).collect()}
    assert got == cases


def test_decoding_splits_and_counts(spark):
    good = dict(FULL, id="1")
    bad = [dict(good, level="LOUD"), dict(good, service_name=" "), dict(good, timestamp="soon"), {"message": "m"}]
    values = [json.dumps(v) for v in [good, *bad]] + ["\x00\x01", "[1]"]
    decoded = decode_records(spark.createDataFrame([(v,) for v in values], "value STRING"))
    rows, quarantine = split_decoded(decoded)
    assert [r.id for r in rows.collect()] == ["1"]
    assert quarantine.count() == 6
    assert decode_counts(decoded).first().asDict() == {"processed": 1, "errors": 6}


def test_published_records_decode_to_the_same_logs(spark):
    logs = spark.createDataFrame(
        [("1", START, "s", "INFO", 'quote " and → arrow', "t", "p", "h", "production", {"k": "v"}), ("2", at(1.5), "s", "ERROR", "m", "", "", "", "dev", {})],
        "id STRING, timestamp TIMESTAMP, service_name STRING, level STRING, message STRING, trace_id STRING, span_id STRING, host STRING, environment STRING, attributes MAP<STRING,STRING>",
    )
    messages = as_messages(logs)
    assert {r.key for r in messages.collect()} == {"s"}
    back, quarantine = split_decoded(decode_records(messages))
    assert sorted(map(str, back.collect())) == sorted(map(str, logs.collect()))
    assert quarantine.isEmpty()
