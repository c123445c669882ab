"""Encoded log records: decode, publish, dead letters."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenwatch.functions.columns import once, parse_timestamp, present, strip
from lumenwatch.operators.normalise import default_id
from lumenwatch.schemas import LEVELS, LOG_WIRE, LOGS
from lumenwatch.session import settle

# Tries for a batch, the pause after each (times its number), the largest message of a broker.
PUBLISH_ATTEMPTS = 3
BACK_OFF_SECONDS = 0.3
MESSAGE_BYTES = 1_048_576

_COLUMNS = [field.split()[0] for field in LOGS.split(", ")]


def decode_records(messages: DataFrame, value: str = "value", position: Column | None = None) -> DataFrame:
    """Decode JSON log records; adds ``raw`` and ``decode_error`` (null for good records).

    Missing log and trace ids follow from the record's position: ``position``, or topic, partition and offset where the messages have
    them. Without a position they are random, so equal records without ids stay apart.
    """
    if position is None and {"topic", "partition", "offset"} <= set(messages.columns):
        position = F.concat_ws(":", "topic", "partition", "offset")
    seed = F.lit(None).cast("string") if position is None else position.cast("string")
    rows = once(messages.select(F.col(value).cast("string").alias("raw"), seed.alias("seed")), "r", F.from_json("raw", LOG_WIRE))

    def own(given: Column, kind: str) -> Column:
        return default_id(given, None if position is None else F.col("seed"), kind, 36)

    service, message = strip(F.col("r.service_name")), strip(F.col("r.message"))
    at = parse_timestamp(F.col("r.timestamp"))
    error = (
        F.when(F.get_json_object("raw", "$").isNull(), "malformed_json")
        .when(F.coalesce(F.length(service), F.lit(0)) == 0, "empty_service")
        .when(F.coalesce(F.length(message), F.lit(0)) == 0, "empty_message")
        .when(~F.coalesce(F.col("r.level").isin(*LEVELS), F.lit(False)), "bad_level")
        .when(at.isNull(), "bad_timestamp")
    )
    return rows.select(
        own(present(F.col("r.id")), "log").alias("id"),
        at.alias("timestamp"),
        F.lower(service).alias("service_name"),
        F.col("r.level").alias("level"),
        message.alias("message"),
        own(F.col("r.trace_id"), "trace").alias("trace_id"),
        F.coalesce("r.span_id", F.lit("")).alias("span_id"),
        F.coalesce("r.host", F.lit("")).alias("host"),
        F.coalesce("r.environment", F.lit("production")).alias("environment"),
        F.coalesce(F.col("r.attributes"), F.expr("CAST(map() AS MAP<STRING,STRING>)")).alias("attributes"),
        "raw",
        error.alias("decode_error"),
    )


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good log rows, and the quarantine with its reason."""
    good = decoded.where("decode_error IS NULL").select(*_COLUMNS)
    bad = decoded.where("decode_error IS NOT NULL").select("raw", F.col("decode_error").alias("reason"))
    return good, bad


def _decode_totals() -> list[Column]:
    return [F.count_if(F.col("decode_error").isNull()).alias("processed"), F.count_if(F.col("decode_error").isNotNull()).alias("errors")]


def decode_counts(decoded: DataFrame) -> DataFrame:
    """Processed and error totals of a batch."""
    return decoded.agg(*_decode_totals())


def observed_counts(decoded: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and their totals of ``decode_counts`` once an action has read them: no pass of their own."""
    totals = Observation()
    return decoded.observe(totals, *_decode_totals()), totals


def record_json(logs: DataFrame) -> Column:
    """One log row as JSON, every field present and the time in ISO form."""
    fields = [
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c) if c == "timestamp" else F.col(c)
        for c in _COLUMNS
        if c in logs.columns
    ]
    return F.to_json(F.struct(*fields))


def as_messages(logs: DataFrame) -> DataFrame:
    """Key, value and headers as a message broker takes them."""

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), F.encode(value, "UTF-8").alias("value"))

    return logs.select(
        F.col("service_name").alias("key"),
        record_json(logs).alias("value"),
        F.array(
            header("content-type", F.lit("application/json")),
            header("log-level", F.col("level")),
            header("environment", F.col("environment")),
        ).alias("headers"),
    )


def _shown(header: Column) -> Column:
    return F.struct(header["key"].alias("key"), F.decode(header["value"], "UTF-8").alias("value"))


def publish(
    logs: DataFrame, target: str, kafka_servers: str | None = None, dead_letters: str | None = None,
    attempts: int = PUBLISH_ATTEMPTS, most_bytes: int = MESSAGE_BYTES,
) -> DataFrame:
    """Write messages to a topic when broker addresses are given, else as JSON files below ``target``; one row: sent, failed.

    A message without a key or larger than a broker takes goes to ``dead_letters`` (beside ``target`` by default) with its reason; so
    do all messages of a batch that fails ``attempts`` times. The totals are observed while the messages are written.
    """
    spark, letters = logs.sparkSession, dead_letters or f"{target.rstrip('/')}-failed"
    reason = F.when(F.coalesce(F.length("key"), F.lit(0)) == 0, "no key").when(F.octet_length("value") > most_bytes, "too large")
    messages = settle(as_messages(logs).withColumn("reason", reason), "messages")
    good, bad = messages.where("reason IS NULL").drop("reason"), messages.where("reason IS NOT NULL")
    sent, failed = Observation(), Observation()
    write_dead_letters(bad.select(F.col("value").alias("raw"), "reason").observe(failed, F.count("*").alias("n")), letters)
    n_failed, n_sent = failed.get["n"], 0
    for attempt in range(1, attempts + 1):
        try:
            _send(good.observe(sent, F.count("*").alias("n")), target, kafka_servers)
            n_sent = sent.get["n"]
            break
        except Exception as error:
            if attempt == attempts:
                rest = Observation()
                lost = good.select(F.col("value").alias("raw"), F.lit(f"{type(error).__name__} at attempt {attempt}").alias("reason"))
                write_dead_letters(lost.observe(rest, F.count("*").alias("n")), letters)
                n_failed += rest.get["n"]
            else:
                sent = Observation()
                time.sleep(BACK_OFF_SECONDS * attempt)
    return spark.createDataFrame([(n_sent, n_failed)], "sent BIGINT, failed BIGINT")


def _send(messages: DataFrame, target: str, kafka_servers: str | None) -> None:
    if kafka_servers:
        writer = messages.write.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
        writer.option("topic", target).option("includeHeaders", "true").save()
    else:
        messages.select("key", "value", F.transform("headers", _shown).alias("headers")).write.mode("append").json(target)


def write_dead_letters(rejects: DataFrame, path: str) -> None:
    """Append rejected records as JSON lines."""
    rejects.write.mode("append").json(path)


def replay_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("raw STRING, reason STRING").json(path)
