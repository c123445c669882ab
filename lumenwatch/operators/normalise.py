"""Raw records (JSON objects and plain-text lines) to log rows (P1-P9), and their rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenwatch.functions.columns import canonical_level, once, parse_timestamp, present, strip

# Top-level names that do not become attributes, and the plain-text line format.
RESERVED = (
    "timestamp", "time", "ts", "service_name", "service", "level", "severity", "message", "msg",
    "trace_id", "span_id", "host", "environment", "env", "resource",
)
LINE = (
    r"(?is)^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)"
    r"\s+(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL)\s+(\S+)\s+(.+)$"
)
_LINE_PARTS = ("ts", "level", "service", "message")
_TEXT_MAP = "map<string,string>"
_NO_ATTRIBUTES = "CAST(map() AS MAP<STRING,STRING>)"


def normalise_logs(
    raw: DataFrame,
    default_service: str = "unknown",
    default_environment: str = "production",
    ingested_at: Column | None = None,
    position: tuple[str, ...] = (),
    column: str = "raw",
) -> DataFrame:
    """Valid log rows of a frame with one text column of records, in one pass.

    ``ingested_at`` stands in for missing times (default: now). ``position`` names columns that identify a
    record in its source, such as partition and offset; missing ids are then hashes of them, so that a
    replayed record gets the same id. Without it missing ids are random.
    """
    parsed = parse_records(raw, default_service, default_environment, ingested_at, position, column)
    return parsed.where("reject_reason IS NULL").select(*_log_columns(), "ts_parsed")


def rejected_records(
    raw: DataFrame, default_service: str = "unknown", default_environment: str = "production", column: str = "raw"
) -> DataFrame:
    """The records ``normalise_logs`` drops, with the reason."""
    parsed = parse_records(raw, default_service, default_environment, None, (), column)
    return parsed.where("reject_reason IS NOT NULL").select(F.col("raw_text").alias("raw"), "reject_reason")


def parse_records(
    raw: DataFrame,
    default_service: str = "unknown",
    default_environment: str = "production",
    ingested_at: Column | None = None,
    position: tuple[str, ...] = (),
    column: str = "raw",
) -> DataFrame:
    """Every record with its log columns, ``ts_parsed`` and ``reject_reason`` (null when valid)."""
    ingested_at = F.current_timestamp() if ingested_at is None else ingested_at
    text = strip(F.col(column))
    framed = raw.select(
        F.col(column).alias("raw_text"),
        *[F.col(p).alias(f"pos_{p}") for p in position],
        ingested_at.alias("ingested_at"),
        text.alias("text"),
    )
    framed = once(framed, "m", F.when(F.col("text").startswith("{"), F.from_json("text", _TEXT_MAP)))
    line = F.when(F.col("m").isNull(), F.col("text"))
    framed = once(
        framed,
        "p",
        F.struct(
            F.from_json(F.col("m")["attributes"], _TEXT_MAP).alias("nested"),
            F.from_json(F.col("m")["resource"], _TEXT_MAP).alias("resource"),
            *[present(F.regexp_extract(line, LINE, g)).alias(n) for g, n in enumerate(_LINE_PARTS, 1)],
        ),
    )
    is_object = F.col("text").startswith("{")
    fields = {
        "ts_raw": F.when(is_object, first_field("timestamp", "time", "ts")).otherwise(F.col("p.ts")),
        "service": F.when(is_object, service_field(F.col("p.resource"), default_service)).otherwise(
            F.coalesce("p.service", F.lit(default_service))
        ),
        "level": canonical_level(F.when(is_object, first_field("level", "severity")).otherwise(F.col("p.level"))),
        "message": F.when(is_object, first_field("message", "msg", "body")).otherwise(F.coalesce("p.message", "text")),
        "environment": F.when(is_object, F.coalesce(first_field("environment", "env"), F.lit(default_environment)))
        .otherwise(default_environment),
        "attributes": F.when(is_object, merged_attributes(F.coalesce("p.nested", F.expr(_NO_ATTRIBUTES)))),
        "given_id": F.when(is_object, first_field("id")),
        "given_trace": F.when(is_object, first_field("trace_id")),
        "given_span": F.when(is_object, first_field("span_id")),
        "host": F.when(is_object, F.coalesce(F.col("m")["host"], F.lit(""))).otherwise(""),
    }
    named = framed.select("*", *[v.alias(k) for k, v in fields.items()])
    named = named.select("*", parse_timestamp(F.col("ts_raw")).alias("event_time"))
    seed = F.concat_ws("|", *[F.col(f"pos_{p}").cast("string") for p in position]) if position else None
    return named.select(
        "raw_text",
        default_id(F.col("given_id"), seed, "log", 36).alias("id"),
        F.coalesce("event_time", "ingested_at").alias("timestamp"),
        F.lower(strip(F.col("service"))).alias("service_name"),
        F.col("level"),
        strip(F.col("message")).alias("message"),
        default_id(F.col("given_trace"), seed, "trace", 36).alias("trace_id"),
        default_id(F.col("given_span"), seed, "span", 16).alias("span_id"),
        "host",
        "environment",
        F.coalesce("attributes", F.expr(_NO_ATTRIBUTES)).alias("attributes"),
        F.col("event_time").isNotNull().alias("ts_parsed"),
        _reject_reason(is_object).alias("reject_reason"),
    )


def first_field(*names: str) -> Column:
    """First of the named top-level fields that is present and not empty."""
    return F.coalesce(*[present(F.col("m")[name]) for name in names])


def service_field(resource: Column, default_service: str) -> Column:
    """Service by its two names, then by the resource's ``service.name``."""
    return F.coalesce(
        first_field("service_name", "service"), present(resource["service.name"]), F.lit(default_service)
    )


def merged_attributes(nested: Column) -> Column:
    """Top-level fields without a meaning of their own, overlaid by the ``attributes`` object."""
    extra = F.map_filter(
        F.col("m"), lambda k, _: ~k.isin(*RESERVED, "attributes", "id") & ~F.map_contains_key(nested, k)
    )
    return F.map_concat(extra, nested)


def default_id(given: Column, seed: Column | None, kind: str, length: int) -> Column:
    """A given id, else a hash of the record's position, else a random one."""
    made = F.uuid() if seed is None else F.sha2(F.concat_ws("|", F.lit(kind), seed), 256)
    return F.coalesce(given, F.substring(made, 1, length))


def _reject_reason(is_object: Column) -> Column:
    def not_object(name: str) -> Column:
        value = F.col("m")[name]
        return is_object & value.isNotNull() & ~value.startswith("{")

    return (
        F.when(F.col("text").isNull(), "missing")
        .when(is_object & F.col("m").isNull(), "malformed_json")
        .when(not_object("resource"), "bad_resource")
        .when(not_object("attributes"), "bad_attributes")
        .when(F.length(strip(F.coalesce("service", F.lit("")))) == 0, "empty_service")
        .when(F.length(strip(F.coalesce("message", F.lit("")))) == 0, "empty_message")
    )


def _log_columns() -> list[str]:
    return [
        "id", "timestamp", "service_name", "level", "message", "trace_id", "span_id", "host", "environment",
        "attributes",
    ]
