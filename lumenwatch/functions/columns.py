"""Column expressions: levels, timestamps, latency, rendering, lookups and bands. All stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenwatch.schemas import ALERT_SEVERITIES, ERROR_LEVELS, LEVELS

# ---- fixed values ---------------------------------------------------------------------------
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LATENCY_KEYS = ("latency_ms", "duration_ms", "response_time_ms", "elapsed_ms")
SEVERITY_ACTION = {
    "normal": "No action required.",
    "low": "Monitor closely over the next 5 minutes.",
    "medium": "Investigate logs; consider scaling or alerting on-call.",
    "high": "Immediate investigation required — check dependent services.",
    "critical": "Page on-call immediately — potential service outage.",
}
SEVERITY_PRIORITY = {"critical": 4, "high": 3, "medium": 2, "low": 1, "normal": 0}
SEVERITY_EMOJI = {
    "low": ":information_source:",
    "medium": ":warning:",
    "high": ":rotating_light:",
    "critical": ":fire:",
}
SEVERITY_COLOR = {"low": "#36a64f", "medium": "#f0a500", "high": "#e01e5a", "critical": "#800000"}
PAGER_SEVERITY = {"critical": "critical", "high": "error", "medium": "warning", "low": "info"}
# Bands: a value takes the name of the first bound it is below, or the last name.
ANOMALY_BANDS = ((0.30, "normal"), (0.50, "low"), (0.70, "medium"), (0.85, "high"), (None, "critical"))
CONFIDENCE_BUCKETS = ((0.3, "low (< 0.3)"), (0.6, "medium (0.3-0.6)"), (0.8, "high (0.6-0.8)"), (None, "very_high (>= 0.8)"))
# ---------------------------------------------------------------------------------------------

_TIME_TEXT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})?$"


def present(value: Column) -> Column:
    """Null for a missing or empty string."""
    return F.nullif(value, F.lit(""))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once per row however often it is used.

    Projections are merged and filters pushed below them, which repeats a parse for every field read from
    it. They do not pass the one-element explode.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def strip(value: Column) -> Column:
    """Trim every kind of white space, line ends included."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def is_error(level: Column) -> Column:
    return level.isin(*ERROR_LEVELS)


def canonical_level(raw: Column) -> Column:
    """Upper case, two aliases, INFO for anything unknown."""
    upper = F.upper(raw)
    return (
        F.when(upper == "WARN", "WARNING")
        .when(upper == "FATAL", "CRITICAL")
        .when(upper.isin(*LEVELS), upper)
        .otherwise("INFO")
    )


def parse_timestamp(raw: Column) -> Column:
    """Epoch seconds, epoch milliseconds (above 1e10) or ISO-like text; null when neither fits."""
    number = raw.try_cast("double")
    seconds = F.when(number > 1e10, number / 1000).otherwise(number)
    from_number = F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))
    with_colon = F.regexp_replace(raw, r"([+-]\d{2})(\d{2})$", "$1:$2")
    from_text = F.when(raw.rlike(_TIME_TEXT), with_colon.try_cast("timestamp"))
    return F.when(number.isNotNull(), from_number).otherwise(from_text)


def latency_ms(attributes: Column) -> Column:
    """First attribute of the four latency names that reads as a number."""
    return F.coalesce(*[attributes[key].try_cast("double") for key in LATENCY_KEYS])


def log_line(ts: Column, level: Column, message: Column) -> Column:
    return F.format_string("[%s] %s %s", F.date_format(ts, "HH:mm:ss"), level, message)


def iso8601(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch with micro precision."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def coerce_severity(raw: Column) -> Column:
    """One of the four alert severities; unknown text and null give medium."""
    return F.when(F.lower(raw).isin(*ALERT_SEVERITIES), F.lower(raw)).otherwise("medium")


def band(value: Column, bands: tuple) -> Column:
    """The name of the band that holds a value; null falls to the last name, as a comparison with null is not true."""
    (bound, name), *rest = bands
    return F.lit(name) if bound is None else F.when(value < bound, name).otherwise(band(value, rest))


def anomaly_severity(score: Column) -> Column:
    """Band of an unrounded ensemble score."""
    return band(score, ANOMALY_BANDS)


def lookup(key: Column, table: dict, default=None) -> Column:
    """A literal map lookup; no join, no shuffle."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 0.8, "red").when(score >= 0.6, "amber").when(score >= 0.4, "indigo").otherwise("green")
    )


def error_rate_band(percent: Column) -> Column:
    return F.when(percent > 10, "red").when(percent > 3, "amber").otherwise("green")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence > 0.7, "green").otherwise("amber")


def confidence_bucket(confidence: Column) -> Column:
    return band(confidence, CONFIDENCE_BUCKETS)


def since(ts: Column, as_of: Column, interval: str) -> Column:
    """Strictly newer than ``as_of - interval``; a pushable range predicate when ``as_of`` is a literal."""
    return ts > as_of - F.expr(f"INTERVAL {interval}")
