"""Suppression of repeats (ST4, ST5), admission cap (ST6) and active locks.

An event is kept if at least ``ttl`` seconds passed since the last *kept* event of its key. That is a
recursion over a key's timeline, yet it can run in parallel. Cut time into cells of one ttl: a cell keeps at
most one event, the first whose offset in the cell is not below the offset kept in the cell before (or any
offset if that cell kept none). So what a cell needs from the past is one number, its entry offset. A span
of cells is then a step function from entry offset to exit offset, found without knowing the entry. Pass one
finds these functions per (key, span) in parallel, a small fold per key over spans gives the true entry of
each, and pass two keeps events per (key, span) in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenwatch.functions.columns import SEVERITY_PRIORITY, lookup
from lumenwatch.session import settle

SUPPRESS_SECONDS = 300
MAX_PENDING = 1000
CELLS_PER_SPAN = 256
_NEVER = np.iinfo(np.int64).max


def eligible(anomalies: DataFrame) -> DataFrame:
    """Anomalies worth queueing: flagged and above low severity."""
    return anomalies.where(F.col("is_anomaly") & ~F.col("severity").isin("normal", "low"))


def mark_accepted(
    events: DataFrame, keys: list[str], ts: str, event_id: str, ttl_seconds: Column | int, out: str = "accepted"
) -> DataFrame:
    """Adds a boolean: kept or suppressed. Ties on time go to the smallest id. Lands the instants (one job).

    ``ttl_seconds`` may be a column but must be the same for all events of a key, whole and positive.
    """
    ttl = (F.lit(ttl_seconds) if isinstance(ttl_seconds, int) else ttl_seconds).cast("bigint") * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    # Only the first of the events at one instant can be kept.
    instants = settle(
        events.select(*keys, at.alias("at"), ttl.alias("ttl"), F.col(event_id).alias("eid"))
        .groupBy(*keys, "at")
        .agg(F.min("eid").alias("eid"), F.min("ttl").alias("ttl"))
        .withColumn("span", _whole(F.col("at"), F.col("ttl") * CELLS_PER_SPAN)),
        "suppression-instants",
    )
    key_fields = ", ".join(f"{instants.schema[k].name} {instants.schema[k].dataType.simpleString()}" for k in keys)
    timeline = instants.drop("eid")
    steps = timeline.groupBy(*keys, "span").applyInPandas(
        _span_steps(keys), f"{key_fields}, span BIGINT, upto BIGINT, exit BIGINT"
    )
    entries = steps.groupBy(*keys).applyInPandas(_fold_spans(keys), f"{key_fields}, span BIGINT, entry BIGINT")
    kept_times = (
        timeline.join(entries, [*keys, "span"])
        .groupBy(*keys, "span")
        .applyInPandas(_keep(keys), f"{key_fields}, at BIGINT")
    )
    kept = instants.join(kept_times, [*keys, "at"], "left_semi").select(*keys, F.col("eid").alias("__kept"))
    same = [events[k].eqNullSafe(kept[k]) for k in keys]
    matched = events.join(kept, [*same, events[event_id] == kept["__kept"]], "left")
    return matched.select(*[events[c] for c in events.columns], kept["__kept"].isNotNull().alias(out))


def _whole(number: Column, step: Column) -> Column:
    """Floor division on whole numbers."""
    return ((number - F.pmod(number, step)) / step).cast("bigint")


def _cells(span: pd.DataFrame):
    """Sorted offsets per cell, for the cells of one span."""
    if span["ttl"].nunique() > 1:
        raise ValueError("the events of a key must share one ttl")
    at, ttl = np.sort(span["at"].to_numpy()), int(span["ttl"].iloc[0])
    cell = at // ttl
    bounds = np.flatnonzero(np.diff(cell)) + 1
    return zip(cell[np.r_[0, bounds]], np.split(at % ttl, bounds)), ttl


def _next_offsets(entry: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Exit offset of a cell per entry offset; 0 where the cell keeps nothing."""
    place = np.searchsorted(offsets, entry)
    return np.where(place < len(offsets), offsets[np.minimum(place, len(offsets) - 1)], 0)


def _span_steps(keys: list[str]):
    def steps(span: pd.DataFrame) -> pd.DataFrame:
        number = int(span["span"].iloc[0])
        first_cell, last_cell = number * CELLS_PER_SPAN, (number + 1) * CELLS_PER_SPAN - 1
        cells, _ = _cells(span)
        upto = state = None
        previous = None
        for cell, offsets in cells:
            if upto is None:
                # Entries that matter: up to each event of the first cell, and beyond its last one.
                upto = np.r_[offsets, _NEVER] if cell == first_cell else np.array([_NEVER])
                state = _next_offsets(upto, offsets) if cell == first_cell else _next_offsets(np.zeros(1, int), offsets)
            else:
                entry = state if cell == previous + 1 else np.zeros_like(state)
                state = _next_offsets(entry, offsets)
            previous = cell
        if previous < last_cell:
            state = np.zeros_like(state)
        last_of_run = np.r_[np.flatnonzero(np.diff(state)), len(state) - 1]
        return _with_keys(span, keys, {"span": number, "upto": upto[last_of_run], "exit": state[last_of_run]})

    return steps


def _fold_spans(keys: list[str]):
    def fold(steps: pd.DataFrame) -> pd.DataFrame:
        spans, entries, carried, previous = [], [], 0, None
        for number, table in steps.sort_values(["span", "upto"]).groupby("span", sort=True):
            entry = carried if previous is not None and number == previous + 1 else 0
            spans.append(number)
            entries.append(entry)
            carried = int(table["exit"].to_numpy()[np.searchsorted(table["upto"].to_numpy(), entry)])
            previous = number
        return _with_keys(steps, keys, {"span": spans, "entry": entries})

    return fold


def _keep(keys: list[str]):
    def keep(span: pd.DataFrame) -> pd.DataFrame:
        first_cell = int(span["span"].iloc[0]) * CELLS_PER_SPAN
        cells, ttl = _cells(span)
        kept, previous, state = [], first_cell - 1, int(span["entry"].iloc[0])
        for cell, offsets in cells:
            entry = state if cell == previous + 1 else 0
            place = np.searchsorted(offsets, entry)
            if place < len(offsets):
                state = int(offsets[place])
                kept.append(cell * ttl + state)
            else:
                state = 0
            previous = cell
        return _with_keys(span, keys, {"at": np.array(kept, dtype=np.int64)})

    return keep


def _with_keys(group: pd.DataFrame, keys: list[str], columns: dict) -> pd.DataFrame:
    """Result rows of one group with its key. Plain objects, because an empty Arrow-backed string column
    cannot be sent back."""
    n = max(len(v) for v in columns.values() if not np.isscalar(v))
    out = {k: pd.Series([group[k].iloc[0]] * n, dtype=object) for k in keys}
    for name, v in columns.items():
        if np.isscalar(v):
            out[name] = np.full(n, v)
        else:
            out[name] = v if isinstance(v, np.ndarray) else pd.Series(v, dtype=object)
    return pd.DataFrame(out)


def suppress_anomalies(anomalies: DataFrame, ttl_seconds: int = SUPPRESS_SECONDS) -> DataFrame:
    """Eligible anomalies with ``accepted`` (ST4)."""
    return mark_accepted(eligible(anomalies), ["service_name", "severity"], "detected_at", "id", ttl_seconds)


def admit(pending: DataFrame, capacity: int = MAX_PENDING, ts: str = "detected_at") -> DataFrame:
    """Admission cap of one trigger (ST6): adds ``admitted``; the rest is marked, not dropped.

    The oldest ``capacity`` rows are found by a distributed top-k, never by numbering all rows.
    """
    order = [F.col(ts), F.col("id")]
    last_admitted = (
        pending.select(ts, "id").orderBy(*order).limit(capacity).agg(F.max(F.struct(ts, "id")).alias("__last"))
    )
    return pending.withColumn("admitted", F.coalesce(F.struct(ts, "id") <= last_admitted.scalar(), F.lit(False)))


def active_locks(accepted: DataFrame, as_of: Column, ttl_seconds: int = SUPPRESS_SECONDS) -> DataFrame:
    """(service, severity) keys whose last kept event is younger than the ttl at ``as_of``."""
    last = accepted.where(F.col("accepted") & (F.col("detected_at") <= as_of)).groupBy("service_name", "severity").agg(
        F.max("detected_at").alias("last_accepted")
    )
    return last.where(F.col("last_accepted") + F.expr(f"INTERVAL {ttl_seconds} SECONDS") > as_of)


def triage_order(anomalies: DataFrame) -> DataFrame:
    """Most severe first, then oldest."""
    ranked = anomalies.withColumn("priority", lookup(F.col("severity"), SEVERITY_PRIORITY))
    return ranked.orderBy(F.desc("priority"), F.asc("detected_at"), F.asc("id"))


def queue_counts(accepted: DataFrame) -> DataFrame:
    """Pushed and deduplicated totals."""
    return accepted.agg(
        F.count_if("accepted").alias("pushed"), F.count_if(~F.col("accepted")).alias("deduplicated")
    )
