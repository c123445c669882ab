"""Streaming anomalies: both detectors, fusion, suppression and routing over the versions of feature windows.

``AnomalyScorer`` keeps for each service its windows in blocks of one fit's length, with what the detectors carry into each
block, and the forest in use. New windows at the end cost a block's read. A window that comes late or changes, or a restart that
becomes known, is worked in from its block on, for everything after it may change; results that differ from what was handed on
go out again as new versions. Draws of the forest are counted by hash, so a refit gives the same forest.

Downstream each trigger decides anew, for its services, from the earliest version it brings: which anomalies are kept, and which of
their alerts. What no longer holds is withdrawn. So at any time the tables are what the batch operators make of all logs so far.
"""

from __future__ import annotations

import bisect
import json
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lumenwatch.operators.ensemble import as_anomalies
from lumenwatch.operators.forest import (
    CONTAMINATION, DRIVER_SCORE, DRIVER_Z, FIRST_FIT, REFIT_EVERY, SAMPLE_ROWS, VECTOR, fit_history, isolation,
)
from lumenwatch.operators.routing import route_alerts
from lumenwatch.operators.statistical import WEIGHTS, StatisticalConfig
from lumenwatch.operators.suppression import SUPPRESS_SECONDS, eligible, mark_accepted
from lumenwatch.schemas import ALERTS
from lumenwatch.session import ROCKSDB_PROVIDER, settle
from lumenwatch.sources.tables import path_exists
from lumenwatch.streaming.jobs import FEATURE_TABLE, _start, fused_score, latest, rolling_step

_NUMBERS = (
    "window_seconds", "total_logs", "logs_per_second", "error_count", "critical_count", "error_rate", "latency_p50", "latency_p95",
    "latency_p99", "latency_mean", "unique_traces",
)
_STAT = [VECTOR.index(c) for c in WEIGHTS]
_VEC = [_NUMBERS.index(c) for c in VECTOR]
SCORED = (
    "window_id STRING, service_name STRING, window_start TIMESTAMP, window_end TIMESTAMP, window_seconds INT, total_logs BIGINT, "
    "logs_per_second DOUBLE, error_count BIGINT, critical_count BIGINT, error_rate DOUBLE, latency_p50 DOUBLE, latency_p95 DOUBLE, "
    "latency_p99 DOUBLE, latency_mean DOUBLE, unique_traces BIGINT, first_log TIMESTAMP, last_log TIMESTAMP, segment BIGINT, rn BIGINT, "
    "history_size BIGINT, stat_warming BOOLEAN, stat_score DOUBLE, stat_triggered STRING, stat_feature_scores STRING, "
    "forest_warming BOOLEAN, forest_score DOUBLE, forest_triggered STRING"
)
_WINDOW = "id: STRING, times: ARRAY<BIGINT>, numbers: ARRAY<DOUBLE>, shown: STRING"
_NEVER = -(2**62)


def _block(rn: int) -> int:
    """The first fit whose training set holds a position; 0 for the first ``FIRST_FIT``."""
    return max(0, -(-(rn - FIRST_FIT) // REFIT_EVERY))


class AnomalyScorer(StatefulProcessor):
    """Per service: windows by block with the carry into it, the known restarts, and the forest in use."""

    def __init__(self, config: StatisticalConfig = StatisticalConfig()):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Which blocks there are: the first window's time, the segment's first time, and the number within the segment.
        self.index = handle.getValueState("index", "resets ARRAY<BIGINT>, firsts ARRAY<BIGINT>, segments ARRAY<BIGINT>, blocks ARRAY<BIGINT>")
        self.windows = handle.getMapState("windows", "segment BIGINT, block BIGINT", f"rows ARRAY<STRUCT<{_WINDOW}>>, carry ARRAY<DOUBLE>")
        self.forest = handle.getValueState("forest", "segment BIGINT, ordinal BIGINT, epoch BIGINT, model BINARY")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        service, given = key[0], pd.concat(list(rows)).sort_values("version", kind="stable")
        resets, firsts, segments, blocks = map(list, self.index.get()) if self.index.exists() else ([], [], [], [])
        new_resets = {int(t) for t in given.loc[given["window_id"].isna(), "start"]} - set(resets)
        resets = sorted({*resets, *new_resets})
        new = {}
        for w in given[given["window_id"].notna()].itertuples():  # of several versions the last
            new[int(w.start)] = {"id": w.window_id, "times": [int(w.start), int(w.stop), int(w.first_at), int(w.last_at)], "numbers": [float(getattr(w, n)) for n in _NUMBERS], "shown": ""}
        if not new and not (new_resets and firsts):
            if new_resets:
                self.index.update((resets, firsts, segments, blocks))
            return

        # Work anew from the block that holds the earliest change.
        at = max(0, bisect.bisect_right(firsts, min([*new, *new_resets])) - 1)
        held, carry = {}, None
        for k in range(at, len(firsts)):
            body = self.windows.getValue((segments[k], blocks[k]))
            carry = carry if carry is not None else list(body[1])
            held |= {w["times"][0]: w for w in (dict(zip(("id", "times", "numbers", "shown"), r)) for r in body[0])}
            self.windows.removeKey((segments[k], blocks[k]))
        segment, block = (segments[at], blocks[at]) if firsts else (None, 0)
        before = self._vectors(segment, block - 1, block) if firsts else np.empty((0, len(VECTOR)))
        del firsts[at:], segments[at:], blocks[at:]
        run = _Run(self.config, before, 0 if block == 0 else FIRST_FIT + REFIT_EVERY * (block - 1), carry)

        done, out = [], []
        for start in sorted(held | new):
            w = new.get(start) or held[start]
            ordinal = bisect.bisect_right(resets, start)
            mine = resets[ordinal - 1] if ordinal else _NEVER
            if mine != segment:
                segment, run = mine, _Run(self.config, np.empty((0, len(VECTOR))), 0, None)
            starts_block = _block(run.seen + 1) != _block(run.seen) or run.seen == 0
            if starts_block:
                firsts.append(start), segments.append(segment), blocks.append(_block(run.seen + 1))
            carried = run.carry() if starts_block else None
            done.append((segment, ordinal, blocks[-1], w, carried, run.step(np.array(w["numbers"])[_VEC])))
        self._score_forest(service, done)
        for segment, ordinal, block, w, _, r in done:
            shown = json.dumps([ordinal, r["rn"], r["stat_score"], r["stat_triggered"], r["forest_score"], r["forest_triggered"]])
            if shown != w["shown"]:
                w["shown"] = shown
                out.append(self._shown(service, ordinal, w, r))
        self._store(done)
        self.index.update((resets, firsts, segments, blocks))
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SCORED.split(", ")])

    def _vectors(self, segment: int, low: int, high: int) -> np.ndarray:
        """The vectors of the stored blocks from ``low`` to before ``high`` of a segment."""
        parts = [[w[2] for w in self.windows.getValue((segment, b))[0]] for b in range(max(low, 0), high)]
        return np.array([n for p in parts for n in p], dtype=float).reshape(-1, len(_NUMBERS))[:, _VEC]

    def _score_forest(self, service: str, done: list) -> None:
        """Forest scores of the windows worked on, fit by fit."""
        groups: dict[tuple, list] = {}
        for segment, ordinal, _, w, _, r in done:
            if r["rn"] >= FIRST_FIT:
                groups.setdefault((segment, ordinal, (r["rn"] - FIRST_FIT) // REFIT_EVERY), []).append((w, r))
        kept = None
        if self.forest.exists():
            *name, model = self.forest.get()
            first_changed = {}
            for segment, ordinal, _, _, _, r in done:
                first_changed.setdefault(segment, r["rn"])
            # The forest in use stands unless a window it trained on has changed.
            trained = FIRST_FIT + REFIT_EVERY * name[2]
            if first_changed.get(name[0], trained + 1) > trained or self._same_training(name[0], trained, done):
                kept = (tuple(name), pickle.loads(bytes(model)))
        for name, members in groups.items():
            if kept is None or kept[0] != name:
                segment, ordinal, epoch = name
                train = FIRST_FIT + REFIT_EVERY * epoch
                mine = [np.array(w["numbers"])[_VEC] for s, _, _, w, _, r in done if s == segment and r["rn"] <= train]
                stored = self._vectors(segment, 0, _block(train - len(mine) + 1)) if len(mine) < train else np.empty((0, len(VECTOR)))
                history = np.vstack([stored, *mine])
                trees = fit_history(history, service, ordinal, epoch)
                size = min(SAMPLE_ROWS, len(history))
                zero = float(np.percentile(isolation(history, trees, size), 100 * (1 - CONTAMINATION)))
                kept = (name, (trees, size, zero))
            trees, size, zero = kept[1]
            raw = np.clip(2 * (isolation(np.array([np.array(w["numbers"])[_VEC] for w, _ in members]), trees, size) - zero), 0, 1)
            for (_, r), x in zip(members, raw):
                r["forest_warming"], r["forest_score"] = False, round(float(x), 4)
                r["forest_triggered"] = r["drivers"] if x > DRIVER_SCORE else []
        if kept is not None:
            self.forest.update((*kept[0], pickle.dumps(kept[1])))

    def _same_training(self, segment: int, trained: int, done: list) -> bool:
        """Windows that were handed on before with the same place and are not new versions."""
        inside = [(w, r, o) for s, o, _, w, _, r in done if s == segment and r["rn"] <= trained]
        return all(w["shown"] and json.loads(w["shown"])[:2] == [o, r["rn"]] for w, r, o in inside)

    def _shown(self, service: str, ordinal: int, w: dict, r: dict) -> tuple:
        start, stop, first, last = (pd.Timestamp(t, unit="us") for t in w["times"])
        seconds, total, *rest = w["numbers"]
        numbers = [int(seconds), int(total), rest[0], int(rest[1]), int(rest[2]), *rest[3:8], int(rest[8])]
        weighted = None if r["weighted"] is None else json.dumps({n: round(float(x), 4) for n, x in zip(WEIGHTS, r["weighted"])})
        return (
            w["id"], service, start, stop, *numbers, first, last, ordinal, r["rn"], min(r["rn"], self.config.history), r["weighted"] is None, r["stat_score"],
            "|".join(r["stat_triggered"]), weighted, r["forest_warming"], r["forest_score"], "|".join(r["forest_triggered"]),
        )

    def _store(self, done: list) -> None:
        bodies: dict[tuple, tuple[list, list]] = {}
        for segment, _, block, w, carry, _ in done:
            body = bodies.setdefault((segment, block), ([], carry))
            body[0].append((w["id"], w["times"], w["numbers"], w["shown"]))
        for name, body in bodies.items():
            self.windows.updateValue(name, body)

    def close(self) -> None:
        pass


class _Run:
    """What the detectors carry from window to window of one segment."""

    def __init__(self, config: StatisticalConfig, before: np.ndarray, seen: int, carry: list | None):
        n, m = len(_STAT), len(VECTOR)
        self.config, self.seen, self.history = config, seen, before[-config.history :][:, _STAT]
        flat = np.array(carry if seen else [0.0] * (3 * n + 2 * m), dtype=float)
        self.above, self.below, self.target, self.mean, self.square = np.split(flat, [n, 2 * n, 3 * n, 3 * n + m])

    def carry(self) -> list[float]:
        return np.concatenate([self.above, self.below, self.target, self.mean, self.square]).tolist()

    def step(self, vector: np.ndarray) -> dict:
        value = vector[_STAT]
        weighted, self.above, self.below, self.target = rolling_step(value, self.history, self.seen, self.above, self.below, self.target, self.config)
        self.history = np.vstack([self.history, value])[-self.config.history :]
        self.seen += 1
        shift = vector - self.mean
        self.mean = self.mean + shift / self.seen
        self.square = self.square + shift * (vector - self.mean)
        far = np.abs((vector - self.mean) / (np.sqrt(self.square / self.seen) + 1e-9)) > DRIVER_Z
        score, triggered = fused_score(weighted)
        return {
            "rn": self.seen, "weighted": weighted, "stat_score": score, "stat_triggered": triggered, "drivers": [n for n, f in zip(VECTOR, far) if f],
            "forest_warming": True, "forest_score": 0.0, "forest_triggered": [],
        }


# ---- the job -------------------------------------------------------------------------------------


def window_versions(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The versions of feature windows at ``path`` (``stream_features``) as a stream; all there are a trigger unless bounded."""
    reader = spark.readStream.schema(f"{FEATURE_TABLE}, batch_id BIGINT")
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def stream_anomalies(
    versions: DataFrame, path: str, checkpoint: str, rules: DataFrame | None = None, analyze: Callable[[DataFrame], DataFrame] | None = None,
    resets: DataFrame | None = None, config: StatisticalConfig = StatisticalConfig(), ttl_seconds: int = SUPPRESS_SECONDS, every: str | None = None,
) -> StreamingQuery:
    """Versions of windows to anomalies, kept anomalies and, with ``rules`` and ``analyze``, routed alerts.

    ``resets(service_name, reset_at)`` is a second stream: a service's history starts anew there. ``analyze`` makes analyses of kept
    anomalies, one each, dated by their anomaly. Read the results by ``read_anomalies``, ``read_kept`` and ``read_alerts_routed``.
    """
    micros = lambda c: F.unix_micros(c)
    rows = versions.select(
        "service_name", "window_id", micros("window_start").alias("start"), micros("window_end").alias("stop"), micros("first_log").alias("first_at"),
        micros("last_log").alias("last_at"), *_NUMBERS, F.col("batch_id").alias("version"),
    )
    if resets is not None:
        known = resets.select("service_name", micros("reset_at").alias("start"), F.lit(-1).cast("bigint").alias("version"))
        rows = rows.unionByName(known, allowMissingColumns=True)
    scored = rows.groupBy("service_name").transformWithStateInPandas(
        statefulProcessor=AnomalyScorer(config), outputStructType=SCORED, outputMode="append", timeMode="None"
    )

    # A batch of a stateful query has a session that does not plan adaptively, where each small step of a trigger takes a task for every
    # shuffle partition; what follows its own rows is planned by the session that starts the job.
    spark = versions.sparkSession

    def process(batch: DataFrame, batch_id: int) -> None:
        here = f"batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(f"{path}/scores/{here}")
        new = spark.read.schema(SCORED).parquet(f"{path}/scores/{here}")
        listed = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|"))
        new = new.withColumns({
            "stat_triggered": listed("stat_triggered"), "forest_triggered": listed("forest_triggered"),
            "stat_feature_scores": F.from_json("stat_feature_scores", "map<string,double>"),
        })
        names = [f.split()[0] for f in FEATURE_TABLE.split(", ")]
        as_anomalies(new, names).write.mode("overwrite").parquet(f"{path}/anomalies/{here}")
        since = _since(spark, path, batch_id)
        _decide(spark, path, batch_id, since, ttl_seconds)
        if rules is not None and analyze is not None:
            _route(spark, path, batch_id, since, rules, analyze)

    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB_PROVIDER)  # the query keeps the setting it starts with
    try:
        return _start(scored.writeStream.outputMode("append").foreachBatch(process), checkpoint, every)
    finally:
        spark.conf.set(name, was)


def _since(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The services of a batch with the earliest version it brings."""
    new = spark.read.parquet(f"{path}/anomalies/batch_id={batch_id}")
    return settle(new.groupBy("service_name").agg(F.min("detected_at").alias("since")), "since")


def _versions(spark: SparkSession, path: str, batch_id: int, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, batch_id BIGINT")
    return reader.parquet(path).where(F.col("batch_id") <= batch_id)


_DECISION = "id STRING, service_name STRING, severity STRING, detected_at TIMESTAMP, accepted BOOLEAN"


def _decide(spark: SparkSession, path: str, batch_id: int, since: DataFrame, ttl_seconds: int) -> None:
    """Which anomalies are kept, decided anew for the services of the batch from its earliest version on."""
    keys, columns = ["service_name", "severity"], ["id", "service_name", "severity", "detected_at"]
    every = _versions(spark, f"{path}/anomalies", batch_id).select(*columns, "is_anomaly", "batch_id").join(since, "service_name").where("detected_at >= since").drop("since")
    now = settle(latest(every, "id"), "anomalies-now")
    decide = eligible(now).select(*columns, F.lit(False).alias("known"))
    if path_exists(spark, f"{path}/decisions"):
        past = latest(_versions(spark, f"{path}/decisions", batch_id - 1, _DECISION).join(since, "service_name").where("detected_at < since").drop("since"), "id")
        last = past.where("accepted").groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("detected_at", "id")).alias("row")).select("row.*")
        decide = decide.unionByName(last.withColumn("known", F.lit(True)))
    marked = mark_accepted(settle(decide, "to-decide"), keys, "detected_at", "id", ttl_seconds).where("NOT known")
    accepted = marked.select(F.col("id").alias("of"), "accepted")
    rows = now.select(*columns).join(accepted, F.col("id") == F.col("of"), "left").select(*columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))
    rows.write.mode("overwrite").parquet(f"{path}/decisions/batch_id={batch_id}")


def _route(spark: SparkSession, path: str, batch_id: int, since: DataFrame, rules: DataFrame, analyze: Callable[[DataFrame], DataFrame]) -> None:
    """Alerts of the kept anomalies of the same stretch, and the withdrawal of those that no longer stand."""
    kept = spark.read.schema(_DECISION).parquet(f"{path}/decisions/batch_id={batch_id}").where("accepted").select("id")
    rows = _versions(spark, f"{path}/anomalies", batch_id).join(kept, "id", "left_semi")
    analyses = settle(analyze(latest(rows, "id")), "analyses")
    earlier = before = None
    if path_exists(spark, f"{path}/alerts"):
        mine = latest(_versions(spark, f"{path}/alerts", batch_id - 1, ALERTS).join(since, "service_name").withColumn("again", F.col("created_at") >= F.col("since")), "id")
        mine = settle(mine.where("status <> 'withdrawn'").drop("since"), "alerts-before")
        last = mine.where("NOT again AND status <> 'suppressed'").groupBy("service_name", "severity")
        earlier = last.agg(F.max_by(F.struct("id", "created_at"), F.struct("created_at", "id")).alias("r")).select("service_name", "severity", "r.*")
        before = mine.where("again").drop("again")
    routed = settle(route_alerts(analyses, rules, earlier=earlier), "routed")
    if before is not None:
        gone = before.join(routed.select("id"), "id", "left_anti").withColumn("status", F.lit("withdrawn"))
        routed = routed.unionByName(gone.select(routed.columns))
    routed.write.mode("overwrite").parquet(f"{path}/alerts/batch_id={batch_id}")


def read_anomalies(spark: SparkSession, path: str) -> DataFrame:
    """The anomalies as they now stand."""
    return latest(spark.read.parquet(f"{path}/anomalies"), "id")


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    """The decisions as they now stand."""
    return latest(spark.read.schema(f"{_DECISION}, batch_id BIGINT").parquet(f"{path}/decisions"), "id")


def read_alerts_routed(spark: SparkSession, path: str) -> DataFrame:
    """The alerts as they now stand, without withdrawn ones."""
    return latest(spark.read.schema(f"{ALERTS}, batch_id BIGINT").parquet(f"{path}/alerts"), "id").where("status <> 'withdrawn'")
