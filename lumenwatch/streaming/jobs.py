"""Streaming jobs (ST1-ST10). Each returns a started query; state and progress live in its checkpoint.

Stages hand over through landed tables: logs -> features -> scores -> kept anomalies. A stage that fails
restarts from its checkpoint and rewrites the same ``batch_id=N`` folder. Results do not depend on how the input is cut
into files and micro-batches, nor on its order: a late log or event changes what it touches, and readers take the
latest version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lumenwatch.operators import forest
from lumenwatch.operators.features import WINDOW_SECONDS, features_from_folds, fold_logs
from lumenwatch.operators.statistical import (
    FLAT, TRIGGER_ABOVE, WEIGHTS, StatisticalConfig, numbered,
)
from lumenwatch.operators.suppression import MAX_PENDING, admit, mark_accepted
from lumenwatch.schemas import FEATURES, LOGS
from lumenwatch.session import ROCKSDB_PROVIDER, settle
from lumenwatch.sources.records import decode_records, observed_counts, split_decoded
from lumenwatch.sources.tables import append_new, by_day, path_exists, read_batches

FEATURE_TABLE = FEATURES + ", first_log TIMESTAMP, last_log TIMESTAMP"


def _start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    """Run until the input is drained, or for good with one micro-batch per ``every``."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# ---- landing (ST7, ST8, ST9) ---------------------------------------------------------------------


def land_logs(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    quarantine: str | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Decode records and append new logs, then call ``on_batch(logs, batch_id)``.

    Progress is committed after both have finished. A batch that is run again overwrites its own folder, and
    ids of earlier batches are skipped, so each log lands once. ``on_batch`` may see a batch twice. Records that cannot
    be decoded go to ``quarantine`` (beside ``path`` by default) with their reason, and each batch's totals of processed
    records and errors to ``counts`` below it.
    """
    rejected = quarantine or f"{path.rstrip('/')}-rejected"

    def process(batch: DataFrame, batch_id: int) -> None:
        observed, totals = observed_counts(decode_records(batch))
        decoded = settle(observed, "decoded")
        good, bad = split_decoded(decoded)
        landed = append_new(good, path, LOGS, ["timestamp", "message"], "timestamp", batch_id)
        bad.write.mode("overwrite").json(f"{rejected}/rows/batch_id={batch_id}")
        counts = batch.sparkSession.createDataFrame([(totals.get["processed"], totals.get["errors"])], "processed BIGINT, errors BIGINT")
        counts.write.mode("overwrite").json(f"{rejected}/counts/batch_id={batch_id}")
        if on_batch:
            on_batch(landed.drop("event_date"), batch_id)

    return _start(messages.writeStream.foreachBatch(process), checkpoint, every)


def without_repeats(logs: DataFrame) -> DataFrame:
    """The first log of each id (ST9), however late. The state holds every id; landing does the same from its table."""
    return logs.dropDuplicates(["id"])


# ---- feature windows (ST1, ST8, ST10) ------------------------------------------------------------


_FOLD_KEYS = "service_name STRING, slot_start TIMESTAMP, slot_end TIMESTAMP"
_FOLDS = {
    "values": f"{_FOLD_KEYS}, latency DOUBLE, level STRING, n BIGINT, first_ts TIMESTAMP, last_ts TIMESTAMP",
    "traces": f"{_FOLD_KEYS}, trace STRING",
}


def window_folds(spark: SparkSession, path: str, kind: str, days: list[str], batch_id: int) -> DataFrame:
    """The landed folds of the windows of some days up to a batch; only the folders of these days are listed and read."""
    folder = f"{path.rstrip('/')}-folds/{kind}"
    reader = spark.read.schema(f"{_FOLDS[kind]}, slot_date STRING, batch_id BIGINT").option("basePath", folder)
    return reader.parquet(*[f"{folder}/slot_date={d}" for d in days]).where(F.col("batch_id") <= batch_id)


def refresh_features(logs: DataFrame, path: str, batch_id: int, window_seconds: int = WINDOW_SECONDS, rounded: bool = True) -> None:
    """Bring every window that new logs fall into up to date, without reading older logs.

    The new logs are folded to (window, latency, level) counts and (window, trace) pairs, which land beside ``path`` by day of
    the window. A touched window is the sum of its folds, those of this batch and of the batches before that touched it.
    It gets a new version; a batch that is run again writes the same ones.
    """
    spark, keys = logs.sparkSession, ["service_name", "slot_start"]
    dated = F.date_format("slot_start", "yyyy-MM-dd").alias("slot_date")
    slots = logs.select("service_name", F.window("timestamp", f"{window_seconds} seconds")["start"].alias("slot_start")).distinct()
    touched = settle(slots.select("*", dated), "touched-windows")
    days = sorted(r.slot_date for r in touched.select("slot_date").distinct().collect())  # the days of one batch
    if not days:
        return
    folded = {}
    for kind, fold in zip(_FOLDS, fold_logs(logs, window_seconds), strict=True):
        writer = by_day(fold.select("*", dated, F.lit(batch_id).alias("batch_id")), "slot_date").write.mode("overwrite")
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy("slot_date", "batch_id")
        writer.parquet(f"{path.rstrip('/')}-folds/{kind}")
        folded[kind] = window_folds(spark, path, kind, days, batch_id).join(touched.select(*keys), keys, "left_semi").drop("slot_date", "batch_id")
    values = settle(folded["values"], "folds")  # read twice for exact percentiles
    features_from_folds(values, folded["traces"], window_seconds, rounded).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def stream_features(
    logs: DataFrame, path: str, checkpoint: str, window_seconds: int = WINDOW_SECONDS, rounded: bool = True, every: str | None = None
) -> StreamingQuery:
    """Feature rows of a stream of logs: ``path``/logs has each log once, ``path``/windows the versions of windows."""

    def process(batch: DataFrame, batch_id: int) -> None:
        landed = append_new(batch.select(*_LOG_COLUMNS), f"{path}/logs", LOGS, ["timestamp", "message"], "timestamp", batch_id)
        refresh_features(landed, f"{path}/windows", batch_id, window_seconds, rounded)

    return _start(logs.writeStream.foreachBatch(process), checkpoint, every)


_LOG_COLUMNS = [field.split()[0] for field in LOGS.split(", ")]


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The version of each row from the last batch that wrote it."""
    columns = [c for c in rows.columns if c != "batch_id"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch_id").alias("row")).select("row.*")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The windows as they now stand."""
    return latest(spark.read.schema(f"{FEATURE_TABLE}, batch_id BIGINT").parquet(path), "window_id")


def close_windows(spark: SparkSession, path: str, closed: str, batch_id: int, upto=None) -> None:
    """Land at ``closed`` the windows of ``path`` that end by ``upto`` (all without it) and are not there yet.

    Scoring takes windows in order and once, so it reads closed ones; a later version of a closed window stays out.
    """
    rows = read_features(spark, path)
    if upto is not None:
        rows = rows.where(F.col("window_end") <= upto)
    before = _before(spark, closed, FEATURE_TABLE, batch_id)
    if before is not None:
        rows = rows.join(before.select("window_id"), "window_id", "left_anti")
    rows.select([f.split()[0] for f in FEATURE_TABLE.split(", ")]).write.mode("overwrite").parquet(f"{closed}/batch_id={batch_id}")


def feature_stream(spark: SparkSession, path: str) -> DataFrame:
    """A landed table of closed windows as a stream. A trigger takes all files there are, so it never splits a landed batch."""
    return spark.readStream.schema(FEATURE_TABLE).parquet(f"{path}/batch_id=*")


# ---- statistical scoring (ST2) -------------------------------------------------------------------

SCORES = "service_name STRING, window_id STRING, window_start TIMESTAMP, stat_warming BOOLEAN, stat_score DOUBLE, stat_triggered STRING"


def rolling_step(value, history, seen: int, above, below, target, conf: StatisticalConfig):
    """One window against the values before it: the weighted score of each feature (None while warming up), and the CUSUM's
    sums and target afterwards."""
    if seen < conf.min_samples:
        return None, above, below, target
    if seen == conf.min_samples:
        target = history.mean(axis=0)
    mean, std = history.mean(axis=0), history.std(axis=0)
    flat = std < FLAT
    z = np.where(flat, 0.0, np.abs(value - mean) / np.where(flat, 1.0, std) / conf.z_threshold)
    q1, q3 = np.percentile(history, [25, 75], axis=0)
    iqr = q3 - q1
    outside = np.maximum(np.maximum(value - q3 - 1.5 * iqr, q1 - 1.5 * iqr - value), 0.0)
    fence = np.where(iqr < FLAT, 0.0, outside / (iqr + FLAT))
    scale = np.where(flat, 1.0 if conf.flat_std == "one" else 0.0, std)
    above = np.maximum(0.0, above + (value - target) - conf.cusum_k * scale)
    below = np.maximum(0.0, below - (value - target) - conf.cusum_k * scale)
    drift = np.maximum(above, below) / (conf.cusum_h * scale + FLAT)
    return np.minimum(np.maximum(np.maximum(z, fence), drift), 1.0) * np.array(list(WEIGHTS.values())), above, below, target


def fused_score(weighted) -> tuple[float, list[str]]:
    """The score of a window and the features that raised it."""
    if weighted is None:
        return 0.0, []
    return round(min(float(weighted.sum()), 1.0), 4), [n for n, w in zip(WEIGHTS, weighted) if w > TRIGGER_ABOVE]


class RollingScorer(StatefulProcessor):
    """Per service: the last values of each feature, the CUSUM sums and targets, and the count so far."""

    def __init__(self, config: StatisticalConfig = StatisticalConfig()):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "rolling", "seen BIGINT, history ARRAY<ARRAY<DOUBLE>>, above ARRAY<DOUBLE>, below ARRAY<DOUBLE>, target ARRAY<DOUBLE>"
        )

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names, conf = list(WEIGHTS), self.config
        part = pd.concat(list(rows)).sort_values("window_start")
        seen, history = 0, np.empty((0, len(names)))
        above, below, target = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        if self.state.exists():
            seen, stored, above, below, target = self.state.get()
            history = np.array([list(h) for h in stored]).reshape(-1, len(names))
            above, below, target = np.array(above), np.array(below), np.array(target)
        out = []
        for row in part.itertuples():
            value = np.array([getattr(row, n) for n in names], dtype=float)
            weighted, above, below, target = rolling_step(value, history, seen, above, below, target, conf)
            score, triggered = fused_score(weighted)
            history = np.vstack([history, value])[-conf.history :]
            out.append((row.service_name, row.window_id, row.window_start, weighted is None, score, ",".join(triggered)))
            seen += 1
        self.state.update((seen, history.tolist(), above.tolist(), below.tolist(), target.tolist()))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in SCORES.split(", ")])

    def close(self) -> None:
        pass


def stream_scores(
    features: DataFrame, path: str, checkpoint: str, config: StatisticalConfig = StatisticalConfig(), every: str | None = None
) -> StreamingQuery:
    """Statistical scores of closed windows with state per service."""
    # Windows are few beside logs, and a service has one per window length, so a key stays small.
    scored = features.groupBy("service_name").transformWithStateInPandas(
        statefulProcessor=RollingScorer(config), outputStructType=SCORES, outputMode="append", timeMode="None"
    )
    spark, name = features.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB_PROVIDER)  # the query keeps the setting it starts with
    try:
        return _start(scored.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint, every)
    finally:
        spark.conf.set(name, was)


# ---- forest scoring (ST3) ------------------------------------------------------------------------


def stream_forest_scores(features: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Forest scores of closed windows; a service is refitted when its schedule is due.

    Below ``path``: ``features`` (history), ``model`` and ``quantiles`` (one fit each, reused until the next),
    ``scores``. All are written per batch folder, so a batch can be run again.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        here = f"batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(f"{path}/features/{here}")
        mine = spark.read.schema(FEATURE_TABLE).parquet(f"{path}/features/{here}")
        services = mine.select("service_name").distinct()
        history = _up_to(spark, f"{path}/features", FEATURE_TABLE, batch_id).join(services, "service_name", "left_semi")
        scheduled = settle(forest.with_schedule(numbered(history)), "scheduled")
        epochs = forest.due_epochs(scheduled)
        known = _before(spark, f"{path}/quantiles", _QUANTILES, batch_id)
        if known is not None:
            epochs = epochs.join(known, ["service_name", "segment", "epoch"], "left_anti")
        forest.fit_forest(scheduled, epochs).write.mode("overwrite").parquet(f"{path}/model/{here}")
        # Two reads, so that the two sides of the join below are distinct relations.
        new_model, fits = [spark.read.schema(forest.MODEL_SCHEMA).parquet(f"{path}/model/{here}") for _ in range(2)]
        new_epochs = fits.select("service_name", "segment", "epoch").distinct()
        forest.train_quantiles(scheduled, new_model, new_epochs).write.mode("overwrite").parquet(f"{path}/quantiles/{here}")

        model = _up_to(spark, f"{path}/model", forest.MODEL_SCHEMA, batch_id)
        quantiles = _up_to(spark, f"{path}/quantiles", _QUANTILES, batch_id)
        scored = forest.score_windows(scheduled, model, quantiles, mine.select("window_id"))
        scored.select(
            "service_name", "window_id", "window_start", "rn", "forest_warming", "forest_score", "forest_triggered"
        ).write.mode("overwrite").parquet(f"{path}/scores/{here}")

    return _start(features.writeStream.foreachBatch(process), checkpoint, every)


_QUANTILES = "service_name STRING, segment BIGINT, epoch BIGINT, train_quantile DOUBLE"


def _up_to(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """A per-batch table up to a batch; the folder name prunes files."""
    return spark.read.schema(f"{schema}, batch_id BIGINT").parquet(path).where(F.col("batch_id") <= batch_id).drop("batch_id")


def _before(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame | None:
    return _up_to(spark, path, schema, batch_id - 1) if path_exists(spark, path) else None


# ---- suppression, cooldown, admission (ST4, ST5, ST6) ---------------------------------------------


def stream_suppression(
    events: DataFrame, path: str, checkpoint: str, ts: str = "detected_at", ttl_seconds=300, every: str | None = None
) -> StreamingQuery:
    """Mark events kept or suppressed per (service, severity). ``ttl_seconds`` is a number (ST4) or a column
    of ``events`` such as the cooldown of its rule (ST5).

    A batch decides its keys anew from its earliest event on, after the last event kept before that, so the decisions
    are those of the batch operator over all events so far, in whatever order they come. ``read_decisions`` gives
    the latest.
    """
    keys, columns = ["service_name", "severity"], ["id", "service_name", "severity", ts]
    ttl = F.col(ttl_seconds) if isinstance(ttl_seconds, str) else F.lit(ttl_seconds)
    schema = f"id STRING, service_name STRING, severity STRING, {ts} TIMESTAMP, ttl_seconds BIGINT"

    def process(batch: DataFrame, batch_id: int) -> None:
        spark, here = batch.sparkSession, f"batch_id={batch_id}"
        batch.select(*columns, ttl.cast("bigint").alias("ttl_seconds")).write.mode("overwrite").parquet(f"{path}/events/{here}")
        new = spark.read.schema(schema).parquet(f"{path}/events/{here}")
        since = settle(new.groupBy(*keys).agg(F.min(ts).alias("since")), "since")
        again = _up_to(spark, f"{path}/events", schema, batch_id).join(since, keys).where(F.col(ts) >= F.col("since"))
        again = again.dropDuplicates(["id"]).select(*columns, "ttl_seconds", F.lit(False).alias("known"))
        if path_exists(spark, f"{path}/decisions"):
            known = spark.read.schema(f"{schema}, accepted BOOLEAN, batch_id BIGINT").parquet(f"{path}/decisions").where(F.col("batch_id") < batch_id)
            kept = latest(known.join(since, keys).where(F.col(ts) < F.col("since")), "id").where("accepted")
            last = kept.groupBy(*keys).agg(F.max_by(F.struct(*columns, "ttl_seconds"), F.struct(ts, "id")).alias("row")).select("row.*")
            again = again.unionByName(last.withColumn("known", F.lit(True)))
        marked = mark_accepted(settle(again, "to-decide"), keys, ts, "id", F.col("ttl_seconds"))
        marked.where("NOT known").drop("known").write.mode("overwrite").parquet(f"{path}/decisions/{here}")

    return _start(events.writeStream.foreachBatch(process), checkpoint, every)


def read_decisions(spark: SparkSession, path: str, ts: str = "detected_at") -> DataFrame:
    schema = f"id STRING, service_name STRING, severity STRING, {ts} TIMESTAMP, accepted BOOLEAN, batch_id BIGINT"
    return latest(spark.read.schema(schema).parquet(f"{path}/decisions"), "id")


def stream_admission(
    events: DataFrame, path: str, checkpoint: str, pending: Callable[[int], int] | None = None, capacity: int = MAX_PENDING,
    every: str | None = None, finished: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Admit the oldest rows while at most ``capacity`` are pending; the others are kept with ``admitted`` false.

    How many admitted rows still wait when a batch begins follows from what earlier batches admitted and ``finished()``, a table with
    the ``id`` of each row that is done with (none without it), unless ``pending(batch_id)`` says it.
    """

    def waiting(spark: SparkSession, batch_id: int) -> int:
        if pending is not None:
            return pending(batch_id)
        if not path_exists(spark, path):
            return 0
        admitted = spark.read.schema("id STRING, admitted BOOLEAN, batch_id BIGINT").parquet(path).where((F.col("batch_id") < batch_id) & F.col("admitted"))
        return (admitted if finished is None else admitted.join(finished().select("id"), "id", "left_anti")).count()

    def process(batch: DataFrame, batch_id: int) -> None:
        room = max(0, capacity - waiting(batch.sparkSession, batch_id))
        admit(batch, room).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(events.writeStream.foreachBatch(process), checkpoint, every)
