"""Tables on Parquet: scan, point lookup, idempotent append and upsert.

Layout: one ``event_date=``/``created_date=`` partition per day, so time predicates prune files.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.schemas import ALERTS
from lumenwatch.session import settle

# The alert columns a second write may change.
ALERT_UPDATES = ("status", "sent_at", "channels_succeeded", "error_messages")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Scan with a declared schema."""
    return spark.read.schema(schema).parquet(path)


def by_id(table: DataFrame, value: str) -> DataFrame:
    """Point lookup (S9); an unknown id gives no rows."""
    return table.where(F.col("id") == value)


def analysis_by_id(analyses: DataFrame, value: str, result_schema: str) -> DataFrame:
    """Point lookup that expands the stored JSON of an analysis."""
    return by_id(analyses, value).select(F.from_json("raw_result", result_schema).alias("r")).select("r.*")


def first_per_id(rows: DataFrame, order: Iterable[str]) -> DataFrame:
    """The first row of each id. A min-aggregate: copies of a hot id are folded before the shuffle. The id is the one grouped by,
    so a join on it that follows needs no shuffle of the rows and no sort."""
    row = F.struct(*rows.columns)
    firsts = rows.groupBy("id").agg(F.min_by(row, F.struct(*order)).alias("row"))
    return firsts.select(*("id" if c == "id" else F.col("row")[c].alias(c) for c in rows.columns))


def new_rows(batch: DataFrame, target: DataFrame | None, order: Iterable[str]) -> DataFrame:
    """Rows of a batch to append: first write wins on ``id``, against itself and the target."""
    firsts = first_per_id(batch, order)
    if target is None:
        return firsts
    return firsts.join(target.select("id"), "id", "left_anti").select(*batch.columns)


def append_new(
    batch: DataFrame,
    path: str,
    schema: str,
    order: Iterable[str],
    time_column: str,
    batch_id: int = 0,
) -> DataFrame:
    """Append new rows below ``path`` and return what this batch has there.

    Each batch owns ``batch_id=N`` and overwrites only that, so a replayed batch replaces itself. Only the
    id column of earlier batches is read. Rows are dealt by day, so that a batch leaves few files of a good size, not one a task and day.
    """
    spark = batch.sparkSession
    target = _earlier(spark, path, schema, batch_id)
    fresh = new_rows(batch, target, order).withColumn("event_date", F.to_date(time_column))
    mine = f"{path}/batch_id={batch_id}"
    by_day(fresh, "event_date").write.mode("overwrite").partitionBy("event_date").parquet(mine)
    return spark.read.schema(f"{schema}, event_date DATE").parquet(mine)


def by_day(rows: DataFrame, day: str) -> DataFrame:
    """Rows dealt by day for a write by day; Spark joins small days and splits large ones by their sizes."""
    return rows.hint("rebalance", day)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that ``append_new`` writes; filter on ``event_date`` to prune."""
    return spark.read.schema(f"{schema}, batch_id BIGINT, event_date DATE").parquet(path)


def _earlier(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame | None:
    if not path_exists(spark, path):
        return None
    return read_batches(spark, path, schema).where(F.col("batch_id") != batch_id)


def with_raw_result(analyses: DataFrame) -> DataFrame:
    """Keep the whole row as JSON beside its columns."""
    plain = [c for c in analyses.columns if c != "raw_result"]
    return analyses.select(*plain, F.to_json(F.struct(*plain)).alias("raw_result"))


def save_analyses(batch: DataFrame, path: str, schema: str, batch_id: int = 0) -> DataFrame:
    return append_new(with_raw_result(batch), path, schema, ["analyzed_at", "anomaly_id"], "analyzed_at", batch_id)


def merge_alerts(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert by id (S8): known ids take four delivery columns from the batch, new ids are inserted."""
    new = batch.select([F.col(c).alias(f"new_{c}") for c in batch.columns])
    joined = current.join(new, current["id"] == new["new_id"], "full_outer")
    # The delivery columns are set as written, null included; the others keep what is stored.
    in_batch = F.col("new_id").isNotNull()
    return joined.select(
        *[
            (
                F.when(in_batch, F.col(f"new_{c}")).otherwise(current[c])
                if c in ALERT_UPDATES
                else F.when(current["id"].isNotNull(), current[c]).otherwise(F.col(f"new_{c}"))
            ).alias(c)
            for c in current.columns
        ]
    )


def upsert_alerts(batch: DataFrame, path: str) -> None:
    """Merge a batch into the alert table at ``path``, rewriting only the days in the batch.

    Of several states of an alert in a batch the last sent one counts. The merged days are staged in the shared folder first, because a table cannot be overwritten while it
    is read; then their partitions are replaced. An alert keeps its ``created_at``, hence its day.
    """
    spark = batch.sparkSession
    state = F.struct(*batch.columns)
    last = batch.groupBy("id").agg(F.max_by(state, F.struct("sent_at", "status", "created_at")).alias("s")).select("s.*")
    dated = settle(last.withColumn("created_date", F.to_date("created_at")), "alerts-batch")
    if path_exists(spark, path):
        stored = read_alerts(spark, path)
        known = stored.select("id", F.col("created_date").alias("stored_date")).join(dated.select("id"), "id", "left_semi")
        # A stored alert keeps its day, whatever time the batch names.
        dated = settle(
            dated.join(known, "id", "left").withColumn("created_date", F.coalesce("stored_date", "created_date")).drop("stored_date"), "alerts-dated"
        )
        days = dated.select("created_date").distinct()
        current = stored.join(days, "created_date", "left_semi")
    else:
        current = spark.createDataFrame([], f"{ALERTS}, created_date DATE")
    columns = [*current.columns]
    staged = settle(merge_alerts(current.select(columns), dated.select(columns)), "alerts-merged")
    writer = staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("created_date").parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ALERTS}, created_date DATE").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
