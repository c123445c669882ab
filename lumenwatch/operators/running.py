"""Running totals over long keyed histories without putting one key into one task.

A plain ``sum() OVER (PARTITION BY key ORDER BY ts)`` sorts a whole key in one task. Here each key is
cut into time cells: totals run inside (key, cell), and the offset of a cell is the running total of the
cells before it, which is one small row per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenwatch.session import settle

_CELL = "__cell"


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], cell: Column, values: dict[str, Column]
) -> DataFrame:
    """Add one inclusive running total per entry of ``values``.

    ``cell`` must not decrease along ``order`` within a key, for example a truncated timestamp.
    """
    celled = df.withColumn(_CELL, cell)
    inside = Window.partitionBy(*keys, _CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = celled.select("*", *[F.sum(v).over(inside).alias(f"__in_{n}") for n, v in values.items()])

    before = Window.partitionBy(*keys).orderBy(_CELL).rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.groupBy(*keys, _CELL).agg(*[F.sum(v).alias(f"__cell_{n}") for n, v in values.items()])
    offsets = cells.select(
        *keys, _CELL, *[F.coalesce(F.sum(f"__cell_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in values]
    )
    joined = local.join(offsets, [*keys, _CELL])
    return joined.select(
        *df.columns, *[(F.col(f"__off_{n}") + F.col(f"__in_{n}")).alias(n) for n in values]
    )


def ranged_totals(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """``running_totals`` for keys whose rows may crowd into any stretch of time: cells are tasks of a range partitioning on key and
    order, which Spark bounds by sampled row counts. The dealt rows are landed once, so that both passes see the same cells."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id())
    dealt = settle(dealt, "ranges").withColumn("__task", F.shiftright("__at", 33))
    return running_totals(dealt, keys, ["__at"], F.col("__task"), values).drop("__at", "__task")


def number_rows(df: DataFrame, keys: list[str], order: list[str], cell: Column, out: str = "rn") -> DataFrame:
    """``row_number()`` per key, computed cell by cell."""
    return running_totals(df, keys, order, cell, {out: F.lit(1).cast("bigint")})


def day_cell(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


def with_halo(df: DataFrame, number: str, rows_per_chunk: int, halo: int) -> DataFrame:
    """Cut a numbered history into chunks of ``rows_per_chunk`` and repeat the last ``halo`` rows of each
    chunk at the head of the next one, so bounded ROWS frames can be taken per (key, chunk).

    Adds ``chunk`` and ``is_halo``. Only the halo is copied: halo / rows_per_chunk of the data.
    """
    if halo > rows_per_chunk:
        raise ValueError("a halo cannot be longer than a chunk")
    position = F.col(number) - 1
    home = F.floor(position / rows_per_chunk)
    in_tail = (position % rows_per_chunk) >= rows_per_chunk - halo
    homes = F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home))
    return (
        df.withColumn("chunk", F.explode(homes))
        .withColumn("is_halo", F.col("chunk") > home)
    )
