"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
BLOCK = 64
HELD_BITS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet, whatever columns came with it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lowered(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def spaced_words(text: Column) -> Column:
    """Words between ASCII white space; an empty array for null or blank text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )


def row_key(id_column: Column, text: Column) -> Column:
    """Names a row by id and text. Rows that agree in both have equal results, so they may share a key."""
    return F.md5(F.concat_ws(":", F.coalesce(id_column.cast("string"), F.lit("none")), F.coalesce(text, F.lit(""))))


def held_bits(rows: DataFrame, column: str, bits: int = HELD_BITS) -> DataFrame:
    """One row, ``held``: a bitmap of the hashes of a column's values, 2**bits bits whatever the input's size."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    words = rows.select(F.floor(at / 64).cast("int").alias("word"), (at % 64).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("held")).toArrow()
    held = np.zeros(1 << bits - 6, np.int64)
    held[words["word"].to_numpy()] = words["held"].to_numpy()
    return rows.sparkSession.createDataFrame(pa.table({"held": pa.array([held], pa.list_(pa.int64()))}))


def may_hold(held: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """What a semi or anti join takes to keep or drop rows whose value may be among those of ``held_bits``: never one too few,
    and some too many as the bitmap fills. Rows are not shuffled."""
    words = F.col("held")
    at = F.pmod(F.xxhash64(column), F.size(words).cast("long") * 64)
    word = F.get(words, F.floor(at / 64).cast("int"))
    return F.broadcast(held), F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, though a lambda inside ``use`` reads it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def totals_before(lengths: Column) -> Column:
    """For each element of an integer array the sum of those before it.

    Sums are taken by blocks, so an array of n elements costs about n * 64 + (n / 64) ** 2 additions.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
        lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))),
    )

    def within(bases: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(lengths) - 1),
            lambda i: F.get(bases, F.floor(i / BLOCK).cast("int"))
            + total(F.slice(lengths, (i - i % BLOCK + 1).cast("int"), (i % BLOCK).cast("int"))),
        )

    sums = let(
        blocks,
        lambda sizes: let(
            F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda b: total(F.slice(sizes, F.lit(1), b - 1))), within
        ),
    )
    return F.when(F.size(lengths) > 0, sums).otherwise(F.array().cast("array<int>"))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)
