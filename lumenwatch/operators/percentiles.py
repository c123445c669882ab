"""Exact linear-interpolated percentiles per group without collecting a group.

``percentile()`` keeps every distinct value of a group in one buffer of one task. Here a bounded histogram
per group, folded on the map side, tells which bucket holds each wanted rank; only the values in those
buckets are then read again, folded and ordered. Rows of a group are never gathered, and apart from the
wanted buckets nothing but histogram partials is shuffled when the bucket list fits a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS_PER_OCTAVE = 32
_NO_VALUE = -(2**31)


def magnitude_bucket(value: str) -> str:
    """SQL for an integer that never decreases with the value: sign times position on a log2 scale.

    Doubles span about 2,100 octaves, so a group has a bounded number of buckets whatever its size.
    """
    octave = f"if(isnan({value}) OR abs({value}) = double('infinity'), 1100, log2(abs({value})))"
    size = f"CAST(floor(({octave} + 1100) * {BUCKETS_PER_OCTAVE}) AS INT)"
    return f"CASE WHEN {value} > 0 THEN {size} WHEN {value} < 0 THEN -{size} WHEN {value} = 0 THEN 0 ELSE {_NO_VALUE} END"


def group_percentiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    probabilities: dict[str, float],
    weight: str = "1L",
    totals: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per group: a column per entry of ``probabilities`` (name to fraction), then ``totals``.

    ``weight`` is how often a row counts (default once). ``totals`` maps a name to "sum", "min" or "max" and
    the expression to fold; they ride on the histogram pass and cost no pass of their own. Null values have
    no rank; a group of nulls keeps its totals and gets null percentiles. Expressions are SQL text.
    """
    totals = totals or {}
    by = ", ".join(keys)
    bucketed = rows.selectExpr(
        "*", f"{magnitude_bucket(value)} AS __b", f"if({value} IS NULL, 0L, {weight}) AS __w"
    )
    histogram = bucketed.groupBy(*keys, "__b").agg(
        F.expr("sum(__w) AS __bn"), *[F.expr(f"{kind}({e}) AS {n}") for n, (kind, e) in totals.items()]
    )
    ranked = histogram.selectExpr(
        *keys,
        "__b",
        "__bn",
        f"coalesce(sum(__bn) OVER (PARTITION BY {by} ORDER BY __b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS __below",
        f"sum(__bn) OVER (PARTITION BY {by}) AS __total",
        *[f"{kind}({n}) OVER (PARTITION BY {by}) AS {n}" for n, (kind, _) in totals.items()],
    )

    def rank(fraction: float) -> str:
        return f"((__total - 1) * double({float(fraction)}))"

    holds = [
        f"(floor({rank(p)}) < __below + __bn AND ceil({rank(p)}) >= __below)" for p in dict.fromkeys(probabilities.values())
    ]
    buckets = ranked.where(
        f"(__bn > 0 AND ({' OR '.join(holds)})) OR (__total = 0 AND __b = {_NO_VALUE})"
    ).drop("__bn")

    carried = ["__below", "__total", *totals]
    candidates = bucketed.selectExpr(*keys, "__b", f"{value} AS __v", "__w").join(buckets, [*keys, "__b"])
    distinct = candidates.groupBy(*keys, "__b", "__v").agg(
        F.expr("sum(__w) AS __n"), *[F.expr(f"max({c}) AS {c}") for c in carried]
    )
    placed = distinct.selectExpr(
        "*",
        f"__below + sum(__n) OVER (PARTITION BY {by}, __b ORDER BY __v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __upto",
    )

    def at(position: str, name: str):
        return F.expr(f"max(CASE WHEN {position} < __upto AND {position} >= __upto - __n THEN __v END) AS {name}")

    picks = []
    for name, p in probabilities.items():
        picks += [at(f"floor({rank(p)})", f"__lo_{name}"), at(f"ceil({rank(p)})", f"__hi_{name}")]
    picked = placed.groupBy(*keys).agg(*picks, *[F.expr(f"max({c}) AS {c}") for c in ["__total", *totals]])
    interpolated = [
        f"__lo_{n} + (__hi_{n} - __lo_{n}) * ({rank(p)} - floor({rank(p)})) AS {n}" for n, p in probabilities.items()
    ]
    return picked.selectExpr(*keys, *interpolated, *totals)
