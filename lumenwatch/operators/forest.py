"""Isolation Forest per service with scheduled refits (W8-W12), after Liu, Ting and Zhou (2008).

The work is split over (service, epoch, tree block) for fitting and (service, epoch, row chunk) for
scoring, so every Python group is bounded: 256 sampled rows per tree, ``CHUNK_ROWS`` rows per scoring
group. Sampling draws row numbers first and joins only the drawn rows; no history is copied per tree.

Chance is counted, not kept: a draw is a fixed part of the MD5 of the seed, the service, its fit, the tree and the
draw's number or the node's. So a tree is the same wherever, whenever and in whatever company it is grown (batch or
stream, any cut into blocks, a task run again), and any engine with MD5 can restate it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenwatch.operators.percentiles import group_percentiles
from lumenwatch.session import settle

# The feature vector, in order, and the schedule.
VECTOR = (
    "error_rate",
    "critical_count",
    "latency_p50",
    "latency_p95",
    "latency_p99",
    "logs_per_second",
    "unique_traces",
)
FIRST_FIT = 50
REFIT_EVERY = 200
TREES = 100
SEED = 42
CONTAMINATION = 0.05

SAMPLE_ROWS = 256
#: Draws for a sample; the first 256 different ones count. From 450 rows, the fewest that are drawn from, fewer than 256 of 1024 draws
#: differ with a chance below 1e-40.
DRAWS = 1024
TREES_PER_BLOCK = 10
CHUNK_ROWS = 10_000
DRIVER_Z = 2.0
DRIVER_SCORE = 0.5
_EULER = 0.5772156649015329

MODEL_SCHEMA = (
    "service_name STRING, segment BIGINT, epoch BIGINT, tree INT, sample_size INT, feature ARRAY<INT>, "
    "threshold ARRAY<DOUBLE>, low ARRAY<INT>, high ARRAY<INT>, path ARRAY<DOUBLE>"
)
_KEY = ["service_name", "segment"]


# ---- schedule and scaling (W8, W9, W12) -------------------------------------------------------


def with_schedule(numbered: DataFrame) -> DataFrame:
    """Which fit scores a window: ``epoch`` and its ``train_end``; null while warming up.

    ``block`` is the first epoch whose training set holds the window.
    """
    epoch = F.floor((F.col("rn") - FIRST_FIT) / REFIT_EVERY)
    return (
        numbered.withColumn("epoch", F.when(F.col("rn") >= FIRST_FIT, epoch))
        .withColumn("train_end", FIRST_FIT + REFIT_EVERY * F.col("epoch"))
        .withColumn("block", F.greatest(F.ceil((F.col("rn") - FIRST_FIT) / REFIT_EVERY), F.lit(0)))
    )


def growing_moments(scheduled: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population std of a service's whole history up to and including each window.

    Moments run inside blocks of 200 windows and are merged with those of the earlier blocks. Adds
    ``c__mean`` and ``c__std`` per column.
    """
    prefix = "OVER (PARTITION BY service_name, segment ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND"
    blocks = scheduled.groupBy(*_KEY, "block").agg(
        F.expr("count(*) AS __n"),
        *[F.expr(f"avg({c}) AS __a_{c}") for c in columns],
        *[F.expr(f"var_pop({c}) * count({c}) AS __m_{c}") for c in columns],
    )
    # Deviations from the first block's mean keep the merged sums of squares small.
    blocks = blocks.selectExpr("*", *[f"first(__a_{c}) {prefix} CURRENT ROW) AS __r_{c}" for c in columns])
    before = f"{prefix} 1 PRECEDING)"
    earlier = [f"coalesce(sum(__n) {before}, 0L) AS __n0"]
    for c in columns:
        shift = f"(__a_{c} - __r_{c})"
        earlier += [
            f"__r_{c}",
            f"coalesce(sum(__n * {shift}) {before}, 0D) AS __s0_{c}",
            f"coalesce(sum(__m_{c} + __n * {shift} * {shift}) {before}, 0D) AS __q0_{c}",
        ]
    prior = blocks.selectExpr(*_KEY, "block", *earlier)

    inside = "OVER (PARTITION BY service_name, segment, block ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    local = scheduled.selectExpr(
        "*",
        f"count(*) {inside} AS __n1",
        *[f"avg({c}) {inside} AS __a1_{c}" for c in columns],
        *[f"var_pop({c}) {inside} AS __v1_{c}" for c in columns],
    )
    merged, out = [], []
    for c in columns:
        shift = f"(__a1_{c} - __r_{c})"
        merged += [
            f"(__s0_{c} + __n1 * {shift}) / (__n0 + __n1) AS __mean_{c}",
            f"(__q0_{c} + __n1 * (__v1_{c} + {shift} * {shift})) / (__n0 + __n1) AS __square_{c}",
        ]
        out += [
            f"__r_{c} + __mean_{c} AS {c}__mean",
            f"sqrt(greatest(__square_{c} - __mean_{c} * __mean_{c}, 0D)) AS {c}__std",
        ]
    joined = local.join(prior, [*_KEY, "block"])
    return joined.selectExpr("*", *merged).selectExpr(*scheduled.columns, *out)


def standardised(scheduled: DataFrame, columns: list[str] = list(VECTOR)) -> DataFrame:
    """The feature vector scaled by the mean and std of the training set of its epoch.

    A zero std counts as 1. Isolation trees split uniformly between the extremes of a feature and so are
    not changed by this scaling; fitting works on raw values, and this is for callers that want the vector.
    """
    moments = growing_moments(scheduled, columns).where(F.col("rn") == F.col("train_end"))
    scaler = moments.select(
        *_KEY, "epoch", *[f"{c}__mean" for c in columns], *[f"{c}__std" for c in columns]
    )
    joined = scheduled.where(F.col("epoch").isNotNull()).join(scaler, [*_KEY, "epoch"])
    return joined.select(
        *scheduled.columns,
        *[F.expr(f"({c} - {c}__mean) / if({c}__std < 1e-12D, 1D, {c}__std) AS {c}_scaled") for c in columns],
    )


def drivers(scheduled: DataFrame, columns: list[str] = list(VECTOR)) -> DataFrame:
    """Adds ``driver_candidates``: features more than 2 std from the history's mean."""
    far = ", ".join(f"if(abs(({c} - {c}__mean) / ({c}__std + 1e-9D)) > {DRIVER_Z}D, '{c}', NULL)" for c in columns)
    moments = growing_moments(scheduled, columns)
    return moments.selectExpr(*scheduled.columns, f"array_compact(array({far})) AS driver_candidates")


# ---- fitting (W10) -----------------------------------------------------------------------------


def due_epochs(scheduled: DataFrame) -> DataFrame:
    """Every fit a history has come to: (service, segment, epoch)."""
    last = scheduled.groupBy(*_KEY).agg(F.max("epoch").alias("last_epoch")).where(F.col("last_epoch").isNotNull())
    return last.select(*_KEY, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last_epoch"))).alias("epoch"))


def fit_forest(
    scheduled: DataFrame, epochs: DataFrame | None = None, trees: int = TREES, seed: int = SEED
) -> DataFrame:
    """One row per (service, segment, epoch, tree), for all due epochs or the given ones."""
    vectors = scheduled.select(*_KEY, "rn", _vector())
    plan = (
        (due_epochs(scheduled) if epochs is None else epochs)
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("tree_key", F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*_KEY, "epoch", "tree")]))
        .withColumn("rows", FIRST_FIT + REFIT_EVERY * F.col("epoch"))
    )
    drawn = plan.select(*_KEY, "epoch", "tree", "tree_key", F.explode(_drawn_rows(F.col("rows"), F.col("tree_key"))).alias("rn"))
    sampled = drawn.join(vectors, [*_KEY, "rn"]).withColumn("tree_block", F.floor(F.col("tree") / TREES_PER_BLOCK))
    return sampled.groupBy(*_KEY, "epoch", "tree_block").applyInPandas(_grow_block, MODEL_SCHEMA)


def _vector():
    return F.array(*[F.col(c).cast("double") for c in VECTOR]).alias("vector")


def _drawn_rows(rows: Column, tree_key: Column) -> Column:
    """Distinct row numbers 1..rows, at most 256 of them."""

    def draw(i: Column) -> Column:
        share = F.conv(F.substring(F.md5(F.concat_ws("|", tree_key, F.lit("draw"), i.cast("string"))), 1, 13), 16, 10).cast("double") / 2**52
        return (F.floor(share * rows) + 1).cast("bigint")

    some = F.slice(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(DRAWS)), draw)), 1, SAMPLE_ROWS)
    return F.when(rows <= SAMPLE_ROWS, F.sequence(F.lit(1).cast("bigint"), rows.cast("bigint"))).otherwise(some)


def _node_draws(tree_key: str, node: int) -> tuple[float, float]:
    """Two numbers below 1 for the split of a node: where to cut, and which feature."""
    text = hashlib.md5(f"{tree_key}|{node}".encode()).hexdigest()
    return int(text[:13], 16) / 2**52, int(text[16:29], 16) / 2**52


def _grow_block(sample: pd.DataFrame) -> pd.DataFrame:
    """Grow the trees of a block together, level by level."""
    sample = sample.sort_values(["tree", "rn"])
    head = sample.iloc[0]
    trees, first, root, sizes = np.unique(sample["tree"].to_numpy(), return_index=True, return_inverse=True, return_counts=True)
    grown = grow_trees(np.array(sample["vector"].tolist()), root, sample["tree_key"].iloc[first].tolist(), int(sizes.max()))
    rows = [(head.service_name, head.segment, head.epoch, tree, size, *parts) for tree, size, parts in zip(trees, sizes, grown)]
    return pd.DataFrame(rows, columns=[field.split()[0] for field in MODEL_SCHEMA.split(", ")])


def grow_trees(rows: np.ndarray, root: np.ndarray, tree_keys: list[str], sample_size: int) -> list[tuple]:
    """For each tree (feature, threshold, low, high, path) by node, the root first. ``root`` says whose sample a row is in."""
    nodes = _grow_nodes(rows, root, tree_keys, sample_size)
    # Nodes were numbered over all trees; number them within their tree.
    place = np.zeros(len(nodes["tree"]), dtype=int)
    members = [np.flatnonzero(nodes["tree"] == t) for t in range(len(tree_keys))]
    for member in members:
        place[member] = np.arange(len(member))
    return [(nodes["feature"][m], nodes["threshold"][m], place[nodes["low"][m]], place[nodes["high"][m]], nodes["path"][m]) for m in members]


def fit_history(history: np.ndarray, service: str, segment: int, epoch: int, trees: int = TREES, seed: int = SEED) -> list[tuple]:
    """The forest of one fit from the vectors it trains on, in order: that of ``fit_forest``, for a history at hand."""
    n = len(history)
    keys = [f"{seed}|{service}|{segment}|{epoch}|{t}" for t in range(trees)]
    drawn = [np.arange(n) if n <= SAMPLE_ROWS else _draw_history(n, key) for key in keys]
    root = np.repeat(np.arange(trees), [len(d) for d in drawn])
    return grow_trees(history[np.concatenate(drawn)], root, keys, len(drawn[0]))


def _draw_history(n: int, tree_key: str) -> np.ndarray:
    texts = (hashlib.md5(f"{tree_key}|draw|{i}".encode()).hexdigest() for i in range(1, DRAWS + 1))
    distinct = dict.fromkeys(int(int(t[:13], 16) / 2**52 * n) for t in texts)
    return np.sort(np.array(list(distinct)[:SAMPLE_ROWS]))


def _grow_nodes(rows: np.ndarray, node: np.ndarray, tree_keys: list[str], sample_size: int) -> dict:
    """Random splits until a row stands alone or the height limit is met; leaves carry a path length.

    A split is uniform between the extremes of one feature, drawn among those that vary in the node. For its draws a node is
    named by its place in a full binary tree: 1 at the root, 2 k and 2 k + 1 below k.
    """
    roots, limit = len(tree_keys), int(np.ceil(np.log2(max(sample_size, 2))))
    parts = {"tree": [np.arange(roots)], "feature": [], "threshold": [], "low": [], "high": [], "path": []}
    made, place = roots, np.ones(roots, dtype=int)
    for depth in range(limit + 1):
        first = made - len(parts["tree"][-1])
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        starts = np.flatnonzero(np.r_[True, np.diff(node) > 0])
        here, counts = node[starts] - first, np.diff(np.r_[starts, len(node)])
        lows, highs = np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts)
        varying = highs > lows
        splits = varying.any(axis=1) & (depth < limit)

        draws = np.zeros((len(here), 2))
        for k in np.flatnonzero(splits):
            draws[k] = _node_draws(tree_keys[parts["tree"][-1][here[k]]], int(place[here[k]]))
        wanted = np.floor(draws[:, 1] * varying.sum(axis=1)).astype(int) + 1
        pick = (varying.cumsum(axis=1) >= wanted[:, None]).argmax(axis=1)
        each = np.arange(len(here))
        low, high = lows[each, pick], highs[each, pick]
        cut = low + draws[:, 0] * (high - low)
        cut = np.where(cut < high, cut, low)
        child = made + 2 * (np.cumsum(splits) - 1)

        level = len(parts["tree"][-1])
        columns = {"feature": np.full(level, -1), "threshold": np.zeros(level), "low": np.zeros(level, int), "high": np.zeros(level, int), "path": np.zeros(level)}
        split_here = here[splits]
        columns["feature"][split_here], columns["threshold"][split_here] = pick[splits], cut[splits]
        columns["low"][split_here], columns["high"][split_here] = child[splits], child[splits] + 1
        columns["path"][here[~splits]] = depth + _average_path(counts[~splits])
        for name, column in columns.items():
            parts[name].append(column)
        if not splits.any():
            break

        group = np.repeat(each, counts)
        goes_on = splits[group]
        rows, group = rows[goes_on], group[goes_on]
        goes_high = rows[np.arange(len(rows)), pick[group]] > cut[group]
        node = child[group] + goes_high
        parts["tree"].append(np.repeat(parts["tree"][-1][split_here], 2))
        place = np.repeat(place[split_here] * 2, 2) + np.tile([0, 1], len(split_here))
        made += 2 * len(split_here)
    return {name: np.concatenate(column) for name, column in parts.items()}


def _average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    many = 2.0 * (np.log(np.maximum(n, 2) - 1.0) + _EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, many))


# ---- scoring (W11) -----------------------------------------------------------------------------


def forest_scores(scheduled: DataFrame, trees: int = TREES) -> DataFrame:
    """Adds ``forest_warming``, ``forest_score`` and ``forest_triggered`` to a scheduled history.

    Fits all due epochs, then scores each window under its own. Lands the model (one job).
    """
    model = settle(fit_forest(scheduled, trees=trees), "forest-model")
    return score_windows(scheduled, model, train_quantiles(scheduled, model))


def train_quantiles(scheduled: DataFrame, model: DataFrame, epochs: DataFrame | None = None) -> DataFrame:
    """The 95 % quantile of the training scores of each epoch: the zero of its scores.

    It is taken over the whole training set, as the schedule defines it, so the work grows with windows
    times epochs; ``epochs`` restricts it to new fits.
    """
    rows = scheduled.select(*_KEY, "rn", "block", _vector())
    if epochs is None:
        last = scheduled.groupBy(*_KEY).agg(F.max("epoch").alias("last_epoch"))
        pairs = rows.join(last, _KEY).where(F.col("block") <= F.col("last_epoch"))
        pairs = pairs.withColumn("epoch", F.explode(F.sequence("block", "last_epoch")))
    else:
        pairs = rows.join(epochs, _KEY).where(F.col("block") <= F.col("epoch"))
    scored = isolation_scores(pairs, model)
    return group_percentiles(scored, [*_KEY, "epoch"], "isolation", {"train_quantile": 1.0 - CONTAMINATION})


def score_windows(
    scheduled: DataFrame, model: DataFrame, quantiles: DataFrame, only: DataFrame | None = None
) -> DataFrame:
    """A score is twice the distance above the training quantile, clipped to 0..1.

    ``only(window_id)`` restricts the result to some windows of the history.
    """
    wanted = scheduled if only is None else scheduled.join(only, "window_id", "left_semi")
    own = wanted.where(F.col("epoch").isNotNull()).select(*_KEY, "epoch", "rn", _vector())
    scored = isolation_scores(own, model).join(quantiles, [*_KEY, "epoch"])
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * (F.col("isolation") - F.col("train_quantile"))))
    explained = drivers(scheduled)
    if only is not None:
        explained = explained.join(only, "window_id", "left_semi")
    joined = explained.join(scored.select(*_KEY, "rn", raw.alias("__raw")), [*_KEY, "rn"], "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *scheduled.columns,
        F.col("epoch").isNull().alias("forest_warming"),
        F.coalesce(F.round("__raw", 4), F.lit(0.0)).alias("forest_score"),
        F.when(F.col("__raw") > DRIVER_SCORE, F.col("driver_candidates")).otherwise(none).alias("forest_triggered"),
    )


def isolation_scores(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """Isolation score of each (window, epoch) pair: (service, segment, epoch, rn, vector)."""
    rows = pairs.select(*_KEY, "epoch", F.floor((F.col("rn") - 1) / CHUNK_ROWS).alias("chunk"), "rn", "vector")
    # A forest goes to every chunk that may hold rows it trained on or scores.
    last_row = FIRST_FIT + REFIT_EVERY * (F.col("epoch") + 1)
    per_chunk = model.withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((last_row - 1) / CHUNK_ROWS)))
    )
    key = [*_KEY, "epoch", "chunk"]
    return rows.groupBy(*key).cogroup(per_chunk.groupBy(*key)).applyInPandas(
        _isolate, "service_name STRING, segment BIGINT, epoch BIGINT, rn BIGINT, isolation DOUBLE"
    )


def _isolate(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    out = rows[["service_name", "segment", "epoch", "rn"]].astype({"service_name": object}).assign(isolation=np.nan)
    if rows.empty or trees.empty:
        return out.iloc[:0]
    parts = [tuple(np.asarray(tree[c]) for c in ("feature", "threshold", "low", "high", "path")) for tree in trees.to_dict("records")]
    out["isolation"] = isolation(np.array(rows["vector"].tolist()), parts, int(trees["sample_size"].iloc[0]))
    return out


def isolation(x: np.ndarray, trees: list[tuple], sample_size: int) -> np.ndarray:
    """Isolation scores of vectors under a forest."""
    every, depth = np.arange(len(x)), np.zeros(len(x))
    for feature, threshold, low, high, path in trees:
        node = np.zeros(len(x), dtype=int)
        while (feature[node] >= 0).any():
            f = feature[node]
            step = np.where(x[every, f] <= threshold[node], low[node], high[node])
            node = np.where(f >= 0, step, node)
        depth += path[node]
    return 2.0 ** (-depth / len(trees) / _average_path(sample_size))
