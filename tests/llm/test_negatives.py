"""Hard negatives against all pairs, with ties, repeats and odd vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenwatch.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def sound(row):
    vec_id, label, v = row
    return None not in (vec_id, label, v) and all(x is not None and math.isfinite(x) for x in v)


def restated(rows, k=5, m=10):
    good = [(i, d, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (d, label, v) in enumerate(filter(sound, rows))]
    out = []
    for i, d, label, v in good:
        if d % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), e, j, other) for j, e, other, w in good if j != i and len(w) == len(v)]
        for s, e, j, _ in sorted(x for x in scored if x[3] == label)[:k]:
            fit = sorted(x for x in scored if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:m]
            out += [(d, e, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


def corpus(seed, n=700, dim=6, labels=3, coarse=False):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = []
    for i in range(n):
        c, long = rng.choice(centres), rng.choice([0.2, 1, 3])
        v = [long * (x + rng.gauss(0, 0.4)) for x in c]
        rows.append((i * 5, rng.randrange(labels), [round(x) / 4 for x in v] if coarse else v))
    return rows


@pytest.mark.parametrize("coarse, chunk, block", [(False, 8192, 2048), (False, 100, 7), (True, 64, 16)])
def test_negatives_are_those_of_all_pairs(spark, coarse, chunk, block):
    rows = corpus(chunk, coarse=coarse)
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "'x' AS id", "2 AS v", "0 AS block")
    got = negatives.mine_negatives(docs, F.col("id") % 100 == 0, chunk=chunk, block=block).collect()
    assert sorted(map(tuple, got)) == restated(rows)


def test_odd_rows(spark):
    rows = corpus(5, 300) + [
        (None, 1, [1.0] * 6), (100, None, [1.0] * 6), (200, 1, None), (300, 1, [1.0, None] * 3), (400, 2, [float("nan")] * 6),
        (500, 0, [float("inf")] * 6), (600, 0, []), (700, 1, []), (601, 0, []), (800, 1, [1.0, 2.0]), (801, 1, [2.0, 2.0]), (802, 2, [1.0, 1.5]), (900, 0, [0.0] * 6), (5, 1, [0.0] * 6),
    ]
    got = negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0, chunk=90, block=4).collect()
    assert sorted(map(tuple, got)) == restated(rows)
    assert (800, 801) in {(r.anchor_id, r.positive_id) for r in got} and (600, 601) in {(r.anchor_id, r.positive_id) for r in got}


def test_repeated_rows_and_no_row(spark):
    rows = [(0, 1, [1.0, 0.5])] * 3 + [(1, 1, [1.0, 0.5])] * 8 + [(2, 2, [0.6, 0.1])] * 30
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, negatives.mine_negatives(docs, F.col("id") % 100 == 0).collect()))
    assert got == restated(rows) and len(got) == 3 * 5 * 10
    assert negatives.mine_negatives(docs.limit(0), F.col("id") % 100 == 0).collect() == []


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i * 50, i % 2, [rng.uniform(-2e5, 2e5) for _ in range(9)]) for i in range(60)]
    got = negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == restated(rows)


def test_walks_end_early():
    rng = np.random.default_rng(0)
    base = np.eye(8)[:4] * 100
    candidates = np.concatenate([np.round(b + rng.normal(0, 2, (2000, 8))) for b in base])
    anchors = np.round(base[:1] + rng.normal(0, 2, (5, 8)))
    n = len(candidates)
    walks = [negatives.PositiveWalk({"row": -1, "label": 0}, 5) for _ in anchors]
    scored = negatives.walk_cluster(anchors, walks, candidates, np.arange(n), np.arange(n), np.zeros(n))
    assert scored < 0.5 * n * len(anchors)
    for u, walk in zip(anchors, walks):
        assert walk.lists[0].scores.tolist() == sorted((candidates @ u).tolist())[::-1][:5]
