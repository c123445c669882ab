"""Components against union-find, on chains, stars and random graphs."""

import random

import pytest

from lumenwatch.llm.components import components


def restated(edges):
    up = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            up[find(a)] = find(b)
    return {i: find(i) for i in up}


def same_parts(got, want):
    """Both maps name the same groups, whatever the names; names are members."""
    pairs = {(got[i], want[i]) for i in want}
    return got.keys() == want.keys() and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and all(got[got[i]] == got[i] for i in got)


def check(spark, edges):
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert same_parts(got, restated(edges))


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_parts_are_those_of_union_find(spark, shape):
    rng, n = random.Random(4), 10_000
    if shape == "chain":
        edges = [(i, i + 1) for i in range(n)]
    elif shape == "star":
        edges = [(0, i) for i in range(1, n)] + [(n + 1, n + 2), (n + 2, n + 2)]
    else:
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)] + [(5, 5), (1, 2), (2, 1), (1, 2)]
    check(spark, edges)


def test_no_edge(spark):
    none = spark.createDataFrame([(1, 1)], "a long, b long")
    assert components(none).collect() == [] and components(none.limit(0)).collect() == []
    assert components(none).columns == ["node", "label"]
