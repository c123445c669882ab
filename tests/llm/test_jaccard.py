import random

import numpy as np
import pyarrow as pa
import pytest

from lumenwatch.llm import jaccard
from lumenwatch.llm.common import held_bits, may_hold
from lumenwatch.llm.shingles import bitmap, signature_bits

from . import plain


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: [f"v{rng.randint(0, 400)}" for _ in range(n)]
    passage, out = say(40), []
    for _ in range(25):
        base = say(rng.randint(3, 160))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9999)}"
            out.append(copy)
    base = say(120)
    for _ in range(60):  # a large group, each a few words from its source and further from each other
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(120)] = f"h{rng.randint(0, 9999)}"
        out.append(copy)
    out += [passage + say(rng.randint(2, 30)) for _ in range(25)]
    texts = [" ".join(w) for w in out] + [None, "", " \n", "One", "one", "one two", "ONE\tTWO", "one two three"] + ["exact copy of this text"] * 9
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, percent, cell", [(3, 90, 1024), (3, 90, 8), (5, 80, 16)])
def test_groups_are_those_of_all_pairs(spark, width, percent, cell):
    rows = corpus(width * 1000 + cell)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'k' AS keys", "2 AS n")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(docs, width, percent, cell=cell, sketch_bits=12).collect()}
    of, sizes = plain.groups([t for _, t in rows], width, percent)
    least = {}
    for (doc, _), g in zip(rows, of, strict=True):
        least[g] = min(doc, least.get(g, doc))
    assert got == {doc: (n, least[g]) for (doc, _), g, n in zip(rows, of, sizes, strict=True)}


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d"), (None, "x y z w"), (3, "a b c d"), (3, "other words here now"), (3, "a b c d"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.near_groups(docs, 3, 90).collect())
    assert got == [(0, 0), (0, 3), (3, 3), (3, 3), (3, 3), (4, 4)]
    assert jaccard.near_groups(docs.limit(0), 3, 90).collect() == []
    assert jaccard.one_of_each(docs).columns == docs.columns


def test_one_row_of_each_group_stays(spark):
    a, near, b, c = ([f"{x}{i}" for i in range(40)] for x in "axbc")
    near = [*a[:39], "other"]
    a, near, b, c = map(" ".join, (a, near, b, c))
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (7, c), (8, c), (None, c), (None, c), (9, None), (9, None), (1, near), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS row_key")
    got = [(r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()]
    ones = [r for r in got if r[0] == 1]
    assert len(ones) == 1 and ones[0][1] in (a, near)
    rest = sorted((r for r in got if r[0] != 1), key=str)
    assert rest == sorted([(5, b), (7, c), (None, c), (None, c), (9, None), (9, None), (10, "")], key=str)


def test_tiles_are_worked_on_together(spark):
    """Cells of two, a few and many classes in one call; what the edges connect is what the pairs one by one connect."""
    rng, rows, wanted, held = np.random.default_rng(5), [], [], {}
    for key in range(400):
        m = [2, 2, 3, 7, 60][key % 5]
        nodes = rng.choice(900, m, replace=False)
        for node in nodes.tolist():
            if node not in held:
                n = int(rng.integers(40, 300)) if node % 3 else 128 + node % 7
                like = np.random.default_rng(1 if node % 3 == 0 else node)
                s = np.unique(like.integers(0, 2**63, 400).astype(np.uint64)[:n])
                held[node] = (len(s), bitmap(s, signature_bits(len(s))))
            low, own, probe = rng.random(3) < 0.8
            rows.append((key % 9, key // 9, 0, 0, node, node // 2, held[node][0], bool(low), bool(own), bool(probe), held[node][1].tobytes()))
        tile = sorted(rows[-m:], key=lambda r: r[6])
        for x, a in enumerate(tile):
            for b in tile[x + 1 :]:
                if a[5] != b[5] and a[7] and (a[8] or b[8]) and (a[9] or b[9]) and b[6] * 80 <= a[6] * 100:
                    least = min(len(held[a[4]][1]), len(held[b[4]][1])) * 64
                    left, right = (np.bitwise_or.reduce(held[r[4]][1].reshape(-1, least // 64), axis=0) for r in (a, b))
                    if np.bitwise_count(left ^ right).sum(dtype=np.int64) * 180 <= 20 * (a[6] + b[6]):
                        wanted.append((a[5], b[5], a[6] == b[6]))
    names = ("key", "band", "i", "j", "node", "label", "n", "low", "own", "probe", "bits")
    random.Random(1).shuffle(rows)
    found = jaccard._tiles(80)(pa.table(dict(zip(names, map(list, zip(*rows))))))

    def parts(edges):
        forest = jaccard.Forest(500)
        for a, b in edges:
            forest.join(a, b)
        return [forest.find(i) for i in range(500)]

    sure = [(a, b) for a, b, tie in wanted if not tie]  # of equal sizes either may come first
    got = [(a // 2, b // 2) for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist())]
    assert len(got) == len({*parts([])}) - len({*parts(got)}) > 50  # a forest
    assert parts(got + sure) == parts(got)


def test_rows_that_are_not_wanted_are_left_out_without_a_shuffle(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(2000)] + [(None, "null")], "id long, text string")
    wanted = spark.createDataFrame([(5,), (None,), (1999,), (70_000,)], "id long")
    held = held_bits(wanted, "id")
    some = [r.id for r in rows.join(*may_hold(held, "id"), "left_semi").collect()]
    rest = [r.id for r in rows.join(*may_hold(held, "id"), "left_anti").collect()]
    assert {5, None, 1999} <= {*some} and len(some) < 20 and len(some) + len(rest) == 2001
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n")], "doc_id long, text string")
    kept = jaccard.one_of_each(docs)
    assert "LeftAnti" in (plan := kept._jdf.queryExecution().optimizedPlan().toString()) and "Union" in plan
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
