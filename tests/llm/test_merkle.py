"""Merkle manifest against a plain restatement: leaves, roots, proofs and tampered rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumenwatch.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Levels from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        low = i - i % 3
        out.append(("".join(level[low:i]), "".join(level[i + 1 : low + 3])))
        i //= 3
    return out


def restated(rows):
    """(leaf, subroot, root, steps) of each row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([k[2] for k in sorted(groups[s], key=lambda k: k[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for i, k in enumerate(sorted(groups[s], key=lambda k: k[:3])):
            out.append((k[3], k[2], trees[s][-1][0], top[-1][0], path(trees[s], i) + path(top, place)))
    return out


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in df.collect())


def want(rows):
    return sorted((r[0] if r[0] is not None else -1, *rest) for r, *rest in restated(rows))


def corpus(sizes):
    rng, out = random.Random(3), []
    for source, n in sizes.items():
        for _ in range(n):
            doc = rng.randint(0, 10**9)
            out.append((doc, source, rng.choice(["en", None, "de"]), rng.choice([None, 5, -1]), rng.choice([None, "", "ü\n€", f"line\n{doc}"])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", ["one", "several"])
def test_manifest_is_that_of_the_plain_tree(spark, block):
    sizes = {"hot": 800, "b": 244, "c": 243, "ä": 1, None: 28} if block == "several" else {f"s{i}": i % 11 + 1 for i in range(30)}
    rows = corpus(sizes)
    rows += rows[:7] + [(None, "hot", "en", 1, "no id"), (None, "b", "en", 1, "x"), (5, "hot", None, None, None), (5, "hot", None, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "'t' AS total", "2 AS block", "3 AS g", "4 AS steps")
    assert got(merkle.manifest(docs)) == want(rows)


def test_one_row_and_no_row(spark):
    one = [(7, "only", "en", 3, "abc")]
    docs = spark.createDataFrame(one, SCHEMA)
    (row,) = merkle.manifest(docs).collect()
    assert row.root == row.subroot == row.leaf == leaf(one[0]) and row.steps == []
    assert merkle.manifest(docs.limit(0)).collect() == []


def test_tampering_shows(spark):
    rows = corpus({"a": 20, "b": 300})
    docs = spark.createDataFrame(rows, SCHEMA)
    out = merkle.manifest(docs, changed={"text": F.translate("text", "\n", "")})
    out = out.select("leaf", "changed_leaf", "root", merkle.folded(F.col("changed_leaf"), F.col("steps")).alias("folded"), merkle.proof_digest(F.col("steps")).alias("proof"), "steps")
    for r in out.collect():
        assert (r.folded == r.root) == (r.leaf == r.changed_leaf)
        assert r.proof == digest("".join(a + b for a, b in r.steps))


def test_long_text(spark):
    rows = [(1, "a", "en", 9, "word\n" * 400_000), (2, "a", "en", 1, "x")]
    assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == want(rows)
