import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumenwatch.llm import decontaminate

from . import plain


def test_against_plain_scan(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ü1", "It's", "X_y"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = say(14)
    items = [(i, say(12) + " " + shared) for i in range(6)] + [(6, "Tiny item"), (6, say(11)), (7, None), (None, say(10)), (8, "--"), (9, "w1")]
    docs = [(i, say(rng.randint(0, 60))) for i in range(30)] + [(30, None), (31, ""), (32, "a tiny-ITEM b"), (33, shared), (33, shared), (33, "other")]
    docs += [(40 + i, f"{say(5)} {t[1]}! {say(3)} {t[1]}") for i, t in enumerate(items) if t[1]] + [(60, "w1 " * 3000)]
    given = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS n_hit", "3 AS row_key")
    bench = spark.createDataFrame(items, "item_id long, text string")
    held = plain.windows(items)
    want = sorted((d, *plain.contamination(t, held)) for d, t in docs)
    out = decontaminate.contamination(given, bench).collect()
    assert sorted((r.doc_id, r.hits.n_words, r.hits.n_hit, r.hits["items"]) for r in out) == want
    kept = decontaminate.drop_contaminated(given, bench)
    assert kept.columns == given.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, n, _ in want if not n)
    big, decontaminate.BROADCAST_WINDOWS = decontaminate.BROADCAST_WINDOWS, 0
    try:
        assert sorted((r.doc_id, r.hits.n_words, r.hits.n_hit, r.hits["items"]) for r in decontaminate.contamination(given, bench).collect()) == want
    finally:
        decontaminate.BROADCAST_WINDOWS = big


def test_empty_tables_and_spans(spark):
    docs = spark.createDataFrame([(1, "One two three. Four five six seven eight nine ten eleven!")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    row = decontaminate.contamination(docs, bench).select("hits", decontaminate.remove_spans(docs.text, decontaminate.F.col("hits.spans")).alias("rest")).first()
    assert row.hits.n_hit == 10 and row.rest == "one"
    assert decontaminate.contamination(docs, bench.limit(0)).first().hits.n_hit == 0
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    assert hashlib.sha256(b"").hexdigest() == decontaminate.op6_decontamination(spark, "/root/testdata/sf0.001").where("n_hit = 0").first().items_sha256


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_many_lengths_by_broadcast_and_by_shuffle(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randint(0, 60)}" for _ in range(n))
    items = [(i, say(i % 14)) for i in range(60)] + [(100 + i, items_of) for i, items_of in enumerate(["shared passage of ten words that many items hold in common"] * 50)]
    texts = [say(rng.randint(0, 80)) for _ in range(40)] + [f"{say(3)} {t} {say(4)}" for _, t in items[8:60:5]] + ["Shared passage of TEN words that many items hold in common"] * 9 + [None, "", items[50][1] * 1, say(3000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'h' AS h", "1 AS length")
    bench = spark.createDataFrame(items, "item_id long, text string")
    held = plain.windows([(i, t) for i, t in items])
    got = {r.doc_id: (r.hits["n_words"], r.hits["n_hit"], sorted(r.hits["items"])) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {i: plain.contamination(t, held) for i, t in rows}
    hits = decontaminate.window_hits(docs, decontaminate.benchmark_windows(bench)[0], F.col("doc_id").cast("string"))
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # one scan for all lengths
