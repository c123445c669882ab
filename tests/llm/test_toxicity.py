"""Toxicity: accuracy on rows that training never saw."""

import random
import zlib

from lumenwatch.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = toxicity.op2_toxicity(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [r for r in rows if r.held_out]
    hit = sum(r.predicted == r.toxic for r in test) / len(test)
    caught = sum(r.predicted for r in test if r.toxic) / sum(r.toxic for r in test)
    false = sum(r.predicted for r in test if not r.toxic)
    print("held out", len(test), "accuracy", hit, "caught", caught, "false", false)
    assert hit >= 0.97 and caught >= 0.85 and false <= 0.01 * len(test)


def test_long_words_nulls_and_few_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "x" * 100_000), (None, "a b")], "doc_id long, text string").selectExpr("*", "1 AS score")
    labels = spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert sorted(r.score for r in toxicity.score_texts(docs, model).collect()) == [0.0] * 4
    few = toxicity.Model(["you idiot fool"] * 4, ["fine words here"] * 4)
    assert all(0 <= r.score <= 1 for r in toxicity.score_texts(docs, few).collect())
    assert toxicity.score_texts(docs.limit(0), few).collect() == []
    assert b"".join(toxicity.word_windows("x" * 1000)) == b"x" * 1000


def test_gains_count_at_any_cost():
    words = "idiot moron stupid trash pathetic loser disgusting hate worthless garbage".split()
    content = b"".join(toxicity.START + w.encode() + toxicity.STOP for w in words)
    usual = b"".join(toxicity.START + w + toxicity.STOP for w in b"some plain words of a story about the house and the garden".split())
    lengths = toxicity.Lengths(content, usual)
    for glued in (b"pathetically", b"stupidity", b"idiot/moron", b"youidiot"):
        gain, cost = divmod(lengths[glued], toxicity.COSTS)
        assert gain >= 3 and cost == toxicity.COSTS - 1
    assert lengths.features("youidiot")[3 * toxicity.MOST] > 0


def test_rare_words_and_phrases_of_common_words():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["go", "back", "home", "now"]
    say = lambda: rng.choices(words, k=30)
    rare = ["".join(rng.choices("bcdfghjkmpqvxz", k=7)) for _ in range(60)]
    with_words = [" ".join([*say(), rare[i % 60]]) for i in range(1600)]
    with_phrases = [" ".join([*say(), "go", "back", "home", *say()]) for _ in range(1600)]
    ordinary = [" ".join(say()) for _ in range(3000)]
    for toxic, part in ((with_words[:1500] + ordinary[:1500], rare), (with_phrases[:1500], ["go back", "back home"])):
        content, _ = toxicity._dictionaries(toxic, ordinary)
        assert all(toxicity.START + w.encode() + toxicity.STOP in content for w in part)
    score = toxicity.Model(with_words[:1500], ordinary[:1500]).scorer()
    assert sum(score(t) >= 0.5 for t in with_words[1500:]) >= 95 and sum(score(t) >= 0.5 for t in ordinary[1500:1600]) <= 5
    score = toxicity.Model(with_phrases[:1500], ordinary[:1500]).scorer()
    assert sum(score(t) >= 0.5 for t in with_phrases[1500:]) >= 95 and sum(score(t) >= 0.5 for t in ordinary[1500:1600]) <= 5


def test_sample_of_repeated_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "Model", lambda toxic, ordinary: (sorted(toxic), sorted(ordinary)))
    ids = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 5][:40]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    rows = [(i, f"text {i}") for i in ids]
    docs = spark.createDataFrame(rows + [r for r in rows for _ in range(60 if r[0] in ids[1:8:2] else 0)], "doc_id long, text string")
    toxic, ordinary = ([f"text {i}" for i in ids[k::2]] for k in (1, 0))
    assert toxicity.train(docs, labels, sample=20) == (sorted(toxic), sorted(ordinary))
    first = labels.where("toxic = 1").selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").first().doc_id
    long = docs.selectExpr("doc_id", f"CASE WHEN doc_id = {first} THEN repeat('x', 5000) ELSE text END AS text")
    assert toxicity.train(long, labels, sample=20, sample_bytes=4000) == (sorted(set(toxic) - {f"text {first}"}), sorted(ordinary))
