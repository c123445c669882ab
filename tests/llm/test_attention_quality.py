"""Attention over passages: gradients, pooling against a plain restatement, held-out accuracy, odd rows."""

import numpy as np
import pytest

from lumenwatch.llm import attention_quality as aq
from lumenwatch.llm.shingles import Shingler

from . import plain


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = aq.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, firsts = rng.normal(0, 1, (9, aq.WIDTH)), np.array([1.0, 0.0, 1.0]), np.array([0, 4, 5])

    def loss():
        out = 0
        for k, bag in enumerate(np.split(x, firsts[1:])):
            h = net.encode(bag)
            a = np.exp(net.attention(h)[0])
            s = net.score((a / a.sum()) @ h)[0]
            out -= np.log(s if y[k] else 1 - s) / len(y)
        return out

    grad = net._gradients(x, y, firsts)
    for name, g in grad.items():
        for at in rng.integers(0, g.size, 5):
            p = net.p[name].reshape(-1)
            was, d = p[at], 1e-6
            p[at] = was + d
            up = loss()
            p[at] = was - d
            assert (up - loss()) / (2 * d) == pytest.approx(g.reshape(-1)[at], rel=1e-4, abs=1e-8)
            p[at] = was


def plain_bag(text):
    words = plain.words(text)
    return [words[i : i + aq.WORDS] for i in range(0, len(words), aq.WORDS)]


def test_passages_and_pooling(monkeypatch):
    texts = ["one two  two\tThree.", None, "", " \n ", "word " * 300, "A b c\nd e f! " * 70, "ünï çödé 12"]
    for group in (1 << 20, 40):
        monkeypatch.setattr(aq, "GROUP", group)
        got = [aq.describe(p, Shingler(1)) for p in aq._parts(texts)]
        count = np.bincount(np.concatenate([of for _, of in got]), minlength=len(texts))
        if group > 10**6:
            assert count.tolist() == [len(plain_bag(t)) for t in texts]
            x = got[0][0]
            assert x[0, -4:-1].tolist() == [0.75, 0.25, 0.25]  # distinct words, words that come back at once, capitals
        model = aq.Model(["good text here"] * 3 + ["BAD!!"] * 3, [1, 1, 1, 0, 0, 0])
        scores, counts, focus = model.scores(texts, Shingler(1))
        assert counts.tolist() == count.tolist() and ((0 <= focus) == (counts > 0)).all() and (focus < np.maximum(counts, 1)).all()
        for k, text in enumerate(texts):
            x = np.concatenate([a[of == k] for a, of in got])
            h = model.network.encode(x if len(x) else np.zeros((1, aq.WIDTH), np.float32))
            a = np.exp(model.network.attention(h)[0].astype(float))
            assert scores[k] == pytest.approx(model.network.score((a / a.sum()) @ h)[0], abs=1e-5)


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = aq.op11_attention_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert len(held) > 500 and np.mean([a == b for a, b in held]) >= 0.97
    assert np.mean([a == 0 for a, b in held if b == 0]) >= 0.9


def test_odd_rows(spark):
    texts = ["fine words in a row " * 20, "!!! ### $$$ " * 30]
    docs = spark.createDataFrame([(i, texts[i % 2]) for i in range(60)] + [(None, None), (100, ""), (100, " \n"), (101, texts[0] * 3000), (101, "x" * 3_000_000)], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS score", "2 AS id", "3 AS h")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (5, None), (100, 1)], "doc_id long, quality int")
    got = aq.score_quality(docs, aq.train(docs, labels)).collect()
    assert len(got) == 65 and {r.score >= 0.3 for r in got if r.doc_id in range(0, 60, 2)} == {True} and {r.score >= 0.3 for r in got if r.doc_id in range(1, 60, 2)} == {False}
    assert {r.n_passages for r in got if r.doc_id == 100} == {0}
    none = aq.train(docs, labels.limit(0))
    assert {r.score for r in aq.score_quality(docs, none).collect()} == {0.0}
    assert aq.score_quality(docs.limit(0), none).collect() == []
    assert aq.train(docs.limit(0), labels).network is None
