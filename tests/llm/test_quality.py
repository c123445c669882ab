import random

from lumenwatch.llm import quality
from lumenwatch.llm.common import fresh

from . import plain

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def texts():
    rng = random.Random(1)
    bits = ["the", "of", "a", "#", "x|y", "\n", "\n\n", " ", "  ", "\t", "\x0b", "é", "🙂", " ", "THE!!", "word"]
    return [None, "", " \n\t", "a", "a b a b a b", "x\nx\nx \nx", "the " * 3000, "w " + "é" * 9000] + [
        " ".join(rng.choice(bits) for _ in range(rng.randint(1, 120))) for _ in range(150)
    ]


def test_counts_of_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS counts", "3 AS windows")
    out = quality.measures(docs).collect()
    assert out and set(docs.columns) < set(out[0].asDict())
    for r in out:
        assert tuple(r.measures[n] for n in MEASURES) == plain.quality(rows[r.doc_id][1])[:5], repr(rows[r.doc_id][1])[:200]


def test_keep_good(spark):
    good = "\n".join(f"It was{i} line {i} of tale{i} and people{i} in it{i} went{i} to town{i} by{i} the road{i} {i * 7}." for i in range(8))
    rows = [(1, good), (1, good), (2, good.replace(" ", "### ")), (3, "same line of the text\n" * 30), (4, None), (5, "short text"), (6, good.upper() + "!!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS measures")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1]
    assert quality.keep_good(docs.limit(0)).collect() == []
    assert fresh(docs, "Measures") == "Measures_"
