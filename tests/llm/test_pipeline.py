"""The pipeline, stage by stage, against plain restatements on what the stage before kept."""

from collections import defaultdict

import corpus_pipeline
from lumenwatch.llm.quality import STOP_WORDS

from . import plain

FOLDER = "/root/testdata/sf0.01"


def good(text):
    n, chars, symbols, dup, repeated, lines = plain.quality(text)
    spoken = {w for s in STOP_WORDS for w in (s, s.capitalize())}
    stops = sum(w in spoken for w in plain.words(text))
    return n >= 50 and 2 * repeated <= n and 2 <= chars / n <= 12 and symbols / n <= 0.1 and stops / n >= 0.02 and dup / lines <= 0.4


def test_every_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    want = {r.doc_id: r.text for r in rows if good(r.text)}
    kept = corpus_pipeline.good_documents(spark, docs, FOLDER).cache()
    assert kept.columns == columns and {r.doc_id: r.text for r in kept.collect()} == want

    order = sorted(want)
    of, _ = plain.groups([want[i] for i in order], 5, 80)
    first = {}
    for i, g in zip(order, of, strict=True):
        first.setdefault(g, i)
    want = {i: want[i] for i in first.values()}
    kept = corpus_pipeline.unlike_documents(spark, kept, FOLDER).cache()
    assert kept.columns == columns and {r.doc_id: r.text for r in kept.collect()} == want

    held = plain.windows([(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
    want = {i: t for i, t in want.items() if not plain.contamination(t, held)[1]}
    kept = corpus_pipeline.unseen_documents(spark, kept, FOLDER).cache()
    assert kept.columns == columns and {r.doc_id: r.text for r in kept.collect()} == want

    clean = corpus_pipeline.documents_without_secrets(spark, kept, FOLDER).cache()
    out = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and set(out) == set(want)
    marked = [i for i, r in out.items() if r.text != want[i]]
    assert marked and all("[SECRET]" in out[i].text for i in marked) and all(r.n_chars == len(r.text) for r in out.values())

    pieces = defaultdict(int)
    for r in corpus_pipeline.packed_sequences(spark, clean, FOLDER).collect():
        pieces[r.doc_id, r.doc_tokens] += r.length
    assert {k[0] for k in pieces} == set(want) and all(n == k[1] for k, n in pieces.items())


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER) if stage is not corpus_pipeline.packed_sequences else docs
    assert docs.collect() == [] and corpus_pipeline.packed_sequences(spark, docs, FOLDER).collect() == []


def test_nulls_repeats_and_long_texts_through_all_stages(spark):
    say = lambda seed, n: " ".join(f"{'the of and to in'.split()[(seed + i) % 5]} w{seed}x{i % 97}y{i}" for i in range(n))
    long = say(9, 40_000)
    rows = [(None, None), (1, None), (2, ""), (3, say(1, 60)), (3, say(1, 60)), (3, say(2, 60)), (4, say(1, 60)), (None, say(3, 60)), (None, say(3, 60)), (5, long), (6, "short")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, FOLDER)
        assert out.columns == docs.columns
    kept = sorted(((r.doc_id or 0, r.text[:12]) for r in out.collect()))
    # One row of the equal texts of ids 3 and 4; the other text of id 3; rows without an id stay.
    assert kept == sorted([(3, say(1, 60)[:12]), (3, say(2, 60)[:12]), (0, say(3, 60)[:12]), (0, say(3, 60)[:12]), (5, long[:12])])
    pieces = defaultdict(int)
    for r in corpus_pipeline.packed_sequences(spark, out, FOLDER).collect():
        pieces[r.doc_id, r.doc_tokens] += r.length
    assert {i for i, _ in pieces} == {None, 3, 5} and all(n % tokens == 0 for (_, tokens), n in pieces.items())
