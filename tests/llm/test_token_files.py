"""Token files against encoding whole texts with the tokenizers library."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenwatch.llm import token_files
from lumenwatch.llm.tokens import Encoder
from lumenwatch.session import scratch_path

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

ODD = [
    "", " ", "  ", "a  b", "a \n b", "\n\n  x", "don't  we'll 've", "tab\t space \t x", "x  y　 z", "\x1c a\x1c b",
    "ends with blank ", "é ñ 日本 語", "a" * 5000, "12 345  6,7.", " lead", "a  b", "🙂 🙂",
]


def whole(texts, end):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def test_pieces_give_the_ids_of_whole_texts():
    got = [[*np.frombuffer(b, "<u4").tolist(), 0] for b in Encoder().encode([*ODD, None])]
    assert got == whole([*ODD, None], 0)


def test_query_matches_whole_encoding(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    start, want = 0, set()
    for row, ids in zip(docs, whole([r.text for r in docs], 0), strict=True):
        want.add((row.doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in token_files.op8_token_files(spark, folder).collect()} == want


def test_nulls_ties_and_clashing_names(spark):
    rows = [(None, "x y"), (2, None), (2, "b"), (2, "a"), (2, "a"), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("p")).withColumn("first", F.lit(1))
    got = token_files.read_token_files(token_files.write_token_files(docs, scratch_path(spark, "t")), rows=2).collect()
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 2, 2]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    assert sorted(r.n_tokens for r in got) == sorted(len(i) for i in whole([t for _, t in rows], 0))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    parts = token_files.write_token_files(docs, scratch_path(spark, "t"))
    assert token_files.read_token_files(parts).collect() == []


def test_pieces_of_marks_and_line_feeds():
    import random

    rng = random.Random(4)
    bits = ["a", "Wort", "é", "日", "7", " ", "  ", "\n", ".", ",", "'s", "'", "!?", "\t", " ", "🙂", "…", "́", "<|endoftext|>", "\r", "\x1c", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    got = [[*np.frombuffer(b, "<u4").tolist(), 0] for b in Encoder().encode(texts)]
    for text, a, b in zip(texts, got, whole(texts, 0), strict=True):
        assert a == b, repr(text)
