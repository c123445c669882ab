"""Packing: every id in one piece, limits kept, nothing padded."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenwatch.llm import packing
from lumenwatch.llm.packing import Limits, Piece

public_tokenizers = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 90), st.integers(0, 90)), max_size=40),
    st.sampled_from([Limits(32, 4, 31), Limits(32, 2, 9), Limits(16, 16, 3), Limits(8, 1, 7)]),
    st.integers(1, 12),
)
def test_limits_and_cover(docs, limits, pool):
    pieces = [Piece(i, 0, np.arange(n, dtype=np.uint32), n, max(0, n - bears)) for i, (n, bears) in enumerate(docs)]
    seen = defaultdict(list)
    for sequence in packing.sequences(iter(pieces), limits, pool):
        total = sum(len(p.ids) for p in sequence)
        assert 0 < total <= limits.tokens and total & (total - 1) == 0
        assert len(sequence) <= limits.segments
        assert sum(p.loss(len(p.ids)) for p in sequence) <= limits.loss
        for p in sequence:
            seen[p.doc].extend(p.ids.tolist())
            assert p.ids[0] == p.start
    assert {k: sorted(v) for k, v in seen.items()} == {i: list(range(n)) for i, (n, _) in enumerate(docs)}


def test_query_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.op5_packing(spark, folder).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids, at = [*t.encode(row.text or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(by_doc.pop(row.doc_id), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None), (1, ""), (1, "x"), (1, "x"), (2, "word " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS start", "1 AS loss")
    got = packing.pack(docs, with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got if r.start == 0) == [(0, 1), (1, 1), (1, 2), (1, 2), (2, 9002)]
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert packing.pack(docs.limit(0)).collect() == []
