"""Vector bin packing of documents into training sequences.

A sequence has three capacities: tokens, segments (pieces of documents) and loss-bearing tokens. A task packs the
documents of its own partition, with no shuffle: whole sequences are cut from the front of a long document, and the rests wait
in a pool. An open sequence takes, again and again, the piece that fits and has the largest dot product of its demands
with the capacities still free, both as shares of the whole; when nothing fits whole, the longest piece is cut
to fill the sequence. A sequence that a limit or the end of the partition leaves short gives back tokens down to a
power of two, where no padding is due. The pool holds a bounded number of rests, each shorter than a sequence.

Loss-bearing tokens are the last ``loss`` ids of a document (all of them without such a column); the first id of a
piece bears none, as nothing before it in its sequence predicts it.

Defined cases: null text is an empty document, which is its end id alone; repeated rows are packed each; a null
``doc_id`` stays null; an empty table gives no pieces. Sequence ids are unique: the partition's number times 2**40 plus
the number within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.llm.common import table
from lumenwatch.llm.tokens import encoder

END_ID = 1
POOL = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Limits(NamedTuple):
    tokens: int = 2048
    segments: int = 256
    loss: int = 2047


class Piece(NamedTuple):
    doc: int | None
    start: int
    ids: np.ndarray
    whole: int  # tokens of the document
    quiet: int  # leading tokens of the document that bear no loss

    def loss(self, n: int) -> int:
        """Loss-bearing ids among the first n: from the document's loss on, but never the piece's first."""
        return max(0, n - max(1, self.quiet - self.start))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:n]), self._replace(start=self.start + n, ids=self.ids[n:])

    def room(self, tokens: int, loss: int) -> int:
        """The most leading ids that fit both limits."""
        return min(tokens, len(self.ids), loss + max(1, self.quiet - self.start))


class Packer:
    """Packs the pieces of one partition; ``sequences`` yields lists of pieces."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.pieces: list[Piece | None] = []
        self.size = np.zeros(0, np.int64)
        self.loss = np.zeros(0, np.int64)

    def add(self, piece: Piece) -> None:
        if len(self.pieces) == len(self.size):
            more = max(64, len(self.size))
            self.size, self.loss = (np.concatenate([a, np.zeros(more, np.int64)]) for a in (self.size, self.loss))
        self.size[len(self.pieces)], self.loss[len(self.pieces)] = len(piece.ids), piece.loss(len(piece.ids))
        self.pieces.append(piece)

    def take(self, at: int) -> Piece:
        """Remove a piece; the last one fills its place."""
        piece, last = self.pieces[at], len(self.pieces) - 1
        self.pieces[at], self.size[at], self.loss[at] = self.pieces[last], self.size[last], self.loss[last]
        self.pieces.pop()
        return piece

    def sequence(self) -> list[Piece]:
        """The next sequence from the pool, which must not be empty."""
        limits = self.limits
        tokens, segments, loss, out = limits.tokens, limits.segments, limits.loss, []
        while self.pieces and tokens and segments:
            n = len(self.pieces)
            size, bears = self.size[:n], self.loss[:n]
            gain = size * (tokens / limits.tokens**2) + bears * (loss / max(1, limits.loss) ** 2) + segments / limits.segments**2
            gain = np.where((size <= tokens) & (bears <= loss), gain, -1.0)
            best = int(np.argmax(gain))
            if gain[best] < 0:
                best = int(np.argmax(size))
                most = self.pieces[best].room(tokens, loss)
                if most < 1:
                    break
                piece, rest = self.take(best).cut(most)
                self.add(rest)
            else:
                piece = self.take(best)
            out.append(piece)
            tokens, segments, loss = tokens - len(piece.ids), segments - 1, loss - piece.loss(len(piece.ids))
        filled = limits.tokens - tokens
        over = filled - (filled if filled == limits.tokens else 1 << (filled.bit_length() - 1))
        while over:  # give back what stands beyond a power of two
            piece = out.pop()
            if len(piece.ids) > over:
                kept, rest = piece.cut(len(piece.ids) - over)
                out.append(kept)
                self.add(rest)
                over = 0
            else:
                over -= len(piece.ids)
                self.add(piece)
        return out


def sequences(documents: Iterator[Piece], limits: Limits = Limits(), pool: int = POOL) -> Iterator[list[Piece]]:
    packer = Packer(limits)
    for piece in documents:
        while len(piece.ids) >= limits.tokens and piece.loss(limits.tokens) <= limits.loss:
            full, piece = piece.cut(limits.tokens)
            yield [full]
        if len(piece.ids):
            packer.add(piece)
        while len(packer.pieces) >= pool:
            yield packer.sequence()
    while packer.pieces:
        yield packer.sequence()


def pack(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", loss: str | None = None, limits: Limits = Limits(),
    end_id: int = END_ID, pool: int = POOL, vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """One row for each piece; ``with_ids`` adds the ids themselves as little-endian unsigned 32-bit bytes."""
    names = [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, base = encoder(vocabulary).encode, TaskContext.get().partitionId() << 40

        def documents() -> Iterator[Piece]:
            for batch in batches:
                keys, texts, bears = (batch.column(i).to_pylist() for i in range(3))
                for key, raw, n in zip(keys, encode(texts), bears, strict=True):
                    ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id))
                    yield Piece(key, 0, ids, len(ids), 0 if n is None else max(0, len(ids) - n))

        rows: list[tuple] = []
        for number, pieces in enumerate(sequences(documents(), limits, pool)):
            offset = 0
            for p in pieces:
                raw = p.ids.astype("<u4").tobytes()
                rows.append((p.doc, p.start, len(p.ids), zlib.crc32(raw), p.whole, base + number, offset, *([raw] * with_ids)))
                offset += len(p.ids)
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema)

    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])
    bears = F.lit(None).cast("long") if loss is None else F.col(loss).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), bears.alias("loss"))
    return rows.mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
