"""Encoding whole texts with a public byte-level vocabulary, a batch at a time."""

from __future__ import annotations

import os
import re
import struct
import sys
import types
from collections.abc import Iterable, Iterator

#: Pieces whose ids a worker remembers, half of them from the time before the last turn-over.
REMEMBERED = 1_600_000
_STORE = "_lumenwatch_encoders"
_LONE_BLANK = re.compile(r"(?<=\S)(?= )")
_BLANK_AFTER_SPACE = re.compile(r"\s ")
#: Letters before this one are letters in every version of the character tables.
FIRST_OTHER_SCRIPT = "\u0250"


def _shown() -> dict[int, int]:
    """The letter by which a byte-level vocabulary shows each byte: printable ones show themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: 256 + k for k, b in enumerate(others)}


_SHOWN = _shown()


def encoder(vocabulary: str | None = None) -> Encoder:
    """The encoder of this worker process, which later tasks of the process find again with what it remembers."""
    held = sys.modules.setdefault(_STORE, types.ModuleType(_STORE)).__dict__
    if ("encoder", vocabulary) not in held:
        held["encoder", vocabulary] = Encoder(vocabulary)
    return held["encoder", vocabulary]


class Pieces(dict):
    """Ids of pieces of text as little-endian unsigned 32-bit bytes, worked out when first asked for.

    A key stands for itself, or for a blank and itself where ``blank`` is set.
    """

    def __init__(self, tokenizer, bare: Pieces | None = None):
        super().__init__()
        self._tokenizer, self._older = tokenizer, {}
        self._most = REMEMBERED // 10 if bare is None else REMEMBERED * 4 // 10  # before a turn-over; most pieces follow a blank
        self._bare, self._before = (self, "") if bare is None else (bare, " ")
        self._blank = self._before.translate(_SHOWN)

    def __missing__(self, piece: str) -> bytes:
        ids = self._older.pop(piece, None)
        if ids is None:
            ids = self._ids(piece)
        if len(self) >= self._most:
            self._older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def _ids(self, piece: str) -> bytes:
        if piece.isalpha() and (piece.isascii() or max(piece) < FIRST_OTHER_SCRIPT):
            # The splitting rule leaves a word whole: only its merges are due.
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
            ids = [t.id for t in self._tokenizer.model.tokenize(self._blank + shown)]
            return struct.pack(f"<{len(ids)}I", *ids)
        # It ends a token between a letter and a mark, and around a single line feed between visible characters.
        head, tail = piece[:-1], piece[-1:]
        if tail in ".,;:!?" and head[-1:].isalpha():
            return self[head] + self._bare[tail]
        head, feed, tail = piece.partition("\n")
        if feed and head.lstrip(" ") and tail and not head[-1].isspace() and not tail[0].isspace():
            return self[head] + self._bare[feed] + self._bare[tail]
        ids = self._tokenizer.encode(self._before + piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary's own splitting rule never lets a token reach from a visible character over a following blank, so a
    text is cut there and each distinct piece is encoded by the tokenizers library once; the pieces' ids joined are
    the text's ids. The tests compare that with encoding whole texts.
    """

    def __init__(self, vocabulary: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        self._pieces = Pieces(tokenizer)
        self._words = Pieces(tokenizer, self._pieces)  # each after a blank

    def _of(self, text: str) -> bytes:
        if _BLANK_AFTER_SPACE.search(text):
            return b"".join(map(self._pieces.__getitem__, _LONE_BLANK.split(text)))
        first, *rest = text.split(" ")
        return self._pieces[first] + b"".join(map(self._words.__getitem__, rest))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn; a null text is an empty one."""
        for text in texts:
            yield self._of(text or "")
