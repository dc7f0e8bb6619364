"""Ids of short pieces of text by a library tokenizer, kept in a bounded cache of each Python worker."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Mapping, Set

import numpy as np
import public_tokenizers

#: Entries of a worker's cache that make it a generation old (the generation before goes), and the longest piece kept.
CACHE_SIZE, CACHE_PIECE = 300_000, 48

_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: A blank or none, letters, and ASCII marks but the apostrophe: pieces whose pre-tokens need no pattern engine.
_PLAIN = re.compile(f"( ?[{_LETTERS}]+)([!-&(-/:-@\\[-`{{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Known(dict):
    """Ids by piece; pieces too long to be kept are held apart until the next lookup."""

    def __init__(self) -> None:
        super().__init__()
        self.passing: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        return self.passing[piece]


class PieceIds:
    """A worker's tokenizer with a cache from pieces to their ids (little-endian, 4 bytes each).

    A plain piece goes straight to the tokenizer's model, letters and marks
    apart; any other goes through the whole tokenizer. ``lower``: whether the
    tokenizer lower-cases (the letters taken as plain lower-case one to one).
    """

    def __init__(self, vocabulary: str, lower: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.model, self.lower = self.tokenizer.model, lower
        self.letters = _byte_letters()
        self.young, self.old = _Known(), _Known()
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """Ids of letters or marks; words that differ in capitals or marks share their letters'."""
        part = part.lower() if self.lower else part
        ids = self.parts.get(part)
        if ids is None:
            shown = part.encode().decode("latin-1").translate(self.letters)
            ids = self.parts[part] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def lookup(self, pieces: Set[str]) -> Mapping[str, bytes]:
        """A mapping that has the ids of each piece, until the next lookup."""
        if len(self.young) > CACHE_SIZE:
            self.old, self.young = self.young, _Known()
        if len(self.parts) > CACHE_SIZE:
            self.parts = {}
        young, old, plain = self.young, self.old, _PLAIN.fullmatch
        young.passing = {}
        other = []
        for p in pieces - young.keys():
            ids = old.get(p)
            if ids is None:
                if len(p) > CACHE_PIECE or not (m := plain(p)):
                    other.append(p)
                    continue
                ids = self._part(m[1]) + self._part(m[2]) if m[2] else self._part(m[1])
            young[p] = ids
        for p, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            (young if len(p) <= CACHE_PIECE else young.passing)[p] = np.array(e.ids, "<u4").tobytes()
        return young


_WORKERS: dict[tuple[str, bool], PieceIds] = {}


def worker(vocabulary: str, lower: bool) -> PieceIds:
    """The worker's own :class:`PieceIds`, made once."""
    key = (vocabulary, lower)
    if key not in _WORKERS:
        _WORKERS[key] = PieceIds(*key)
    return _WORKERS[key]
