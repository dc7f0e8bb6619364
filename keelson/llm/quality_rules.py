"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

A document is repetitive if too many of its characters lie inside word n-grams
that occur twice or more in it, or inside lines that repeat an earlier line.
Everything is computed per document from its whole text, for a block of
documents at once in numpy: word starts, a hash per word, one rolling hash per
n-gram length, one sort per length.

Defined cases: null and empty texts have no words, fail the base rule and are
not kept; repeated rows are judged alike; an empty table gives an empty table;
other columns pass through untouched, whatever their names (those of
:data:`STATS` are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import (
    blocks, joined, mix, prefix_hash, random_table, repeated, schema_of, set_aside, span_hash, whole_texts,
    without, words_of,
)

#: Largest share of word characters inside duplicated n-grams, by n-gram length.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters inside lines that repeat an earlier line.
LINE_LIMIT = 0.20
MIN_WORDS = 20
REPEAT_WINDOW, REPEAT_PERCENT = 8, 30
#: The characters counted as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Bytes of text measured at once; numpy takes some 60 times as much, and every worker of an executor does so at once.
BLOCK = 1 << 19

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, dup_ngram_share double, dup_line_share double, kept boolean"
)
_TABLE = random_table(5)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of :data:`STATS` for some whole texts."""
    buf, starts, ends = joined(texts)
    n = len(texts)
    w0, w1, doc = words_of(buf, starts, ends)
    prefix = prefix_hash(_TABLE[buf])
    point = np.zeros(len(buf) + 1, np.int64)  # code points before each byte
    np.cumsum((buf & 0xC0) != 0x80, out=point[1:])
    chars = point[w1] - point[w0]
    total = np.bincount(doc, chars, n)
    n_words = np.bincount(doc, minlength=n)
    rolling = word = span_hash(prefix, w0, w1)
    worst = np.zeros(n)
    n_repeat = np.zeros(n, np.int64)
    alive = np.ones(len(w0), bool)
    for size in range(2, max(NGRAM_LIMITS) + 1):
        if len(rolling) <= 1:
            break
        rolling = rolling[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[size - 1 :]
        if size not in NGRAM_LIMITS:
            continue
        at = np.flatnonzero((doc[: len(rolling)] == doc[size - 1 :]) & alive[: len(rolling)])
        if not len(at):
            break
        keys = mix(rolling[at]) ^ mix(doc[at].astype(np.uint64) + np.uint64(1))
        hit = at[repeated(keys)]
        alive = np.zeros(len(w0), bool)
        alive[hit] = True  # a longer n-gram repeats only where its first part does
        cover = np.zeros(len(w0) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + size, -1)
        inside = np.cumsum(cover[:-1]) > 0
        share = np.bincount(doc[inside], chars[inside], n) / np.maximum(total, 1)
        worst = np.maximum(worst, share / NGRAM_LIMITS[size])
        if size == REPEAT_WINDOW:
            n_repeat = np.bincount(doc[inside], minlength=n)
    dup_lines, dup_chars = _lines(buf, starts, ends, prefix, point, w0, n)
    line_share = dup_chars / np.maximum(total, 1)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words, "word_chars": total.astype(np.int64),
        "n_symbols": _per_text(SYMBOLS[buf], starts, ends),
        "n_dup_lines": dup_lines, "n_repeat_words": n_repeat, "base_failed": failed,
        "dup_ngram_share": worst, "dup_line_share": line_share,
        "kept": ~failed & (worst <= 1) & (line_share <= LINE_LIMIT),
    }


def measured(column: pa.Array) -> dict[str, np.ndarray]:
    """:func:`measure` for a batch's texts, a block at a time."""
    parts = [measure(t) for _, t in blocks(whole_texts(column), BLOCK)]
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if parts else {}


def _per_text(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    count = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return count[ends] - count[starts]


def _lines(buf, starts, ends, prefix, point, w0, n):
    """Per text: lines (with a word) equal to an earlier line, and the word characters in them."""
    breaks = np.flatnonzero(buf == 0x0A)
    l0 = np.sort(np.concatenate([starts, breaks + 1]))
    l1 = np.sort(np.concatenate([ends, breaks]))
    words = np.searchsorted(w0, l1) - np.searchsorted(w0, l0)
    l0, l1 = l0[words > 0], l1[words > 0]
    doc = np.searchsorted(ends, l0, side="right")
    keys = span_hash(prefix, l0, l1) ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")  # stable: earlier lines come first
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order][1:] == keys[order][:-1]
    white = np.isin(buf, list(b" \t\n\v\f\r"))
    solid = point[1:] - point[:-1]
    solid[white] = 0
    run = np.concatenate([[0], np.cumsum(solid)])
    return (
        np.bincount(doc[again], minlength=n),
        np.bincount(doc[again], (run[l1] - run[l0])[again], n),
    )


def quality_stats(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``carry`` of ``docs`` with those of :data:`STATS` (per row, no shuffle)."""
    names = [s.split()[0] for s in STATS.split(", ")]
    carry = without(carry, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if stats := measured(batch.column(len(carry))):
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(stats[c]) for c in names)], [*carry, *names])

    taken = docs.select(*set_aside(carry)[0], F.col(text_col).alias("__text"))
    return taken.mapInArrow(run, schema_of(docs.select(*carry), STATS))


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all columns of ``docs``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if stats := measured(batch.column(at)):
                yield batch.filter(pa.array(stats["kept"]))

    return docs.mapInArrow(run, docs.schema)
