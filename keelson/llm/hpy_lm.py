"""Hierarchical Pitman-Yor language model of words, trained and applied as Spark jobs.

Each word's context is the word before it. A context is a restaurant whose
customers are its next words; a customer opens a table for a word drawn from the
parent restaurant, which all contexts share and whose base is uniform over the
training words and one unseen word. Seating is sampled by Gibbs: a customer
leaves and sits down again, every customer of every (context, word) in a sweep. Up to
``GROUPS`` customers of a (context, word) move one by one; of more, one in ``GROUPS`` moves
at a time and sees where the others sit. A sweep ends with the parent seating the
tables that were opened; the predictive probabilities of the states after the burn-in,
each a whole sweep from the one before, are averaged.

How it is dealt. Texts become blocks of word numbers. Words are numbered in
buckets by their hash, (context, word) cells lie in buckets by context, and
blocks, cells and parent exchange what each asks or tells another once, summed
and packed, so a hot word or pair is one entry of each block. A context of more
than ``SPLIT`` customers is spread over buckets by its next word; only its number
of tables is summed across them. During a sweep the cells see the totals and
parent probabilities from before it, as usual for distributed Gibbs sampling.

Words are told apart by 64-bit hashes. Same input and seed, same result.

Defined cases: null text is empty and only has the end token; null ``doc_id``
counts as empty text in the fold; repeated rows count each; without training
rows every probability is that of the unseen word; an empty table gives an
empty table; extra columns are ignored whatever their names. A long text is
hashed in pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import (
    WHITE, blocks, cut, joined, mix, prefix_hash, random_table, release, span_hash, whole_texts, words_of,
)

#: Bytes of text in a block, and hashed at once; tokens that a bucket is sized for; customers of a context before it is spread.
BLOCK, PIECE, BUCKET, SPLIT = 1 << 23, 1 << 20, 1 << 20, 1 << 20
#: Discount and strength of the parent and of a context.
PARENT, CONTEXT = (0.5, 1.0), (0.8, 1.0)
#: Times every customer moves in a sweep, sweeps of the burn-in, states averaged.
MOVES, BURN, SAMPLES = 1, 1, 2
#: Steps of a move of all customers: up to as many of a cell move one by one, of more a group moves at once.
GROUPS = 64
SEED = 12
#: Log probabilities travel as whole numbers of steps: 5e-7 at most off for a token.
LOG_STEPS = 1 << 20

_TABLE = random_table(12)
#: Key of the end of a text among words' hashes; number of the context at a text's start (words count from 1).
_END, START = np.uint64(0x9E3779B97F4A7C15), 0
#: Customers seated one by one for all cells at once; those beyond sit down by jumps between new tables.
_STEPWISE = 32
#: Customers of a cell who are listed to move, and listed at once; larger cells are moved by their tables' sizes.
_ONE_BY_ONE, _AT_ONCE = 1 << 16, 1 << 20


def pack(values: np.ndarray) -> bytes:
    """Whole numbers or floats, compressed with equal places together."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(blob: bytes, kind: str = "<i8") -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).reshape(-1)


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each value's place among them, by hashing before sorting."""
    codes, found = pd.factorize(values)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[codes]


# --------------------------------------------------------------------- texts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, lower-cased, and the number of words of each text; a long text in pieces."""
    hashes, counts = [], []
    for _, few in blocks(pa.array(texts, pa.binary()), PIECE):
        pieces = few
        if len(few) == 1 and len(few[0]) > PIECE:
            text, pieces, at = few[0], [], 0
            while at < len(text):
                end = min(at + PIECE, len(text))
                while end < len(text) and not WHITE[text[end]]:
                    end += 1
                pieces.append(text[at:end])
                at = end
        total = np.zeros(len(few), np.int64)
        for part in [few] if pieces is few else [[p] for p in pieces]:
            buf, starts, ends = joined(part)
            buf = buf + (((buf >= 65) & (buf <= 90)) * np.uint8(32))
            w0, w1, text_no = words_of(buf, starts, ends)
            hashes.append(span_hash(prefix_hash(_TABLE[buf]), w0, w1))
            total += np.bincount(text_no, minlength=len(few))
        counts.append(total)
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)])


def with_ends(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words and then the end; sizes with it."""
    sizes = counts + 1
    out = np.full(int(sizes.sum()), _END, np.uint64)
    last = np.zeros(len(out), bool)
    last[np.cumsum(sizes) - 1] = True
    out[~last] = hashes
    return out, sizes


_BLOCK_FIELDS = "block long, doc_id array<long>, sizes binary, held binary, seq binary, words binary, trained binary, n_train long, n_docs long"


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _BLOCK_FIELDS.split(", ")]
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        held_all = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for first, texts in blocks(whole_texts(batch.column(1)), BLOCK):
            held = held_all[first : first + len(texts)]
            tokens, sizes = with_ends(*word_hashes(texts))
            words, seq = numbered(mix(tokens))  # in the order of their buckets, however many there will be
            train = ~np.repeat(held, sizes)
            trained = np.bincount(seq[train], minlength=len(words))
            ids = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(0).slice(first, len(texts)))
            row = [[number], ids, [pack(sizes)], [pack(held.astype(np.int64))], [pack(seq)], [pack(words)], [pack(trained)],
                   [int(trained.sum())], [int((~held).sum())]]
            number += 1
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in row], names)


# ---------------------------------------------------------------- exchanging


def _order(bucket: np.ndarray, columns: list[np.ndarray], by: int) -> np.ndarray:
    """How entries are sent: by bucket, then by the first ``by`` columns, which pack better and merge in order."""
    return np.lexsort((*reversed(columns[:by]), bucket))


def _dealt(names: list[str], bucket: np.ndarray, sender: int, columns: list[np.ndarray], by: int) -> Iterator[pa.RecordBatch]:
    """One row (bucket, sender, packed columns) for every bucket."""
    order = _order(bucket, columns, by)
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    rows = [
        (int(bucket[order[a]]), sender, *(pack(c[order[a:b]]) for c in columns))
        for a, b in zip(edges[:-1], edges[1:], strict=True)
    ]
    for i in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 256], strict=True)], names)


def _gathered(table: pa.Table, *columns: tuple[str, str]) -> tuple[list[np.ndarray], list[int]]:
    """The rows' columns unpacked and joined, and where each row ends."""
    parts = [[unpack(b, kind) for b in table[c].to_pylist()] for c, kind in columns]
    return [np.concatenate(p) for p in parts], np.cumsum([len(x) for x in parts[0]]).tolist()


def _answers(table: pa.Table, names: list[str], to: str, me: int, ends: list[int], columns: list[np.ndarray]) -> pa.Table:
    """Each sender's part of the answers, in the order of its questions."""
    starts = [0, *ends[:-1]]
    packed = [[pack(c[a:b]) for a, b in zip(starts, ends, strict=True)] for c in columns]
    return pa.table([table[to], pa.array([me] * len(ends), pa.int64()), *(pa.array(p, pa.binary()) for p in packed)], names)


def _placed(table: pa.Table, bucket: np.ndarray, asked: list[np.ndarray], column: str) -> np.ndarray:
    """The answers from all buckets, back in the order of the questions."""
    out = np.zeros(len(bucket), np.int64)
    order = _order(bucket, asked, len(asked))
    numbers = bucket[order]
    for sender, blob in zip(table["bucket"].to_pylist(), table[column].to_pylist(), strict=True):
        a, b = np.searchsorted(numbers, [sender, sender + 1])
        out[order[a:b]] = unpack(blob)
    return out


def _row(table: pa.Table) -> dict:
    return {c: table[c][0].as_py() for c in table.column_names}


def _numbers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's word numbers and training counts: words are in the order of the buckets that answered."""
    rows = table.sort_by("bucket")
    return tuple(np.concatenate([unpack(b) for b in rows[c].to_pylist()]) for c in ("ids", "c"))


# ------------------------------------------------------------------- seating


def seat(c: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(tables of each cell, their sizes one cell after the other): ``c`` customers sit down in turn, ``a`` the weight of a new table."""
    order = np.argsort(-c, kind="stable")
    c, a = c[order], a[order]
    size, joiners = (np.zeros((len(c), _STEPWISE), np.int64) for _ in range(2))
    size[:, 0] = c > 0
    t = (c > 0).astype(np.int64)
    for n in range(1, min(_STEPWISE, int(c[0]) if len(c) else 0)):
        k = int(np.searchsorted(-c, -n, side="left"))  # cells of more than n customers
        rows, old = np.arange(k), t[:k].copy()
        later = n - old  # customers who joined a table: each counts 1, each table 1 - discount
        x = rng.random(k) * (a[:k] + n - discount * old)
        opens, joins = x >= n - discount * old, x < later
        at = np.where(opens, old, np.minimum((x - later) / (1 - discount), old - 1).astype(np.int64))
        at[joins] = joiners[rows[joins], x[joins].astype(np.int64)]
        size[rows, at] += 1
        joiners[rows[~opens], later[~opens]] = at[~opens]
        t[:k] += opens
    many = int(np.searchsorted(-c, -_STEPWISE, side="left"))
    rest = [_jumps(size[i][size[i] > 0].tolist(), int(c[i]), float(a[i]), discount, rng) for i in range(many)]
    t[:many] = [len(r) for r in rest]
    tables = np.empty_like(t)
    tables[order] = t
    out = np.zeros(int(tables.sum()), np.int64)
    at = (np.cumsum(tables) - tables)[order]
    row, place = np.nonzero(size[many:])
    out[at[many:][row] + place] = size[many:][row, place]
    for i, r in enumerate(rest):
        out[at[i] : at[i] + len(r)] = r
    return tables, out


def _jumps(size: list[int], c: int, a: float, discount: float, rng: np.random.Generator) -> list[int]:
    """The customers up to the ``c``-th: how many join before the next new table, and which tables they join."""
    n = sum(size)
    while n < c:
        u, t = math.log(1 - rng.random()), len(size)
        base = n - discount * t

        def stays(m: int) -> float:  # log probability that m customers open no table
            return math.lgamma(base + m) - math.lgamma(base) + math.lgamma(a + base) - math.lgamma(a + base + m)  # noqa: B023

        low, high = 0, c - n
        if stays(high) < u:  # the customer after `low` others opens a table
            while high - low > 1:
                half = (low + high) // 2
                low, high = (half, high) if stays(half) >= u else (low, half)
            joining, opens = low, True
        else:
            joining, opens = high, False
        share = rng.dirichlet(np.array(size) - discount)
        size = (np.array(size) + rng.multinomial(joining, share)).tolist() + [1] * opens
        n += joining + opens
    return size


def gibbs(t: np.ndarray, sizes: np.ndarray, a: np.ndarray, discount: float, moves: int, rng: np.random.Generator):
    """The seating after every customer of every cell stood up and sat down again, ``moves`` times."""
    starts = np.cumsum(t) - t
    c = np.add.reduceat(sizes, starts) if len(t) else t
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    few = np.flatnonzero(c <= _ONE_BY_ONE)
    few = few[np.argsort(c[few], kind="stable")]
    for some in np.split(few, np.flatnonzero(np.diff(np.cumsum(c[few]) // _AT_ONCE)) + 1):
        place = np.arange(t[some].sum()) - np.repeat(np.cumsum(t[some]) - t[some], t[some])
        seated = t[some], sizes[np.repeat(starts[some], t[some]) + place]
        for _ in range(moves):
            seated = _moved(*seated, a[some], discount, rng)
        found.append((some, *seated))
    for i in np.flatnonzero(c > _ONE_BY_ONE).tolist():
        size = sizes[starts[i] : starts[i] + t[i]]
        for _ in range(moves):
            size = _moved_many(size, float(a[i]), discount, rng)
        found.append((np.array([i]), np.array([len(size)]), size))
    new = np.zeros(len(t), np.int64)
    for some, tables, _ in found:
        new[some] = tables
    out = np.zeros(int(new.sum()), np.int64)
    at = np.cumsum(new) - new
    for some, tables, size in found:
        out[np.arange(len(size)) + np.repeat(at[some] - (np.cumsum(tables) - tables), tables)] = size
    return new, out


def _moved(t: np.ndarray, sizes: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator):
    """One move of every customer: the ``s``-th of a cell, and every ``GROUPS``-th after it, move in step ``s``.

    A table is found by a random customer who sits there and taken or left by its
    discount. A customer who opens a table gives it their own number.
    """
    t, of = t.copy(), np.repeat(np.arange(len(t)), t)
    c = np.bincount(of, sizes, len(t)).astype(np.int64)
    n, first = int(c.sum()), np.cumsum(c) - c
    cell, place = np.repeat(np.arange(len(c)), c), np.arange(n) - np.repeat(first, c)
    at = np.repeat(np.arange(len(sizes)) + n, sizes)[np.argsort(cell + rng.random(n))]  # the table of each customer, in any order
    size, owner = np.concatenate([np.zeros(n, np.int64), sizes]), np.concatenate([cell, of])
    step = place % GROUPS
    order, ends = np.argsort(step.astype(np.uint8), kind="stable"), np.cumsum(np.bincount(step, minlength=GROUPS))
    for s in range(min(GROUPS, int(c.max(initial=0)))):
        who = order[ends[s - 1] if s else 0 : ends[s]]
        k, left = cell[who], at[who]
        np.subtract.at(size, left, 1)
        empty = np.unique(left[size[left] == 0])
        np.subtract.at(t, owner[empty], 1)
        seated = c[k] - (c[k] - s + GROUPS - 1) // GROUPS
        opens = rng.random(len(who)) * (a[k] + seated - discount * t[k]) < a[k]
        to, asking = who.copy(), np.flatnonzero(~opens)
        while len(asking):
            one = rng.integers(0, seated[asking])
            one = one // (GROUPS - 1) * GROUPS + one % (GROUPS - 1) + (one % (GROUPS - 1) >= s)  # none of this step
            table = at[first[k[asking]] + one]
            taken = rng.random(len(asking)) * size[table] < size[table] - discount
            to[asking[taken]] = table[taken]
            asking = asking[~taken]
        at[who] = to
        np.add.at(size, to, 1)
        np.add.at(t, k[opens], 1)
    live = np.flatnonzero(size)
    return t, size[live][np.argsort(owner[live], kind="stable")]


def _moved_many(size: np.ndarray, a: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """:func:`_moved` for a cell whose customers are too many to be listed: each table's are dealt to the steps."""
    waiting = size.copy()  # those at the first tables who have not moved yet
    for s in range(GROUPS):
        leaving = rng.binomial(waiting, 1 / (GROUPS - s))
        waiting -= leaving
        m = int(leaving.sum())
        size = size - np.pad(leaving, (0, len(size) - len(leaving)))
        weight = np.maximum(size - discount, 0)
        opens = int(rng.binomial(m, a / (a + weight.sum())))
        size = np.concatenate([size + rng.multinomial(m - opens, weight / weight.sum()), np.ones(opens, np.int64)])
    return size[size > 0]


# ------------------------------------------------------------------ the model


def _summed(left: pa.Table, before: int, p: np.ndarray) -> np.ndarray:
    """``p`` and the probabilities that a bucket's state holds of the states ``before``."""
    return p + unpack(left["p"][0].as_py(), "<f4") if before else p


def _cell_bucket(u: np.ndarray, w: np.ndarray, cu: np.ndarray, buckets: int, split: int) -> np.ndarray:
    """The bucket of a cell: its context's, and of a large context one of several by the word."""
    first = mix(u.astype(np.uint64) + np.uint64(1)) % np.uint64(buckets)
    return ((first.astype(np.int64) + w % (1 + cu // split)) % buckets).astype(np.int64)


def _cells(row: dict, ids: np.ndarray, c: np.ndarray, start_customers: int):
    """Per (context, word) of a block: u, w, training count, customers of u; and each token's cell."""
    seq = unpack(row["seq"])
    sizes, held = unpack(row["sizes"]), unpack(row["held"]).astype(bool)
    before = np.concatenate([[0], seq[:-1] + 1])
    before[np.cumsum(sizes) - sizes] = 0  # the start, else 1 + the place of the word before
    key, cell = numbered(before * (len(ids) + 1) + seq)
    at, w = key // (len(ids) + 1), key % (len(ids) + 1)
    train = ~np.repeat(held, sizes)
    n = np.bincount(cell[train], minlength=len(key))
    contexts, customers = np.concatenate([[START], ids]), np.concatenate([[start_customers], c])
    return contexts[at], ids[w], n, customers[at], cell


class Model:
    """The stages, with the settings they share."""

    def __init__(self, buckets: int, split: int, moves: int, seed: int, parent: tuple, context: tuple) -> None:
        self.buckets, self.split, self.moves, self.seed = buckets, split, moves, seed
        self.parent, self.context = parent, context

    def numbered_words(self, blocks_: DataFrame) -> DataFrame:
        """Each block's words get numbers and training counts: (block, bucket, ids, c, known)."""
        buckets = self.buckets

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, words, trained in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    words = unpack(words, "<u8")
                    bucket = ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                    yield from _dealt(["bucket", "block", "words", "n"], bucket, number, [words, unpack(trained)], 1)

        def number(key: tuple, table: pa.Table) -> pa.Table:
            me = key[0].as_py()
            (words, n), ends = _gathered(table, ("words", "<u8"), ("n", "<i8"))
            found, at = numbered(words)
            c = np.zeros(len(found), np.int64)
            np.add.at(c, at, n)
            rank = np.empty(len(found), np.int64)
            rank[np.argsort(-c, kind="stable")] = np.arange(len(found))
            answers = _answers(table, ["block", "bucket", "ids", "c"], "block", me, ends, [(1 + rank * buckets + me)[at], c[at]])
            known = np.zeros(answers.num_rows, np.int64)
            known[0] = (c > 0).sum()
            return answers.append_column("known", pa.array(known))

        asked = blocks_.select("block", "words", "trained").mapInArrow(ask, "bucket long, block long, words binary, n binary")
        return asked.groupBy("bucket").applyInArrow(number, "block long, bucket long, ids binary, c binary, known long")

    def asked_cells(self, texts: DataFrame, numbers: DataFrame, starts: int) -> DataFrame:
        """(bucket, block, u, w, n, cu): the cells that each block has, in order within a bucket."""
        buckets, split = self.buckets, self.split
        names = ["bucket", "block", "u", "w", "n", "cu"]

        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            row = _row(left)
            u, w, n, cu, _ = _cells(row, *_numbers(right), starts)
            rows = _dealt(names, _cell_bucket(u, w, cu, buckets, split), row["block"], [u, w, n, cu], 2)
            return pa.Table.from_batches(list(rows))

        return texts.groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(
            ask, "bucket long, block long, u binary, w binary, n binary, cu binary"
        )

    STATE = "bucket long, block long, u binary, w binary, c binary, cu binary, t binary, sizes binary, tables long, p binary"

    def state(self, asked: DataFrame) -> DataFrame:
        """A bucket's cells, one table for each that has customers; and for each block (in ``u``) which cells it asked for."""

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            me = key[0].as_py()
            (u, w, n, cu), ends = _gathered(table, *((c, "<i8") for c in ("u", "w", "n", "cu")))
            order = np.lexsort((w, u))
            u, w, n, cu = u[order], w[order], n[order], cu[order]
            new = (np.diff(u, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0)
            first = np.flatnonzero(new)
            place = np.empty(len(u), np.int64)
            place[order] = np.cumsum(new) - 1
            c = np.add.reduceat(n, first)
            t = np.minimum(c, 1)
            asks = [pack(np.diff(place[a:b], prepend=0)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            none = [None] * len(ends)
            own = [pack(x) for x in (w[first], c, cu[first], t, np.zeros(0, np.int64))]
            columns = [[me] * (1 + len(ends)), [None, *table["block"].to_pylist()], [pack(u[first]), *asks],
                       *([x, *none] for x in own), [int(t.sum()), *none], [None, *none]]
            types = [pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.binary()]
            return pa.table([pa.array(x, k) for x, k in zip(columns, types, strict=True)], [f.split()[0] for f in Model.STATE.split(", ")])

        return asked.groupBy("bucket").applyInArrow(merge, Model.STATE)

    def seated_parent(self, state: DataFrame, sweep: int, tables: int, unseen: int) -> DataFrame:
        """(bucket, parent, c0, t0, new): customers and tables of every word in the parent, told to each bucket of cells.

        ``tables``: the parent's number of tables before; ``unseen``: one over the base probability.
        """
        buckets, (discount, strength), moves, seed = self.buckets, self.parent, self.moves, self.seed

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for me, w, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    words, at = numbered(unpack(w))
                    n = np.bincount(at, unpack(t)).astype(np.int64)
                    yield from _dealt(["parent", "bucket", "w", "n"], words % buckets, me, [words, n], 1)

        def sit(key: tuple, table: pa.Table) -> pa.Table:
            me = key[0].as_py()
            rng = np.random.default_rng([seed, 1, sweep, me])
            (words, n), ends = _gathered(table, ("w", "<i8"), ("n", "<i8"))
            found, at = numbered(words)
            c = np.zeros(len(found), np.int64)
            np.add.at(c, at, n)
            t = np.minimum(c, 1)
            some = np.flatnonzero(c > 1)
            a = np.full(len(some), (strength + discount * tables) / unseen)
            t[some] = gibbs(*seat(c[some], a, discount, rng), a, discount, moves, rng)[0]
            out = _answers(table, ["bucket", "parent", "c0", "t0"], "bucket", me, ends, [c[at], t[at]])
            new = np.zeros(out.num_rows, np.int64)
            new[0] = t.sum()
            return out.append_column("new", pa.array(new))

        told = state.select("bucket", "w", "t").mapInArrow(ask, "parent long, bucket long, w binary, n binary")
        return told.groupBy("parent").applyInArrow(sit, "bucket long, parent long, c0 binary, t0 binary, new long")

    def split_tables(self, state: DataFrame) -> DataFrame:
        """(bucket, parent -1, c0: contexts, t0: their tables in all buckets): for contexts that are spread."""
        buckets, split = self.buckets, self.split

        def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for me, u, cu, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    u, cu, t = unpack(u), unpack(cu), unpack(t)
                    large = cu >= split
                    contexts, at = numbered(u[large])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([me] * len(contexts), pa.int64()), pa.array(contexts, pa.int64()),
                         pa.array(np.bincount(at, t[large], len(contexts)).astype(np.int64))], ["bucket", "u", "t"])

        parts = state.select("bucket", "u", "cu", "t").mapInArrow(mine, "bucket long, u long, t long")
        sums = parts.groupBy("u").agg(F.sum("t").alias("t"))

        def packed(key: tuple, table: pa.Table) -> pa.Table:
            return pa.table([pa.array([key[0].as_py()]), pa.array([-1], pa.int64()), pa.array([pack(table["u"].to_numpy())]),
                             pa.array([pack(table["t"].to_numpy())]), pa.array([0], pa.int64())], ["bucket", "parent", "c0", "t0", "new"])

        rows = parts.select("bucket", "u").join(sums, "u").select("bucket", "u", "t")
        return rows.groupBy("bucket").applyInArrow(packed, "bucket long, parent long, c0 binary, t0 binary, new long")

    def tell(self, state: DataFrame, sweep: int, tables: int, unseen: int) -> tuple[DataFrame, int, int]:
        """What the parent, seated anew, and spread contexts tell the buckets; the parent's customers and tables."""
        customers = int(state.agg(F.coalesce(F.sum("tables"), F.lit(0))).first()[0])
        seated = cut(self.seated_parent(state, sweep, tables, unseen))
        tables = int(seated.agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0])
        return seated.union(self.split_tables(state)).drop("new"), customers, tables

    def _sweeper(self, sweep: int, customers: int, tables: int, unseen: int):
        """A function from a bucket's state and what the parent told to the state as arrays, its next sweep and its probabilities."""
        buckets, moves, seed = self.buckets, self.moves, self.seed
        (d0, s0), (discount, strength) = self.parent, self.context

        def start(left: pa.Table, told: pa.Table):
            row = {c: left[c][0].as_py() for c in ("bucket", "u", "w", "c", "cu", "t", "sizes")}
            u, w, c, cu, t, sizes = (unpack(row[x]) for x in ("u", "w", "c", "cu", "t", "sizes"))
            rng = np.random.default_rng([seed, 2, sweep, row["bucket"]])
            words, at = numbered(w)
            own = told.filter(pa.compute.greater_equal(told["parent"], 0)).select(["parent", "c0", "t0"]).rename_columns(["bucket", "c0", "t0"])
            c0, t0 = (_placed(own, words % buckets, [words], x) for x in ("c0", "t0"))
            below = ((c0 - d0 * t0 + (s0 + d0 * tables) / unseen) / (s0 + customers))[at]
            new = np.flatnonzero(np.diff(u, prepend=-1))  # cells are in order of contexts
            of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(u))))
            spread = told.filter(pa.compute.equal(told["parent"], -1))
            some = np.flatnonzero(c > 1)
            total = np.bincount(of, t, len(new))  # tables of each context; of a spread context, those in all buckets
            for x, y in zip(spread["c0"].to_pylist(), spread["t0"].to_pylist(), strict=True):
                total[np.searchsorted(u[new], unpack(x))] = unpack(y)
            opened = (strength + discount * total[of]) * below

            def swept() -> tuple[np.ndarray, np.ndarray]:
                """Everyone moves; the first time everyone is seated before."""
                fresh, after = opened[some], t.copy()
                seating = (t[some], sizes) if sweep > 0 else seat(c[some], fresh, discount, rng)
                after[some], own = gibbs(*seating, fresh, discount, moves, rng)
                return after, own

            def probability() -> np.ndarray:
                seen = (np.maximum(c - discount * t, 0) + opened) / (strength + np.maximum(cu, 1))
                return np.where(cu > 0, seen, below)

            return swept, probability

        return start

    def swept(
        self, state: DataFrame, told: DataFrame, sweep: int, customers: int, tables: int, unseen: int, sampled: int | None = None
    ) -> DataFrame:
        """The state after a sweep; the first one seats everyone.

        ``sampled``: the state before is averaged, with as many before it; ``p`` is their probabilities' sum.
        """
        start = self._sweeper(sweep, customers, tables, unseen)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            swept, probability = start(left, right)
            p = None if sampled is None else pack(_summed(left, sampled, probability()).astype(np.float32))
            t, sizes = swept()
            out = left.select(["bucket", "block", "u", "w", "c", "cu"])
            for k, x in (("t", t), ("sizes", sizes)):
                out = out.append_column(k, pa.array([pack(x)]))
            return out.append_column("tables", pa.array([int(t.sum())])).append_column("p", pa.array([p], pa.binary()))

        return state.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(run, Model.STATE)

    def answered(
        self, state: DataFrame, told: DataFrame, asks: DataFrame, sweep: int, customers: int, tables: int, unseen: int, samples: int
    ) -> DataFrame:
        """(block, bucket, p): the log10 probability (in steps) of each cell that a block asked for, averaged over ``samples`` states.

        The state is the last of them and holds the sum of those before.
        """
        start = self._sweeper(sweep, customers, tables, unseen)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            asked = right.filter(pa.compute.equal(right["parent"], -2))
            _, probability = start(left, right)
            p = _summed(left, samples - 1, probability())
            log = np.rint(np.log10(p / samples) * LOG_STEPS).astype(np.int64)
            blobs = [pack(log[np.cumsum(unpack(b))]) for b in asked["c0"].to_pylist()]
            return pa.table([asked["block"], asked["bucket"], pa.array(blobs, pa.binary())], ["block", "bucket", "p"])

        questions = asks.selectExpr("bucket", "-2L as parent", "u as c0", "cast(null as binary) as t0", "block")
        both = told.selectExpr("bucket", "parent", "c0", "t0", "cast(null as long) as block").union(questions)
        return state.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(run, "block long, bucket long, p binary")

    def scored(
        self, texts: DataFrame, numbers: DataFrame, answers: DataFrame, starts: int, train_tokens: int, vocabulary: int
    ) -> DataFrame:
        buckets, split = self.buckets, self.split
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            row, given = _row(left), right["p"].is_null()
            ids, c = _numbers(right.filter(given))
            u, w, _, cu, cell = _cells(row, ids, c, starts)
            p = _placed(right.filter(pa.compute.invert(given)), _cell_bucket(u, w, cu, buckets, split), [u, w], "p")[cell] / LOG_STEPS
            sizes, c = unpack(row["sizes"]), c[unpack(row["seq"])]
            first = np.cumsum(sizes) - sizes
            base = np.log10((c + 1) / (train_tokens + vocabulary + 1))
            columns = [
                row["doc_id"], unpack(row["held"]).astype(bool), sizes, np.add.reduceat((c > 0).astype(np.int64), first),
                np.full(len(sizes), train_tokens), np.add.reduceat(base, first), np.add.reduceat(p, first),
            ]
            return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

        told = numbers.selectExpr("block", "bucket", "ids", "c", "cast(null as binary) as p").union(
            answers.selectExpr("block", "bucket", "cast(null as binary) as ids", "cast(null as binary) as c", "p")
        )
        fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, fields)


@dataclass
class Fitted:
    """A trained model and the blocks it was asked for: the first state to be averaged, and what the parent told it."""

    model: Model
    texts: DataFrame
    numbers: DataFrame
    asks: DataFrame
    state: DataFrame
    told: DataFrame
    starts: int
    train_tokens: int
    vocabulary: int
    sweep: int
    customers: int
    tables: int

    def answers(self, samples: int) -> DataFrame:
        """Averaged over ``samples`` states a whole sweep apart: of all customers, and of the parent. The last one is kept."""
        unseen = self.vocabulary + 1
        for sampled in range(samples - 1):
            self.state = cut(
                self.model.swept(self.state, self.told, self.sweep, self.customers, self.tables, unseen, sampled)
            )
            self.told = None  # it holds the state before
            release(self.state.sparkSession)
            self.sweep += 1
            self.told, self.customers, self.tables = self.model.tell(self.state, self.sweep, self.tables, unseen)
        return self.model.answered(
            self.state, self.told, self.asks, self.sweep, self.customers, self.tables, unseen, samples
        )

    def scores(self, answers: DataFrame) -> DataFrame:
        return self.model.scored(self.texts, self.numbers, answers, self.starts, self.train_tokens, self.vocabulary)


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_tokens: int = BUCKET,
    split: int = SPLIT,
    moves: int = MOVES,
    burn: int = BURN,
    parent: tuple[float, float] = PARENT,
    context: tuple[float, float] = CONTEXT,
    seed: int = SEED,
) -> Fitted:
    """Train on the documents of the training fold; the cells of all documents are asked for on the way."""
    fold = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 = 2 as held"
    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).selectExpr("doc_id", "text", fold)
    made = cut(taken.mapInArrow(_to_blocks, _BLOCK_FIELDS))
    sums = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n_train", "n_docs", F.octet_length("seq")))
    train_tokens, starts, packed = map(int, made.agg(*sums).first())
    model = Model(max(1, -(-max(train_tokens, packed // 4) // bucket_tokens)), split, moves, seed, parent, context)
    numbers = cut(model.numbered_words(made))
    vocabulary = int(numbers.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0])
    numbers = numbers.drop("known")
    texts = cut(made.drop("words", "trained", "n_train", "n_docs"))
    del made
    release(docs.sparkSession)
    merged = cut(model.state(model.asked_cells(texts, numbers, starts)))
    state = merged.where("block is null")
    release(docs.sparkSession)
    asks = cut(merged.where("block is not null").select("bucket", "block", "u"))
    del merged
    tables = vocabulary
    for sweep in range(burn + 1):
        told = None  # what was told before the last sweep holds the state before it
        release(docs.sparkSession)
        told, customers, tables = model.tell(state, sweep, tables, vocabulary + 1)
        if sweep < burn:
            state = cut(model.swept(state, told, sweep, customers, tables, vocabulary + 1))
    release(docs.sparkSession)
    return Fitted(model, texts, numbers, asks, state, told, starts, train_tokens, vocabulary, burn, customers, tables)


def score(docs: DataFrame, samples: int = SAMPLES, **settings) -> DataFrame:
    """One row per document: its fold, tokens, unigram score, and log10 probability under the model of the training fold."""
    fitted = fit(docs, **settings)
    answers = cut(fitted.answers(samples))
    fitted.state = fitted.told = fitted.asks = None
    release(docs.sparkSession)
    return fitted.scores(answers)


def perplexity(scores: DataFrame, column: str = "score") -> DataFrame:
    """Perplexity per token of the training and the held-out documents."""
    return scores.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"))
