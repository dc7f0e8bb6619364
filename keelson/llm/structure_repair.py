"""Conversation structure repair: the cheapest edits that make a conversation's roles ``(s?(ua)+)?``.

Each row is one symbol: must go, or the initial of its role (s, u, a, other)
with or without a truncated text. A row is kept (0), gets the role that fits
(2), or is deleted (3); an empty turn may be inserted anywhere (2); a truncated
row that stays adds 1. Four states say what stands before a row: nothing, s, u,
a. The cost to go from each state, less the least of them, takes few values, so
by the Four-Russians method the step over every block of ``BLOCK`` symbols is
tabled for every normalised vector, and a conversation is read from its end
block by block, one lookup each. Tracing goes forward: a block is expanded
backward from the vector at its end, and of the letters that lose nothing the
ASCII-least is taken. A letter fixes the next state, so this audit is the least.

On Spark: equal rows are summed, first occurrences joined, rows of a
conversation streamed in order. A task holds one byte for each row of the
conversation that it reads (the audit itself is as long); texts pass by in a
second stream that follows the audit. A hash of a whole conversation can only
be taken in order, so one conversation is one task, however long.

Defined cases: null role and text count as one space, as do null ``conv_id``
and ``turn`` in the damage key; a null ``conv_id`` is a conversation of its own;
rows tied in turn are ordered by role and text; roles of other initials can be
kept nowhere; a conversation without rows needs no edit; an empty table gives
an empty table; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut

#: Costs of giving a role, deleting, inserting, and keeping a truncated text.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a block.
BLOCK = 4
#: Fixed value: white space, which makes no text.
WHITE = " \t\n\x0b\x0c\r"
#: Symbols: 0 must be deleted; 1 + 2 * class + truncated, classes s, u, a, other.
SYMBOLS = 9

#: States: 0 nothing, 1 after s, 2 after u, 3 after a. By class, the state that keeping a row leads to.
_KEEP = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
#: The state that an inserted or renamed turn leads to: u, but a after u.
_FREE = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
#: Cost to go after the last row.
END = (0, 2 * INSERT, INSERT, 0)


def step(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs to go before a row from the costs after it."""
    klass, extra = divmod(symbol - 1, 2)
    extra *= TRUNCATED
    cost = [c + DELETE for c in after]
    if symbol:
        for q in range(4):
            kept = _KEEP[klass][q]
            if kept is not None:
                cost[q] = min(cost[q], after[kept] + extra)
            cost[q] = min(cost[q], after[_FREE[q]] + REROLE + extra)
    for _ in range(2):  # at most two inserted turns help
        cost = [min(c, cost[_FREE[q]] + INSERT) for q, c in enumerate(cost)]
    return tuple(cost)


class Tables:
    """The normalised vectors, and for each of them and each block of symbols the vector before it and the cost."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        self.vectors: list[tuple[int, ...]] = [END]
        found = {END: 0}
        rows: list[list[tuple[int, int]]] = []
        while len(rows) < len(self.vectors):
            row = []
            for s in range(SYMBOLS):
                v = step(self.vectors[len(rows)], s)
                low = min(v)
                v = tuple(c - low for c in v)
                if v not in found:
                    found[v] = len(self.vectors)
                    self.vectors.append(v)
                row.append((found[v], low))
            rows.append(row)
        one = np.array(rows, np.int32)
        self.next1, self.add1 = one[:, :, 0], one[:, :, 1]
        self.next, self.add = self.next1, self.add1
        for _ in range(block - 1):  # one more symbol before the block
            self.next, self.add = (
                self.next1[self.next].swapaxes(1, 2).reshape(len(rows), -1),
                (self.add[:, :, None] + self.add1[self.next]).swapaxes(1, 2).reshape(len(rows), -1),
            )
        self.radix = SYMBOLS ** np.arange(block - 1, -1, -1)

    def trace_row(self, after: tuple[int, ...], symbol: int, q: int) -> tuple[str, int]:
        """The ASCII-least cheapest edits up to and with this row, from state ``q``."""
        before = step(after, symbol)
        klass, extra = divmod(symbol - 1, 2)
        letters = ""
        while True:
            if after[q] + DELETE == before[q]:
                return letters + "D", q
            if before[_FREE[q]] + INSERT == before[q]:
                letters, q = letters + "I", _FREE[q]
                continue
            kept = _KEEP[klass][q] if symbol else None
            if kept is not None and after[kept] + extra * TRUNCATED == before[q]:
                return letters + "K", kept
            return letters + "R", _FREE[q]

    @functools.lru_cache(maxsize=1 << 16)  # noqa: B019 - one object lives in each worker
    def trace(self, vector: int, symbols: bytes, q: int) -> tuple[str, int]:
        """The same for a block (or less) that ends at ``vector``: expanded backward, followed forward."""
        ends = [vector]
        for s in symbols[:0:-1]:
            ends.append(int(self.next1[ends[-1], s]))
        letters = ""
        for s, v in zip(symbols, reversed(ends), strict=True):
            part, q = self.trace_row(self.vectors[v], s, q)
            letters += part
        return letters, q

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """The least cost and the audit of a conversation."""
        n, block = len(symbols), self.block
        head = n % block
        codes = np.frombuffer(symbols, np.uint8)[head:].reshape(-1, block) @ self.radix
        vector, cost = 0, 0
        ends = []
        for code in codes[::-1].tolist():
            ends.append(vector)
            cost += int(self.add[vector, code])
            vector = int(self.next[vector, code])
        head_end = vector
        for s in symbols[:head][::-1]:
            cost += int(self.add1[vector, s])
            vector = int(self.next1[vector, s])
        cost += self.vectors[vector][0]
        audit = []
        q = 0
        if head:
            part, q = self.trace(head_end, symbols[:head], q)
            audit.append(part)
        for i, v in enumerate(reversed(ends)):
            part, q = self.trace(v, symbols[head + i * block : head + (i + 1) * block], q)
            audit.append(part)
        while END[q]:
            audit.append("I")
            q = _FREE[q]
        return cost, "".join(audit)


@functools.cache
def tables() -> Tables:
    return Tables()


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows damaged by the checksum of ``conv_id:turn``; n is 2 for a repeated row."""
    taken = conversations.select("conv_id", "turn", "role", "text")
    hit = taken.selectExpr(
        "conv_id", "turn", "coalesce(role, ' ') as role", "coalesce(text, ' ') as text",
        "crc32(cast(concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' ')) as binary)) % 20 as hit",
    ).where("hit <> 0")
    return hit.selectExpr(
        "conv_id", "turn", "if(hit = 4, 'user', role) as role",
        "case hit when 1 then '' when 2 then translate(text, '.!?', '') else text end as text",
        "if(hit = 3, 2, 1) as n",
    )


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one row: copies n, and blank, truncated, first (of its role and text)."""
    runs = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    firsts = runs.groupBy("conv_id", "role", "text").agg(F.min(at).alias("first_at"))
    same = F.expr("a.conv_id <=> b.conv_id and a.role = b.role and a.text = b.text")
    joined = runs.alias("a").join(firsts.alias("b"), same)
    end = F.rtrim(F.col("a.text"), F.lit(WHITE))
    return joined.select(
        "a.conv_id", "a.turn", "a.role", "a.text", "a.n",
        F.expr("a.turn <=> b.first_at.turn").alias("first"),
        (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """A conversation's rows in one partition, one after the other: the marker first."""
    return rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", "marker", F.col("turn").asc_nulls_first(), "role", "text"
    )


class _Count:
    """What one pass over a conversation's rows adds up."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None
        self.role = -1

    def add(self, turn: int | None, role: str, n: int, first: bool, blank: bool, truncated: bool) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.last
            self.high = self.last = turn
        klass = "sua".find(role[0]) if role else -1
        if self.symbols:
            self.illegal += (self.role, klass) not in ((0, 1), (1, 2), (2, 1))
        self.illegal += n - 1
        self.role = klass
        if blank:
            self.blank += n
            self.symbols += bytes(n)
        elif not first:
            self.duplicate += n
            self.symbols += bytes(n)
        else:
            self.duplicate += n - 1
            self.truncated += truncated
            self.symbols.append(1 + 2 * (3 if klass < 0 else klass) + truncated)
            self.symbols += bytes(n - 1)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = tables().repair(bytes(self.symbols))
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


class _Follow:
    """The repaired conversation, hashed row by row along its audit."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.q = audit, 0, 0
        self.hash, self.any = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.any}{role}:{text}".encode())
        self.any = True

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.q = _FREE[self.q]
            self.put(_ROLE[self.q], "")
            self.at += 1

    def add(self, role: str, text: str, n: int) -> None:
        for _ in range(n):
            self.inserted()
            letter = self.audit[self.at]
            if letter == "K":
                self.q = _KEEP["sua".index(role[0])][self.q]
                self.put(role, text)
            elif letter == "R":
                self.q = _FREE[self.q]
                self.put(_ROLE[self.q], text)
            self.at += 1

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


_FIELDS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
_TYPES = [pa.int64()] * 7 + [pa.string()]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Count | None = None
    for batch in batches:
        done = []
        for conv_id, marker, turn, role, n, first, blank, truncated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if marker == 0:
                if now is not None:
                    done.append(now.row())
                now = _Count(conv_id)
            else:
                now.add(turn, role, n, first, blank, truncated)
        if done:
            yield _batch(done, _NAMES, _TYPES)
    if now is not None:
        yield _batch([now.row()], _NAMES, _TYPES)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [*_NAMES, "repaired_sha256"], [*_TYPES, pa.string()]
    head: tuple = ()
    now: _Follow | None = None
    for batch in batches:
        done = []
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            marker, role, text, n = values[:4]
            if marker == 0:
                if now is not None:
                    done.append((*head, now.digest()))
                head, now = values[4:], _Follow(values[-1])
            else:
                now.add(role, text, n)
        if done:
            yield _batch(done, names, types)
    if now is not None:
        yield _batch([(*head, now.digest())], names, types)


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``conversations``: its faults, the cheapest repair and the repaired text's hash.

    ``rows`` (conv_id, turn, role, text, n) are the turns to repair; without
    them, those of ``conversations`` as they are.
    """
    if rows is None:
        rows = conversations.selectExpr(
            "conv_id", "turn", "coalesce(role, ' ') as role", "coalesce(text, ' ') as text", "1 as n"
        )
    found = cut(faults(rows))
    ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    marks = ids.selectExpr(
        "conv_id", "0 as marker", "cast(null as long) as turn", "cast(null as string) as role", "cast(null as string) as text",
        "cast(null as long) as n", "cast(null as boolean) as first", "cast(null as boolean) as blank", "cast(null as boolean) as truncated",
    )
    turns = found.selectExpr("conv_id", "1 as marker", "turn", "role", "text", "n", "first", "blank", "truncated")
    thin = _in_order(marks.unionByName(turns)).select("conv_id", "marker", "turn", "role", "n", "first", "blank", "truncated")
    audits = cut(thin.mapInArrow(_audits, _FIELDS))
    rest = [c for c in _NAMES if c != "conv_id"]
    empty = [F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in rest]
    heads = audits.select(
        "conv_id", F.lit(0).alias("marker"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("n"), *rest,
    )
    body = found.select("conv_id", F.lit(1).alias("marker"), "turn", "role", "text", "n", *empty)
    return _in_order(heads.union(body)).select("marker", "role", "text", "n", *_NAMES).mapInArrow(
        _hashes, _FIELDS + ", repaired_sha256 string"
    )
