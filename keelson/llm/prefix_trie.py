"""Prefix trie of conversations by vertical bitmaps.

Every distinct sequence of first turns is a node. A task takes the
conversations of one subtree (a shard), numbers them by id, and indexes for
each (position, turn) the set of conversations that have it there, as bits of an
integer. Depth first, a node's set intersected with the posting of its lowest
undealt member's next turn is a child; the count of bits is the number of
members, the bits that end at the depth are the end list.

Shards: the nodes of more than ``LIMIT`` members are heavy; a conversation
belongs to the shard of its first prefix that isn't. So a hot first turn or a
conversation with very many copies is split or needs no bitmap at all: a heavy
node's members, smallest member and end list come from partial sums and a
sorted stream, its children and subtree sums from the shards below it. There is
at most one heavy node for ``LIMIT`` turns; each adds what is its own to its
ancestors, the prefixes of its smallest member.

Prefixes are told apart between tasks by two 64-bit sums (XOR) of position-
salted hashes of their turns. Texts are only shuffled to be ordered; then a turn
is 60 bytes. A task holds the turns of one shard, at most ``LIMIT``
conversations.

Defined cases: null role and text are empty; rows without ``conv_id`` belong to
no conversation; rows tied in turn are ordered by role and text; equal rows are
turns of their own; a conversation without turns ends at the root; an empty
table has no node; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import cut, maybe_broadcast

#: Members beyond which a node is shared by several shards.
LIMIT = 128
#: Conversations in a family share the first turns of its first id; at most so many turns less one.
FAMILY, HEADS = 20, 4

_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
_NODE_NAMES = [f.split()[0] for f in _NODE.split(", ")]
_WORD = r"[^\\x20\\x09-\\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, d1, d2, words): every turn's place, two hashes of role and text, and words."""
    taken = conversations.where("conv_id is not null").selectExpr(
        "cast(conv_id as long) as conv_id", "turn", "coalesce(role, '') as role", "coalesce(text, '') as text"
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return taken.withColumn("pos", F.row_number().over(order)).selectExpr(
        "conv_id", "pos", "xxhash64(role, text) as d1", "xxhash64(text, 1, role) as d2",
        f"cast(regexp_count(text, '{_WORD}') as long) as words",
    )


def rebuild(turns: DataFrame) -> DataFrame:
    """Each conversation begins with its family's first turns: (conv_id, part, pos, d1, d2, words), part 0 or 1.

    ``h`` = crc32 of the id, modulo 4, turns come from the id's family's first
    conversation (those it has), then its own after its first ``h``.
    """
    h = f"crc32(cast(cast(conv_id as string) as binary)) % {HEADS}"
    ids = turns.select("conv_id").distinct().selectExpr("conv_id", f"{h} as h", f"conv_id - conv_id % {FAMILY} as base")
    heads = turns.where(f"conv_id % {FAMILY} = 0 and pos < {HEADS}").withColumnRenamed("conv_id", "base")
    borrowed = ids.join(heads, "base").where("pos <= h")
    columns = ["pos", "d1", "d2", "words"]
    return borrowed.select("conv_id", F.lit(0).alias("part"), *columns).union(
        turns.where(f"pos > {h}").select("conv_id", F.lit(1).alias("part"), *columns)
    )


def paths(ids: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, d1, d2, words, p1, p2, up1, up2, last): every prefix of every conversation, from the root."""
    zero = F.lit(0).cast("long")
    top = ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("pos"), zero.alias("d1"), zero.alias("d2"), zero.alias("words"))
    order = Window.partitionBy("conv_id").orderBy("part", "pos")
    placed = top.union(rebuilt).withColumn("depth", (F.row_number().over(order) - 1).cast("long"))
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    salted = placed.withColumns({
        "x1": F.expr("if(depth = 0, 0L, xxhash64(depth, d1, d2))"), "x2": F.expr("if(depth = 0, 0L, xxhash64(d2, depth, d1))")
    })
    summed = salted.withColumns({"p1": F.bit_xor("x1").over(sofar), "p2": F.bit_xor("x2").over(sofar)})
    return summed.select(
        "conv_id", "depth", "d1", "d2", "words", "p1", "p2",
        F.lag("p1").over(order).alias("up1"), F.lag("p2").over(order).alias("up2"),
        F.lead("depth").over(order).isNull().alias("last"),
    )


class Shard:
    """Vertical bitmaps of the conversations below one prefix.

    ``local``: a turn's conversation by number, in the order of ids; ``posting``:
    the number of its (position, turn). Both are ordered by conversation, depth.
    """

    def __init__(self, ids: list[int], local: np.ndarray, posting: np.ndarray, words: np.ndarray, top: int) -> None:
        self.ids, self.top = ids, top
        self.posting = posting.tolist()
        starts = np.searchsorted(local, np.arange(len(ids) + 1)).tolist()
        self.starts = starts
        self.words = dict(zip(self.posting, words.tolist(), strict=True))
        self.bits: dict[int, int] = {}
        for i, p in zip(local.tolist(), self.posting, strict=True):
            self.bits[p] = self.bits.get(p, 0) | 1 << i
        self.ends: dict[int, int] = {}
        for i in range(len(ids)):
            depth = top + starts[i + 1] - starts[i] - 1
            self.ends[depth] = self.ends.get(depth, 0) | 1 << i

    def children(self, members: int, depth: int) -> Iterator[tuple[int, int]]:
        """(members, posting) of every child of a node."""
        left = members & ~self.ends.get(depth, 0)
        while left:
            first = (left & -left).bit_length() - 1
            p = self.posting[self.starts[first] + depth + 1 - self.top]
            child = members & self.bits[p]
            yield child, p
            left &= ~child

    def end_list(self, members: int, depth: int) -> str:
        done = members & self.ends.get(depth, 0)
        names = []
        while done:
            first = done & -done
            names.append(str(self.ids[first.bit_length() - 1]))
            done ^= first
        return hashlib.sha256(",".join(names).encode()).hexdigest()

    def nodes(self) -> list[list]:
        """Rows of ``_NODE`` for the subtree, parents before children."""
        out: list[list] = []
        above: list[int] = []
        stack = [((1 << len(self.ids)) - 1, self.posting[0], self.top, -1)]
        while stack:
            members, p, depth, parent = stack.pop()
            me, n = len(out), members.bit_count()
            smallest = self.ids[(members & -members).bit_length() - 1]
            below = list(self.children(members, depth))
            out.append([
                smallest, depth, out[parent][0] if parent >= 0 else None, n, len(below), int(not below),
                (n - 1) * self.words[p], self.end_list(members, depth),
            ])
            above.append(parent)
            stack.extend((child, q, depth + 1, me) for child, q in below)
        for me in range(len(out) - 1, 0, -1):
            up = out[above[me]]
            up[5] += out[me][5]
            up[6] += out[me][6]
        return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of every shard, and at its first the key (up1, up2) of the heavy node above."""
    kept: list[pa.RecordBatch] = []

    def finish(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: rows[c].to_numpy() for c in ("s1", "s2", "conv_id", "depth", "d1", "d2", "words")}
        new = np.flatnonzero(np.diff(col["s1"]) | np.diff(col["s2"])) + 1
        edges = [0, *new.tolist(), rows.num_rows]
        found: list[list] = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            ids, local = np.unique(col["conv_id"][a:b], return_inverse=True)
            turn = np.stack([col[c][a:b] for c in ("depth", "d1", "d2")])
            _, posting = np.unique(turn, axis=1, return_inverse=True)
            nodes = Shard(ids.tolist(), local, posting.reshape(-1), col["words"][a:b], int(col["depth"][a])).nodes()
            nodes[0] += [rows["up1"][a].as_py(), rows["up2"][a].as_py(), True]
            found += nodes[:1] + [n + [None, None, False] for n in nodes[1:]]
            if len(found) > 20_000:
                yield out(found)
                found = []
        if found:
            yield out(found)

    def out(found: list[list]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        types = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*_NODE_NAMES, "up1", "up2", "top"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        s1, s2 = batch["s1"].to_numpy(), batch["s2"].to_numpy()
        begins = np.flatnonzero((s1 != s1[-1]) | (s2 != s2[-1]))
        at = int(begins[-1]) + 1 if len(begins) else 0  # the last shard of the batch may go on
        if kept and (at or (kept[-1]["s1"][-1].as_py(), kept[-1]["s2"][-1].as_py()) != (s1[0], s2[0])):
            yield from finish(pa.Table.from_batches([*kept, batch.slice(0, at)]))
            kept = []
        elif at:
            yield from finish(pa.Table.from_batches([batch.slice(0, at)]))
        kept.append(batch.slice(at))
    if kept:
        yield from finish(pa.Table.from_batches(kept))


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p1, p2, ends_sha256) of rows (p1, p2, conv_id) in order, one pass."""
    key = digest = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], ["p1", "p2", "ends_sha256"]
        )

    for batch in batches:
        p1, p2, ids = (c.to_numpy() for c in batch.columns)
        if not len(ids):
            continue
        edges = [0, *(np.flatnonzero(np.diff(p1) | np.diff(p2)) + 1).tolist(), len(ids)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            names = ",".join(map(str, ids[a:b].tolist()))
            if key == (int(p1[a]), int(p2[a])):
                digest.update(f",{names}".encode())
                continue
            if key is not None:
                yield row()
            key, digest = (int(p1[a]), int(p2[a])), hashlib.sha256(names.encode())
    if key is not None:
        yield row()


def trie(conversations: DataFrame, rebuilt: bool = True, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie of ``conversations`` (``rebuilt``: as their families begin)."""
    turns = cut(turns_of(conversations))
    ids = turns.select("conv_id").distinct()
    body = rebuild(turns) if rebuilt else turns.select("conv_id", F.lit(1).alias("part"), "pos", "d1", "d2", "words")
    path = cut(paths(ids, body))
    heavy = cut(
        path.groupBy("p1", "p2", "depth", "up1", "up2", "words")
        .agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
        .where(F.col("n_convs") > limit)
    )
    n_heavy = heavy.count()
    keys = maybe_broadcast(heavy.select("p1", "p2", F.lit(True).alias("heavy")), n_heavy)
    order = Window.partitionBy("conv_id").orderBy("depth")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    light = path.join(keys, ["p1", "p2"], "left").where("heavy is null").drop("heavy")
    light = light.select(
        "*", F.first("p1").over(sofar).alias("s1"), F.first("p2").over(sofar).alias("s2"),
    )
    shards = light.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "conv_id", "depth")
    nodes = cut(
        shards.select("s1", "s2", "conv_id", "depth", "d1", "d2", "words", "up1", "up2").mapInArrow(
            _shards, _NODE + ", up1 long, up2 long, top boolean"
        )
    )
    tops = nodes.where("top").select("up1", "up2", "conv_id", "depth", "n_leaves", "saved_tokens")

    # children and sums below heavy nodes
    under = tops.select("up1", "up2", "n_leaves", "saved_tokens").union(
        heavy.where("depth > 0").select("up1", "up2", F.lit(0).cast("long"), F.lit(0).cast("long"))
    )
    under = under.groupBy(F.col("up1").alias("p1"), F.col("up2").alias("p2")).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    own = heavy.join(under, ["p1", "p2"], "left").selectExpr(
        "conv_id", "depth", "if(n_children is null, 1L, leaves) as leaves",
        "(n_convs - 1) * words + coalesce(saved, 0L) as saved",
    )
    # each heavy node's own share goes to the prefixes of its smallest member
    sums = (
        path.select("conv_id", F.col("depth").alias("at"), "p1", "p2").join(own, "conv_id").where("at <= depth")
        .groupBy("p1", "p2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    )
    ended = path.where("last").select("p1", "p2", "conv_id").join(keys, ["p1", "p2"]).select("p1", "p2", "conv_id")
    ends = ended.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "conv_id").mapInArrow(
        _end_hashes, "p1 long, p2 long, ends_sha256 string"
    )
    above = maybe_broadcast(
        heavy.selectExpr("p1 as up1", "p2 as up2", "conv_id as parent_conv_id"), n_heavy
    )
    upper = (
        heavy.join(sums, ["p1", "p2"]).join(under.select("p1", "p2", "n_children"), ["p1", "p2"], "left")
        .join(ends, ["p1", "p2"], "left").join(above, ["up1", "up2"], "left")
        .selectExpr(
            "conv_id", "depth", "parent_conv_id", "n_convs", "coalesce(n_children, 0L) as n_children", "n_leaves", "saved_tokens",
            f"coalesce(ends_sha256, '{hashlib.sha256().hexdigest()}') as ends_sha256",
        )
    )
    lower = nodes.withColumnRenamed("parent_conv_id", "inside").join(above, ["up1", "up2"], "left").select(
        *(F.coalesce("inside", "parent_conv_id").alias(c) if c == "parent_conv_id" else F.col(c) for c in _NODE_NAMES)
    )
    return upper.union(lower)
