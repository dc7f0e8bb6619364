"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are 64-bit majority votes over the XXH64 (seed 42) of a document's
word shingles. Two fingerprints link at ``max_bits`` or fewer differing bits;
components of links are the groups.

Search: the bits are grouped so that correlated bits share a partition. With
thresholds ``t_i`` whose sum is ``max_bits - m + 1`` every linked pair agrees
within ``t_i`` bits in at least one of the ``m`` partitions. A dynamic
programme picks the thresholds (and the number of partitions) of least
estimated cost from the candidate counts seen in a bounded sample. A
fingerprint is indexed under its exact partition value and probes all values
within ``t_i`` bits. Buckets are verified where they lie: only true links leave
them, at most one for each member (a spanning forest), so neither candidates
nor all pairs of a group are ever emitted. Buckets with many members are split
by the remaining bits first. Links are closed to components by alternating
star contraction, with lineage cut each round.

Defined cases: null and empty texts have the fingerprint zero and link like any
other; equal fingerprints count once, with the smallest doc_id; null doc_ids
get the component of their fingerprint (null if nothing there has an id); an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import blocks, cut, maybe_broadcast, schema_of, whole_texts

SEED = 42
#: Fingerprints sampled to place partitions and thresholds (results don't depend on it).
SAMPLE = 2048
#: Index entries of a bucket beyond which it is split by the remaining bits.
BUCKET_SPLIT = 4096
#: Cost of comparing one candidate pair in numpy, in shuffled signatures.
PAIR_COST = 0.02

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.translate(_LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    first = [0, *(ends[: len(words) - size].tolist())]
    last = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)]


def fingerprints_of(texts: list[bytes], size: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, size), "<u8")
        if len(hashes):
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes = bits.sum(axis=0, dtype=np.int64)
            out[i] = weights[2 * votes > len(hashes)].sum()
    return out


def fingerprints(rows: DataFrame, size: int = 3) -> DataFrame:
    """``rows`` with their column ``text`` replaced by ``fp`` (the fingerprint's 64 bits as a long)."""
    carry = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints_of(t, size) for _, t in blocks(whole_texts(batch.column(len(carry))))]
            if parts:
                fp = pa.array(np.concatenate(parts).view(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], [*carry, "fp"])

    return rows.select(*carry, "text").mapInArrow(run, schema_of(rows.select(*carry), "fp long"))


# ---------------------------------------------------------------- partitions


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits into ``parts`` equal groups, each grown around a bit by correlation."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(axis=0)
    scale = np.sqrt((bits**2).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(scale, scale), 1e-9)
    left, groups = list(range(64)), []
    for p in range(parts):
        size = 64 * (p + 1) // parts - 64 * p // parts
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def plan(sample: np.ndarray, total: int, max_bits: int) -> list[tuple[int, int]]:
    """(bit mask, threshold) of each partition that is searched.

    For each number of partitions the dynamic programme spends the threshold
    sum ``max_bits - parts + 1`` (minus one means: not searched) where the
    estimated signatures and candidate pairs grow least; the cheapest wins.
    """
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    x = sample[:, None] ^ sample[None, :]
    upper = np.triu_indices(len(sample), 1)
    x = x[upper]
    for parts in range(1, max_bits + 2):
        groups = group_bits(sample, parts)
        budget = max_bits - parts + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            apart = np.bitwise_count(x & np.uint64(_mask(g))) if len(x) else np.zeros(0)
            nxt: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, picks) in table.items():
                for t in range(-1, max_bits + 1):
                    ball = sum(comb(len(g), e) for e in range(t + 1))
                    seen = float((apart <= t).mean()) if len(x) and t >= 0 else 0.0
                    near = max(seen, ball / 2.0 ** len(g))
                    extra = total * ball + PAIR_COST * near * total * total / 2
                    at = (cost + (extra if t >= 0 else 0.0), [*picks, t])
                    if spent + t not in nxt or at[0] < nxt[spent + t][0]:
                        nxt[spent + t] = at
            table = nxt
        cost, picks = table[budget]
        if cost < best[0]:
            best = cost, [(_mask(g), t) for g, t in zip(groups, picks, strict=True) if t >= 0]
    return best[1]


def signatures(fps: DataFrame, chosen: list[tuple[int, int]]) -> DataFrame:
    """(part, key, fp, probe): the exact partition value, and the probes around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part, (mask, threshold) in enumerate(chosen):
                bits = [b for b in range(64) if mask >> b & 1]
                value = fp & np.uint64(mask)
                for e in range(threshold + 1):
                    for flips in combinations(bits, e):
                        key = value ^ np.uint64(_mask(list(flips)))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(fp), part, np.int32)),
                                pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)),
                                pa.array(np.full(len(fp), e > 0)),
                            ],
                            ["part", "key", "fp", "probe"],
                        )

    return fps.select("fp").mapInArrow(run, "part int, key long, fp long, probe boolean")


# ---------------------------------------------------------------- verification


def _remaining(mask: int, pieces: int) -> list[np.uint64]:
    """The bits outside ``mask`` in ``pieces`` masks."""
    bits = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(bits) * i // pieces for i in range(pieces + 1)]
    return [np.uint64(_mask(bits[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def bucket_links(fp: np.ndarray, max_bits: int, mask: int = 0, leaf: int = 256) -> list[tuple[int, int]]:
    """A spanning forest of the links among a bucket's fingerprints.

    Small sets are compared directly; larger ones are split into ``max_bits + 1``
    pieces of the bits not used yet, in one of which every linked pair is equal.
    """
    fp = np.unique(fp)
    if len(fp) < 2:
        return []
    rest = 64 - bin(mask).count("1")
    if len(fp) <= leaf or rest < max_bits + 1:
        return _forest(fp, max_bits)
    out: list[tuple[int, int]] = []
    for piece in _remaining(mask, max_bits + 1):
        value = fp & piece
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for run in np.split(order, cuts):
            if len(run) > 1:
                out += bucket_links(fp[run], max_bits, mask | int(piece), leaf)
    return out


def _forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    left, out = fp, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            out += [(int(at), int(x)) for x in left[near]]
            queue += list(left[near])
            left = left[~near]
    return out


def links(sigs: DataFrame, chosen: list[tuple[int, int]], max_bits: int) -> DataFrame:
    """True links (a, b) found in the buckets of (part, key, piece, sub)."""
    index = sigs.where("not probe").groupBy("part", "key").count()
    hot = cut(index.where(F.col("count") > BUCKET_SPLIT).select("part", "key", F.lit(True).alias("hot")))
    n_hot = hot.count()
    pieces = [_remaining(mask, max_bits + 1) for mask, _ in chosen]

    def signed(v: np.uint64) -> int:
        return int(np.array([v]).view(np.int64)[0])

    # (piece, value of its bits) for each piece of a hot bucket, else one (-1, 0)
    subs = F.lit(None)
    for part, masks in enumerate(pieces):
        subs = F.when(
            F.col("part") == part,
            F.array(*[
                F.struct(F.lit(j).alias("piece"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("sub"))
                for j, m in enumerate(masks)
            ]),
        ).otherwise(subs)
    one = F.array(F.struct(F.lit(-1).alias("piece"), F.lit(0).cast("long").alias("sub")))
    if n_hot:
        sigs = sigs.join(maybe_broadcast(hot, n_hot), ["part", "key"], "left").withColumn(
            "s", F.explode(F.when(F.col("hot"), subs).otherwise(one))
        )
    else:
        sigs = sigs.withColumn("s", F.explode(one))
    dealt = (
        sigs.select("part", "key", "s.piece", "s.sub", "fp")
        .repartition("part", "key", "piece", "sub")
        .sortWithinPartitions("part", "key", "piece", "sub")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)  # the last bucket seen, until its end is known
        for batch in chain(batches, [None]):
            rows, keep = held, 0
            if batch is not None:
                columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
                rows, keep = np.concatenate([held, np.stack(columns, axis=1)]), 1
            change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            edges = np.concatenate([[0], change, [len(rows)]])
            held = rows[edges[-2] :] if keep else held[:0]
            edges = edges[: len(edges) - keep]
            found: list[tuple[int, int]] = []
            for i in np.flatnonzero(np.diff(edges) > 1):
                mask, threshold = chosen[rows[edges[i], 0]]
                fp = np.ascontiguousarray(rows[edges[i] : edges[i + 1], 4]).view(np.uint64)
                found += bucket_links(fp, max_bits, 0 if threshold else mask)
            if found:
                pairs = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) can reach.

    Alternating large-star and small-star contraction; every step is a grouped
    minimum and a join on the node, so a hub's edges may be spread by Spark.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour points to the smallest one
        large = (
            both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: every node and its smaller neighbours point to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        before = state


# ---------------------------------------------------------------- operator


def _grouped(prints: DataFrame, max_bits: int) -> DataFrame:
    """``prints`` (with doc_id and fp) and the component_id of each row, and ``root``, its component's smallest fp."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    total = distinct.count()
    taken = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r.fp for r in taken], np.int64).view(np.uint64)
    chosen = plan(sample, total, max_bits)
    roots = components(links(signatures(distinct, chosen), chosen, max_bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(smallest, "root"), "fp")


def near_duplicates(
    docs: DataFrame, size: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _grouped(cut(fingerprints(taken, size)), max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, size: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs`` for each component: that of smallest id (nulls last), one of repeated rows.

    Rows are told apart by a digest of id and text, so winners are chosen on thin
    rows and whole texts move once.
    """
    ident = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))))
    keyed = docs.withColumn("__key", F.unhex(ident))
    thin = keyed.select("__key", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    groups = _grouped(cut(fingerprints(thin, size)), max_bits)
    first = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "__key")
    winners = groups.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("__key")
    once = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("__key"))).where("__n = 1")
    return once.join(winners, "__key", "left_semi").select(*docs.columns)
