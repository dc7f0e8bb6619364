"""Suffix-array dedup: remove every byte covered by a string of fixed length that starts anywhere else too.

Sorting every suffix of a corpus would move each text hundreds of times. Three
steps make it small without losing a match:

1. Anchors. In every window of ``length`` bytes one gram is chosen by its
   content alone (least hash, leftmost of equals), so equal windows choose the
   same gram at the same place. Runs of windows that share an anchor travel as
   one thin record: a hash of the gram, a hash of all the run's bytes. A run
   whose bytes occur again is settled; a run whose gram occurs nowhere else
   holds no repeated window; of the others, one run of each kind of bytes goes on.
   What a task knows from its own block is summed
   there, so a common passage is a few rows from each task.
2. Suffixes. Of the few runs left (edges of passages) the bytes around the
   anchor are range-partitioned by the leading bytes of the anchor's suffix,
   with splitters that Spark samples. Each bucket sorts its windows by
   multikey quicksort over 8-byte tokens, refining only what is still tied;
   windows tied to the end are repeated. Splitters never part suffixes with
   equal leading bytes, so no match crosses a boundary unseen. Grams with very
   many runs are compared window by window through a count instead.
3. Removal. The repeated windows of each text are merged to spans.

Defined cases: null and empty texts, and texts shorter than ``length``, lose
nothing; equal texts of that length or more lose everything; repeated rows are
occurrences of their own; an empty table gives an empty table; other columns
pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import (
    blocks, cut, joined, maybe_broadcast, mix, prefix_hash, random_table, repeated, schema_of, span_hash, whole_texts,
)

LENGTH = 400
#: Bytes of text handled at once by a task; bytes around anchors in a bucket.
BLOCK, BUCKET = 1 << 20, 1 << 22
#: Windows that a task compares at once.
WINDOWS = 1 << 18
#: Runs of one gram beyond which windows are counted one by one.
HOT_GRAM = 20_000
#: Runs of one gram with different bytes that a block reports one by one.
REPORTED = 8

_TABLE = random_table(7)
_LOW = np.uint64((1 << 32) - 1)


def gram_length(length: int) -> int:
    return max(1, length * 16 // 25)


def anchor_runs(buf: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """(first window, last window, anchor) of every run of windows, never across texts."""
    gram = gram_length(length)
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none
    at = np.arange(len(buf) - gram + 1)
    key = (span_hash(prefix, at, at + gram) & ~_LOW) | at.astype(np.uint64)
    width, low = length - gram + 1, key
    step = 1
    while step * 2 <= width:  # minima over windows of twice the width
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    inside = np.zeros(len(buf) + 1, np.int64)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside)[: len(low)] > 0)
    if not len(window):
        return none, none, none
    anchor = (low[window] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(window) - 1]])
    return window[first], window[last], anchor[first]


def _sums(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value, the summed weights of its equals, and whether it is the first of them."""
    _, first, inverse = np.unique(values, return_index=True, return_inverse=True)
    is_first = np.zeros(len(values), bool)
    is_first[first] = True
    return np.bincount(inverse, weights)[inverse].astype(np.int64), is_first


def run_records(keys: list[bytes], texts: list[bytes], length: int) -> pa.RecordBatch:
    """A block's runs: route, whole (hash of the run's bytes), key, s1, s2, n, known and open.

    ``known``: 2 if the run's bytes occur again in the block, 1 if its gram
    does. Of runs known to match, a few stand for all under the gram's route;
    the others travel under a route of their own. ``open``: some run of this
    gram is not settled in the block.
    """
    copies: dict[bytes, int] = {}
    once: dict[bytes, bytes] = {}
    for k, t in zip(keys, texts, strict=True):
        copies[k] = copies.get(k, 0) + 1
        once[k] = t
    buf, starts, ends = joined(list(once.values()))
    prefix = prefix_hash(_TABLE[buf])
    s1, s2, anchor = anchor_runs(buf, prefix, starts, ends, length)
    gram = span_hash(prefix, anchor, anchor + gram_length(length))
    raw = buf.tobytes()
    digest = xxhash.xxh3_64_intdigest
    whole = np.fromiter(
        (digest(raw[a : b + length]) for a, b in zip(s1.tolist(), s2.tolist(), strict=True)), np.uint64, len(s1)
    )
    doc = np.searchsorted(ends, s1, side="right")
    n = np.fromiter(copies.values(), np.int64, len(copies))[doc]
    both = mix(gram) ^ whole
    n_gram, first_gram = _sums(gram, n)
    n_whole, first_whole = _sums(both, n)
    kinds, _ = _sums(gram, first_whole.astype(np.int64))
    known = np.where(n_whole > 1, 2, np.where(n_gram > 1, 1, 0))
    few = kinds <= REPORTED
    # every settled kind is reported once; of the others a few, or one for all
    stands = (first_whole & (few | (n_whole > 1))) | first_gram
    opened, _ = _sums(gram, (n_whole == 1).astype(np.int64))
    own = mix(both + starts[doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s1.astype(np.uint64))
    names = list(once)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(stands, gram, own).view(np.int64)), pa.array(whole.view(np.int64)),
            pa.array([names[d] for d in doc.tolist()], pa.binary()),
            pa.array((s1 - starts[doc]).astype(np.int32)), pa.array((s2 - starts[doc]).astype(np.int32)),
            pa.array(n_whole), pa.array(known.astype(np.int8)),
            pa.array(stands & (opened > 0)),
        ],
        ["route", "whole", "key", "s1", "s2", "n", "known", "open"],
    )


def _judged(docs: DataFrame, length: int) -> DataFrame:
    """(key, s1, s2, settled, compared) of every run that may hold a repeated window. ``docs``: key, text.

    ``compared``: not settled, or standing for its equals among runs that aren't.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in blocks(whole_texts(batch.column(1)), BLOCK):
                yield run_records(keys[first : first + len(texts)], texts, length)

    records = docs.mapInArrow(
        run, "route long, whole long, key binary, s1 int, s2 int, n long, known byte, open boolean"
    )
    judged = records.selectExpr(
        "*",
        "known = 2 or sum(n) over (partition by route, whole) > 1 as settled",
        "known = 1 or sum(n) over (partition by route) > 1 as likely",
        "struct(key, s1) = min(struct(key, s1)) over (partition by route, whole) as first",
    ).where("settled or likely")
    return judged.selectExpr(
        "key", "s1", "s2", "settled",
        "not settled or (first and max(open or not settled) over (partition by route)) as compared",
    )


def _edges(docs: DataFrame, judged: DataFrame, length: int) -> DataFrame:
    """(gram, lead, bytes, at, key, s1) around the anchor of every run to compare."""
    lead = min(16, gram_length(length))  # within the gram: equal grams are never parted
    wanted = judged.where("compared").groupBy("key").agg(F.collect_set(F.struct("s1", "s2")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, runs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, texts in blocks(whole_texts(batch.column(1)), BLOCK):
                buf, starts, ends = joined(texts)
                prefix = prefix_hash(_TABLE[buf])
                s1, s2, anchor = anchor_runs(buf, prefix, starts, ends, length)
                own = np.sort(np.array(
                    [starts[i] + r["s1"] for i in range(len(texts)) for r in runs[first + i]], np.int64
                ))
                at = np.flatnonzero(np.isin(s1, own))
                s1, s2, anchor = s1[at], s2[at], anchor[at]
                gram = span_hash(prefix, anchor, anchor + gram_length(length))
                doc = np.searchsorted(ends, s1, side="right")
                raw = buf.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram.view(np.int64)),
                        pa.array([raw[a : a + lead] for a in anchor.tolist()], pa.binary()),
                        pa.array([raw[a : b + length] for a, b in zip(s1.tolist(), s2.tolist(), strict=True)], pa.binary()),
                        pa.array((anchor - s1).astype(np.int32)),
                        pa.array([keys[first + d] for d in doc.tolist()], pa.binary()),
                        pa.array((s1 - starts[doc]).astype(np.int32)),
                    ],
                    ["gram", "lead", "bytes", "at", "key", "s1"],
                )

    fields = "gram long, lead binary, bytes binary, at int, key binary, s1 int"
    return docs.join(wanted.select(respread("key"), "runs"), "key").select("key", "text", "runs").mapInArrow(run, fields)


def respread(name: str) -> Column:
    """The binary column, computed anew: a join on it exchanges both sides, so Spark can split a hot key."""
    return F.unhex(F.hex(name)).alias(name)


def tied(text: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the equally long strings at ``at`` equal another one of their group.

    Multikey quicksort: by one 8-byte token after the other, only strings still
    tied are compared, and only groups that differ in a token are sorted.
    """
    words = np.ndarray((max(0, len(text) - 7),), "<u8", text.tobytes(), 0, (1,))
    left = np.argsort(group, kind="stable")
    group = np.unique(group[left], return_inverse=True)[1]
    offsets = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    for offset in [None, *offsets]:
        if offset is not None:
            token = words[at[left] + offset]
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            differs = token != token[head][group]
            if not differs.any():
                continue
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[differs]] = True
            part = np.flatnonzero(mixed[group])
            order = part[np.lexsort((token[part], group[part]))]
            left[part], token[part] = left[order], token[order]
            cut_here = np.concatenate([[True], (group[1:] != group[:-1]) | (token[1:] != token[:-1])])
            group = np.cumsum(cut_here) - 1
        size = np.bincount(group)
        keep = size[group] > 1
        left, group = left[keep], np.unique(group[keep], return_inverse=True)[1]
        if not len(left):
            break
    out = np.zeros(len(at), bool)
    out[left] = True
    return out


def _windows(batch_bytes: list[bytes], length: int):
    """(buffer, run, place of each window in its run, where it stands in the buffer)."""
    text, starts, ends = joined(batch_bytes)
    count = ends - starts - length + 1
    run = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    return text, run, place, starts[run] + place


def _steps(gram: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(runs, d0, d1): whole grams of about ``WINDOWS`` windows, a larger one by distances d0 <= d < d1 to the anchor.

    Equal windows hold their anchor at the same distance, so no step parts them.
    """
    order = np.argsort(gram, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1], [True]]))
    every = int(anchor.max()) + 1
    begin = edges[0]
    for end in edges[1:].tolist():
        runs = order[begin:end]
        n = int(count[runs].sum())
        following = edges[np.searchsorted(edges, end) + 1] if end < edges[-1] else None
        if following is not None and n + int(count[order[end:following]].sum()) <= WINDOWS:
            continue
        step = every if n <= WINDOWS else max(1, WINDOWS // len(runs))
        for d in range(0, every, step):
            yield runs, d, d + step
        begin = end


def _spans(keys: list[bytes], s1: np.ndarray, run: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Neighbouring repeated windows as (key, s1, s2)."""
    if len(run):
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(run)]]) - 1
    else:
        first = last = np.zeros(0, np.int64)
    own = run[first]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([keys[i] for i in own.tolist()], pa.binary()),
            pa.array((s1[own] + place[first]).astype(np.int32)), pa.array((s1[own] + place[last]).astype(np.int32)),
        ],
        ["key", "s1", "s2"],
    )


def _sorted_buckets(edges: DataFrame, length: int, buckets: int) -> DataFrame:
    """(key, s1, s2): repeated windows, found by sorting range-partitioned suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        gram, s1 = table["gram"].to_numpy(), table["s1"].to_numpy()
        anchor, keys = table["at"].to_numpy(), table["key"].to_pylist()
        order = np.flatnonzero(repeated(gram))
        if not len(order):
            return
        size = pa.compute.binary_length(table["bytes"]).to_numpy()
        for runs, d0, d1 in _steps(gram[order], size[order] - length + 1, anchor[order]):
            some = order[runs]
            text, starts, ends = joined(table["bytes"].take(pa.array(some)).to_pylist())
            low = np.clip(anchor[some] - d1 + 1, 0, ends - starts - length + 1)
            high = np.clip(anchor[some] - d0 + 1, 0, ends - starts - length + 1)
            own = np.repeat(np.arange(len(some)), high - low)
            place = np.arange(len(own)) + np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low)
            group = mix(gram[some].view(np.uint64))[own] + (anchor[some][own] - place).astype(np.uint64)
            same = tied(text, starts[own] + place, group, length)
            if same.any():
                yield _spans(keys, s1, some[own[same]], place[same])

    dealt = edges.repartitionByRange(buckets, "lead", "gram")
    return dealt.select("gram", "bytes", "at", "key", "s1").mapInArrow(run, "key binary, s1 int, s2 int")


def _counted_windows(edges: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many runs: every window counts under a digest of its bytes.

    A block sums its own windows first, so a common window is a row from each block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, s1 = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            text, own, place, at = _windows(batch.column(0).to_pylist(), length)
            raw = text.tobytes()
            digests = [xxhash.xxh3_128_digest(raw[a : a + length]) for a in at.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digests, pa.binary()), pa.array([keys[i] for i in own.tolist()], pa.binary()),
                    pa.array((s1[own] + place).astype(np.int32)),
                ],
                ["window", "key", "s1"],
            )

    windows = edges.select("bytes", "key", "s1").mapInArrow(run, "window binary, key binary, s1 int")
    common = windows.groupBy("window").count().where("count > 1")
    return windows.join(common.select(respread("window")), "window").select("key", "s1", F.col("s1").alias("s2"))


def repeated_windows(docs: DataFrame, length: int = LENGTH, hot: int = HOT_GRAM) -> DataFrame:
    """(key, runs): the repeated windows [s1, s2] of every text that has some. ``docs``: key, text."""
    judged = cut(_judged(docs, length))
    edges = cut(_edges(docs, judged, length))
    size = edges.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    many = cut(edges.groupBy("gram").count().where(F.col("count") > hot).select("gram"))
    n_many = many.count()
    found = judged.where("settled").select("key", "s1", "s2")
    cold = edges
    if n_many:
        listed = maybe_broadcast(many, n_many)
        cold = edges.join(listed, "gram", "left_anti")
        found = found.union(_counted_windows(edges.join(listed, "gram", "left_semi"), length))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.union(_sorted_buckets(cold, length, max(parts, -(-size // BUCKET))))
    return cut(found.groupBy("key").agg(F.collect_set(F.struct("s1", "s2")).alias("runs")))


def merged(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal covered byte ranges of some runs of windows."""
    out: list[list[int]] = []
    for a, b in sorted((r["s1"], r["s2"] + length) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _long(docs: DataFrame, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose text can hold a match, with the digest ``__key`` of the text; the other rows."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    return docs.where(size >= length).withColumn("__key", F.unhex(F.md5(text_col))), docs.where(size < length)


def _with_runs(docs: DataFrame, text_col: str, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    long, short = _long(docs, text_col, length)
    runs = repeated_windows(long.select(F.col("__key").alias("key"), F.col(text_col).alias("text")), length, hot)
    runs = runs.select(respread("key").alias("__key"), F.col("runs").alias("__runs"))
    return long.join(runs, "__key", "left").drop("__key"), short


def digests(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_GRAM
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``."""
    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    long, short = _with_runs(taken, "text", length, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = whole_texts(batch.column(1)).to_pylist(), batch.column(2).to_pylist()
            spans = [merged(r or [], length) for r in runs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(map(len, texts), pa.int64()),
                    pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array(map(len, spans), pa.int64()),
                    pa.array([hashlib.sha256(kept_bytes(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    rest = short.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return long.select("doc_id", "text", "__runs").mapInArrow(run, fields).union(rest)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, text_col: str = "text", hot: int = HOT_GRAM
) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text.

    Spans are bytes: of a character cut in two, the bytes left over go too.
    """
    long, short = _with_runs(docs, text_col, length, hot)
    at = docs.columns.index(text_col)
    long = long.select(*docs.columns, "__runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = whole_texts(batch.column(at)).to_pylist(), batch.column(len(docs_columns)).to_pylist()
            left = [
                kept_bytes(t, merged(r, length)).decode("utf-8", "ignore") if r else t.decode()
                for t, r in zip(texts, runs, strict=True)
            ]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(left, pa.string())
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = docs.columns
    return long.mapInArrow(run, schema_of(docs)).union(short)
