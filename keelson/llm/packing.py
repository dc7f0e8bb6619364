"""Packing token sequences by minimum bin slack.

Every document is tokenised where it lies and cut into full pieces of the
capacity and one remainder. The plan needs only how many pieces have each
length: at most ``capacity`` counts, however large the corpus. It repeats: put
the longest remaining length into a window, find by a bitset subset-sum
dynamic programme the multiset of remaining lengths that fills the window
closest to capacity, backtrack its counts, and use that pattern as often as the
counts allow. Pieces are numbered within their length on Spark and look up
their place in the plan.

Defined cases: null and empty texts are one piece holding only the end id;
repeated rows are packed each for itself; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.bpe import PieceIds, worker
from keelson.llm.common import blocks, bucket_counts, cut, numbered, whole_texts

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 1


def encode(texts: list[str], ids: PieceIds) -> list[bytes]:
    """The ids of each text, 4 bytes each.

    No token spans a blank or a line feed, and normalisation doesn't reach over
    one, so a text's ids are its words' ids in order.
    """
    words = [t.replace("\n", " ").split(" ") for t in texts]
    known = ids.lookup(set().union(*words))
    return [b"".join(map(known.__getitem__, ws)) for ws in words]


def cut_pieces(
    docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, with_ids: bool
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of every piece."""
    end = np.array([END_ID], "<u4").tobytes()
    fields = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 4 * capacity
        for batch in batches:
            doc_ids = batch.column(0)
            for first, texts in blocks(whole_texts(batch.column(1))):
                at: list[int] = []
                out: list[tuple] = []
                for i, ids in enumerate(encode([t.decode() for t in texts], worker(vocabulary, True)), first):
                    ids += end
                    for a in range(0, len(ids), step):
                        piece = ids[a : a + step]
                        at.append(i)
                        out.append((a // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece))
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(at)), *arrays][: len(names)], names)

    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return taken.mapInArrow(run, fields)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset (length: times) with the longest length and the least slack."""
    longest = max(counts)
    room = capacity - longest
    reach, full = 1, 1 << room
    mask = (full << 1) - 1
    steps: list[tuple[int, int, int]] = []  # length, copies taken at once, sums reachable before
    for length in sorted((n for n in counts if n <= room), reverse=True):
        spare = min(counts[length] - (length == longest), room // length)
        copies = 1
        while spare > 0 and not reach & full:
            take = min(copies, spare)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            spare -= take
            copies *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    used = {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, times in a sequence, first sequence, offset) by rank."""
    left = {n: c for n, c in counts.items() if c > 0}
    given = dict.fromkeys(left, 0)
    out: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in left}
    sequence = 0
    while left:
        used = fill(left, capacity)
        repeats = min(left[n] // k for n, k in used.items())
        offset = 0
        for n in sorted(used, reverse=True):
            k = used[n]
            out[n].append((given[n], k, sequence, offset))
            offset += n * k
            given[n] += k * repeats
            left[n] -= k * repeats
            if not left[n]:
                del left[n]
        sequence += repeats
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: its place (sequence_id, offset) and its ids' checksum (and the ids)."""
    pieces = cut(
        cut_pieces(docs, id_col, text_col, vocabulary, capacity, with_ids)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("one", F.lit(1))
    )
    counts = pieces.groupBy("length").agg(F.count("*").alias("n"))  # at most `capacity` rows
    places = plan({r.length: r.n for r in counts.collect()}, capacity)
    rows = numbered(pieces, ["length"], ["row"], "one", bucket_counts(counts, ["length"]))
    names = [c for c in pieces.columns if c not in ("row", "one")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                table = places[int(n)]
                first, times, base, start = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1].T
                sequence[at] = base + (rank[at] - first) // times
                offset[at] = start + (rank[at] - first) % times * n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(names).schema)
    placed = rows.select(*names, "rank").mapInArrow(run, fields + ", sequence_id long, offset long")
    return placed.withColumn("length", F.col("length").cast("long"))
