"""Token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

A text is cut before every run of white space, where the tokenizer's own
pre-tokens always end; each cut piece is counted on its own. Tier one is a
broadcast table of the lengths of frequent pieces; tier two is a bounded cache
in each Python worker that the tokenizer fills with the misses of a block.

The table is of the most frequent pieces of all documents: each map task counts
its own in a bounded counter (Misra-Gries: when it is full, all counts go down
alike and the least leave), tasks' counters are summed on Spark, and pieces above
a count that at most :data:`TABLE_SIZE` reach are collected and broadcast. Text isn't
shuffled, only each task's counter. The table only saves time: a piece it lacks
is encoded, so counts never depend on it.

Defined cases: null and empty texts have 0 tokens and 0 bytes; special strings
inside texts count as the library counts them by default; repeated rows are
counted alike; an empty table gives an empty table; other columns are carried
as asked.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.bpe import CACHE_PIECE, PieceIds, worker
from keelson.llm.common import blocks, cut, schema_of, set_aside, whole_texts, without

VOCABULARY = "byte_bpe_50k.json"
#: Entries of the broadcast table and of what a map task reports, at most (a piece has up to CACHE_PIECE characters).
TABLE_SIZE = 20_000
#: Steps of the scale of counts to a doubling, on which the table's least count is found.
STEPS = 8

#: Unicode white space, as the tokenizer's pattern sees it.
SPACE = " \t\n\v\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{SPACE}]{{2}}")
_PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def pieces(text: str) -> tuple[list[str], list[str]]:
    """(pieces that begin with one blank, written without it; all other pieces).

    Where no two white-space characters meet, a blank belongs to the word after
    it and a line feed stands alone, so plain splitting finds the pieces.
    """
    blank: list[str] = []
    other: list[str] = []
    if _RUN.search(text):
        for p in _PIECES.findall(text):
            if p[0] == " " and _RUN.match(p) is None:
                blank.append(p[1:])
            else:
                other.append(p)
        return blank, other
    lines = text.split("\n")
    for line in lines:
        first, *rest = line.split(" ")
        blank += rest
        if first:
            other.append(first)
    other += ["\n"] * (len(lines) - 1)
    return blank, other


def count(texts: list[str], table: dict[str, int], ids: PieceIds) -> list[int]:
    """Tokens of each text; ``table`` holds lengths of frequent pieces, ``ids`` the worker's cache."""
    cut = [pieces(t) for t in texts]
    words = {" " + w for w in set().union(*(b for b, _ in cut))}.union(*(o for _, o in cut))
    known = {w: table[w] for w in words if w in table}
    missing = words - known.keys()
    found = ids.lookup(missing)
    known.update((w, len(found[w]) // 4) for w in missing)
    after_blank = {w[1:]: n for w, n in known.items() if w[0] == " "}
    return [sum(map(after_blank.__getitem__, b)) + sum(map(known.__getitem__, o)) for b, o in cut]


class Frequent:
    """Counts of the most frequent pieces seen, of at most ``size`` after :meth:`trim` and four times that before.

    A count is too small by at most what :meth:`trim` took off, never too large.
    """

    def __init__(self, size: int = TABLE_SIZE) -> None:
        self.size, self.blank, self.other = size, Counter(), Counter()

    def add(self, text: str) -> None:
        blank, other = pieces(text)
        self.blank.update(blank)
        self.other.update(other)
        if len(self.blank) + len(self.other) > 4 * self.size:
            self.trim()

    def trim(self) -> None:
        counts = sorted([*self.blank.values(), *self.other.values()], reverse=True)
        off = counts[self.size] if len(counts) > self.size else 0
        if off:
            self.blank = Counter({w: n - off for w, n in self.blank.items() if n > off})
            self.other = Counter({w: n - off for w, n in self.other.items() if n > off})

    def found(self) -> dict[str, int]:
        """Counts of pieces short enough for the table."""
        self.trim()
        every = {" " + w: n for w, n in self.blank.items()} | self.other
        return {w: n for w, n in every.items() if len(w) <= CACHE_PIECE}


def frequent_table(docs: DataFrame, text_col: str, vocabulary: str, size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of the most frequent pieces of all documents, at most ``size``."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(size)
        for batch in batches:
            for _, texts in blocks(whole_texts(batch.column(0))):
                for t in texts:
                    frequent.add(t.decode())
        found = frequent.found()
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["piece", "seen"]
        )

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = worker(vocabulary, False).lookup(set(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(ids[w]) // 4 for w in words], pa.int32())], ["piece", "n"]
            )

    counted = docs.select(F.col(text_col).alias("t")).mapInArrow(seen, "piece string, seen long")
    step = F.floor(F.log2("seen") * STEPS).cast("int").alias("step")
    merged = cut(counted.groupBy("piece").agg(F.sum("seen").alias("seen")).select("piece", step))
    least, total = None, 0
    for r in merged.groupBy("step").count().orderBy(F.desc("step")).collect():  # some hundreds of steps
        total += r["count"]
        if total > size:
            break
        least = r["step"]
    if least is None:
        return {}
    top = merged.where(F.col("step") >= least).select("piece")
    return {r.piece: r.n for r in top.mapInArrow(lengths, "piece string, n int").collect()}


def count_tokens(
    docs: DataFrame, carry: list[str], text_col: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """The columns ``carry`` with n_bytes (UTF-8) and n_tokens of the whole text."""
    carry = without(carry, ["n_bytes", "n_tokens"])
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, text_col, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes: list[int] = []
            n_tokens: list[int] = []
            for _, texts in blocks(whole_texts(batch.column(len(carry)))):
                n_bytes += map(len, texts)
                n_tokens += count([t.decode() for t in texts], table.value, worker(vocabulary, False))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                [*carry, "n_bytes", "n_tokens"],
            )

    taken = docs.select(*set_aside(carry)[0], F.col(text_col).alias("__text"))
    return taken.mapInArrow(run, schema_of(docs.select(*carry), "n_bytes long, n_tokens long"))
