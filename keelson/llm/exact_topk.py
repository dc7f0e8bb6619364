"""Exact top-k inner-product search as a Voronoi kNN join.

A bounded sample of vectors serves as pivots; data and queries belong to their
nearest pivot's cell. Queries are packed, cell by cell, into blocks of bounded
size. Each query first finds its k + 1 best among a bounded part of the data of
its block's cells: the last of them is its bound, which any better row must reach. For a block b and a cell with pivot p the summaries give the distance

    reach(b, p) = min over q in b of (bound(q) - q.p) / |q|

and since q.x = q.p + q.(x - p) <= q.p + |q| |x - p|, a row x of that cell can
matter to the block only if |x - p| >= reach(b, p). Exactly those rows are sent
to the block, which is solved in slices by matrix products; the best k of a
query over all slices are exact.

Equal vectors score equally and ties go to smaller ids, so of equal data
vectors only the k + 1 smallest ids can ever be returned: the others are left
out before anything is sent (a window that Spark limits before its shuffle).
Equal query vectors are solved once.

Defined cases: rows with a null id, a null vector, or a null or non-finite
component take no part; shorter vectors count as padded with zeros; a query's own
row is no candidate; rows equal in id and vector count once, rows of one id with
different vectors are different rows; with fewer candidates
all are returned; an empty table gives an empty table. Scores must fit a long
(components to about 2**26 at any usual length).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import cut, maybe_broadcast

PIVOTS = 64
#: Distinct queries solved together, data rows in a slice, rows of a cell that give bounds.
BLOCK, SLICE, SEEDS = 512, 8_192, 1_024
#: Rows of the (block, cell) summary up to which it is broadcast.
SUMMARY_ROWS = 1_000_000
#: Components of a vector (more are refused).
MAX_WIDTH = 65_536


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable(vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, padded with zeros to ``width``."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point only where that is exact."""
    if len(queries) and len(data):
        largest = float(np.abs(queries).max()) * float(np.abs(data).max()) * queries.shape[1]
        if largest < 2.0**53:
            return (queries.astype(float) @ data.T.astype(float)).astype(np.int64)
    return queries @ data.T


def _best(scores: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """(query row, data column) of the k largest scores of each query, ties to earlier columns."""
    for i, row in enumerate(scores):
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            above = np.flatnonzero(row > least)
            ties = np.flatnonzero(row == least)[: k - len(above)]
            picked = np.concatenate([above, ties])
        else:
            picked = np.arange(len(row))
        for j in picked:
            yield i, int(j)


_FOUND = "query long, vec_id long, score long, same boolean"


def _solve(queries: pd.DataFrame, data: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of some data for every query of a block; ``same``: the vectors are equal."""
    out: list[tuple[int, int, int, bool]] = []
    if len(queries) and len(data):
        data = data.sort_values("vec_id")
        q = np.frombuffer(b"".join(queries["v"]), np.int64).reshape(len(queries), -1)
        x = np.frombuffer(b"".join(data["v"]), np.int64).reshape(len(data), -1)
        ids, own = data["vec_id"].tolist(), queries["query"].tolist()
        q2, x2 = (q * q).sum(axis=1), (x * x).sum(axis=1)
        s = _scores(q, x)
        out = [
            (own[i], ids[j], int(s[i, j]), bool(q2[i] + x2[j] == 2 * s[i, j])) for i, j in _best(s, k)
        ]
    return pd.DataFrame(out, columns=["query", "vec_id", "score", "same"])


def _solved(queries: DataFrame, data: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of every query over all groups of ``keys``."""
    pairs = queries.groupBy(*keys).cogroup(data.groupBy(*keys))
    found = pairs.applyInPandas(lambda q, x: _solve(q, x, k), _FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _assign(rows: DataFrame, pivots: np.ndarray, width: int, columns: list[str]) -> DataFrame:
    """``columns`` with v (the padded vector's bytes), cell and dist (to the cell's pivot)."""
    norms = (pivots.astype(float) ** 2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(len(columns)), width)
            f = x.astype(float)
            apart = (f**2).sum(axis=1)[:, None] - 2 * f @ pivots.T.astype(float) + norms
            cell = apart.argmin(axis=1)
            dist = np.sqrt(((f - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(dist)],
                [*columns, "v", "cell", "dist"],
            )

    taken = rows.select(*columns, "vector")
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*columns).schema)
    return taken.mapInArrow(run, fields + "v binary, cell int, dist double")


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    block: int = BLOCK,
    slice_rows: int = SLICE,
    seed_rows: int = SEEDS,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best candidates of every query."""
    clean = rows.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    same = Window.partitionBy("vector").orderBy("vec_id")
    data = (
        clean.select("vec_id", "vector").distinct()
        .withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")
    )
    asked = clean.where("asks").select("vec_id", "vector").distinct()
    asked_once = cut(asked.select("vector").distinct().withColumn("query", F.monotonically_increasing_id()))

    width = max(1, clean.agg(F.max(F.size("vector"))).first()[0] or 0)
    if width > MAX_WIDTH:
        raise ValueError(f"vectors of more than {MAX_WIDTH} components")
    sample = clean.select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(pivots).collect()
    centres = np.zeros((max(1, len(sample)), width), np.int64)
    for i, r in enumerate(sample):
        centres[i, : len(r.vector)] = r.vector
    data = cut(_assign(data, centres, width, ["vec_id"]))
    queries = cut(_assign(asked_once, centres, width, ["query"]))
    queries, blocks_of = _in_blocks(queries, len(centres), block)

    seed_order = Window.partitionBy("cell").orderBy(F.xxhash64("vec_id"), "vec_id")
    seeds = data.withColumn("n", F.row_number().over(seed_order)).where(F.col("n") <= seed_rows)
    seeds = seeds.join(F.broadcast(blocks_of), "cell").select("block", "vec_id", "v")
    first = _solved(queries.select("query", "v", "block"), seeds, ["block"], k + 1)
    bounds = first.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).alias("bound"))
    reach = cut(_reach(queries.join(bounds, "query", "left"), centres))

    # each row goes to the blocks that it may matter to, each block's rows to slices
    n_slices = max(1, -(-data.count() // slice_rows))
    sent = data.join(maybe_broadcast(reach, reach.count(), SUMMARY_ROWS), "cell").where("dist >= reach")
    sent = sent.select("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_slices)).alias("slice"), "vec_id", "v")
    spread = queries.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slices - 1).cast("long"))).alias("slice"), "query", "v")
    best = _solved(spread, sent, ["block", "slice"], k + 1)

    # back to every query row; its own row goes
    named = asked.withColumnRenamed("vec_id", "query_id").join(asked_once, "vector").select("query_id", "query")
    others = named.join(best, "query").where("not (same and vec_id = query_id)")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _in_blocks(queries: DataFrame, cells: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Queries with their block, and the (cell, block) pairs. A large cell is split, small ones share a block."""
    sizes = {r.cell: r.n for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    places, at, room = [], 0, block
    for cell in range(cells):
        n = sizes.get(cell, 0)
        if n > room:
            at, room = at + (room < block), block
        parts = max(1, -(-n // block))
        places.append((cell, at, parts))
        if parts > 1:
            at, room = at + parts, block
        else:
            room -= n
    table = queries.sparkSession.createDataFrame(places, "cell int, first long, parts long")
    dealt = queries.join(F.broadcast(table), "cell").withColumn(
        "block", F.col("first") + F.pmod(F.xxhash64("query"), F.col("parts"))
    )
    pairs = table.select("cell", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("block"))
    return dealt.drop("first", "parts"), pairs


def _reach(queries: DataFrame, centres: np.ndarray) -> DataFrame:
    """(block, cell, reach): rows of the cell nearer to its pivot than ``reach`` can't matter to the block."""
    f = centres.astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, bound = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            q = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(len(blocks), -1).astype(float)
            norm = np.sqrt((q * q).sum(axis=1))
            free = np.isnan(bound) | (norm == 0)
            reach = (bound[:, None] - q @ f.T) / np.where(free, 1, norm)[:, None]
            reach -= 1e-6 * (1 + np.abs(reach))  # rounding must never exclude a row
            reach[free] = -1.0
            for b in np.unique(blocks):
                least = reach[blocks == b].min(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(f), b)), pa.array(np.arange(len(f), dtype=np.int32)), pa.array(least),
                    ],
                    ["block", "cell", "reach"],
                )

    found = queries.select("block", "v", "bound").mapInArrow(run, "block long, cell int, reach double")
    return found.groupBy("block", "cell").agg(F.min("reach").alias("reach"))
