"""Mixing sources to target weights by Poisson replication.

A source's documents are repeated at the mean rate that brings the source to
its target share of a budget of bytes. Each document draws its own count: a
uniform number from a hash of the seed and the document inverts the Poisson
distribution of that mean. Documents are exploded by their counts and spread by
a hash of document and copy, which is a global shuffle; ``shuffle_key`` gives
its order.

Defined cases: a null source is a source of its own; null texts have no bytes;
a source without bytes is repeated at the rate ``epochs``; sources missing from
given weights weigh 0; rows equal in id and text draw the same count; an empty
table gives an empty table; other columns pass through, whatever their names
(``copy``, ``n_copies`` and ``shuffle_key`` are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut, maybe_broadcast, set_aside, without

#: Target weight of a source: its share of bytes to this power.
FLATTEN = 0.7
#: Size of the mix, in times the input's bytes.
EPOCHS = 1.0
#: Larger means are drawn as sums of several draws of at most this mean.
DRAW_MEAN = 8.0
#: Terms of the distribution; beyond them a draw of mean 8 is below 2**-52.
TERMS = 64


def source_rates(
    docs: DataFrame, weights: DataFrame | None, epochs: float, source_col: str, text_col: str
) -> DataFrame:
    """(source, draws, cdf) of each source: how many draws, and the distribution of one."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).cast("double").alias("bytes"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow("bytes", F.lit(FLATTEN)))
    else:
        w = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        weighted = sizes.join(w, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").na.fill({"weight": 0.0})
    weighted = cut(weighted)
    all_bytes, all_weight = weighted.agg(F.sum("bytes"), F.sum("weight")).first()
    mean = F.lit(epochs)
    if all_weight:
        wanted = F.lit(epochs * all_bytes) * F.col("weight") / F.lit(all_weight) / F.col("bytes")
        mean = F.when(F.col("bytes") > 0, wanted).otherwise(mean)
    rated = weighted.select("source", mean.cast("double").alias("mean"))
    draws = F.greatest(F.ceil(F.col("mean") / DRAW_MEAN), F.lit(1))
    terms = F.expr(
        f"aggregate(sequence(1, {TERMS - 1}), "
        "named_struct('p', exp(-one), 'c', exp(-one), 'cdf', array(exp(-one))), "
        "(a, k) -> named_struct('p', a.p * one / k, 'c', a.c + a.p * one / k, 'cdf', array_append(a.cdf, a.c + a.p * one / k)), "
        "a -> a.cdf)"
    )
    return rated.withColumn("draws", draws.cast("int")).withColumn(
        "one", F.col("mean") / F.col("draws")
    ).select("source", "mean", "draws", terms.alias("cdf"))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    epochs: float = EPOCHS,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` repeated to the target weights, with copy, n_copies and shuffle_key, shuffled globally."""
    away, back = set_aside(without(docs.columns, ["copy", "n_copies", "shuffle_key"]))
    rates = source_rates(docs, weights, epochs, source_col, text_col)
    rates = maybe_broadcast(rates.withColumnRenamed("source", "__rated"), rates.count())
    ident = F.concat_ws(
        "|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text_col), F.lit("")))
    )
    drawn = F.expr(
        "cast(aggregate(transform(sequence(1, draws), j -> "
        "conv(substring(md5(concat_ws('|', __ident, cast(j as string))), 1, 13), 16, 10) / 4503599627370496D), "
        "0, (n, u) -> n + size(filter(cdf, c -> c <= u))) as int)"
    )
    taken = docs.select(*away, F.col(source_col).alias("__source"), ident.alias("__ident"))
    joined = taken.join(rates, F.col("__source").eqNullSafe(F.col("__rated")))
    counted = joined.withColumn("n_copies", drawn).where("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("__ident"), F.lit("c"), F.col("copy").cast("string"))), 1, 15), 16, 10)
    keyed = copies.select(*back, "copy", "n_copies", key.cast("long").alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
