"""The registered queries op1 to op13: each operator over its whole table, with production parameters.

Queries take (spark, sf_dir) and read only what Spark can read. ``ORACLES`` has
DuckDB SQL where SQL can express the result; the others are tested against
brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import (
    exact_topk, hpy_lm, html_extract, language_id, mixing, packing, prefix_trie, quality_rules, sharding, simhash, sql_conversations, structure_repair,
    suffix_dedup, token_counts,
)
from keelson.llm.common import ship
from keelson.session import configure

#: Arrow batches of this many rows keep a batch of long texts small.
ARROW_ROWS = 1_000
TOKEN_LIMIT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """The session settings that the operators assume, and the package on the executors."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship(spark)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to flattened source weights, in shuffled order."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "n_copies", "shuffle_key")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_stats(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return structure_repair.repair(turns, structure_repair.damage(turns))


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpy_lm.score(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


_MIX_ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS body, strlen(coalesce(text, '')) AS n FROM documents
), per_source AS (
  SELECT source, sum(n)::DOUBLE AS bytes, pow(sum(n)::DOUBLE, {mixing.FLATTEN}) AS weight FROM sized GROUP BY source
), rates AS (
  SELECT source, CASE WHEN bytes > 0 THEN (SELECT sum(bytes) FROM per_source) * weight
         / (SELECT sum(weight) FROM per_source) / bytes ELSE 1.0 END AS mean FROM per_source
), parts AS (
  SELECT source, greatest(ceil(mean / 8.0), 1)::INT AS draws, mean / greatest(ceil(mean / 8.0), 1) AS one FROM rates
), draws AS (
  SELECT d.doc_id, d.source, concat_ws('|', 'mix-1', coalesce(d.doc_id::VARCHAR, '-'), md5(d.body)) AS ident, p.draws, p.one
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
), uniform AS (
  SELECT *, list_transform(range(1, draws + 1), lambda j: ('0x' || substr(md5(ident || '|' || j::VARCHAR), 1, 13))::BIGINT
         / 4503599627370496.0) AS us FROM draws
), counted AS (
  SELECT *, list_sum(list_transform(us, lambda u: len(list_filter(range(0, 64), lambda k:
         list_sum(list_transform(range(0, k + 1), lambda i: exp(-one) * pow(one, i) / gamma(i + 1))) <= u))))::INT AS n_copies
  FROM uniform
), copies AS (
  SELECT doc_id, source, ident, n_copies, unnest(range(0, n_copies))::INT AS copy FROM counted
)
SELECT doc_id, source, copy, n_copies,
       ('0x' || substr(md5(ident || '|c|' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM copies
"""

_TOP_ORACLE = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM clean q JOIN clean c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_token_counts, op3_simhash, op4_sharding, op5_quality_rules, op6_html_extract,
        op7_suffix_dedup, op8_exact_topk, op9_language_id, op10_packing, op11_structure_repair, op12_lm_score, op13_prefix_trie,
    )
}
ORACLES: dict[str, str] = {"op1_mixing": _MIX_ORACLE, "op8_exact_topk": _TOP_ORACLE, **sql_conversations.ORACLES}
