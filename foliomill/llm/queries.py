"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import decontaminate, language, near_duplicates, packing, quality, secrets, sharding, substrings, top_k, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(_read(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_components(spark, _read(spark, sf_dir, "documents"))


def op3_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(secrets.find_secrets(_read(spark, sf_dir, "documents"), carry=["doc_id"]))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _read(spark, sf_dir, "documents"))


def op5_difference_cover_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(spark, _read(spark, sf_dir, "documents"))


def op6_no_random_access_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_inner_products(_read(spark, sf_dir, "embeddings"))


def op7_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(spark, _read(spark, sf_dir, "documents"))


def op10_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return decontaminate.contamination_report(found)


TOP_K = """
WITH whole AS (
  SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op6_no_random_access_top_k": TOP_K, "op9_extendible_sharding": sharding.ORACLE}
