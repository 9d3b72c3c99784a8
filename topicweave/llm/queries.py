"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, language_id, license_scan, lm_scoring, mixing, near_dedup, packing, prefix_trie, quality_rules, sharding, url_filters, vector_codes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", url_filters.fetched(F.col("page_id")).alias("day"))
    hosts = captures.select(url_filters.host(F.col("url")).alias("host")).filter("host is not null").distinct()
    return url_filters.filter_captures(captures, url_filters.dated_entries(hosts))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source", "copies")


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_sharding, op3_language_id, op4_quality_rules, op5_url_filters, op6_lm_scoring, op7_exact_dedup, op8_packing, op9_license_scan, op10_mixing,
        op11_embedding_near_dedup, op12_conversation_trie, op13_vector_codes,
    )
}

ORACLE_SQL = {
    "op4_quality_rules": quality_rules.SQL,
    "op5_url_filters": url_filters.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op9_license_scan": license_scan.SQL,
    "op12_conversation_trie": prefix_trie.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
