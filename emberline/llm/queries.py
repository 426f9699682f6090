"""One query per corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.catalog import ORACLES, QUERIES, query
from emberline.llm import hosts, lines, mixing
from emberline.llm.conversations import repair_conversations
from emberline.llm.hosts import judge_urls
from emberline.llm.languages import identify_languages
from emberline.llm.lines import drop_boilerplate_lines
from emberline.llm.mixing import mix_sources
from emberline.llm.near_text import near_duplicates
from emberline.llm.near_vectors import near_vectors
from emberline.llm.packing import pack
from emberline.llm.privacy import KINDS, sanitise
from emberline.llm.quality import COUNTS, quality_rules
from emberline.llm.secrets import scan_secrets
from emberline.llm.sharding import shard_by_bytes
from emberline.llm.tables import read
from emberline.llm.whitening import whiten


@query("op1_site_line_dedup", lines.ORACLE)
def op1_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@query("op2_hnsw_near_dedup")
def op2_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"), least=0.95).select("vec_id", "n_links", "component_id", "kept")


@query("op3_histogram_sort_sharding")
def op3_histogram_sort_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(read(spark, sf_dir, "documents"), shards=24)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_minhash_near_dedup")
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op5_disclosure_sanitising")
def op5_disclosure_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(read(spark, sf_dir, "documents")).select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans")


@query("op6_host_trust", hosts.ORACLE)
def op6_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op7_sum_of_squares_packing")
def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).drop("ids")


@query("op8_compression_quality")
def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


@query("op9_forest_secret_scan")
def op9_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "label", F.round("probability", 6).alias("probability"), "is_secret")


@query("op10_pareto_mixing", mixing.ORACLE)
def op10_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_naive_bayes_language")
def op11_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query("op12_lightest_repair")
def op12_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(read(spark, sf_dir, "conversations"))


@query("op13_chebyshev_whitening")
def op13_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(read(spark, sf_dir, "embeddings"), components=16)
    each = F.explode(F.sequence(F.lit(1), F.size("whitened"))).alias("component")
    some = found.where(F.size("whitened") > 0).select("vec_id", "n", "deviation", "whitened", "explained", "residual", "identity_error", each)
    one = lambda c: F.element_at(c, F.col("component")).alias(c)
    return some.select("vec_id", "component", "n", "deviation", one("whitened"), one("explained"), "identity_error", one("residual"))


__all__ = ["ORACLES", "QUERIES"]
