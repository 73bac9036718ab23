"""The registered queries of the training-data operators, each over its whole table, and SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytenet, decontaminate, hostrules, interactions, mixing, resample, secrets, sharding, simhash, tokenfiles, tokens, urls, warc
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies"
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op7_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_by_section(table(spark, sf_dir, "documents"))


def op8_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytenet.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32", "copy")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_url_filter": op2_url_filter,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_sharding": op6_sharding,
    "op7_token_attribution": op7_token_attribution,
    "op8_host_quality_rules": op8_host_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_warc_round_trip": op10_warc_round_trip,
    "op11_token_files": op11_token_files,
    "op12_filter_audit": op12_filter_audit,
    "op13_target_resampling": op13_target_resampling,
}

# Where SQL is missing, the tests hold the query against a brute-force version.
ORACLE_SQL: dict[str, str] = {
    "op10_warc_round_trip": warc.round_trip_sql(),
    "op12_filter_audit": interactions.audit_sql(),
    "op13_target_resampling": resample.resample_sql(),
    "op8_host_quality_rules": hostrules.judge_sql(),
    "op2_url_filter": urls.judge_sql(),
}
