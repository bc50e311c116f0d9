"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litfeed.llm import decontam, html_density, license_scan, lm_mixing, merkle, mixing, packing, quality, quotes, sharding, simhash, variants, warc
from litfeed.llm import sql as S
from litfeed.llm.common import table


#: The vocabulary file of the packing query.
VOCABULARY = "byte_bpe_50k.json"


def op1_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.scored(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.slotted(sharding.assign(table(spark, sf_dir, "documents"), shards=24))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def merkle_rows(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and its verdict on those of even CRC whose line breaks were deleted."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.checked(docs, {"text": F.replace("text", F.lit("\n"), F.lit(""))}, even).withColumnRenamed("id", "doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rows(table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(variants.counted(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_html_density, op2_simhash, op3_license_scan, op4_warc, op5_lm_mixing, op6_quality_rules, op7_kd_sharding, op8_quotation_linking,
    op9_decontamination, op10_packing, op11_merkle_manifest, op12_source_mixing,
    op13_spelling_variants)}

SQL: dict[str, str] = {k: v for k, v in S.ORACLES.items() if k in QUERIES}
