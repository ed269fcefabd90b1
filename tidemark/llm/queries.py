"""The opN_<name> queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, language_id, license_scan, line_dedup, near_dup, oracles, packing, sharding, url_filter, warc
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.similar_lines(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language_id.fit(docs.where(~language_id.held_out()))
    out = language_id.predict(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))[0].drop("text_key")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of the pages, with a digest of the payload and the headers as sorted text."""
    out = warc.resolve(warc.crawl_of(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "url_key", "response_id", "outcome", "status", headers.alias("headers"), F.md5("payload").alias("payload_md5"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_sharding": op3_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_ann": op7_ann,
    "op8_near_dup": op8_near_dup,
    "op9_url_filter": op9_url_filter,
    "op10_warc_revisits": op10_warc_revisits,
}

#: DuckDB SQL by query, where SQL can express it.
ORACLES = {
    "op1_decontamination": oracles.decontamination(),
    "op2_license_scan": oracles.license_labels(),
    "op10_warc_revisits": oracles.revisits(),
}
