"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

``run`` applies the stages to ``documents``; each is written as Parquet into the shared folder and read again as the next
one's input, so a lost executor costs one stage at most. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, language_id, line_dedup, near_dup, packing
from tidemark.llm.common import stage, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects (no letters, or a narrow margin) go; all others stay as they are."""
    dictionaries = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.keep_sure(docs, dictionaries)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: one occurrence of each fuzzy line stays; documents left without a line go."""
    return line_dedup.apply(docs, line_dedup.similar_lines(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    return near_dup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL cannot compress, hash words or tokenize as the stages do; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
