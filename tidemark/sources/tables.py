"""Logs and command streams from the test tables: event_id and o_orderkey are unique, so they serve as seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, op, key, value): views are gets, errors are deletes, all else puts."""
    op = F.when(F.col("event_type") == "view", "g").when(F.col("event_type") == "error", "d").otherwise("p")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("key"), "value")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, key, value, tombstone) of the writes among the events."""
    return event_ops(spark, sf_dir).where("op <> 'g'").select("seq", "key", "value", (F.col("op") == "d").alias("tombstone"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as writes to their customer: finished ones (F) are tombstones."""
    orders = read(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "F").alias("tombstone"))
