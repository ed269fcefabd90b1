"""Run files of the text kind: ``L<level>/run_<id>.txt`` with one ``key value 0|1`` line a key, sorted by key.

Ids are compared as numbers. A lower level is newer, and within a level a larger id; that order becomes ``seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 10


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(level, run, key, value, tombstone, seq) of every run below ``path``; lines that do not parse are left out."""
    lines = spark.read.text(f"{path.rstrip('/')}/L*/run_*.txt").select("value", F.col("_metadata.file_path").alias("file"))
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("int")
    part = F.split("value", " ")
    rows = lines.select(
        number(r"/L(\d+)/run_\d+\.txt$").alias("level"),
        number(r"/run_(\d+)\.txt$").alias("run"),
        F.get(part, F.lit(0)).try_cast("int").alias("key"),
        F.get(part, F.lit(1)).try_cast("int").alias("value"),
        (F.get(part, F.lit(2)) == "1").alias("tombstone"),
    )
    return rows.where("key is not null and value is not null and tombstone is not null").withColumn("seq", (LEVELS - F.col("level")).cast("long") * (1 << 32) + F.col("run"))


def run_metadata(runs: DataFrame) -> DataFrame:
    """(level, run, min_key, max_key, n): what recovery rebuilds, newest run first."""
    return runs.groupBy("level", "run").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n")).orderBy("level", F.desc("run"))


def to_lines(rows: DataFrame) -> DataFrame:
    """(value): the text lines of one run's rows, in key order."""
    return rows.orderBy("key").select(F.concat_ws(" ", F.col("key"), F.coalesce("value", F.lit(0)), F.col("tombstone").cast("int")).alias("value"))
