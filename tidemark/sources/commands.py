"""Command files: ``p k v``, ``g k``, ``d k``, ``r a b``, ``l file [threads]``, ``s``, ``c``; the long form PUT, GET, DELETE,
RANGE; and binary pairs.

The op is the first character that is not blank and numbers follow, each from where the last one ended, so ``p1 2`` puts 2
at 1 and whatever stands behind is ignored. Numbers are 32-bit; larger ones are invalid. Empty lines and lines that begin
with ``#`` are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = {
    "p": "Error: Invalid put format. Usage: p <key> <value>",
    "g": "Error: Invalid get format. Usage: g <key>",
    "d": "Error: Invalid del format. Usage: d <key>",
    "r": "Error: Invalid range format. Usage: r <start> <end>",
}


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` plus op, a, b and error, without what is skipped."""
    kept = lines.where((F.col(line) != "") & ~F.col(line).startswith("#"))
    op = F.regexp_extract(line, r"^\s*(\S)", 1)
    a = F.regexp_extract(line, r"^\s*\S\s*([+-]?\d+)", 1).try_cast("int")
    # the possessive quantifier keeps the second number from being made of the first one's digits
    b = F.regexp_extract(line, r"^\s*\S\s*[+-]?\d++\s*([+-]?\d+)", 1).try_cast("int")
    rows = kept.select("*", op.alias("op"), a.alias("a"), b.alias("b"))
    return rows.withColumn("error", _error(F.col(line)))


def _error(line: Column) -> Column:
    op, a, b = F.col("op"), F.col("a"), F.col("b")
    return (
        F.when(op == "", "Error: Invalid command format.")
        .when((op == "p") & (a.isNull() | b.isNull()), USAGE["p"])
        .when((op == "g") & a.isNull(), USAGE["g"])
        .when((op == "d") & a.isNull(), USAGE["d"])
        .when((op == "r") & (a.isNull() | b.isNull()), USAGE["r"])
        .when(~op.isin("p", "g", "d", "r", "l", "s", "c"), F.concat(F.lit("Unknown command: "), op))
    )


def parse_long(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` plus op, a and b from PUT, GET, DELETE and RANGE; other lines have a null op."""
    word = F.regexp_extract(line, r"^\s*(PUT|GET|DELETE|RANGE)\b", 1)
    number = lambda i: F.regexp_extract(line, r"^\s*[A-Z]+" + r"\s+[+-]?\d+" * i + r"\s+([+-]?\d+)", 1).try_cast("int")
    op = F.when(word == "PUT", "p").when(word == "GET", "g").when(word == "DELETE", "d").when(word == "RANGE", "r")
    return lines.select("*", op.alias("op"), number(0).alias("a"), F.when(op.isin("p", "r"), number(1)).alias("b"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a text file in file order; line numbers need the one RDD call there is for them."""
    rows = spark.sparkContext.textFile(path).zipWithIndex().map(lambda x: (x[1], x[0]))
    return spark.createDataFrame(rows, "seq long, line string")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, key, value) of binary files of little-endian int32 pairs."""
    import numpy as np
    import pandas as pd

    def pairs(files):
        for batch in files:
            for name, content in zip(batch["path"], batch["content"]):
                x = np.frombuffer(content[: len(content) // 8 * 8], "<i4").reshape(-1, 2)
                yield pd.DataFrame({"path": name, "at": np.arange(len(x)), "key": x[:, 0], "value": x[:, 1]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pairs, "path string, at long, key int, value int")


def answers(replayed: DataFrame) -> DataFrame:
    """(seq, answer) of replayed ops: OK for writes, the value or an empty line for gets."""
    text = F.when(F.col("op") == "g", F.coalesce(F.col("value").cast("string"), F.lit(""))).otherwise("OK")
    return replayed.select("seq", text.alias("answer"))
