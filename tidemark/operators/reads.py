"""Point, multi-key and range reads of a log, and many ranges at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import live


def get(log: DataFrame, key) -> DataFrame:
    """(key, value) of one live key; the predicate reaches the scan."""
    return live(log.where(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) for every row of ``keys``; value is null where the key is missing or deleted."""
    return keys.join(live(log.join(keys, "key", "left_semi")), "key", "left").select("key", "value")


def between(low, high, right_open: bool = False):
    """Inclusive at both ends; ``right_open`` leaves the upper end out. An inverted range is empty."""
    return (F.col("key") >= low) & ((F.col("key") < high) if right_open else (F.col("key") <= high))


def range_pairs(log: DataFrame, low, high, right_open: bool = False) -> DataFrame:
    return live(log.where(between(low, high, right_open)))


def range_count(log: DataFrame, low, high, right_open: bool = False) -> DataFrame:
    return range_pairs(log, low, high, right_open).agg(F.count("*").alias("size"))


def counted(df: DataFrame, order: str, before: dict[str, Column], buckets: int = 1024) -> DataFrame:
    """``df`` with a long for each name of ``before``: for how many rows ahead of this one, by the integer column ``order``, the
    condition holds.

    A running count over everything would be one task; here each of ``buckets`` equal ranges of ``order`` is counted by
    itself and starts at the count of those before it.
    """
    span = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    low, width = (span["lo"] or 0), ((span["hi"] or 0) - (span["lo"] or 0)) // buckets + 1
    placed = df.withColumn("_bucket", F.floor((F.col(order) - low) / width).cast("int"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_bucket").agg(*[F.count_if(c).alias(f"_{n}") for n, c in before.items()])
    ahead = totals.select("_bucket", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_ahead_{n}") for n in before])
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    here = placed.select("*", *[F.coalesce(F.count_if(c).over(inside), F.lit(0)).alias(f"_here_{n}") for n, c in before.items()])
    return here.join(F.broadcast(ahead), "_bucket").select(*df.columns, *[(F.col(f"_ahead_{n}") + F.col(f"_here_{n}")).alias(n) for n in before])


def numbered(df: DataFrame, order: str, name: str, buckets: int = 1024) -> DataFrame:
    """``df`` with a gapless long ``name`` from 0 by the integer column ``order``."""
    return counted(df, order, {name: F.lit(True)}, buckets)


def multi_range_counts(log: DataFrame, ranges: DataFrame, buckets: int = 1024) -> DataFrame:
    """(range_id, low, high, size) for ranges (range_id, low, high) of integer keys, however wide.

    Size is the number of live keys up to the upper end less that below the lower one. Keys and ends are counted inside
    equal key ranges, and what stands before a key range is added from one row a range; no pair of range and key is made.
    """
    keys = live(log).select(F.col("key").cast("long").alias("at"))
    ends = ranges.where("low <= high").select("range_id", F.explode(F.array(F.struct((F.col("low").cast("long") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("high").cast("long").alias("at"), F.lit(1).alias("sign")))).alias("e"))
    span = keys.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    low, high = span["lo"] or 0, span["hi"] or 0
    width = (high - low) // buckets + 1
    both = keys.select("at", F.lit(None).cast("long").alias("range_id"), F.lit(0).alias("sign")).union(ends.select("e.at", F.col("range_id").cast("long"), "e.sign"))
    # ends outside the keys count none or all of them
    both = both.withColumn("bucket", F.floor((F.greatest(F.lit(low), F.least(F.lit(high), F.col("at"))) - low) / width).cast("int"))
    inside = Window.partitionBy("bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("here", F.sum(F.when(F.col("sign") == 0, 1).otherwise(0)).over(inside)).where("sign <> 0")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = both.groupBy("bucket").agg(F.sum(F.when(F.col("sign") == 0, 1).otherwise(0)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    sizes = counted.join(F.broadcast(ahead), "bucket").groupBy("range_id").agg(F.sum(F.col("sign") * (F.col("here") + F.col("ahead"))).alias("size"))
    return ranges.join(sizes, "range_id", "left").select("range_id", "low", "high", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
