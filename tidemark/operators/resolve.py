"""Which version of a key counts: logs are (seq, key, value, tombstone), and the largest seq wins.

``max_by`` on scalar columns keeps the aggregation hash-based with map-side combine; tombstones are dropped only after the
newest version is known, or an older value would come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """(key, value, tombstone, seq): the newest version of every key, deleted ones too."""
    newest = {c: F.max_by(c, "seq").alias(c) for c in ("value", "tombstone")}
    return log.groupBy("key").agg(newest["value"], newest["tombstone"], F.max("seq").alias("seq"))


def live(log: DataFrame) -> DataFrame:
    """(key, value) of the keys whose newest version is a put."""
    return latest(log).where("not tombstone").select("key", "value")


def deleted(log: DataFrame) -> DataFrame:
    """(key, seq) of the keys whose newest version is a tombstone."""
    return latest(log).where("tombstone").select("key", "seq")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The live pairs after the write ``seq``."""
    return live(log.where(F.col("seq") <= seq))


def intervals(log: DataFrame) -> DataFrame:
    """(key, seq, until, value, tombstone): each version with the seq that replaces it, null while it is current."""
    w = Window.partitionBy("key").orderBy("seq")
    return log.select("key", "seq", F.lead("seq").over(w).alias("until"), "value", "tombstone")


def merge_runs(runs: list[DataFrame], drop_tombstones: bool = False) -> DataFrame:
    """One run of several: (key, value, tombstone, seq), the newest version of each key.

    ``drop_tombstones`` is only right for the bottom: while any other run in the target level or below may hold a key, its
    tombstone has to stay.
    """
    merged = runs[0]
    for r in runs[1:]:
        merged = merged.unionByName(r)
    out = latest(merged)
    return out.where("not tombstone") if drop_tombstones else out
