"""Where rows of a log lie in a tiered store: batches of ``capacity`` writes, and ``ratio`` runs of a level become one run
of the next. With synchronous merges the place of a batch follows from its number, so statistics need no stored run.

After N full batches, batch f is in the deepest level n with floor(f / ratio^(n-1)) < floor(N / ratio^(n-1)); rows past
the last full batch are in the memtable, level 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reads import numbered
from .resolve import latest

CAPACITY, RATIO, LEVELS = 333, 5, 10


def placed(log: DataFrame, capacity: int = CAPACITY, ratio: int = RATIO, levels: int = LEVELS) -> DataFrame:
    """``log`` plus batch, level and run (the run's number within its level)."""
    batches = log.count() // capacity
    rows = numbered(log, "seq", "_at").withColumn("batch", F.floor(F.col("_at") / capacity).cast("long"))
    level: Column = F.lit(0)
    for n in range(1, levels + 1):
        level = F.when(F.floor(F.col("batch") / ratio ** (n - 1)) < batches // ratio ** (n - 1), n).otherwise(level)
    rows = rows.withColumn("level", level.cast("int"))
    run = F.when(F.col("level") > 0, F.floor(F.col("batch") / F.pow(F.lit(float(ratio)), F.col("level") - 1))).otherwise(F.lit(0))
    return rows.withColumn("run", run.cast("long")).drop("_at")


def runs(log: DataFrame, **layout) -> DataFrame:
    """(level, run, key, value, tombstone, seq): the rows of every run, newest version of each key."""
    rows = placed(log, **layout)
    return rows.groupBy("level", "run", "key").agg(F.max_by("value", "seq").alias("value"), F.max_by("tombstone", "seq").alias("tombstone"), F.max("seq").alias("seq"))


def run_bounds(log: DataFrame, **layout) -> DataFrame:
    """(level, run, min_key, max_key, n): what prunes runs from a read."""
    return runs(log, **layout).groupBy("level", "run").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n"))


def running_keys(log: DataFrame, **layout) -> DataFrame:
    """(seq, batch, keys): how many distinct keys a batch holds after each of its writes."""
    first = F.min("seq").over(Window.partitionBy("batch", "key")) == F.col("seq")
    seen = Window.partitionBy("batch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed(log, **layout).withColumn("first", first).select("seq", "batch", F.count_if("first").over(seen).alias("keys"))


def held_keys(log: DataFrame, **layout) -> DataFrame:
    """(keys): distinct keys in the memtable, deleted ones too."""
    return placed(log, **layout).where("level = 0").agg(F.count_distinct("key").alias("keys"))


def physical_keys(log: DataFrame, levels: int = LEVELS, **layout) -> DataFrame:
    """(level, n) for levels 1 to ``levels``: stored rows, stale ones and tombstones too; 0 for empty levels."""
    counts = runs(log, levels=levels, **layout).groupBy("level").agg(F.count("*").alias("n"))
    every = log.sparkSession.range(1, levels + 1).select(F.col("id").cast("int").alias("level"))
    return every.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def live_by_level(log: DataFrame, **layout) -> DataFrame:
    """(level, live_keys): live keys by where their newest version lies; level 0 is the memtable."""
    newest = latest(log).where("not tombstone").select("seq")
    return placed(log, **layout).join(newest, "seq", "left_semi").groupBy("level").agg(F.count("*").alias("live_keys"))


def listing(log: DataFrame, **layout) -> DataFrame:
    """(line): ``key:value:M`` or ``key:value:L<level>`` of every live key; values are shown as whole numbers."""
    newest = latest(log).where("not tombstone").select("seq")
    at = F.when(F.col("level") == 0, "M").otherwise(F.concat(F.lit("L"), F.col("level")))
    return placed(log, **layout).join(newest, "seq", "left_semi").select(F.concat_ws(":", F.col("key"), F.col("value").cast("bigint"), at).alias("line"))


def running_bytes(rows: DataFrame, size: Column, buckets: int = 256) -> DataFrame:
    """``rows`` plus part, the number of one of ``buckets`` equal ranges of keys, and start, the bytes before the row in its run.

    Sums are taken inside a part and added up over the parts of a run, so a run of any size is worked on by many tasks.
    """
    span = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    low, width = (span["lo"] or 0), ((span["hi"] or 0) - (span["lo"] or 0)) // buckets + 1
    sized = rows.withColumn("_size", size).withColumn("part", F.floor((F.col("key") - low) / width))
    inside = Window.partitionBy("level", "run", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("level", "run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sized.groupBy("level", "run", "part").agg(F.sum("_size").alias("_n")).select("level", "run", "part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_ahead"))
    here = sized.withColumn("_here", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return here.join(ahead, ["level", "run", "part"]).select(*rows.columns, "part", (F.col("_ahead") + F.col("_here")).alias("start"))


def fence_blocks(rows: DataFrame, block: int = 1024) -> DataFrame:
    """(level, run, block_no, first_key, keys): fence pointers by running size. Approximate: a fence does not restart the sum."""
    size = F.length(F.concat_ws(" ", F.col("key").cast("string"), F.col("value").cast("bigint").cast("string"), F.col("tombstone").cast("int").cast("string"))) + 1
    blocks = running_bytes(rows, size).withColumn("block_no", F.floor(F.col("start") / block).cast("long"))
    return blocks.groupBy("level", "run", "block_no").agg(F.min("key").alias("first_key"), F.count("*").alias("keys"))


def fences(rows: DataFrame, block: int = 1024, buckets: int = 256) -> DataFrame:
    """(level, run, key): exact fence pointers, the first key and then the next one once ``block`` bytes have passed since
    the last. The sum restarts, which no window can say.

    The first fence of a part is among its first ``block`` bytes, wherever the last one before it is. So each part finds where
    a chain from each of those few rows ends; a fold over these rows alone, one group a run, says where each part begins; and
    each part marks its fences from there.
    """
    import numpy as np
    import pandas as pd

    text = F.concat(F.col("key").cast("string"), F.lit(" "), F.coalesce(F.col("value").cast("bigint").cast("string"), F.lit("")), F.lit(" "), F.col("tombstone").cast("int").cast("string"))
    sized = running_bytes(rows.select("level", "run", "key", "value", "tombstone"), F.length(text) + 1, buckets).select("level", "run", "part", "key", "start")
    by = ["level", "run", "part"]

    def ends(part: pd.DataFrame) -> pd.DataFrame:
        start = np.sort(part["start"].to_numpy())
        after = np.searchsorted(start, start + block)
        last = np.arange(len(start))
        for i in range(len(start) - 1, -1, -1):
            if after[i] < len(start):
                last[i] = last[after[i]]
        few = slice(0, int(after[0]) + 1)
        return pd.DataFrame({**{c: part[c].iloc[0] for c in by}, "first": start[few], "last": start[last[few]]})

    def begins(run: pd.DataFrame) -> pd.DataFrame:
        due, out = 0, []
        for part, rows_ in run.sort_values(["part", "first"]).groupby("part"):
            fits = np.flatnonzero(rows_["first"].to_numpy() >= due)
            if len(fits):
                out.append((part, rows_["first"].iloc[fits[0]]))
                due = rows_["last"].iloc[fits[0]] + block
        return pd.DataFrame({**{c: run[c].iloc[0] for c in by[:2]}, "part": [p for p, _ in out], "begin": [b for _, b in out]})

    def marked(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("start")
        start = part["start"].to_numpy()
        after, keep = np.searchsorted(start, start + block), []
        i = int(np.searchsorted(start, part["begin"].iloc[0]))
        while i < len(start):
            keep.append(i)
            i = int(after[i])
        return part.iloc[keep][["level", "run", "key"]]

    kinds = "level int, run long, part long"
    few = sized.groupBy(*by).applyInPandas(ends, f"{kinds}, first long, last long")
    starts = few.groupBy("level", "run").applyInPandas(begins, f"{kinds}, begin long")
    return sized.join(starts, by).groupBy(*by).applyInPandas(marked, "level int, run long, key long")
