"""Replaying a command stream: each read sees the writes before it. Ops are (seq, op, key, value) with op p, d or g."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(ops: DataFrame) -> DataFrame:
    """(seq, op, key, value, outcome): what each op finds. One window by key; reads get the value or null.

    Outcomes are 'put', 'hit' or 'miss' for a get, and 'effective' or 'noop' for a delete.
    """
    earlier = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(F.col("op") != "g", F.struct((F.col("op") == "p").alias("alive"), F.col("value").alias("value")))
    seen = ops.withColumn("before", F.last(state, ignorenulls=True).over(earlier))
    alive = F.coalesce(F.col("before.alive"), F.lit(False))
    outcome = F.when(F.col("op") == "p", "put").when(F.col("op") == "g", F.when(alive, "hit").otherwise("miss")).otherwise(F.when(alive, "effective").otherwise("noop"))
    value = F.when(F.col("op") == "g", F.when(alive, F.col("before.value"))).when(F.col("op") == "p", F.col("value"))
    return seen.select("seq", "op", "key", value.alias("value"), outcome.alias("outcome"))


def outcomes(ops: DataFrame) -> DataFrame:
    """(op, outcome, n)"""
    return replay(ops).groupBy("op", "outcome").agg(F.count("*").alias("n"))


def counters(ops: DataFrame) -> DataFrame:
    """(counter, n): what became of all ops (seq, op, key, value) of op p, g, d, r or l, every counter also where it is 0."""
    names = {("p", "put"): "puts", ("g", "hit"): "successful_gets", ("g", "miss"): "failed_gets", ("d", "effective"): "successful_deletes", ("d", "noop"): "failed_deletes"}
    found = outcomes(ops.where("op in ('p', 'g', 'd')"))
    name = F.coalesce(*[F.when((F.col("op") == op) & (F.col("outcome") == what), n) for (op, what), n in names.items()])
    rest = ops.where("op in ('r', 'l')").groupBy(F.when(F.col("op") == "r", "ranges").otherwise("loads").alias("counter")).agg(F.count("*").alias("n"))
    both = found.select(name.alias("counter"), "n").union(rest)
    every = ops.sparkSession.createDataFrame([(n,) for n in [*names.values(), "ranges", "loads"]], "counter string")
    return every.join(F.broadcast(both), "counter", "left").select("counter", F.coalesce("n", F.lit(0)).alias("n"))


def range_counts(log: DataFrame, ranges: DataFrame, buckets: int = 256) -> DataFrame:
    """(seq, low, high, size): for ranges (seq, low, high) of integer keys, of any width, the keys in [low, high] that were
    live at that moment, writes of that seq included.

    A key that comes to life is an event +1 and one that is deleted an event -1; a range has the sum of the earlier events up
    to its upper end less those below its lower one. Keys are written in hexadecimal digits: what lies below a key is, digit
    by digit, what shares the digits before and has a smaller one there. So each event and each end is one row a digit, and a
    row needs the running sums, by seq, of the fifteen smaller digits. They are taken inside ``buckets`` equal ranges of seq
    and added up over those, so the first digit, which all rows share, is no single task.
    """
    before = F.coalesce(F.lag("tombstone").over(Window.partitionBy("key").orderBy("seq")), F.lit(True))
    events = log.select("seq", F.col("key").cast("long").alias("key"), (before.cast("int") - F.col("tombstone").cast("int")).alias("delta")).where("delta <> 0")
    span = log.agg(F.min("key").cast("long"), F.max("key").cast("long"), F.min("seq"), F.max("seq")).first()
    low, high, first, last = (x or 0 for x in span)
    digits = max(1, -(-(high - low + 1).bit_length() // 4))
    width = (last - first) // buckets + 1
    inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(high - low + 1), c - low))
    ends = ranges.where("low <= high").select("seq", "low", "high", F.explode(F.array(F.struct(inside(F.col("low").cast("long")).alias("x"), F.lit(-1).alias("sign")), F.struct(inside(F.col("high").cast("long") + 1).alias("x"), F.lit(1).alias("sign")))).alias("e")).where("e.x > 0")
    null = lambda kind: F.lit(None).cast(kind)
    kind = ranges.schema["low"].dataType.simpleString()
    both = events.select("seq", (F.col("key") - low).alias("x"), "delta", F.lit(0).alias("sign"), null(kind).alias("low"), null(kind).alias("high")).union(ends.select("seq", "e.x", null("int"), "e.sign", "low", "high"))
    rows = both.withColumn("digit_no", F.explode(F.sequence(F.lit(0), F.lit(digits - 1)))).withColumn("left", F.expr("shiftright(x, 4 * digit_no)"))
    rows = rows.withColumn("digit", (F.col("left") % 16).cast("int")).withColumn("prefix", F.shiftright("left", 4)).withColumn("bucket", F.floor((F.greatest(F.lit(first), F.least(F.lit(last + 1), F.col("seq"))) - first) / width))
    node = ["digit_no", "prefix"]
    of = lambda d: F.when(F.col("digit") == d, F.col("delta"))
    earlier = Window.partitionBy(*node, "bucket").orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.select("*", *[F.sum(of(d)).over(earlier).alias(f"d{d}") for d in range(15)]).where("sign <> 0")
    over = Window.partitionBy(*node).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*node, "bucket").agg(*[F.sum(of(d)).alias(f"d{d}") for d in range(15)])
    ahead = totals.select(*node, "bucket", *[F.sum(f"d{d}").over(over).alias(f"b{d}") for d in range(15)])
    smaller = lambda x: sum((F.when(F.col("digit") > d, F.coalesce(f"{x}{d}", F.lit(0))).otherwise(0) for d in range(15)), F.lit(0))
    sizes = here.join(ahead, [*node, "bucket"]).groupBy("seq", "low", "high").agg(F.sum(F.col("sign") * (smaller("d") + smaller("b"))).alias("size"))
    out = ranges.join(sizes.withColumnsRenamed({"low": "_low", "high": "_high", "seq": "_seq"}), F.expr("seq = _seq and low = _low and high = _high"), "left")
    return out.select("seq", "low", "high", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def positional_zip(ops: DataFrame) -> DataFrame:
    """(seq, op, key, value): the i-th put takes the key of the i-th get; gets go, surplus puts keep their key."""
    from .reads import numbered

    gets = numbered(ops.where("op = 'g'"), "seq", "i").select("i", F.col("key").alias("get_key"))
    puts = numbered(ops.where("op = 'p'"), "seq", "i")
    renamed = puts.join(gets, "i", "left").select("seq", "op", F.coalesce("get_key", "key").alias("key"), "value")
    return renamed.unionByName(ops.where("op not in ('p', 'g')").select("seq", "op", "key", "value"))
