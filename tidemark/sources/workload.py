"""Seeded random workloads of puts, gets, ranges and deletes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reads import counted

MOST = 2147483647


@dataclass(frozen=True)
class Workload:
    """How many of each op; ``miss`` is the share of gets of random keys, ``skew`` that of gets that repeat an earlier get."""

    puts: int
    gets: int = 0
    ranges: int = 0
    deletes: int = 0
    miss: float = 0.5
    skew: float = 0.0
    gaussian: bool = False
    seed: int = 13141

    def __post_init__(self):
        if self.puts < 1:
            raise ValueError("a workload needs a put")


def generate(spark: SparkSession, w: Workload) -> DataFrame:
    """(seq, op, a, b): ops in random order, the first a put. Gets that are to hit and deletes take the key of a random put
    before them, gets that repeat the key of a random get before them.

    A random number is cut from the MD5 of (seed, kind, number), which other engines have too, so the result can be made
    again anywhere and does not depend on partitions. The key of the n-th put follows from n: only repeated gets need a join.
    """
    hexadecimal = lambda kind, i, n: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(w.seed), F.lit(kind), i)), 1, n), 16, 10).cast("long")
    uniform = lambda kind, i: hexadecimal(kind, i, 8)
    number = lambda kind, i: (uniform(kind, i) - (1 << 31)).cast("int")
    share = lambda kind, i: uniform(kind, i) / float(1 << 32)
    rows = lambda op, n: spark.range(n).select(F.lit(op).alias("op"), F.col("id").alias("i"))
    ops = rows("p", w.puts).union(rows("g", w.gets)).union(rows("r", w.ranges)).union(rows("d", w.deletes))
    order = F.when((F.col("op") == "p") & (F.col("i") == 0), -1).otherwise(hexadecimal("order", F.concat("op", "i"), 15))
    ops = counted(ops.withColumn("order", order), "order", {"seq": F.lit(True), "puts": F.col("op") == "p", "gets": F.col("op") == "g"})
    n, i = F.col("gets"), F.col("i")
    some_put = lambda kind, j: number("key", uniform(kind, j) % F.col("puts"))
    normal = lambda kind: F.sqrt(-2 * F.log(share(kind, i) + 1e-12)) * F.cos(2 * 3.141592653589793 * share(kind + "'", i))
    end = lambda kind: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), normal(kind) * (MOST / 3))).cast("int") if w.gaussian else number(kind, i)
    null = F.lit(None).cast("int")
    put = ops.where("op = 'p'").select("seq", "op", number("key", F.col("puts")).alias("a"), number("value", F.col("puts")).alias("b"))
    get = ops.where("op = 'g'").select("seq", "op", n.alias("n"), F.when(share("miss?", n) < w.miss, number("miss", n)).otherwise(some_put("get", n)).alias("a"))
    again = F.when((share("skew?", F.col("n")) < w.skew) & (F.col("n") > 0), uniform("earlier", F.col("n")) % F.col("n"))
    get = get.withColumn("of", again)
    get = get.join(get.select(F.col("n").alias("of"), F.col("a").alias("before")), "of", "left").select("seq", "op", F.coalesce("before", "a").alias("a"), null.alias("b"))
    range_ = ops.where("op = 'r'").select("seq", "op", F.least(end("low"), end("high")).alias("a"), F.greatest(end("low"), end("high")).alias("b"))
    delete = ops.where("op = 'd'").select("seq", "op", some_put("del", i).alias("a"), null.alias("b"))
    return put.union(get).union(range_).union(delete)


def workload_sql(w: Workload) -> str:
    """CTEs, of which ``generated`` (seq, op, a, b) is the workload, in DuckDB's SQL."""
    hexadecimal = lambda kind, i, n: f"CAST('0x' || substr(md5(concat('{w.seed}:{kind}:', {i})), 1, {n}) AS BIGINT)"
    uniform = lambda kind, i: hexadecimal(kind.replace("'", "''"), i, 8)
    number = lambda kind, i: f"CAST({uniform(kind, i)} - 2147483648 AS INTEGER)"
    share = lambda kind, i: f"({uniform(kind, i)} / 4294967296.0::DOUBLE)"
    some_put = lambda kind, j: number("key", f"{uniform(kind, j)} % puts")
    normal = lambda kind: f"sqrt(-2 * ln({share(kind, 'i')} + 1e-12)) * cos(2 * 3.141592653589793 * {share(kind + chr(39), 'i')})"
    end = lambda kind: f"CAST(trunc(greatest(-{MOST}, least({MOST}, {normal(kind)} * ({MOST} / 3.0::DOUBLE)))) AS INTEGER)" if w.gaussian else number(kind, "i")
    kinds = " UNION ALL ".join(f"SELECT '{op}' AS op, range AS i FROM range({n})" for op, n in (("p", w.puts), ("g", w.gets), ("r", w.ranges), ("d", w.deletes)))
    return f"""kinds AS ({kinds}), placed AS (SELECT *, CASE WHEN op = 'p' AND i = 0 THEN -1 ELSE {hexadecimal('order', "op || i", 15)} END AS place FROM kinds),
 ops_ AS (SELECT op, i, row_number() OVER w - 1 AS seq, count(*) FILTER (op = 'p') OVER before AS puts, count(*) FILTER (op = 'g') OVER before AS gets FROM placed WINDOW w AS (ORDER BY place), before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 gets_ AS (SELECT seq, gets AS n, CASE WHEN {share('miss?', 'gets')} < {w.miss} THEN {number('miss', 'gets')} ELSE {some_put('get', 'gets')} END AS a, CASE WHEN {share('skew?', 'gets')} < {w.skew} AND gets > 0 THEN {uniform('earlier', 'gets')} % gets END AS of_ FROM ops_ WHERE op = 'g'),
 generated AS (SELECT seq, op, {number('key', 'puts')} AS a, {number('value', 'puts')} AS b FROM ops_ WHERE op = 'p'
 UNION ALL SELECT x.seq, 'g', coalesce(y.a, x.a), NULL FROM gets_ x LEFT JOIN gets_ y ON x.of_ = y.n
 UNION ALL SELECT seq, op, least({end('low')}, {end('high')}), greatest({end('low')}, {end('high')}) FROM ops_ WHERE op = 'r'
 UNION ALL SELECT seq, op, {some_put('del', 'i')}, NULL FROM ops_ WHERE op = 'd')"""
