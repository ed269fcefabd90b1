"""The query catalogue: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl import Shell
from ..functions import bloom
from ..operators import layout, reads, replay, resolve
from ..sources import commands, runs, tables, workload
from ..store import Store, folder

Query = Callable[[SparkSession, str], DataFrame]

OPS_SQL = "ops AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'g' WHEN 'error' THEN 'd' ELSE 'p' END AS op, user_id AS key, value FROM events)"
LOG_SQL = f"{OPS_SQL}, log AS (SELECT seq, key, value, op = 'd' AS tombstone FROM ops WHERE op <> 'g')"
LATEST_SQL = f"{LOG_SQL}, latest AS (SELECT key, value, tombstone, seq FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
LIVE_SQL = f"{LATEST_SQL}, live AS (SELECT key, value FROM latest WHERE NOT tombstone)"
PLACED_SQL = f"""{LOG_SQL},
 numbered AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS pos, CAST(floor((SELECT count(*) FROM log) / 333) AS BIGINT) AS total FROM log),
 batched AS (SELECT *, CAST(floor(pos / 333) AS BIGINT) AS batch FROM numbered),
 leveled AS (SELECT *, {"CASE " + " ".join(f"WHEN floor(batch / {5 ** (n - 1)}) < floor(total / {5 ** (n - 1)}) THEN {n}" for n in range(10, 0, -1)) + " ELSE 0 END"} AS level FROM batched),
 placed AS (SELECT *, CASE WHEN level > 0 THEN CAST(floor(batch / pow(5, level - 1)) AS BIGINT) ELSE 0 END AS run FROM leveled),
 runs AS (SELECT level, run, key, value, tombstone, seq FROM placed QUALIFY row_number() OVER (PARTITION BY level, run, key ORDER BY seq DESC) = 1)"""
#: A command line by event, in a dozen forms, good and bad.
LINE_SQL = """CASE event_id % 14 WHEN 0 THEN concat('p ', user_id, ' ', event_id) WHEN 1 THEN concat('p', user_id, ' ', event_id) WHEN 2 THEN concat('p ', user_id)
 WHEN 3 THEN concat('p ', user_id, '-', event_id) WHEN 4 THEN concat('g ', user_id) WHEN 5 THEN 'g' WHEN 6 THEN concat('d  ', user_id, ' junk') WHEN 7 THEN concat('r ', user_id, ' ', user_id + 5)
 WHEN 8 THEN concat('# ', user_id) WHEN 9 THEN concat('put ', user_id, ' 4') WHEN 10 THEN concat('p 99999999999 ', user_id) WHEN 11 THEN concat('x ', user_id) WHEN 12 THEN '   ' ELSE '' END"""
PARSED_SQL = """WITH lines AS (SELECT {seq} AS seq, @line@ AS line FROM events), kept AS (SELECT * FROM lines WHERE line <> '' AND line NOT LIKE '#%'),
 cut AS (SELECT *, coalesce(substr(ltrim(line), 1, 1), '') AS op, ltrim(substr(ltrim(line), 2)) AS rest FROM kept),
 one AS (SELECT *, regexp_extract(rest, '^[+-]?[0-9]+') AS first FROM cut),
 two AS (SELECT *, regexp_extract(ltrim(substr(rest, length(first) + 1)), '^[+-]?[0-9]+') AS second FROM one),
 cast_ AS (SELECT seq, op, TRY_CAST(nullif(first, '') AS INTEGER) AS a, CASE WHEN first <> '' THEN TRY_CAST(nullif(second, '') AS INTEGER) END AS b FROM two)
 SELECT seq, op, a, b, CASE WHEN op = '' THEN 'Error: Invalid command format.' WHEN op = 'p' AND (a IS NULL OR b IS NULL) THEN '@p@' WHEN op = 'g' AND a IS NULL THEN '@g@'
 WHEN op = 'd' AND a IS NULL THEN '@d@' WHEN op = 'r' AND (a IS NULL OR b IS NULL) THEN '@r@' WHEN op NOT IN ('p', 'g', 'd', 'r', 'l', 's', 'c') THEN concat('Unknown command: ', op) END AS error FROM cast_"""
for _op, _text in commands.USAGE.items():
    PARSED_SQL = PARSED_SQL.replace(f"@{_op}@", _text)
PARSED_SQL = PARSED_SQL.replace("@line@", LINE_SQL)
LOW, HIGH = 20, 60


def on_log(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(tables.event_log(spark, d))


def on_ops(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(tables.event_ops(spark, d))


def wanted_keys(spark: SparkSession, d: str) -> DataFrame:
    """Customer keys: some have events, some have none."""
    return tables.read(spark, d, "customer").select(F.col("c_custkey").alias("key"))


def view_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Each view asks for the 21 keys around its own."""
    views = tables.event_ops(spark, d).where("op = 'g'")
    return views.select("seq", (F.col("key") - 10).alias("low"), (F.col("key") + 10).alias("high"))


def supplier_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A range of keys by supplier, of any width, some inverted."""
    return tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("range_id"), (F.col("s_suppkey") * 3 % 200).alias("low"), (F.col("s_suppkey") * 7 % 300).alias("high"))


def command_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = tables.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.expr(LINE_SQL).alias("line"))
    return commands.parse(lines).select("seq", "op", "a", "b", "error")


def overlapping_runs(log: DataFrame) -> DataFrame:
    bounds = layout.run_bounds(log)
    return bounds.where(~((F.col("max_key") < LOW) | (F.col("min_key") > HIGH))).select("level", "run", "min_key", "max_key")


def summary(log: DataFrame) -> DataFrame:
    live, rows = layout.live_by_level(log), layout.runs(log).where("level > 0").agg(F.count("*").alias("stored"))
    return live.agg(F.sum("live_keys").alias("logical_pairs")).crossJoin(rows)


def bottom_merge(log: DataFrame, drop: bool) -> DataFrame:
    """The runs of level 1 and 2 merged."""
    rows = layout.runs(log).where("level in (1, 2)").select("seq", "key", "value", "tombstone")
    return resolve.merge_runs([rows], drop).select("key", "value", "tombstone", "seq")


def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    keys = tables.event_log(spark, d).select("key").distinct()
    return bloom.may_contain(wanted_keys(spark, d), bloom.build(keys, 1665), 1665)


def _bloom_sql(n: int, source: str) -> str:
    bits, probes = bloom.size_of(n)
    return f"""probes AS (SELECT key, CAST(key AS BIGINT) + i * (((CAST(key AS BIGINT) * 2654435769 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS x
 FROM {source}, (SELECT unnest(range({probes})) AS i)), positions AS (SELECT key, CASE WHEN x >= 0 THEN x % {bits} ELSE ((x % {bits} + {bits}) % {bits} + {2**64 % bits}) % {bits} END AS bit FROM probes)"""


def exact_fences(log: DataFrame) -> DataFrame:
    return layout.fences(layout.runs(log))


def files_of(spark: SparkSession, path: str):
    """The Hadoop path class and the file system of a path."""
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return to_path, to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def one_text_file(lines: DataFrame, path: str) -> None:
    """Writes the ordered column ``value`` as the text file ``path``."""
    lines.coalesce(1).write.text(f"{path}-parts")
    to_path, fs = files_of(lines.sparkSession, path)
    part = next(x.getPath() for x in fs.listStatus(to_path(f"{path}-parts")) if x.getPath().getName().startswith("part-"))
    fs.mkdirs(to_path(path).getParent())
    fs.rename(part, to_path(path))
    fs.delete(to_path(f"{path}-parts"), True)


def filled_store(spark: SparkSession, log: DataFrame, batches: int = 10) -> Store:
    """A store that took the log in equal ranges of seq, with merges."""
    store = Store(spark, f"{folder(spark)}/store", ratio=3)
    span = log.agg(F.min("seq"), F.max("seq")).first()
    step = (span[1] - span[0]) // batches + 1
    for i in range(batches):
        store.put(log.where(F.col("seq").between(span[0] + i * step, span[0] + (i + 1) * step - 1)))
    return store


def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The live view after every batch of a tenth of the log went through the store, with merges."""
    return filled_store(spark, tables.event_log(spark, d)).live()


def store_get(spark: SparkSession, d: str) -> DataFrame:
    """Point reads of a store: keys that are there, deleted and never written."""
    store = filled_store(spark, tables.event_log(spark, d), 4)
    return spark.createDataFrame([(k, store.get(k)) for k in GETS], "key long, value double")


def store_range(spark: SparkSession, d: str) -> DataFrame:
    return filled_store(spark, tables.event_log(spark, d), 4).range(LOW, HIGH)


def split_store(spark: SparkSession, d: str) -> tuple[Store, DataFrame]:
    """A store with the first four fifths of the log by seq, and the writes since, which are only held."""
    log = tables.event_log(spark, d)
    cut = log.agg(F.min("seq") + ((F.max("seq") - F.min("seq")) * 0.8).cast("long")).first()[0]
    return filled_store(spark, log.where(F.col("seq") <= cut), 4), log.where(F.col("seq") > cut)


def memtable_overlay(spark: SparkSession, d: str) -> DataFrame:
    store, held = split_store(spark, d)
    return store.live(held)


def memtable_overlay_range(spark: SparkSession, d: str) -> DataFrame:
    store, held = split_store(spark, d)
    return store.range(LOW, HIGH, held)


def snapshot_after_merge(spark: SparkSession, d: str) -> DataFrame:
    """A view taken before later batches and merges still reads what it saw."""
    log = tables.event_log(spark, d)
    half = log.agg(((F.min("seq") + F.max("seq")) / 2).cast("long")).first()[0]
    store = filled_store(spark, log.where(F.col("seq") <= half), 2)
    before = store.live()
    store.put(log.where(F.col("seq") > half))
    return before


def text_runs_live(spark: SparkSession, d: str) -> DataFrame:
    """The live pairs of all full batches, written as text runs and discovered again."""
    rows = layout.runs(tables.event_log(spark, d)).where("level > 0").withColumn("value", F.col("value").cast("int")).cache()
    base = folder(spark)
    for r in rows.select("level", "run").distinct().collect():
        one_text_file(runs.to_lines(rows.where((F.col("level") == r["level"]) & (F.col("run") == r["run"]))), f"{base}/L{r['level']}/run_{r['run']}.txt")
    rows.unpersist()
    return resolve.live(runs.read_runs(spark, base))


def command_file(spark: SparkSession, d: str) -> DataFrame:
    """The command lines of the events, written as a file and read in its order."""
    lines = tables.read(spark, d, "events").select("event_id", F.expr(LINE_SQL).alias("value")).orderBy("event_id").select("value")
    path = f"{folder(spark)}/commands.txt"
    one_text_file(lines, path)
    return commands.parse(commands.read_lines(spark, path)).select("seq", "op", "a", "b", "error")


def long_form(spark: SparkSession, d: str) -> DataFrame:
    lines = tables.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.expr(LONG_SQL).alias("line"))
    return commands.parse_long(lines).select("seq", "op", "a", "b")


def binary_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a binary file of (key, balance) pairs, read again."""
    rows = tables.read(spark, d, "customer").select(F.col("c_custkey").cast("int"), F.col("c_acctbal").cast("int")).orderBy("c_custkey").toLocalIterator()
    path = f"{folder(spark)}/pairs.dat"
    to_path, fs = files_of(spark, path)
    stream = fs.create(to_path(path))
    for some in iter(lambda: [x for r in itertools.islice(rows, 10_000) for x in r], []):
        stream.write(bytearray(struct.pack(f"<{len(some)}i", *some)))
    stream.close()
    return commands.read_pairs(spark, path).select("at", "key", "value")


def shell_answers(spark: SparkSession, d: str) -> DataFrame:
    """What the shell says to every event as a command, then to three ranges. Fewer than 2^20 keys stay in the memtable."""
    ops = tables.event_ops(spark, d).select("seq", F.concat_ws(" ", "op", "key", F.when(F.col("op") == "p", F.col("value").cast("int"))).alias("line"))
    ends = spark.createDataFrame([(1 << 40, f"r {LOW} {HIGH}"), ((1 << 40) + 1, f"r {HIGH} {LOW}"), ((1 << 40) + 2, "r -2147483648 2147483647")], "seq long, line string")
    return Shell(spark, folder(spark), capacity=1 << 20).answers(ops.union(ends))


def wide_ranges(spark: SparkSession, d: str) -> DataFrame:
    """As-of ranges of any width, up to all of 32 bits, and inverted ones."""
    views = tables.event_ops(spark, d).where("op = 'g'").select("seq", "key", (F.col("seq") % 4).alias("kind"))
    low = F.when(F.col("kind") == 0, -(1 << 31)).when(F.col("kind") == 1, F.col("key")).otherwise(F.col("key") - F.col("kind") * 50)
    high = F.when(F.col("kind") == 0, (1 << 31) - 1).when(F.col("kind") == 3, F.col("key") - 200).otherwise(F.col("key") + F.col("kind") * 40)
    return replay.range_counts(tables.event_log(spark, d), views.select("seq", low.cast("long").alias("low"), high.cast("long").alias("high")))


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.latest import live_table, read_log

    schema = tables.read(spark, d, "events").schema
    events = read_log(spark, f"{d}/events*.parquet", schema)
    log = events.where("event_type <> 'view'").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), "value", (F.col("event_type") == "error").alias("tombstone"))
    base = folder(spark)
    return live_table(log, Store(spark, f"{base}/store"), f"{base}/checkpoint")


WORKLOAD = workload.Workload(puts=10_000, gets=2_000, ranges=50, deletes=500, miss=0.3, skew=0.2, gaussian=True)


def generated(spark: SparkSession, d: str) -> DataFrame:
    return workload.generate(spark, WORKLOAD)


def generated_ops(spark: SparkSession) -> DataFrame:
    return workload.generate(spark, WORKLOAD).select("seq", "op", F.col("a").alias("key"), F.col("b").alias("value"))


def generated_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return replay.outcomes(generated_ops(spark).where("op <> 'r'"))


OUTCOMES_SQL = f"""{workload.workload_sql(WORKLOAD)}, seen AS (SELECT *, last_value(CASE WHEN op <> 'g' THEN op END IGNORE NULLS) OVER (PARTITION BY a ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM generated WHERE op <> 'r'),
 outcomes AS (SELECT op, CASE op WHEN 'p' THEN 'put' WHEN 'g' THEN CASE WHEN before = 'p' THEN 'hit' ELSE 'miss' END ELSE CASE WHEN before = 'p' THEN 'effective' ELSE 'noop' END END AS outcome FROM seen)"""
COUNTERS_SQL = f"""WITH {OUTCOMES_SQL}, counters AS (SELECT unnest(['puts', 'successful_gets', 'failed_gets', 'successful_deletes', 'failed_deletes', 'ranges', 'loads']) AS counter),
 named AS (SELECT CASE outcome WHEN 'put' THEN 'puts' WHEN 'hit' THEN 'successful_gets' WHEN 'miss' THEN 'failed_gets' WHEN 'effective' THEN 'successful_deletes' ELSE 'failed_deletes' END AS counter FROM outcomes UNION ALL SELECT 'ranges' FROM generated WHERE op = 'r')
 SELECT counter, count(named.counter) AS n FROM counters LEFT JOIN named USING (counter) GROUP BY counter"""
#: The first row of a run, then the first one that begins at least a block after the last: a chain of pointers.
FENCES_SQL = f"""WITH RECURSIVE {PLACED_SQL}, sized AS (SELECT level, run, key, length(concat(key, ' ', coalesce(CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR), ''), ' ', CAST(CAST(tombstone AS INTEGER) AS VARCHAR))) + 1 AS bytes FROM runs),
 summed AS (SELECT *, sum(bytes) OVER (PARTITION BY level, run ORDER BY key) - bytes AS start FROM sized),
 chained AS (SELECT a.level, a.run, a.key, b.key AS next FROM (SELECT *, start + 1024 AS due FROM summed) a ASOF LEFT JOIN summed b ON a.level = b.level AND a.run = b.run AND b.start >= a.due),
 fences AS (SELECT level, run, min(key) AS key FROM chained GROUP BY ALL UNION ALL SELECT c.level, c.run, c.next FROM fences f JOIN chained c ON f.level = c.level AND f.run = c.run AND f.key = c.key WHERE c.next IS NOT NULL)
 SELECT CAST(level AS INTEGER) AS level, run, key FROM fences"""
GETS = (42, 7, 60, 149, -7, 1 << 40)
LONG_SQL = """CASE event_id % 6 WHEN 0 THEN concat('PUT ', user_id, ' ', event_id) WHEN 1 THEN concat('GET ', user_id) WHEN 2 THEN concat(' DELETE  ', user_id, ' x') WHEN 3 THEN concat('RANGE ', user_id, ' -', event_id) WHEN 4 THEN concat('p ', user_id) ELSE concat('PUT ', user_id) END"""


CATALOG: dict[str, tuple[Query, str | None]] = {
    "live_pairs": (on_log(resolve.live), f"WITH {LIVE_SQL} SELECT key, value FROM live"),
    "latest_versions": (on_log(resolve.latest), f"WITH {LATEST_SQL} SELECT key, value, tombstone, seq FROM latest"),
    "point_get": (on_log(lambda x: reads.get(x, 42)), f"WITH {LIVE_SQL} SELECT key, value FROM live WHERE key = 42"),
    "point_get_missing": (on_log(lambda x: reads.get(x, -7)), f"WITH {LIVE_SQL} SELECT key, value FROM live WHERE key = -7"),
    "multi_get": (lambda s, d: reads.multi_get(tables.event_log(s, d), wanted_keys(s, d)), f"WITH {LIVE_SQL} SELECT c_custkey AS key, value FROM customer LEFT JOIN live ON c_custkey = key"),
    "range_pairs": (on_log(lambda x: reads.range_pairs(x, LOW, HIGH)), f"WITH {LIVE_SQL} SELECT key, value FROM live WHERE key BETWEEN {LOW} AND {HIGH}"),
    "range_count": (on_log(lambda x: reads.range_count(x, LOW, HIGH)), f"WITH {LIVE_SQL} SELECT count(*) AS size FROM live WHERE key BETWEEN {LOW} AND {HIGH}"),
    "range_count_right_open": (on_log(lambda x: reads.range_count(x, LOW, HIGH, True)), f"WITH {LIVE_SQL} SELECT count(*) AS size FROM live WHERE key >= {LOW} AND key < {HIGH}"),
    "range_empty_when_inverted": (on_log(lambda x: reads.range_count(x, HIGH, LOW)), f"WITH {LIVE_SQL} SELECT count(*) AS size FROM live WHERE key BETWEEN {HIGH} AND {LOW}"),
    "multi_range_counts": (
        lambda s, d: reads.multi_range_counts(tables.event_log(s, d), supplier_ranges(s, d)),
        f"WITH {LIVE_SQL}, ranges AS (SELECT s_suppkey AS range_id, s_suppkey * 3 % 200 AS low, s_suppkey * 7 % 300 AS high FROM supplier) SELECT range_id, low, high, count(key) AS size FROM ranges LEFT JOIN live ON key BETWEEN low AND high GROUP BY ALL",
    ),
    "delete_view": (on_log(resolve.deleted), f"WITH {LATEST_SQL} SELECT key, seq FROM latest WHERE tombstone"),
    "tombstone_antijoin": (
        on_log(lambda x: x.select("key").distinct().join(resolve.deleted(x), "key", "left_anti")),
        f"WITH {LATEST_SQL} SELECT DISTINCT key FROM log WHERE key NOT IN (SELECT key FROM latest WHERE tombstone)",
    ),
    "as_of_snapshot": (
        on_log(lambda x: resolve.as_of(x, 500)),
        f"WITH {LOG_SQL} SELECT key, value FROM (SELECT * FROM log WHERE seq <= 500 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT tombstone",
    ),
    "version_intervals": (on_log(resolve.intervals), f"WITH {LOG_SQL} SELECT key, seq, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS until, value, tombstone FROM log"),
    "replay_gets": (
        on_ops(lambda x: replay.replay(x).where("op = 'g'").select("seq", "key", "value")),
        f"WITH {LOG_SQL} SELECT g.seq, g.key, CASE WHEN NOT log.tombstone THEN log.value END AS value FROM (SELECT * FROM ops WHERE op = 'g') g ASOF LEFT JOIN log ON g.key = log.key AND g.seq >= log.seq",
    ),
    "replay_deletes": (
        on_ops(lambda x: replay.replay(x).where("op = 'd'").select("seq", "key", "outcome")),
        f"WITH {LOG_SQL}, w AS (SELECT *, lag(tombstone) OVER (PARTITION BY key ORDER BY seq) AS before FROM log) SELECT seq, key, CASE WHEN before = false THEN 'effective' ELSE 'noop' END AS outcome FROM w WHERE tombstone",
    ),
    "replay_outcomes": (
        on_ops(replay.outcomes),
        f"""WITH {OPS_SQL}, w AS (SELECT *, last_value(CASE WHEN op <> 'g' THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ops)
 SELECT op, CASE op WHEN 'p' THEN 'put' WHEN 'g' THEN CASE WHEN before = 'p' THEN 'hit' ELSE 'miss' END ELSE CASE WHEN before = 'p' THEN 'effective' ELSE 'noop' END END AS outcome, count(*) AS n FROM w GROUP BY ALL""",
    ),
    "replay_range_counts": (
        lambda s, d: replay.range_counts(tables.event_log(s, d), view_ranges(s, d)),
        f"""WITH {LOG_SQL}, versions AS (SELECT key, seq, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS until, tombstone FROM log), ranges AS (SELECT seq, key - 10 AS low, key + 10 AS high FROM ops WHERE op = 'g')
 SELECT r.seq, r.low, r.high, count(v.key) AS size FROM ranges r LEFT JOIN versions v ON v.key BETWEEN r.low AND r.high AND v.seq < r.seq AND (v.until IS NULL OR v.until > r.seq) AND NOT v.tombstone GROUP BY ALL""",
    ),
    "flush_runs": (
        on_log(lambda x: layout.placed(x).where("level > 0").groupBy("batch", "key").agg(F.max_by("value", "seq").alias("value"), F.max_by("tombstone", "seq").alias("tombstone"))),
        f"WITH {PLACED_SQL} SELECT batch, key, value, tombstone FROM placed WHERE level > 0 QUALIFY row_number() OVER (PARTITION BY batch, key ORDER BY seq DESC) = 1",
    ),
    "run_min_max": (on_log(layout.run_bounds), f"WITH {PLACED_SQL} SELECT CAST(level AS INTEGER) AS level, run, min(key) AS min_key, max(key) AS max_key, count(*) AS n FROM runs GROUP BY ALL"),
    "run_overlap_prune": (
        on_log(overlapping_runs),
        f"WITH {PLACED_SQL} SELECT CAST(level AS INTEGER) AS level, run, min(key) AS min_key, max(key) AS max_key FROM runs GROUP BY level, run HAVING max(key) >= {LOW} AND min(key) <= {HIGH}",
    ),
    "physical_keys_per_level": (
        on_log(layout.physical_keys),
        f"WITH {PLACED_SQL} SELECT CAST(l.level AS INTEGER) AS level, count(runs.key) AS n FROM (SELECT unnest(range(1, 11)) AS level) l LEFT JOIN runs ON runs.level = l.level GROUP BY ALL",
    ),
    "live_by_location": (
        on_log(layout.live_by_level),
        f"WITH {PLACED_SQL}, newest AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT CAST(level AS INTEGER) AS level, count(*) AS live_keys FROM newest WHERE NOT tombstone GROUP BY ALL",
    ),
    "stats_summary": (
        on_log(summary),
        f"WITH {PLACED_SQL}, newest AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT (SELECT count(*) FROM newest WHERE NOT tombstone) AS logical_pairs, (SELECT count(*) FROM runs WHERE level > 0) AS stored",
    ),
    "stats_listing": (
        on_log(layout.listing),
        f"""WITH {PLACED_SQL}, newest AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
 SELECT concat(key, ':', CAST(trunc(value) AS BIGINT), ':', CASE WHEN level = 0 THEN 'M' ELSE concat('L', level) END) AS line FROM newest WHERE NOT tombstone""",
    ),
    "command_answers": (
        on_ops(lambda x: commands.answers(replay.replay(x).withColumn("value", F.col("value").cast("bigint")))),
        f"""WITH {LOG_SQL}, gets AS (SELECT g.seq, CASE WHEN NOT log.tombstone THEN log.value END AS value FROM (SELECT * FROM ops WHERE op = 'g') g ASOF LEFT JOIN log ON g.key = log.key AND g.seq >= log.seq)
 SELECT seq, coalesce(CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR), '') AS answer FROM gets UNION ALL SELECT seq, 'OK' FROM ops WHERE op <> 'g'""",
    ),
    "merge_runs_newest_wins": (
        on_log(lambda x: resolve.merge_runs([x.where("seq % 3 = 0"), x.where("seq % 3 = 1"), x.where("seq % 3 = 2")]).select("key", "value", "tombstone", "seq")),
        f"WITH {LATEST_SQL} SELECT key, value, tombstone, seq FROM latest",
    ),
    "compaction_keeps_tombstones": (
        on_log(lambda x: bottom_merge(x, False)),
        f"WITH {PLACED_SQL} SELECT key, value, tombstone, seq FROM runs WHERE level IN (1, 2) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1",
    ),
    "compaction_bottom_drop": (
        on_log(lambda x: bottom_merge(x, True)),
        f"WITH {PLACED_SQL} SELECT key, value, tombstone, seq FROM (SELECT * FROM runs WHERE level IN (1, 2) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT tombstone",
    ),
    "orders_live": (
        lambda s, d: resolve.live(tables.order_log(s, d)),
        "SELECT o_custkey AS key, o_totalprice AS value FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) WHERE o_orderstatus <> 'F'",
    ),
    "bloom_bits": (on_log(lambda x: bloom.build(x.select("key").distinct(), 1665)), f"WITH {LOG_SQL}, keys AS (SELECT DISTINCT key FROM log), {_bloom_sql(1665, 'keys')} SELECT DISTINCT CAST(bit AS BIGINT) AS bit FROM positions"),
    "bloom_probe": (
        bloom_probe,
        f"WITH {LOG_SQL}, keys AS (SELECT DISTINCT key FROM log), both_keys AS (SELECT key FROM keys UNION SELECT c_custkey FROM customer), {_bloom_sql(1665, 'both_keys')}, bits AS (SELECT DISTINCT bit FROM positions WHERE key IN (SELECT key FROM keys)) SELECT c_custkey AS key, bool_and(bit IN (SELECT bit FROM bits)) AS maybe FROM customer JOIN positions ON key = c_custkey GROUP BY ALL",
    ),
    "fence_blocks_approx": (
        on_log(lambda x: layout.fence_blocks(layout.runs(x))),
        f"""WITH {PLACED_SQL}, sized AS (SELECT *, length(concat_ws(' ', CAST(key AS VARCHAR), CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR), CAST(CAST(tombstone AS INTEGER) AS VARCHAR))) + 1 AS bytes FROM runs),
 blocks AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY level, run ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1024 AS block_no FROM sized)
 SELECT CAST(level AS INTEGER) AS level, run, CAST(floor(block_no) AS BIGINT) AS block_no, min(key) AS first_key, count(*) AS keys FROM blocks GROUP BY ALL""",
    ),
    "positional_zip": (
        on_ops(lambda x: replay.positional_zip(x.where("op <> 'd'"))),
        f"""WITH {OPS_SQL}, gets AS (SELECT row_number() OVER (ORDER BY seq) AS i, key AS get_key FROM ops WHERE op = 'g'), puts AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM ops WHERE op = 'p')
 SELECT seq, op, coalesce(get_key, key) AS key, value FROM puts LEFT JOIN gets USING (i)""",
    ),
    "parse_commands": (command_lines, PARSED_SQL.format(seq="event_id")),
    "store_roundtrip": (store_roundtrip, f"WITH {LIVE_SQL} SELECT key, value FROM live"),
    "stream_latest": (stream_latest, f"WITH {LIVE_SQL} SELECT key, value FROM live"),
    "exact_fences": (on_log(exact_fences), FENCES_SQL),
    "workload_generated": (generated, f"WITH {workload.workload_sql(WORKLOAD)} SELECT seq, op, a, b FROM generated"),
    "workload_outcomes": (generated_outcomes, f"WITH {OUTCOMES_SQL} SELECT op, outcome, count(*) AS n FROM outcomes GROUP BY ALL"),
    "workload_counters": (lambda s, d: replay.counters(generated_ops(s)), COUNTERS_SQL),
    "store_get": (store_get, f"WITH {LIVE_SQL}, wanted AS (SELECT CAST(unnest({list(GETS)}) AS BIGINT) AS key) SELECT key, value FROM wanted LEFT JOIN live USING (key)"),
    "store_range": (store_range, f"WITH {LIVE_SQL} SELECT key, value FROM live WHERE key BETWEEN {LOW} AND {HIGH}"),
    "memtable_overlay": (memtable_overlay, f"WITH {LIVE_SQL} SELECT key, value FROM live"),
    "memtable_overlay_range": (memtable_overlay_range, f"WITH {LIVE_SQL} SELECT key, value FROM live WHERE key BETWEEN {LOW} AND {HIGH}"),
    "snapshot_after_merge": (
        snapshot_after_merge,
        f"WITH {LOG_SQL}, half AS (SELECT * FROM log WHERE seq <= (SELECT floor((min(seq) + max(seq)) / 2) FROM log)) SELECT key, value FROM (SELECT * FROM half QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT tombstone",
    ),
    "text_runs_live": (
        text_runs_live,
        f"WITH {PLACED_SQL} SELECT CAST(key AS INTEGER) AS key, CAST(trunc(value) AS INTEGER) AS value FROM (SELECT * FROM runs WHERE level > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT tombstone",
    ),
    "command_file": (command_file, PARSED_SQL.format(seq="row_number() OVER (ORDER BY event_id) - 1")),
    "long_form_commands": (
        long_form,
        f"""WITH lines AS (SELECT event_id AS seq, {LONG_SQL} AS line FROM events), cut AS (SELECT seq, regexp_extract(line, '^\\s*(PUT|GET|DELETE|RANGE)', 1) AS word, regexp_extract(line, '[A-Z]+\\s+([+-]?[0-9]+)', 1) AS first, regexp_extract(line, '[A-Z]+\\s+[+-]?[0-9]+\\s+([+-]?[0-9]+)', 1) AS second FROM lines)
 SELECT seq, CASE word WHEN 'PUT' THEN 'p' WHEN 'GET' THEN 'g' WHEN 'DELETE' THEN 'd' WHEN 'RANGE' THEN 'r' END AS op, TRY_CAST(nullif(first, '') AS INTEGER) AS a, CASE WHEN word IN ('PUT', 'RANGE') THEN TRY_CAST(nullif(second, '') AS INTEGER) END AS b FROM cut""",
    ),
    "binary_pairs_load": (binary_pairs, "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS at, CAST(c_custkey AS INTEGER) AS key, CAST(trunc(c_acctbal) AS INTEGER) AS value FROM customer"),
    "shell_answers": (
        shell_answers,
        f"""WITH {LIVE_SQL}, gets AS (SELECT g.seq, CASE WHEN NOT log.tombstone THEN log.value END AS value FROM (SELECT * FROM ops WHERE op = 'g') g ASOF LEFT JOIN log ON g.key = log.key AND g.seq >= log.seq),
 said AS (SELECT seq, coalesce(CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR), '') AS answer FROM gets UNION ALL SELECT seq, 'OK' FROM ops WHERE op <> 'g'
 UNION ALL SELECT 1099511627776, concat('Range ({LOW} to {HIGH}):  SIZE: ', (SELECT count(*) FROM live WHERE key BETWEEN {LOW} AND {HIGH})) UNION ALL SELECT 1099511627777, 'Range ({HIGH} to {LOW}):  SIZE: 0'
 UNION ALL SELECT 1099511627778, concat('Range (-2147483648 to 2147483647):  SIZE: ', (SELECT count(*) FROM live)))
 SELECT row_number() OVER (ORDER BY seq) - 1 AS n, answer FROM said""",
    ),
    "replay_wide_ranges": (
        wide_ranges,
        f"""WITH {LOG_SQL}, versions AS (SELECT key, seq, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS until, tombstone FROM log),
 ranges AS (SELECT seq, CASE seq % 4 WHEN 0 THEN -2147483648 WHEN 1 THEN key ELSE key - seq % 4 * 50 END AS low, CASE seq % 4 WHEN 0 THEN 2147483647 WHEN 3 THEN key - 200 ELSE key + seq % 4 * 40 END AS high FROM ops WHERE op = 'g')
 SELECT r.seq, r.low, r.high, count(v.key) AS size FROM ranges r LEFT JOIN versions v ON v.key BETWEEN r.low AND r.high AND v.seq < r.seq AND (v.until IS NULL OR v.until > r.seq) AND NOT v.tombstone GROUP BY ALL""",
    ),
    "memtable_keys": (on_log(layout.held_keys), f"WITH {PLACED_SQL} SELECT count(DISTINCT key) AS keys FROM placed WHERE level = 0"),
    "running_keys": (
        on_log(layout.running_keys),
        f"WITH {PLACED_SQL}, firsts AS (SELECT *, row_number() OVER (PARTITION BY batch, key ORDER BY seq) = 1 AS first FROM placed) SELECT seq, batch, count(*) FILTER (first) OVER (PARTITION BY batch ORDER BY seq) AS keys FROM firsts",
    ),
}
