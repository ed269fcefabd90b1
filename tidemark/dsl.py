"""The command front end: runs parsed commands in order against a store and gives their answers."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import replay
from .operators.reads import range_count
from .operators.resolve import latest
from .sources.commands import answers, parse, read_lines
from .store import Store, folder

WRITES = "seq long, key int, value int, tombstone boolean"
COLUMNS = ["seq", "key", "value", "tombstone"]
#: So many ranges between two other commands are counted one by one, more of them in one pass.
FEW = 16
NESTED = "Error: A loaded file cannot load files."


class Shell:
    """Writes are held like a memtable, which reads look at first, and become one run once it holds ``capacity`` keys.

    Commands of a list are run one by one. Those of a frame stay on the executors, and so do their answers and the writes that
    are held after them; the driver sees counts, and the commands l, s and c.
    """

    def __init__(self, spark: SparkSession, path: str, capacity: int = 100_000):
        self.spark, self.store, self.capacity, self.seq = spark, Store(spark, path), capacity, 0
        self._held: dict[int, tuple] = {}
        self._left: DataFrame | None = None
        self.loads: list[float] = []
        log = self.store.log()
        if log is not None:
            self.seq = log.agg({"seq": "max"}).first()[0] + 1

    @property
    def held(self) -> dict[int, tuple]:
        """The held writes by key, fewer than ``capacity``; what a frame of commands left comes to the driver when it is asked for."""
        if self._left is not None:
            self._held, self._left = {w["key"]: tuple(w) for w in self._left.toLocalIterator()}, None
        return self._held

    def flush(self) -> None:
        if self.holds():
            self.store.put(self.memtable())
            self._held, self._left = {}, None

    def holds(self) -> bool:
        return self._left is not None or bool(self._held)

    def memtable(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """The held writes, newest of each key, in [low, high]."""
        if self._left is not None:
            return self._left.where(F.lit(True) if low is None else F.col("key").between(low, high))
        return self.spark.createDataFrame([w for k, w in self._held.items() if (low is None or k >= low) and (high is None or k <= high)], WRITES)

    def run(self, lines: list[str] | DataFrame, loading: bool = False) -> list[str]:
        """Answers, one a command, for a user to see; ``answers`` leaves those of a frame where they are."""
        if isinstance(lines, DataFrame):
            return self._shown(self._answers(lines, loading)[0])
        out = []
        for c in parse(self.spark.createDataFrame(list(enumerate(lines)), "n long, line string")).orderBy("n").toLocalIterator():
            out += self.answer(c, loading)
        return out

    def answer(self, c, loading: bool = False) -> list[str]:
        if c["error"]:
            return [c["error"]]
        if c["op"] in "pd":
            self.held[c["a"]] = (self.seq, c["a"], c["b"] if c["op"] == "p" else None, c["op"] == "d")
            self.seq += 1
            if len(self.held) >= self.capacity:
                self.flush()
            return ["OK"]
        if c["op"] == "g":
            write = self.held.get(c["a"])
            value = write[2] if write else self.store.get(c["a"])
            return ["" if value is None else str(value)]
        if c["op"] == "r":
            log = self.store.log(c["a"], c["b"], self.memtable(c["a"], c["b"]))
            return [f"Range ({c['a']} to {c['b']}):  SIZE: {range_count(log, c['a'], c['b']).first()[0]}"]
        if c["op"] == "l":
            return self.load(c["line"].split()[1:], loading)
        if c["op"] == "s":
            return self.stats()
        return [self._cleanup()]

    def load(self, words: list[str], loading: bool) -> list[str]:
        """Runs a command file, which may not load another; the number of threads is checked, the tasks are Spark's."""
        return self._load(words, loading, lambda lines: self.run(lines, True))

    def _load(self, words: list[str], loading: bool, run):
        if loading:
            return [NESTED]
        if not words:
            return ["Error: Invalid load format."]
        if len(words) > 1 and not (words[1].isdigit() and 1 <= int(words[1]) <= 32):
            return ["Error: The number of threads must be from 1 to 32."]
        began = time.monotonic()
        try:
            out = run(read_lines(self.spark, words[0]))
        except Exception as e:
            if "InvalidInputException" not in str(e) and "Input path does not exist" not in str(e):
                raise
            return [f"Error: No such file: {words[0]}"]
        self.loads.append(time.monotonic() - began)
        return out

    def stats(self) -> list[str]:
        """Counts, then a line for each live pair, in key order: what a user asks to see is shown in full."""
        return self._shown(self._stats()[0])

    def _cleanup(self) -> str:
        self._held, self._left = {}, None
        self.store.cleanup()
        return "Cleanup initiated."

    # commands of a frame

    def answers(self, lines: DataFrame) -> DataFrame:
        """(n, answer), n from 0 without gaps: what ``run`` answers to the commands of a frame, by its first column, which orders
        them and does not repeat. The shell has taken all of them when this returns; the answers can be read at any time until
        the store is vacuumed."""
        return self._answers(lines, False)[0]

    def _answers(self, lines: DataFrame, loading: bool) -> tuple[DataFrame, int]:
        """The answers, and how many there are. Between two of the commands l, s and c all others are answered at once."""
        order = lines.columns[0]
        error = F.when(F.lit(loading) & (F.col("op") == "l"), NESTED).otherwise(F.col("error"))
        text = F.when(F.col("op") == "l", F.col("line")).alias("line")
        rows, total = self._in_order(parse(lines).select(F.col(order).alias("at"), "op", "a", "b", error.alias("error"), text), "at")
        alone = rows.where("error is null and op in ('l', 's', 'c')").select("n", "op", "line").orderBy("n").collect()
        if alone:  # files that have n, so that a part of them can be read
            rows = self._written(rows.drop("at"), "n")
        out, begin, shift = [], 0, 0
        for c in alone:
            out += self._between(rows, begin, c["n"], shift)
            if c["op"] == "l":
                said = self._load(c["line"].split()[1:], loading, lambda more: self._answers(more, True))
            else:
                said = self._stats() if c["op"] == "s" else [self._cleanup()]
            frame, size = (self._listed(said), len(said)) if isinstance(said, list) else said
            out.append(frame.select((F.col("n") + c["n"] + shift).alias("n"), "answer"))
            begin, shift = c["n"] + 1, shift + size - 1
        out += self._between(rows, begin, total, shift)
        return (reduce(DataFrame.union, out) if out else self._listed([])), total + shift

    def _between(self, rows: DataFrame, begin: int, end: int, shift: int) -> list[DataFrame]:
        """Frames with the answers to the commands from ``begin`` to ``end``, which hold p, g, d, r and invalid ones."""
        if begin == end:
            return []
        rows = rows.where(F.col("n").between(begin, end - 1))
        good = rows.where("error is null")
        ops = good.where("op <> 'r'").select(F.col("n").alias("seq"), "op", F.col("a").alias("key"), F.when(F.col("op") == "p", F.col("b")).alias("value"))
        log = ops.where("op <> 'g'").select("seq", "key", "value", (F.col("op") == "d").alias("tombstone"))
        ranges = good.where("op = 'r'").select(F.col("n").alias("seq"), F.col("a").alias("low"), F.col("b").alias("high"))
        before = self.store.live(self.memtable() if self.holds() else None)
        known, whole = ops, log
        if before is not None:
            asked = before.join(ops.where("op = 'g'").select("key").distinct(), "key", "left_semi")
            known = ops.union(asked.select(F.lit(-1).cast("long").alias("seq"), F.lit("p").alias("op"), "key", "value"))
            # a key has one earlier row, so these may stand in any order; spread over seq they are no single task
            spread = -1 - F.pmod(F.xxhash64("key"), F.lit(end - begin))
            whole = log.union(before.select(spread.alias("seq"), "key", "value", F.lit(False).alias("tombstone")))
        out = [answers(replay.replay(known).where("seq >= 0")), rows.where("error is not null").select(F.col("n").alias("seq"), F.col("error").alias("answer"))]
        if some := ranges.limit(FEW + 1).collect():
            if len(some) > FEW:
                sizes = replay.range_counts(whole, ranges)
            else:
                one = lambda r: range_count(whole.where(F.col("seq") < r["seq"]), r["low"], r["high"]).select(*[F.lit(x).alias(c) for c, x in r.asDict().items()], "size")
                sizes = reduce(DataFrame.union, map(one, some))
            out.append(sizes.select("seq", F.format_string("Range (%d to %d):  SIZE: %d", "low", "high", "size").alias("answer")))
        self._hold(log.withColumn("seq", F.col("seq") - begin + self.seq))
        self.seq += end - begin
        return [x.select((F.col("seq") + shift).alias("n"), "answer") for x in out]

    def _hold(self, writes: DataFrame) -> None:
        """Takes writes newer than those held: the memtable is flushed wherever it is full, and the rest is held."""
        rows = writes.union(self.memtable()) if self.holds() else writes
        left = self._written(latest(rows).select(COLUMNS))
        if left.count() >= self.capacity:
            rows = self._written(rows.withColumn("before", F.lag("seq").over(Window.partitionBy("key").orderBy("seq"))), "seq")
            begin, last = rows.agg(F.min("seq"), F.max("seq")).first()
            while (full := self._full(rows, begin, last)) is not None:
                self.store.put(rows.where(F.col("seq").between(begin, full)).select(COLUMNS))
                begin = full + 1
            left = self._written(latest(rows.where(F.col("seq") >= begin)).select(COLUMNS))
        self._held, self._left = {}, left

    def _full(self, rows: DataFrame, begin: int, last: int, parts: int = 1024) -> int | None:
        """The seq of the write that fills a memtable which is empty at ``begin``. ``rows`` have, as ``before``, the seq of the write
        ahead of them with their key. Stretches of twice the length are looked at until one holds it, and then parts of that."""
        missing, low, length = self.capacity, begin, 4 * self.capacity
        while low <= last:
            width = -(-length // parts)
            new = rows.where(F.col("seq").between(low, low + length - 1) & (F.col("before").isNull() | (F.col("before") < begin)))
            for part, n in sorted(new.groupBy(F.floor((F.col("seq") - low) / width).alias("part")).count().collect()):
                if n >= missing:
                    low, length = low + part * width, width
                    break
                missing -= n
            else:
                low, length = low + length, 2 * length
                continue
            if width == 1:
                return low
        return None

    def _stats(self) -> tuple[DataFrame, int]:
        tail = self.memtable()
        pairs, total = self._in_order(self.store.listing(tail).select("key", F.concat_ws(":", "key", "value", "place").alias("answer")), "key")
        counts = [f"{k}: {v}" for k, v in self.store.stats(tail).items()]
        return self._listed(counts).union(pairs.select((F.col("n") + len(counts)).alias("n"), "answer")), len(counts) + total

    def _listed(self, said: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(said)), "n long, answer string")

    def _shown(self, said: DataFrame) -> list[str]:
        return [r["answer"] for r in said.orderBy("n").toLocalIterator()]

    def _written(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """``rows`` as files, sorted by ``order``."""
        path = folder(self.spark)
        (rows.repartitionByRange(order).sortWithinPartitions(order) if order else rows).write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _in_order(self, rows: DataFrame, order: str) -> tuple[DataFrame, int]:
        """``rows`` with a gapless long ``n`` from 0 by ``order``, and how many there are: the place of a row in its file and the
        number of rows in the files before it, of which there are as many as tasks."""
        rows = self._written(rows, order).withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
        ahead, total = [], 0
        for f in rows.groupBy("_file").agg(F.min(order).alias("first"), F.count("*").alias("rows")).orderBy("first").select("_file", "rows").collect():
            ahead.append((f["_file"], total))
            total += f["rows"]
        ahead = self.spark.createDataFrame(ahead, "_file string, _ahead long")
        return rows.join(F.broadcast(ahead), "_file").withColumn("n", F.col("_ahead") + F.col("_row")).drop("_file", "_row", "_ahead"), total
