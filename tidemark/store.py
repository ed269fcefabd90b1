"""A tiered store: sorted Parquet runs behind a manifest that is replaced atomically.

A batch of writes becomes a run of level 1; ``ratio`` runs of a level are merged into one of the next. Recency is always
``seq``, never the place of a file. Readers see the runs of one manifest, and those stay readable after later commits: the
runs that a manifest leaves out are removed by ``vacuum`` alone, once they have been out for more than ``keep`` manifests. A
failed merge changes nothing. Paths may be on any file system Spark can write.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import date, datetime, timedelta
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.resolve import latest, live, merge_runs


#: How key bounds that JSON has no type for are written and read.
TYPES = {
    "date": (date.isoformat, date.fromisoformat),
    "datetime": (datetime.isoformat, datetime.fromisoformat),
    "timedelta": (lambda x: [x.days, x.seconds, x.microseconds], lambda x: timedelta(*x)),
    "Decimal": (str, Decimal),
    "bytes": (bytes.hex, bytes.fromhex),
    "bytearray": (bytearray.hex, bytearray.fromhex),
}


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; below a temporary one where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='tidemark-')).rstrip('/')}/{uuid.uuid4().hex}"


def to_json(manifest: dict) -> str:
    return json.dumps(manifest, default=lambda x: {"type": type(x).__name__, "is": TYPES[type(x).__name__][0](x)})


def from_json(text: str) -> dict:
    return json.loads(text, object_hook=lambda x: TYPES[x["type"]][1](x["is"]) if x.keys() == {"type", "is"} else x)


class Store:
    """``key`` may have any orderable type (numbers, text, dates, times, intervals, bytes) and ``value`` any; both are fixed by the
    first batch. What is read may have ``held`` writes that are in no run yet, as rows (seq, key, value, tombstone), laid over
    it."""

    def __init__(self, spark: SparkSession, path: str, ratio: int = 5, levels: int = 10, partitions: int = 4):
        self.spark, self.path, self.ratio, self.levels, self.partitions = spark, path.rstrip("/"), ratio, levels, partitions
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def manifest(self) -> dict:
        """The newest manifest: its version, and runs as dicts of id, level, path, rows, min_key, max_key."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        versions = [int(n[9:-5]) for n in found if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return {"version": 0, "next_id": 0, "runs": [], "retired": []}
        stream = self._fs.open(self._path(f"{self.path}/manifest-{max(versions)}.json"))
        try:
            return from_json(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict, runs: list[dict], next_id: int) -> None:
        gone = {r["path"] for r in manifest["runs"]} - {r["path"] for r in runs}
        retired = manifest["retired"] + [{"path": p, "since": manifest["version"] + 1} for p in sorted(gone)]
        self._place(manifest, {"version": manifest["version"] + 1, "next_id": next_id, "runs": runs, "retired": retired})

    def _place(self, manifest: dict, new: dict) -> None:
        temporary = self._path(f"{self.path}/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary)
        stream.write(bytearray(to_json(new).encode()))
        stream.close()
        if not self._fs.rename(temporary, self._path(f"{self.path}/manifest-{new['version']}.json")):
            self._fs.delete(temporary, False)
            raise RuntimeError("another writer committed first")
        if manifest["version"]:
            self._fs.delete(self._path(f"{self.path}/manifest-{manifest['version']}.json"), False)

    def vacuum(self, keep: int = 0) -> int:
        """Removes the runs that have been out for more than ``keep`` manifests, and says how many; older reads of them end."""
        m = self.manifest()
        out = [r for r in m["retired"] if m["version"] - r["since"] >= keep]
        if out:
            self._place(m, m | {"version": m["version"] + 1, "retired": [r for r in m["retired"] if r not in out]})
            for r in out:
                self._fs.delete(self._path(r["path"]), True)
        return len(out)

    def _write(self, rows: DataFrame, level: int, run_id: int) -> dict | None:
        path = f"{self.path}/level={level}/run={run_id}-{uuid.uuid4().hex[:8]}"
        sorted_rows = rows.repartitionByRange(self.partitions, "key").sortWithinPartitions("key")
        sorted_rows.write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)
        b = self.spark.read.parquet(path).agg(F.count("*").alias("rows"), F.min("key").alias("min_key"), F.max("key").alias("max_key")).first()
        if not b["rows"]:
            self._fs.delete(self._path(path), True)
            return None
        return {"id": run_id, "level": level, "path": path, "rows": b["rows"], "min_key": b["min_key"], "max_key": b["max_key"]}

    def put(self, batch: DataFrame) -> None:
        """Writes (seq, key, value, tombstone) as one run, the newest version of each key, and merges full levels."""
        m = self.manifest()
        run = self._write(latest(batch), 1, m["next_id"])
        if run:
            self._commit(m, [*m["runs"], run], m["next_id"] + 1)
            self.compact()

    def compact(self) -> None:
        for level in range(1, self.levels):
            m = self.manifest()
            inputs = [r for r in m["runs"] if r["level"] == level]
            if len(inputs) < self.ratio:
                continue
            rest = [r for r in m["runs"] if r["level"] != level]
            # a tombstone may go only if no run of the target level or below can still hold its key
            bottom = not any(r["level"] > level for r in rest)
            merged = self._write(merge_runs([self.spark.read.parquet(r["path"]) for r in inputs], bottom), level + 1, m["next_id"])
            self._commit(m, rest + ([merged] if merged else []), m["next_id"] + 1)

    def log(self, low=None, high=None, held: DataFrame | None = None) -> DataFrame | None:
        """Rows of all runs that may hold keys in [low, high], and ``held``, whose writes are newer than those of runs; runs outside
        are not opened. None if there are neither runs nor held writes."""
        every = self.manifest()["runs"]
        runs = [r for r in every if (low is None or r["max_key"] >= low) and (high is None or r["min_key"] <= high)]
        if every and not runs and held is None:
            return self.spark.read.parquet(every[0]["path"]).where("false")
        rows = [self.spark.read.parquet(r["path"]) for r in runs] + ([] if held is None else [held.select("key", "value", "tombstone", "seq")])
        return reduce(DataFrame.unionByName, rows) if rows else None

    def live(self, held: DataFrame | None = None) -> DataFrame | None:
        log = self.log(held=held)
        return None if log is None else live(log)

    def get(self, key, held: DataFrame | None = None):
        log = self.log(key, key, held)
        row = None if log is None else live(log.where(F.col("key") == F.lit(key))).first()
        return None if row is None else row["value"]

    def range(self, low, high, held: DataFrame | None = None) -> DataFrame | None:
        log = self.log(low, high, held)
        return None if log is None else live(log.where(F.col("key").between(low, high))).orderBy("key")

    def stats(self, held: DataFrame | None = None) -> dict:
        """Live pairs, and stored rows by level."""
        runs, pairs = self.manifest()["runs"], self.live(held)
        return {"logical_pairs": pairs.count() if pairs is not None else 0} | {f"LVL{n}": sum(r["rows"] for r in runs if r["level"] == n) for n in range(1, self.levels + 1)}

    def listing(self, held: DataFrame | None = None) -> DataFrame | None:
        """(key, value, place) of the live pairs; the place is ``M`` for held writes and ``L<level>`` for runs."""
        runs = [self.spark.read.parquet(r["path"]).withColumn("place", F.lit(f"L{r['level']}")) for r in self.manifest()["runs"]]
        rows = runs + ([] if held is None else [held.select("key", "value", "tombstone", "seq", F.lit("M").alias("place"))])
        if not rows:
            return None
        newest = {c: F.max_by(c, "seq").alias(c) for c in ("value", "tombstone", "place")}
        return reduce(DataFrame.unionByName, rows).groupBy("key").agg(*newest.values()).where("not tombstone").select("key", "value", "place")

    def cleanup(self) -> None:
        """Drops everything; the store stays usable."""
        self._commit(self.manifest(), [], 0)
