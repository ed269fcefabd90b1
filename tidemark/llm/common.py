"""Shared pieces: table access, intermediates in the shared folder, connected components, bounded Bloom filters.

Functions that run on executors are pickled by value (``by_value``), so executors need no copy of this package.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_value(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of applications that have no shared one.
OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one of the application in local mode, in which
    all tasks see it, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in OWN:
            OWN[app] = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        base = OWN[app]
    return base.rstrip("/")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor costs
    no more than a reread. The files stay until the owner of the folder clears it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(rows: DataFrame, most: int = 300_000) -> DataFrame:
    """``rows`` of a staged table of few narrow columns, broadcast in joins if counted to be ``most`` at most."""
    return F.broadcast(rows) if rows.count() <= most else rows


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, comp) for every node of ``edges`` (u long, v long); comp is the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each round is two joins on partially aggregated
    minima, cut by a staged table, so neither the driver nor any task holds a component. Self loops and repeated edges
    are ignored; an empty input gives an empty result.
    """
    e = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0] or tuple(mark) == before:
            break
        before = tuple(mark)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def release() -> None:
    """Hands memory that this Python worker no longer uses back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow``, after which the worker keeps no memory but what it still holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that only those few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def fence(column: Column) -> Column:
    """``column``, which the optimizer may neither copy into a filter below nor inline: it is computed once a row."""
    return F.when(F.rand(0) >= 0, column)


BLOOM_BITS = 26


def bloom_words(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of fixed size over a column of 64-bit hashes, as int64 words; two slices of the hash are its probes.

    At most 2 ** 20 rows reach the driver. The filter only thins rows ahead of an exact join: once it is full it lets
    everything pass, and results stay the same.
    """
    probes = F.explode(F.array(*[F.shiftright(column, i).bitwiseAND((1 << BLOOM_BITS) - 1) for i in (0, BLOOM_BITS)]))
    got = keys.select(probes.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x")).toArrow()
    words = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    words[got["w"].to_numpy()] = got["x"].to_numpy()
    return words


def in_bloom(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which int64 hashes may be in the filter."""
    ok = np.ones(len(keys), bool)
    for i in (0, BLOOM_BITS):
        p = (keys >> i) & ((1 << BLOOM_BITS) - 1)
        ok &= (words[p >> 6] >> (p & 63)) & 1 == 1
    return ok


def passing(df: DataFrame, column: str, words: np.ndarray) -> DataFrame:
    """Rows whose 64-bit hash ``column`` (not null) may be in a filter of :func:`bloom_words`."""
    cast = df.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(cast.value, keys.to_numpy()))

    return df.where(hit(column))


by_value(__name__)
