"""Streams of writes (seq, key, value, tombstone): the running live view, and flushing micro-batches into a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..dsl import Shell
from ..operators.resolve import latest
from ..store import Store


def read_log(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over the Parquet files of a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_stream(log: DataFrame) -> DataFrame:
    """The newest version of every key, kept as state by key; order of arrival does not matter, seq does."""
    return latest(log)


def live_table(log: DataFrame, store: Store, checkpoint: str) -> DataFrame:
    """Runs the stream over what there is now; the keys that a micro-batch changes go into the store, whose live pairs these are.

    The state and the store are spread over the executors; the driver holds neither.
    """
    changed = latest_stream(log).writeStream.outputMode("update").foreachBatch(lambda batch, _: store.put(batch.select("seq", "key", "value", "tombstone")))
    changed.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return store.live()


def command_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """(at, client, n, line): command lines as a stream of the text files of a path, each the lines of a client in their order.

    A file is read as one row, so that its lines keep their numbers.
    """
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("wholetext", "true").text(path)
    meta = F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("client")
    return files.select(*meta, F.posexplode(F.split("value", "\\n")).alias("n", "line"))


def answer_stream(lines: DataFrame, shell: Shell, checkpoint: str, answer: Callable[[list[str]], None]) -> StreamingQuery:
    """Each micro-batch of commands (at, client, n, line) goes through the shell, file by file, and ``answer`` gets the answers."""

    def serve(batch: DataFrame, _: int) -> None:
        answer(shell.run(batch.select(F.struct("at", "client", "n").alias("at"), "line")))

    return lines.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush_stream(log: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Each micro-batch becomes a run. A batch that is replayed after a failure adds equal rows, which changes no read."""

    def flush(batch: DataFrame, _: int) -> None:
        store.put(batch.select("seq", "key", "value", "tombstone"))

    return log.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


