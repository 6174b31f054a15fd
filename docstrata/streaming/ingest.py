"""Continuous ingest and refresh with Structured Streaming.

A batch of a stream is one piece of work of the store, with a key of the stream's name and the batch's number: a batch that
is replayed after a failure finds its key in the log and changes nothing, and a stream on an existing store goes on
behind what is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import Settings, ingest_batch, refresh
from ..operators.store import current


def _started(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool, every: str) -> StreamingQuery:
    out = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)  # without state, the same as append
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


def append_stream(rows: DataFrame, store: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, once: bool = True, every: str = "60 seconds") -> StreamingQuery:
    """Appends a stream of version rows to a Parquet table, a folder a batch; a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return _started(rows, write, checkpoint, once, every)


def stored(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store)


def current_from(spark: SparkSession, store: str) -> DataFrame:
    return current(stored(spark, store).drop("batch"))


def ingest_stream(entries: DataFrame, where: str, checkpoint: str, version: Callable[[int], Column], settings: Settings = Settings(), name: str | None = None, once: bool = True, every: str = "60 seconds") -> StreamingQuery:  # noqa: B008
    """A stream of entries through the write path.  name tells this stream's batches from others' (by default, its
    checkpoint)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch.sparkSession, where, f"{name or checkpoint}#{batch_id}", batch, version(batch_id), settings)

    return _started(entries, write, checkpoint, once, every)


def refresh_stream(ticks: DataFrame, where: str, live: Callable[[DataFrame], DataFrame], checkpoint: str, settings: Settings = Settings(), name: str | None = None, once: bool = True, every: str = "60 seconds") -> StreamingQuery:  # noqa: B008
    """A refresh of the store's due rows at each tick (a stream with a ``now``, such as the rate source's timestamp): statuses
    and new versions in one commit.  A batch without a tick does nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        now = batch.agg(F.max("now").alias("now")).first()["now"]
        if now is not None:
            refresh(batch.sparkSession, where, f"{name or checkpoint}#{batch_id}", live, F.lit(now).cast("timestamp_ntz"), settings)

    return _started(ticks, write, checkpoint, once, every)
