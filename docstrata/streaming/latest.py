"""The latest version of each path, kept as state while versions stream in, in any order.

The state of a path is one row, an aggregate that Spark keeps and merges by partition: the greatest by version_id, then by
event_id, so that an earlier version, and one that comes again, change nothing.  A batch emits the paths that it has rows of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest_stream(rows: DataFrame) -> DataFrame:
    """A stream of version rows (logical_path, version_id, event_id and any others) to the latest of each path that a batch
    has rows of, with ``update``, which counts the path's rows so far: the one with the greatest is the latest."""
    whole = F.struct("version_id", "event_id", *[c for c in rows.columns if c not in ("logical_path", "version_id", "event_id")])
    held = rows.groupBy("logical_path").agg(F.max_by(whole, F.struct("version_id", "event_id")).alias("x"), F.count("*").alias("update"))
    return held.select("logical_path", "x.*", "update").select(*rows.columns, "update")


def last_updates(updates: DataFrame) -> DataFrame:
    """The latest row of each path, of all that ``latest_stream`` has written."""
    rest = [c for c in updates.columns if c not in ("logical_path", "update", "batch")]
    last = updates.groupBy("logical_path").agg(F.max_by(F.struct(*rest), "update").alias("x"))
    return last.select("logical_path", "x.*")
