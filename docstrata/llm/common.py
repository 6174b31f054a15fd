"""Helpers shared by the corpus operators: word hashing on byte buffers, checkpoints, components.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text.  All hashes are 64-bit and depend on nothing but the
bytes, so every executor computes the same values.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
WORD_CLASS = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LARGE = ("measured", "sets", "mixing", "long", "stitched", "scores", "free", "handed", "taught")  # tables that grow with the texts
FEW_EDGES = 1000
BATCH_CONF, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 8 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply, twice)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0x9E6C63D0676A9A99)
_powers = np.ones(1, dtype=U64)


def _power_table(n: int) -> np.ndarray:
    """Powers of the base up to n; a word of n bytes needs n of them."""
    global _powers
    if len(_powers) < n:
        size = 1 << max(8, int(n - 1).bit_length())
        steps = np.full(size, _BASE, dtype=U64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def utf8_rows(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The bytes of each string of an Arrow column, without copying; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]] if valid[i] else None


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte buffer."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~IS_SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    letters = buf[within + np.repeat(starts, lengths)]
    return mix(np.add.reduceat(BYTE_CODE[letters] * _power_table(int(lengths.max()))[within], first) + lengths.astype(U64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; the whole sequence as one run if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    acc = np.full(n - width + 1, U64(width), dtype=U64)
    for i in range(width):
        acc = mix(acc + words[i : n - width + 1 + i] * U64(2 * i + 0x9E3779B97F4A7C15))
    return acc


def shingles(buf: np.ndarray | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: A-Z lower-cased, ``size`` words each."""
    if buf is None or not len(buf):
        return np.zeros(0, dtype=U64)
    low = LOWER[buf]
    return np.unique(window_hashes(word_hashes(low, *word_spans(low)), size))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate data.  Where none is set, a local session (tests) gets one of its
    own; a cluster raises, as its executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-docstrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder, so a lost executor loses nothing."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


_recorder: ContextVar[list[str] | None] = ContextVar("recorder", default=None)


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Adds the folders that ``written`` makes in this block, and in this thread, to paths, for a caller who knows when
    they are done with."""
    held = _recorder.set(paths)
    try:
        yield
    finally:
        _recorder.reset(held)


def emptied(spark: SparkSession, paths: list[str]) -> None:
    """Writes an empty table over each of these folders: their results have been written, and their bytes are free."""
    nothing = spark.createDataFrame([], "done boolean").coalesce(1)
    while paths:
        nothing.write.mode("overwrite").parquet(paths.pop())


def written(df: DataFrame, label: str) -> DataFrame:
    """The table written as Parquet in the shared folder and read again (smaller than a checkpoint)."""
    path = shared_path(df.sparkSession, label)
    paths = _recorder.get()
    if paths is not None and label in LARGE:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded by bytes: texts differ in length by orders of magnitude, so a number of rows
    bounds no memory.  A bound that the session has set stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF) == BATCH_DEFAULT:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def least_reached(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Each node of these edges to the least node that it reaches."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = above
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def closed(edges: DataFrame) -> DataFrame:
    """(node, up) of a few edges (a, b): all of them in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = least_reached((a, b) for batch in batches for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["node", "up"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, up long")


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of an undirected graph given as (a, b) longs; returns (node, component).

    Each round maps every node to the least of itself and its neighbours and contracts the graph, so node
    ids should be in no order along paths (hashes are); then the rounds grow as the logarithm of the longest
    path.  The component is its least node.  Each round is written, so plans stay short and an empty
    partition costs no task in the next.  Nodes and edges stay in Spark throughout.  Every round has the same jobs,
    broadcasts and tasks for the driver to keep, however few edges are left, so at most ``few`` edges (16 KB, at any
    input size) are closed in one round: a task follows their paths to the end.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    while left_over := edges.count():
        last = left_over <= few
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up"))
        parent = written(closed(edges) if last else nearest, "parents")
        if label is None:
            label = parent.select("node", F.col("up").alias("component"))
        else:
            label = label.join(parent.select(F.col("node").alias("component"), "up"), "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")
            )
        if last:
            break
        left = parent.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = edges.join(left, "a").join(right, "b").filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        edges = written(edges, "edges")
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return written(label, "components")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
