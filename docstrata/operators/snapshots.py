"""A store's tables as snapshots of immutable parts.

A store is a folder.  Each table has parts, folders of Parquet files that are written once and never changed, and the log
of commits says which parts a commit adds and which it retires.  Parts are written first and the commit last, so a
failed try leaves nothing visible; a snapshot is what the log says up to a commit, so a reader of an older snapshot still
reads the parts that it began with, until ``vacuum`` removes them.  A commit carries the key of the work that it is of:
work whose key is in the log has been done and is not done again.

The log is a row a commit and a name a part; its size is that of the work done, not of the data.  A store has one writer
at a time; a commit number that is taken raises ``Conflict``.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "files": (
        "logical_path string, version_id timestamp_ntz, tombstone boolean, source_type string, source_path string, source_mtime_ms long, source_sha256 string, blob_sha256 string, content_sha256 string, "
        "content string, description string, mime_type string, size_bytes long, refresh_frequency_sec int, refreshed_at timestamp_ntz, last_refresh_status string, change_note string"
    ),
    "chunks": "logical_path string, version_id timestamp_ntz, chunk_index int, chunk_content string, context string, search_text string, embedding array<float>",
    "blobs": "sha256 string, mime_type string, size_bytes long, bytes binary",
    "refreshes": "logical_path string, version_id timestamp_ntz, refreshed_at timestamp_ntz, status string",
    "outcomes": "key string, logical_path string, version_id timestamp_ntz, status string, change string, error string, mime_type string, size_bytes long, source_sha256 string, duplicates long",
    "postings": "logical_path string, version_id timestamp_ntz, chunk_index int, len int, terms string, tfs array<int>, sign int",
    "corpus": "n long, total_len long",
    "vocabulary": "term string, stem string",
}
_PART = "array<struct<tbl:string,part:string>>"
COMMITS = f"seq long, key string, adds {_PART}, retires {_PART}, revision string"


WRITTEN = {"compression": "zstd", "parquet.block.size": 1 << 22}  # small row groups, so that tasks share a part evenly
PLACE = ("__file", "__at")


def placed(rows: DataFrame) -> DataFrame:
    """Rows read from Parquet files that do not change, with their place: the file and the number in it."""
    return rows.withColumns({"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")})


def chosen(rows: DataFrame, places: DataFrame, but: bool = False) -> DataFrame:
    """The placed rows whose place is in places, or all but these.  Places go along as bitmaps, 4 KB for 32,768 rows of a file,
    so that texts and bytes are neither shuffled nor sorted."""
    bucket, bit = (F.bitmap_bucket_number(F.col("__at") + 1), F.bitmap_bit_position(F.col("__at") + 1))
    marks = places.groupBy("__file", bucket.alias("__b")).agg(F.bitmap_construct_agg(bit).alias("__m"))
    byte = F.conv(F.hex(F.substring("__m", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    found = rows.withColumn("__b", bucket).join(F.broadcast(marks), ["__file", "__b"], "left" if but else "inner")
    return found.filter(~there if but else there).drop(*PLACE, "__b", "__m")


def keyed(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows, read from Parquet files that do not change, whose keys are in keys; only the keys are shuffled."""
    rows = placed(rows)
    return chosen(rows, rows.select(*on, *PLACE).join(keys.select(*on), list(on), "left_semi"))


class Conflict(RuntimeError):
    """Another writer has taken the commit number."""


@dataclass(frozen=True)
class Snapshot:
    spark: SparkSession
    where: str
    seq: int = -1
    parts: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    keys: frozenset[str] = frozenset()
    revision: str | None = None

    def _paths(self, table: str) -> list[str]:
        return [f"{self.where}/{table}/part={p}" for p in self.parts.get(table, ())]

    def read(self, table: str) -> DataFrame:
        return self.read_parts(table).drop("part")

    def read_parts(self, table: str) -> DataFrame:
        """The table with the name of each row's part."""
        schema = f"{SCHEMAS[table]}, part string"
        paths = self._paths(table)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.where}/{table}").parquet(*paths)

    def write(self, table: str, rows: DataFrame) -> str:
        """A new part, which no commit names yet."""
        name = f"p{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], SCHEMAS[table]).schema]).write.options(**WRITTEN).parquet(f"{self.where}/{table}/part={name}")
        return name

    def only(self, table: str, keys: DataFrame, on: Sequence[str]) -> DataFrame:
        """The rows of a table whose keys are in keys; only the keys are shuffled."""
        rows = self.read(table)
        return keyed(rows, keys, on) if self.parts.get(table) else rows

    def part(self, table: str, name: str) -> DataFrame:
        """A part that has been written, whether or not a commit names it."""
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.where}/{table}/part={name}")


def _log(spark: SparkSession, where: str) -> list:
    try:
        rows = spark.read.schema(COMMITS).parquet(f"{where}/commits")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return rows.select("seq", "key", "adds", "retires", "revision").orderBy("seq").collect()


def snapshot(spark: SparkSession, where: str, at: int | None = None) -> Snapshot:
    """The store after its last commit, or after an earlier one; an empty one before the first."""
    parts: dict[str, dict[str, None]] = {}
    seq, keys, revision = -1, set(), None
    for r in _log(spark, where):
        if at is not None and r["seq"] > at:
            break
        for x in r["retires"]:
            parts.get(x["tbl"], {}).pop(x["part"], None)
        for x in r["adds"]:
            parts.setdefault(x["tbl"], {})[x["part"]] = None
        seq, revision = r["seq"], r["revision"] or revision
        keys.add(r["key"])
    return Snapshot(spark, where, seq, {t: tuple(p) for t, p in parts.items()}, frozenset(keys), revision)


def commit(base: Snapshot, key: str, adds: Mapping[str, Sequence[str]], retires: Mapping[str, Sequence[str]] | None = None, revision: str | None = None) -> Snapshot:
    """Publishes written parts and retires others, at once."""
    spark, seq = base.spark, base.seq + 1
    pairs = lambda x: [(t, p) for t, names in (x or {}).items() for p in names]
    path = f"{base.where}/commits/of={seq}"
    row = spark.createDataFrame([(seq, key, pairs(adds), pairs(retires), revision)], COMMITS).coalesce(1)
    try:
        row.write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        if not spark.read.schema(COMMITS).parquet(path).isEmpty():
            raise Conflict(f"commit {seq} is taken") from e
        row.write.mode("overwrite").parquet(path)  # a writer was lost before it wrote its row
    return snapshot(spark, base.where)


def replaced(base: Snapshot, table: str, gone: DataFrame, on: Sequence[str]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """The table without the rows whose keys are in gone, as (adds, retires): only parts that have such rows are written
    anew.  The driver gets their names."""
    if not base.parts.get(table):
        return {}, {}
    rows = placed(base.read_parts(table))
    hit = rows.select(*on, "part", *PLACE).join(gone.select(*on), list(on), "left_semi")
    touched = [r["part"] for r in hit.select("part").distinct().collect()]
    if not touched:
        return {}, {}
    return {table: [base.write(table, chosen(rows.filter(F.col("part").isin(touched)), hit, but=True))]}, {table: touched}


def whole(base: Snapshot, table: str, rows: DataFrame) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """All of a table in one new part, as (adds, retires)."""
    return {table: [base.write(table, rows)]}, {table: list(base.parts.get(table, ()))}


def together(*changes: tuple[dict[str, list[str]], dict[str, list[str]]]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    adds: dict[str, list[str]] = {}
    retires: dict[str, list[str]] = {}
    for a, r in changes:
        for out, x in ((adds, a), (retires, r)):
            for t, names in x.items():
                out.setdefault(t, []).extend(names)
    return adds, retires


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder on whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def vacuum(spark: SparkSession, where: str, before: int) -> int:
    """Removes the parts that no snapshot from a commit on reads; how many.  Older snapshots can no longer be read."""
    retired = [(x["tbl"], x["part"]) for r in _log(spark, where) if r["seq"] <= before for x in r["retires"]]
    for table, part in retired:
        remove_folder(spark, f"{where}/{table}/part={part}")
    return len(retired)
