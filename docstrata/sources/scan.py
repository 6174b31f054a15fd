"""Scans of files, inline texts, landed tracker records, notes and logs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import DEFAULT_EXCLUDES, any_match, glob_base, glob_remainder, is_glob, selected
from ..functions.text import mime_from_name, note_path, sha256_hex

LOG = "ts string, level string, msg string, event string, tool string, call_id string, arg_keys array<string>, duration_ms double, result_bytes long, error_kind string, error_message string"


def _bare(path: str) -> str:
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/+", "/", path)


def scan_files(spark: SparkSession, source: str, includes: Sequence[str] = (), excludes: Sequence[str] = DEFAULT_EXCLUDES, dot: bool = False) -> DataFrame:
    """Files below a folder, of a glob, or one file: path, rel_path, content, size, mtime_ms, sha256, mime_type.
    Only the glob's fixed folders are listed, and only files that pass the filters are read; what filters leave nothing of
    is an empty result.  Paths are relative to the folder, on any file system."""
    base = glob_base(source) if is_glob(source) else source
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    bare = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/+", "/")
    rel = F.regexp_replace(bare, "^" + _escape(_bare(base).rstrip("/")) + "/?", "")
    rel = F.when(rel == "", F.regexp_extract(bare, "([^/]+)$", 1)).otherwise(rel)
    fits = selected(rel, [includes], excludes, dot)
    if is_glob(source):
        fits = fits & any_match(rel, [glob_remainder(source)], dot, expand=False)
    # Spark lists all files in the driver to plan any read; here it lists them without their content.
    kept = [r["path"] for r in files.load(base).filter(fits).select("path").collect()]
    rows = files.load([re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in kept]) if kept else files.load(base).limit(0)
    path = F.regexp_replace("path", "^file:/+", "/")
    return rows.select(path.alias("path"), rel.alias("rel_path"), "content", F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime_ms"), sha256_hex(F.col("content")).alias("sha256"), mime_from_name(F.col("path")).alias("mime_type"))


def _escape(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in text)


def inline(spark: SparkSession, texts: Sequence[tuple[str, str]]) -> DataFrame:
    """(logical_path, content) given in the call."""
    df = spark.createDataFrame(list(texts), "logical_path string, content string")
    return df.withColumn("sha256", sha256_hex(F.col("content"))).withColumn("source_type", F.lit("inline"))


def together(scans: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def issues(landed: DataFrame, kind: str = "all", state: str = "all") -> DataFrame:
    """Landed issue records (number, pull_request, state, updated_at, ...): issues, pulls or both, of one state."""
    rows = landed.withColumn("kind", F.when(F.col("pull_request").isNull(), "issues").otherwise("pulls"))
    rows = rows.filter(F.col("kind") == kind) if kind != "all" else rows
    rows = rows.filter(F.col("state") == state) if state != "all" else rows
    return rows.withColumn("mtime_ms", F.unix_millis(F.to_timestamp("updated_at")))


def team(projects: DataFrame, items: DataFrame) -> DataFrame:
    """A team's projects, each once, and its issues."""
    return projects.dropDuplicates(["project_id"]).unionByName(items, allowMissingColumns=True)


def notes(table: DataFrame, account: str = "*", folder: str = "**", system_folder: str = "Recently Deleted") -> DataFrame:
    """Notes of accounts and folders that fit; the system folder only if it is named."""
    rows = table.filter(any_match(F.col("account"), [account], expand=False) & any_match(F.col("folder"), [folder], expand=False))
    rows = rows if folder == system_folder else rows.filter(F.col("folder") != system_folder)
    return rows.withColumn("logical_path", note_path(F.col("account"), F.col("folder"), F.col("title")))


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a line that is not JSON keeps its raw text."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    raw = whole.select("file", F.posexplode("lines").alias("line_no", "value")).filter("value <> ''")  # a log file is rolled long before it fills a task
    return parse_log(raw)


def parse_log(raw: DataFrame) -> DataFrame:
    ok = F.col("value").startswith("{") & F.get_json_object("value", "$").isNotNull()
    return raw.withColumn("record", F.when(ok, F.from_json("value", LOG))).withColumn("raw", F.when(~ok, F.col("value")))


def last_records(log: DataFrame, n: int, by: Sequence[str] = ("file", "line_no")) -> DataFrame:
    """The last n by file and line, in their order."""
    return log.orderBy(*[F.desc(c) for c in by]).limit(n).orderBy(*by)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Whole markdown files, by path."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return rows.select(F.input_file_name().alias("logical_path"), F.col("value").alias("content")).orderBy("logical_path")


def golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("query string, expect string, kind string, answer string").json(path)


def args_field(args: Column, name: str) -> Column:
    """A field of a JSON argument string; null for bad JSON."""
    return F.get_json_object(args, f"$.{name}")
