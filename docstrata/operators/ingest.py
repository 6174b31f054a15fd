"""The write path as jobs on a store (see ``snapshots``): gate, convert, describe, chunk, search text, vectors, index.

Each piece of work has a key and is one commit: versions, chunks, blobs, what became of each entry, and what the chunks
add to and take from the search index.  Work whose key is in the log is not done again, so a batch that is replayed after
a failure leaves the store as it is.

Cases: of entries of one path in a batch, the one without an error, of the latest modification time, then of the greatest
hash is taken, and the outcome counts the others; an entry with an error or without bytes has the outcome ``failed`` and
changes nothing; bytes that are not valid UTF-8 are read with replacement characters; a version that is not later than the
path's latest raises; a tombstoned path is new again; an empty batch is a commit without rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import describe, persist_reason, search_text
from . import index
from . import store as S
from .chunks import Config, chunks_of
from .convert import converted
from .retrieval import hash_vector
from .snapshots import PLACE, SCHEMAS, WRITTEN, Snapshot, chosen, commit, keyed, placed, remove_folder, replaced, snapshot, together, whole

PATH, KEY = "logical_path", ["logical_path", "version_id"]
BLOBS = SCHEMAS["blobs"]
ENTRY = ("logical_path", "mime_type", "bytes", "source_path", "source_type", "source_mtime_ms")


@dataclass(frozen=True)
class Settings:
    chunks: Config = field(default_factory=Config)
    vector: Callable[[Column], Column] = hash_vector
    structured: Callable[[Column], Column] | None = None  # of text such as JSON
    caption: Callable[[Column, Column], Column] | None = None  # of an image's bytes and type
    max_captions: int = 20
    model: Callable[[Column, Column], Column] | None = None  # a description of type and content, where no title is found
    max_blob_size: int | None = None
    skip_mimes: Sequence[str] = ()
    refresh_frequency_sec: int | None = None
    change_note: str | None = None


def stated(entries: DataFrame) -> DataFrame:
    """Entries with source_sha256, their size, and what is wrong with them.  Entries that a probe has found unchanged (``probed``)
    need no bytes."""
    probed = F.coalesce("probed", F.lit(False)) if "probed" in entries.columns else F.lit(False)
    error = F.col("error") if "error" in entries.columns else F.lit(None).cast("string")
    every = F.col("refresh_frequency_sec") if "refresh_frequency_sec" in entries.columns else F.lit(None).cast("int")
    error = F.when(~probed, F.coalesce(error, F.when(F.col("bytes").isNull(), "no bytes")))
    return entries.select(*ENTRY, error.alias("error"), probed.alias("probed"), every.alias("refresh_frequency_sec"), F.sha2("bytes", 256).alias("source_sha256"), F.octet_length("bytes").cast("long").alias("size_bytes"))


def once(rows: DataFrame) -> DataFrame:
    """One entry a path (see the module's cases), of stated ones, and the number of those left out."""
    order = F.struct(F.col("error").isNull(), F.coalesce("source_mtime_ms", F.lit(-1)), F.coalesce("source_sha256", F.lit("")))
    rest = [c for c in rows.columns if c != PATH]
    best = rows.groupBy(PATH).agg(F.max_by(F.struct(*rest), order).alias("x"), (F.count("*") - 1).alias("duplicates"))
    return best.select(PATH, "x.*", "duplicates")


def judged(entries: DataFrame, files: DataFrame, version: Column, force: bool = False, gated: bool = True) -> DataFrame:
    """entries, one a path, against the versions of a store: status (ok, unchanged or failed), change (new or changed) and
    current (the version that is current before)."""
    last = S.latest(files).select(PATH, F.col("version_id").alias("__last"), F.col("source_sha256").alias("__sha"), F.col("tombstone").alias("__gone"))
    rows = entries.join(last, PATH, "left")
    there = F.coalesce(~F.col("__gone"), F.lit(False))
    same = F.col("probed") | (F.coalesce(F.col("source_sha256") == F.col("__sha"), F.lit(False)) & there & F.lit(gated and not force))
    status = F.when(F.col("error").isNotNull(), "failed").when(same, "unchanged").otherwise("ok")
    late = F.raise_error(F.concat(F.lit("the version is not later than the latest of "), F.col(PATH))).cast("string")
    status = F.when((status == "ok") & (F.col("__last") >= version), late).otherwise(status)
    rows = rows.withColumn("status", status).withColumn("current", F.when(there, F.col("__last")))
    return rows.withColumn("change", F.when(F.col("status") == "ok", F.when(there, "changed").otherwise("new"))).drop("__last", "__sha", "__gone")


def versions(rows: DataFrame, version: Column, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Version rows of stated entries: markdown and description."""
    rows = converted(rows, PATH, settings.structured, settings.caption, settings.max_captions)
    inline = F.col("source_type") == "inline"
    return rows.select(
        PATH, version.alias("version_id"), F.lit(False).alias("tombstone"), "source_type", "source_path", "source_mtime_ms", "source_sha256",
        F.when(~inline, F.col("source_sha256")).alias("blob_sha256"), F.sha2("content", 256).alias("content_sha256"), "content",
        describe(F.col(PATH), F.col("mime_type"), F.col("content"), settings.model and settings.model(F.col("mime_type"), F.col("content"))).alias("description"), "mime_type", "size_bytes",
        F.coalesce("refresh_frequency_sec", F.lit(settings.refresh_frequency_sec)).cast("int").alias("refresh_frequency_sec"), version.alias("refreshed_at"), F.lit("ok").alias("last_refresh_status"),
        F.lit(settings.change_note).cast("string").alias("change_note"),
    )


def chunk_rows(files: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The chunks of version rows: path, version_id, chunk_index, chunk_content, context, search_text, embedding."""
    rows = files.select(*KEY, "description", chunks_of(settings.chunks)("content").alias("x"))
    rows = rows.select(*KEY, "description", F.inline("x"))
    text = search_text(F.col(PATH), F.col("description"), F.col("chunk_content"), F.col("context"))
    rows = rows.withColumn("search_text", text).drop("description")
    return rows.withColumn("embedding", settings.vector(F.col("search_text")))


def blob_rows(rows: DataFrame, ok: DataFrame, known: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The blobs of placed entries that become versions (ok) and are not stored yet, each hash once; the policy decides whether
    bytes are kept."""
    hashes = ok.filter("source_type <> 'inline'").select(F.col("source_sha256").alias("sha256"), F.struct(*PLACE).alias("x"))
    new = hashes.groupBy("sha256").agg(F.min("x").alias("x")).join(known.select("sha256"), "sha256", "left_anti")
    kept = persist_reason(F.col("mime_type"), F.col("size_bytes"), settings.max_blob_size, settings.skip_mimes).isNull()
    return chosen(rows, new.select("x.*")).select(F.col("source_sha256").alias("sha256"), "mime_type", "size_bytes", F.when(kept, F.col("bytes")).alias("bytes"))


def read_store(spark: SparkSession, where: str, at: int | None = None) -> dict[str, DataFrame]:
    """The store's tables after its last commit, or an earlier one."""
    now = snapshot(spark, where, at)
    return {t: now.read(t) for t in SCHEMAS}


def _publish(base: Snapshot, key: str, rows: DataFrame, told: DataFrame, version: Column, settings: Settings, graves: DataFrame | None = None, log: DataFrame | None = None) -> Snapshot:
    """A commit of placed entries, and what is told of each path: status, change, current, and the place of its entry."""
    ok = told.filter("status = 'ok'")
    files = versions(chosen(rows, ok), version, settings)
    left = ok.filter("current is not null").select(PATH, F.col("current").alias("version_id"))
    if graves is not None:
        files = files.unionByName(graves.drop("current"), allowMissingColumns=True)
        left = left.unionByName(graves.select(PATH, F.col("current").alias("version_id")))
    adds = {"files": [base.write("files", files)]}
    adds["chunks"] = [base.write("chunks", chunk_rows(base.part("files", adds["files"][0]).filter("not tombstone"), settings))]
    adds["blobs"] = [base.write("blobs", blob_rows(rows, ok, base.read("blobs"), settings))]
    adds |= index.deltas(base, base.part("chunks", adds["chunks"][0]), left)
    made_version = F.when(F.col("status") == "ok", version).otherwise(F.col("current"))
    outcomes = told.select(F.lit(key).alias("key"), PATH, made_version.alias("version_id"), "status", "change", "error", "mime_type", "size_bytes", "source_sha256", "duplicates")
    adds["outcomes"] = [base.write("outcomes", outcomes)]
    if log is not None:
        adds["refreshes"] = [base.write("refreshes", log)]
    return commit(base, key, adds)


def _kept(rows: DataFrame, path: str) -> DataFrame:
    """Rows as written once, so that a batch is read once, and judged without its bytes."""
    rows.write.options(**WRITTEN).parquet(path)
    return rows.sparkSession.read.parquet(path)


def ingest_batch(spark: SparkSession, where: str, key: str | int, entries: DataFrame, version: Column, settings: Settings = Settings(), in_scope: str | Column | None = None, force: bool = False, gated: bool = True) -> Snapshot:  # noqa: B008
    """Takes a batch of entries (logical_path, mime_type, bytes, source_path, source_type, source_mtime_ms and, if need be,
    error, refresh_frequency_sec and probed) into the store.  Unchanged ones make no version unless forced, or not gated.
    With in_scope, entries are all that the source has below that prefix (or of the rows of that condition), and current
    paths there that it no longer has get a tombstone."""
    base, key = snapshot(spark, where), str(key)
    if key in base.keys:
        return base
    files, path = base.read("files"), f"{base.where}/staged/{uuid.uuid4().hex}"
    rows = placed(_kept(stated(entries), f"{path}/entries"))
    told = _kept(judged(once(rows.drop("bytes")), files, version, force, gated), f"{path}/told")
    graves = None
    if in_scope is not None:
        now = S.current(files).filter(F.col(PATH).startswith(in_scope) if isinstance(in_scope, str) else in_scope)
        gone = S.gone(now, told).select(PATH, F.col("version_id").alias("current"))
        graves = gone.select(PATH, "current", version.alias("version_id"), F.lit(True).alias("tombstone"), F.lit("source gone").alias("change_note"))
    done = _publish(base, key, rows, told, version, settings, graves)
    remove_folder(spark, path)
    return done


def write_texts(spark: SparkSession, where: str, key: str | int, texts: DataFrame, version: Column, settings: Settings = Settings()) -> Snapshot:  # noqa: B008
    """Texts (logical_path, content) as new versions without a gate: inline, markdown, without a blob."""
    none = F.lit(None).cast("string")
    rows = texts.select(PATH, F.lit("text/markdown").alias("mime_type"), F.encode("content", "UTF-8").alias("bytes"), none.alias("source_path"), F.lit("inline").alias("source_type"), none.cast("long").alias("source_mtime_ms"))
    return ingest_batch(spark, where, key, rows, version, settings, gated=False)


# Refresh.


def with_status(now: Snapshot) -> DataFrame:
    """The versions with what the refresh log last said of each: when it was refreshed, and how that went."""
    last = now.read("refreshes").groupBy(*KEY).agg(F.max(F.struct("refreshed_at", "status")).alias("__log"))
    rows = now.read("files").join(last, KEY, "left")
    newer = F.coalesce(F.col("__log.refreshed_at") >= F.col("refreshed_at"), F.col("__log").isNotNull())
    at, status = F.when(newer, F.col("__log.refreshed_at")).otherwise(F.col("refreshed_at")), F.when(newer, F.col("__log.status")).otherwise(F.col("last_refresh_status"))
    return rows.withColumns({"refreshed_at": at, "last_refresh_status": status}).drop("__log")


def due(now: Snapshot, at: Column) -> DataFrame:
    """The current versions whose time has come, by the log."""
    return S.refresh_due(with_status(now), at)


def refresh(spark: SparkSession, where: str, key: str | int, live: Callable[[DataFrame], DataFrame], at: Column, settings: Settings = Settings(), force: bool = False) -> Snapshot:  # noqa: B008
    """One tick: the due rows are read again (live gives logical_path, bytes, mime_type, source_mtime_ms, error of due rows), changed
    ones get a version through the write path, and each gets a row in the refresh log, all in one commit.  Inline rows have
    no source and are unchanged; a source that live does not name is gone, and failed.  force takes unchanged ones anew."""
    base, key = snapshot(spark, where), str(key)
    if key in base.keys:
        return base
    path = f"{base.where}/staged/{uuid.uuid4().hex}"
    asked = _kept(due(base, at).select(PATH, F.col("version_id").alias("current"), "source_type", "source_path", F.col("source_sha256").alias("__old"), F.col("mime_type").alias("__mime"), "refresh_frequency_sec"), f"{path}/asked")
    found = live(asked).select(PATH, "bytes", "mime_type", "source_mtime_ms", "error")
    of = asked.select(PATH, "source_type", "source_path", "__mime", "refresh_frequency_sec").hint("shuffle_hash")  # the side with bytes is not sorted
    rows = placed(_kept(stated(found.join(of, PATH).withColumn("mime_type", F.coalesce("mime_type", "__mime"))), f"{path}/entries"))
    there = rows.select(PATH, "mime_type", "error", "source_sha256", "size_bytes", *PLACE)
    told = asked.drop("refresh_frequency_sec", "source_path").join(there, PATH, "left")
    inline = F.col("source_type") == "inline"
    error = F.when(inline, None).otherwise(F.when(F.col("__at").isNull(), "source gone").otherwise(F.col("error")))
    same = inline | (F.coalesce(F.col("source_sha256") == F.col("__old"), F.lit(False)) & F.lit(not force))
    told = told.withColumn("error", error).withColumn("mime_type", F.coalesce("mime_type", "__mime"))
    told = told.withColumn("status", F.when(F.col("error").isNotNull(), "failed").when(same, "unchanged").otherwise("ok"))
    told = _kept(told.withColumns({"change": F.when(F.col("status") == "ok", "changed"), "duplicates": F.lit(0).cast("long")}).drop("__old", "__mime"), f"{path}/told")
    said = F.when(F.col("status") == "failed", F.concat(F.lit("failed:"), F.col("error"))).otherwise(F.col("status"))
    log = told.select(PATH, F.when(F.col("status") == "ok", at).otherwise(F.col("current")).alias("version_id"), at.alias("refreshed_at"), said.alias("status"))
    done = _publish(base, key, rows, told, at, settings, log=log)
    remove_folder(spark, path)
    return done


# Upkeep: each is one commit that retires parts and adds what takes their place.


def prune(spark: SparkSession, where: str, key: str | int, cutoff: Column) -> Snapshot:
    """Without the versions before the cut-off that are not their path's latest, their chunks and refreshes, and blobs that no
    version has any more."""
    base, key = snapshot(spark, where), str(key)
    if key in base.keys:
        return base
    files = base.read("files")
    gone = S.prunable(files.select(*KEY, "tombstone", "blob_sha256"), cutoff)
    kept = files.select(*KEY, "blob_sha256").join(gone, KEY, "left_anti")
    loose = S.orphan_blobs(base.read("blobs").select("sha256"), kept)
    changes = [replaced(base, t, gone, KEY) for t in ("files", "chunks", "refreshes")]
    return commit(base, key, *together(*changes, replaced(base, "blobs", loose, ["sha256"])))


def collect_blobs(spark: SparkSession, where: str, key: str | int) -> Snapshot:
    """Without the blobs that no version has."""
    base, key = snapshot(spark, where), str(key)
    if key in base.keys:
        return base
    return commit(base, key, *replaced(base, "blobs", S.orphan_blobs(base.read("blobs").select("sha256"), base.read("files")), ["sha256"]))


def strip_blobs(spark: SparkSession, where: str, key: str | int, max_size: int | None, skip_mimes: Sequence[str] = ()) -> Snapshot:
    """Bytes that the policy would not keep are dropped; ``store.reclaimable`` is the dry run."""
    base, key = snapshot(spark, where), str(key)
    if key in base.keys:
        return base
    rows = base.read_parts("blobs")
    touched = [r["part"] for r in S.strip_candidates(rows, max_size, skip_mimes).select("part").distinct().collect()]
    if not touched:
        return commit(base, key, {})
    new = S.strip(rows.filter(F.col("part").isin(touched)), max_size, skip_mimes)
    return commit(base, key, {"blobs": [base.write("blobs", new)]}, {"blobs": touched})


def rechunk(files: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The chunk table built anew for every version that has content, with the stored descriptions: for other settings
    or another vectoriser."""
    return chunk_rows(files.filter("not tombstone and content is not null"), settings)


def reindex(spark: SparkSession, where: str, key: str | int, revision: str, settings: Settings = Settings()) -> Snapshot:  # noqa: B008
    """All chunks and the whole search index built anew, under a revision that tells which settings they are of."""
    base, key = snapshot(spark, where), str(key)
    if key in base.keys:
        return base
    files = base.read("files")
    chunks = whole(base, "chunks", rechunk(files, settings))
    now = keyed(base.part("chunks", chunks[0]["chunks"][0]), S.current(files.select(*KEY, "tombstone")), KEY)
    fresh = index.deltas(base, now, None)
    old = {t: list(base.parts.get(t, ())) for t in ("postings", "corpus")}  # a vocabulary only grows
    return commit(base, key, *together(chunks, (fresh, old)), revision=revision)


def compact(spark: SparkSession, where: str, key: str | int) -> Snapshot:
    """Each table in one part, the search index without what has been taken from it, and the last refresh of each version.  A
    table that is in one part, from which nothing has been taken, stays as it is."""
    base, key = snapshot(spark, where), str(key)
    if key in base.keys:
        return base
    many = {t for t, parts in base.parts.items() if len(parts) > 1}
    if base.parts.get("postings") and not base.read("postings").filter("sign < 0").isEmpty():
        many.add("postings")
    last = base.read("refreshes").groupBy(*KEY).agg(F.max(F.struct("refreshed_at", "status")).alias("x")).select(*KEY, "x.*")
    rows = {t: base.read(t) for t in ("files", "chunks", "blobs", "outcomes", "vocabulary")} | {"refreshes": last} | index.merged(base)
    return commit(base, key, *together(*[whole(base, t, r) for t, r in rows.items() if t in many]))


def move(spark: SparkSession, where: str, key: str | int, renames: DataFrame, version: Column) -> Snapshot:
    """Paths renamed (old_path, new_path): version, chunks and index under the new path, a tombstone under the old."""
    base, key = snapshot(spark, where), str(key)
    if key in base.keys:
        return base
    now = S.current(base.read("files"))
    files, chunks = base.write("files", S.move(now, renames, version)), base.write("chunks", S.moved_chunks(base.read("chunks"), now, renames, version))
    left = now.join(renames.select(F.col("old_path").alias(PATH)), PATH, "left_semi").select(*KEY)
    return commit(base, key, {"files": [files], "chunks": [chunks]} | index.deltas(base, base.part("chunks", chunks), left))


def remove(spark: SparkSession, where: str, key: str | int, targets: DataFrame, version: Column, note: str = "removed") -> Snapshot:
    """Tombstones for current paths (see ``store.remove_guard`` for which)."""
    base, key = snapshot(spark, where), str(key)
    if key in base.keys:
        return base
    left = S.current(base.read("files").select(*KEY, "tombstone")).join(targets.select(PATH), PATH, "left_semi")
    files = base.write("files", _as_files(base, S.tombstones(left, version, note)))
    return commit(base, key, {"files": [files]} | index.deltas(base, None, left))


def _as_files(base: Snapshot, rows: DataFrame) -> DataFrame:
    return base.spark.createDataFrame([], SCHEMAS["files"]).unionByName(rows, allowMissingColumns=True)
