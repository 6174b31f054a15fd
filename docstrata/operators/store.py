"""The versioned store as table jobs: current and past views, gates, tombstones, moves, pruning, blobs, statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import persist_reason, search_text

PATH = "logical_path"
NEWEST = ("version_id", "event_id")


def _order(files: DataFrame) -> list[Column]:
    return [F.col(c).desc() for c in NEWEST if c in files.columns]


def latest(files: DataFrame) -> DataFrame:
    """The latest row of each path, tombstone or not."""
    return files.withColumn("__r", F.row_number().over(W.partitionBy(PATH).orderBy(*_order(files)))).filter("__r = 1").drop("__r")


def current(files: DataFrame) -> DataFrame:
    """The latest row first, tombstones out second: a tombstone hides what came before it."""
    return latest(files).filter(~F.col("tombstone"))


def as_of(files: DataFrame, when: Column) -> DataFrame:
    return current(files.filter(F.col("version_id") <= when))


def tombstoned(files: DataFrame) -> DataFrame:
    return latest(files).filter("tombstone")


def current_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(current(files).select(PATH, "version_id"), [PATH, "version_id"], "left_semi")


def version_list(files: DataFrame) -> DataFrame:
    """All versions with their ordinal, newest first, and which one is current (the first that is no tombstone)."""
    w = W.partitionBy(PATH).orderBy(*_order(files))
    live = F.sum((~F.col("tombstone")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return files.withColumn("ordinal", F.row_number().over(w)).withColumn("is_current", ~F.col("tombstone") & (live == 1))


def list_page(files: DataFrame, limit: int = 1000, offset: int = 0, prefix: str = "") -> DataFrame:
    rows = current(files)
    return (rows.filter(F.col(PATH).startswith(prefix)) if prefix else rows).orderBy(PATH).offset(offset).limit(limit)


def under(path: Column, folder: str) -> Column:
    """The folder itself or anything below it, by whole path parts."""
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def refresh_due(files: DataFrame, now: Column) -> DataFrame:
    due = F.col("refreshed_at").isNull() | (now > F.col("refreshed_at") + F.make_dt_interval(secs=F.col("refresh_frequency_sec")))
    return current(files).filter(F.col("refresh_frequency_sec").isNotNull() & due)


def prunable(files: DataFrame, cutoff: Column) -> DataFrame:
    """Versions before the cut-off that are not their path's latest."""
    r = F.row_number().over(W.partitionBy(PATH).orderBy(*_order(files)))
    return files.withColumn("__r", r).filter((F.col("__r") > 1) & (F.col("version_id") < cutoff)).drop("__r")


def prune(files: DataFrame, cutoff: Column) -> DataFrame:
    r = F.row_number().over(W.partitionBy(PATH).orderBy(*_order(files)))
    return files.withColumn("__r", r).filter((F.col("__r") == 1) | (F.col("version_id") >= cutoff)).drop("__r")


def orphan_chunks_removed(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files.select(PATH, "version_id"), [PATH, "version_id"], "left_semi")


def delete_chunks(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    return chunks.join(versions.select(PATH, "version_id"), [PATH, "version_id"], "left_anti")


def orphan_blobs(blobs: DataFrame, files: DataFrame) -> DataFrame:
    return blobs.join(files.select(F.col("blob_sha256").alias("sha256")), "sha256", "left_anti")


def collect_garbage(blobs: DataFrame, files: DataFrame) -> DataFrame:
    return blobs.join(files.select(F.col("blob_sha256").alias("sha256")), "sha256", "left_semi")


def blobs_under(blobs: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    return blobs.join(files.filter(F.col(PATH).startswith(prefix)).select(F.col("blob_sha256").alias("sha256")), "sha256", "left_semi")


def new_blobs(incoming: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """Each hash once, and only those that are not stored yet."""
    once = incoming.dropDuplicates(["sha256"])
    return once if blobs is None else once.join(blobs.select("sha256"), "sha256", "left_anti")


def strip_candidates(blobs: DataFrame, max_size: int | None, skip_mimes: Sequence[str]) -> DataFrame:
    """Blobs that have bytes the policy would not keep, with the reason."""
    return blobs.withColumn("reason", persist_reason(F.col("mime_type"), F.col("size_bytes"), max_size, skip_mimes)).filter(F.col("bytes").isNotNull() & F.col("reason").isNotNull())


def reclaimable(blobs: DataFrame, max_size: int | None, skip_mimes: Sequence[str]) -> DataFrame:
    """How many blobs a strip would empty, and the bytes that it frees, by their real lengths."""
    found = strip_candidates(blobs, max_size, skip_mimes)
    return found.agg(F.count("*").alias("stripped"), F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).cast("long").alias("reclaimed_bytes"))


def read_bytes(blobs: DataFrame) -> DataFrame:
    """(sha256, mime_type, size_bytes, bytes_base64); a blob whose bytes were skipped raises."""
    skipped = F.raise_error(F.concat(F.lit("bytes were not kept: "), F.col("sha256"))).cast("string")
    return blobs.select("sha256", "mime_type", "size_bytes", F.when(F.col("bytes").isNull(), skipped).otherwise(F.base64("bytes")).alias("bytes_base64"))


def strip(blobs: DataFrame, max_size: int | None, skip_mimes: Sequence[str]) -> DataFrame:
    reason = persist_reason(F.col("mime_type"), F.col("size_bytes"), max_size, skip_mimes)
    return blobs.withColumn("bytes", F.when(reason.isNull(), F.col("bytes")))


def ingest_gate(entries: DataFrame, now_current: DataFrame, force: bool = False) -> DataFrame:
    """entries (logical_path, source_sha256) against the current rows: ``new``, ``changed`` or ``unchanged``."""
    old = now_current.select(PATH, F.col("source_sha256").alias("__old"), F.lit(True).alias("__there"))
    same = F.coalesce(F.col("source_sha256") == F.col("__old"), F.lit(False)) & F.lit(not force)
    return entries.join(old, PATH, "left").withColumn("status", F.when(F.col("__there").isNull(), "new").when(same, "unchanged").otherwise("changed")).drop("__old", "__there")


def probe_unchanged(entries: DataFrame, now_current: DataFrame) -> DataFrame:
    """The cheaper gate by modification time; a missing time is never unchanged."""
    old = now_current.select(PATH, F.col("source_mtime_ms").alias("__old"))
    return entries.join(old, PATH, "left").withColumn("unchanged", F.coalesce(F.col("source_mtime_ms") == F.col("__old"), F.lit(False))).drop("__old")


def gone(now_current: DataFrame, live: DataFrame) -> DataFrame:
    """Current rows in scope that the live enumeration no longer has."""
    return now_current.join(live.select(PATH), PATH, "left_anti")


def tombstones(rows: DataFrame, version: Column, note: str) -> DataFrame:
    return rows.select(PATH).distinct().select(PATH, version.alias("version_id"), F.lit(True).alias("tombstone"), F.lit(note).alias("change_note"))


def sync(now_current: DataFrame, live: DataFrame, version: Column, note: str = "source gone") -> DataFrame:
    return tombstones(gone(now_current, live), version, note)


def move(now_current: DataFrame, renames: DataFrame, version: Column) -> DataFrame:
    """Rows for renames (old_path, new_path): copies under the new path and tombstones for the old; a target that
    is current, or that two renames share, raises."""
    once = renames.groupBy("new_path").agg(F.min("old_path").alias(PATH), F.count("*").alias("__n"))
    hit = now_current.join(once, PATH)
    taken = now_current.select(F.col(PATH).alias("new_path"), F.lit(True).alias("__taken"))
    hit = hit.join(taken, "new_path", "left")
    clash = F.when(F.col("__taken"), "path exists: ").when(F.col("__n") > 1, "path is the target of several renames: ")
    ok = F.when(clash.isNotNull(), F.raise_error(F.concat(clash, F.col("new_path"))).cast("string")).otherwise(F.col("new_path"))
    rest = [c for c in now_current.columns if c not in (PATH, "version_id", "tombstone")]
    rest_of_copy = [F.concat(F.lit("move from "), F.col(PATH)).alias(c) if c == "change_note" else F.col(c) for c in rest]
    copies = hit.select(ok.alias(PATH), version.alias("version_id"), F.lit(False).alias("tombstone"), *rest_of_copy)
    rest_of_grave = [F.concat(F.lit("moved to "), F.col("new_path")).alias(c) if c == "change_note" else F.col(c) for c in rest]
    graves = hit.select(PATH, version.alias("version_id"), F.lit(True).alias("tombstone"), *rest_of_grave)
    return copies.unionByName(graves)


def moved_chunks(chunks: DataFrame, now_current: DataFrame, renames: DataFrame, version: Column) -> DataFrame:
    """The current chunks of renamed paths under their new path and version, with the search text built anew (chunks:
    path, version_id, chunk_index, chunk_content, context, search_text and any others, which stay)."""
    hit = now_current.select(PATH, "version_id", "description").join(renames.withColumnRenamed("old_path", PATH), PATH)
    rows = chunks.join(hit, [PATH, "version_id"])
    made = {PATH: F.col("new_path"), "version_id": version, "search_text": search_text(F.col("new_path"), F.col("description"), F.col("chunk_content"), F.col("context"))}
    return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in chunks.columns])


def remove_guard(now_current: DataFrame, targets: DataFrame, patterns: Sequence[str], force: bool = False) -> DataFrame:
    """Targets of a removal; match-all needs force, and nothing found raises with a hint."""
    if not force and any(p in ("*", "**") for p in patterns):
        raise ValueError("this would remove everything; use force")
    if targets.isEmpty():
        folders = [p for p in patterns if not now_current.filter(F.col(PATH).startswith(p.rstrip("/") + "/")).isEmpty()]
        raise LookupError("nothing matches" + (f"; {folders[0]} is a folder, use {folders[0].rstrip('/')}/**" if folders else ""))
    return targets


def latest_status(log: DataFrame) -> DataFrame:
    """refresh_log: the last status of each version."""
    return log.withColumn("__r", F.row_number().over(W.partitionBy(PATH, "version_id").orderBy(F.desc("refreshed_at")))).filter("__r = 1").drop("__r")


def latest_meta(meta: DataFrame) -> DataFrame:
    return meta.groupBy("key").agg(F.max_by("value", "updated_at").alias("value"))


def stale_revision(meta: DataFrame, revision: str) -> DataFrame:
    row = latest_meta(meta).filter("key = 'embedding_revision'")
    return row.select((F.col("value") != revision).alias("stale"))


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("status").startswith(s)).alias(s) for s in ("ok", "unchanged", "failed")])


def collisions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("collides", F.count("*").over(W.partitionBy(PATH)) > 1)


# Statistics: one row a figure, as section, key, value.


def stats_counts(files: DataFrame) -> DataFrame:
    """One pass over the versions: a row's path is current if its latest row is no tombstone."""
    r = files.withColumn("__last", F.row_number().over(W.partitionBy(PATH).orderBy(*_order(files))) == 1)
    return r.agg(
        F.count_if(F.expr("__last and not tombstone")).alias("current"), F.count_if(F.expr("__last and tombstone")).alias("tombstoned"), F.count("*").alias("versions"),
        F.count_if("__last").alias("paths"), F.coalesce(F.sum(F.when(F.col("__last") & ~F.col("tombstone"), F.col("size_bytes"))), F.lit(0)).cast("long").alias("current_bytes"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("all_bytes"),
    )


def count_by(rows: DataFrame, key: str, skip_null: bool = False) -> DataFrame:
    rows = rows.filter(F.col(key).isNotNull()) if skip_null else rows
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def top_and_other(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n most frequent values and the rest as ``(other)``; ties by value."""
    counts = rows.groupBy(F.coalesce(F.col(key), F.lit("(null)")).alias(key)).agg(F.count("*").alias("c"))
    top = counts.orderBy(F.desc("c"), F.asc(key)).limit(n).select(F.col(key).alias("__top"))
    named = counts.join(F.broadcast(top), F.col(key) == F.col("__top"), "left")  # n rows
    return named.groupBy(F.coalesce("__top", F.lit("(other)")).alias(key)).agg(F.sum("c").alias("n"))


def refresh_health(files: DataFrame, now: Column) -> DataFrame:
    rows = current(files)
    due = F.col("refreshed_at").isNull() | (now > F.col("refreshed_at") + F.make_dt_interval(secs=F.coalesce("refresh_frequency_sec", F.lit(0))))
    return rows.agg(F.count_if(F.col("refresh_frequency_sec").isNotNull()).alias("scheduled"), F.count_if(F.col("refresh_frequency_sec").isNotNull() & due).alias("due"))


def report(files: DataFrame, blobs: DataFrame, chunks: DataFrame, now: Column, prefix: str = "") -> DataFrame:
    """All statistics as (section, key, value), of all paths or those below a prefix and their blobs and chunks."""
    if prefix:
        blobs = blobs_under(blobs, files, prefix)
        files, chunks = files.filter(F.col(PATH).startswith(prefix)), chunks.filter(F.col(PATH).startswith(prefix))

    def rows(df: DataFrame, section: str) -> DataFrame:
        cols = df.columns
        pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("long").alias("value")) for c in cols])
        return df.select(F.explode(pairs).alias("x")).select(F.lit(section).alias("section"), "x.key", "x.value")

    now_current = current(files)
    parts = [rows(stats_counts(files), "files"), rows(refresh_health(files, now), "refresh")]
    parts.append(rows(blobs.agg(F.count("*").alias("count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")), "blobs"))
    parts.append(rows(chunks.agg(F.count("*").alias("all")), "chunks"))
    parts.append(rows(current_chunks(chunks, files).agg(F.count("*").alias("current")), "chunks"))
    for key in ("source_type", "downloader", "last_refresh_status"):
        if key in files.columns:
            parts.append(count_by(now_current, key, key == "downloader").select(F.lit(key).alias("section"), F.col(key).alias("key"), F.col("n").alias("value")))
    parts.append(top_and_other(now_current, "mime_type").select(F.lit("mime_type").alias("section"), F.col("mime_type").alias("key"), F.col("n").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Tree and diff.


def path_tree(paths: DataFrame, max_depth: int = 6) -> DataFrame:
    """(node, depth, is_file, files): every folder and file down to max_depth; a deeper path counts in the deepest node
    above it, which is a file, too."""
    parts = paths.select(F.filter(F.split(PATH, "/"), lambda x: x != "").alias("p")).filter("size(p) > 0")
    rows = parts.withColumn("depth", F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(max_depth)))))
    node = F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/")
    return rows.groupBy(node.alias("node"), "depth").agg(F.max((F.size("p") == F.col("depth")) | (F.col("depth") == max_depth)).alias("is_file"), F.count("*").alias("files"))


def truncate_tree(tree: DataFrame, max_items: int = 20) -> DataFrame:
    """The first children of each folder, and how many more it has."""
    parent = F.when(F.col("depth") == 1, "").otherwise(F.regexp_replace("node", "/[^/]*$", ""))
    rows = tree.withColumn("parent", parent)
    # A folder may hold nearly all paths: its first children are found in salted parts first.
    part = W.partitionBy("parent", F.pmod(F.xxhash64("node"), F.lit(64))).orderBy("node")
    first = rows.withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= max_items)
    first = first.withColumn("__r", F.row_number().over(W.partitionBy("parent").orderBy("node"))).filter(F.col("__r") <= max_items).drop("__r")
    counts = rows.groupBy("parent").agg(F.greatest(F.count("*") - max_items, F.lit(0)).alias("dropped"))
    return first.join(counts, "parent")


def lift_children(tree: DataFrame, folder: str) -> DataFrame:
    """The tree below a folder, its children as first level."""
    up = len([p for p in folder.split("/") if p])
    return tree.filter(F.col("node").startswith(folder.strip("/") + "/")).withColumn("depth", F.col("depth") - up)


def children(tree: DataFrame) -> DataFrame:
    return tree.filter("depth > 1").groupBy(F.regexp_replace("node", "/[^/]*$", "").alias("node")).agg(F.count("*").alias("children"))


def _row_above(below: np.ndarray, line: int, others: np.ndarray) -> np.ndarray:
    """Longest common subsequences of one more line of the old text with each rest of the new: from the right, a row is the
    running maximum of what a match or the row below gives."""
    best = np.maximum(np.where(others == line, below[1:] + 1, 0), below[:-1])
    return np.append(np.maximum.accumulate(best[::-1])[::-1], 0).astype(np.int32)


def line_diff(old: str | None, new: str | None) -> list[str]:
    """Lines of both texts with a sign in front (blank, - or +), by a longest common subsequence; where it leaves a choice,
    a deletion comes first.  Equal heads are set aside.  Of the table of the rest, a row is kept every so often, and the rows
    between are made again, from the nearest kept one, when the way through the table gets there; so for texts of n and m
    lines about 4 m sqrt(n) bytes are held."""
    a, b = (old or "").split("\n"), (new or "").split("\n")
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    x, y = a[head:], b[head:]
    number: dict[str, int] = {}
    p, q = (np.array([number.setdefault(s, len(number)) for s in t], dtype=np.int32) for t in (x, y))
    step = max(1, 2 * int(len(p) ** 0.5))
    below, kept = np.zeros(len(q) + 1, dtype=np.int32), {}
    for i in range(len(p) - 1, -1, -1):
        if (i + 1) % step == 0 or i == len(p) - 1:
            kept[i // step] = below
        below = _row_above(below, p[i], q)
    out, i, j = [" " + s for s in a[:head]], 0, 0
    while i < len(x) and j < len(y):
        first, below = i - i % step, kept.pop(i // step)[j:]
        last, left = min(first + step, len(p)), j
        deletes = np.zeros((last - i, len(q) - left), dtype=bool)  # whether a line of the old text goes before one of the new
        for r in range(last - 1, i - 1, -1):
            row = _row_above(below, p[r], q[left:])
            deletes[r - i] = below[:-1] >= row[1:]
            below = row
        top = i
        while i < last and j < len(y):
            if p[i] == q[j]:
                out.append(" " + x[i])
                i, j = i + 1, j + 1
            elif deletes[i - top, j - left]:
                out.append("-" + x[i])
                i += 1
            else:
                out.append("+" + y[j])
                j += 1
    return [*out, *("-" + s for s in x[i:]), *("+" + s for s in y[j:])]


def diff_pairs(pairs: DataFrame, old: str, new: str, old_label: str, new_label: str) -> DataFrame:
    """pairs with ``diff``: the two labels and the lines of both texts."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(line_diff(x, y)) for x, y in zip(a, b, strict=True)], dtype=object)

    return pairs.withColumn("diff", F.concat(F.lit("--- "), F.col(old_label).cast("string"), F.lit("\n+++ "), F.col(new_label).cast("string"), F.lit("\n"), diff(old, new)))


def diff_versions(versions: DataFrame, order: str = "version_id", text: str = "content") -> DataFrame:
    """The diff of each version with the one before it, for all paths in one job."""
    w = W.partitionBy(PATH).orderBy(order)
    pairs = versions.withColumn("previous", F.lag(text).over(w)).withColumn("from_version", F.lag(order).over(w)).filter(F.col("from_version").isNotNull())
    return diff_pairs(pairs.withColumnRenamed(order, "to_version"), "previous", text, "from_version", "to_version").select(PATH, "from_version", "to_version", "diff")


def diff_with_current(versions: DataFrame, wanted: DataFrame, text: str = "content") -> DataFrame:
    """The diff of stated versions (path, a) with stated ones (b) or, where b is null, with the path's current one."""
    now = current(versions).select(PATH, F.col("version_id").alias("__now"))
    both = wanted.join(now, PATH, "left").withColumn("b", F.coalesce("b", "__now")).drop("__now")
    side = lambda label, name: versions.select(PATH, F.col("version_id").alias(label), F.col(text).alias(name))
    pairs = both.join(side("a", "__old"), [PATH, "a"]).join(side("b", "__new"), [PATH, "b"])
    return diff_pairs(pairs, "__old", "__new", "a", "b").select(PATH, "a", "b", "diff")
