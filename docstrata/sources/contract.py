"""What a source of documents is: it lists entries, reads those that a cheap probe can't rule out, and knows its own rows.

A source is registered by name and found by the name in front of a source text (``name:selector``).  Its functions are
DataFrame jobs over what a collector has landed, so listing, probing, reading and reconciling are joins by path and
nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store as S
from ..operators.ingest import Settings, ingest_batch
from ..operators.snapshots import Snapshot, snapshot


@dataclass(frozen=True)
class Source:
    """listed gives one row an entry of a selector (logical_path, source_path, source_mtime_ms and what fetched needs); fetched gives
    bytes, mime_type and error of such rows, by logical_path; covers says which rows of a store a selector stands for."""

    name: str
    listed: Callable[[SparkSession, str], DataFrame]
    fetched: Callable[[SparkSession, str, DataFrame], DataFrame]
    covers: Callable[[str], Column]
    source_type: str = "remote"


_sources: dict[str, Source] = {}


def register(source: Source) -> Source:
    _sources[source.name] = source
    return source


def found(text: str) -> tuple[Source, str]:
    """The source and the selector that a text names."""
    name, _, selector = text.partition(":")
    if name not in _sources:
        raise LookupError(f"no source is named {name!r}; there are {', '.join(sorted(_sources)) or 'none'}")
    return _sources[name], selector


def add(spark: SparkSession, where: str, key: str | int, text: str, version: Column, settings: Settings = Settings(), sync: bool = False, force: bool = False) -> Snapshot:  # noqa: B008
    """Takes what a source lists into a store.  Entries whose modification time is that of the current version are not read.
    With sync, current rows that the selector stands for and the source no longer lists get a tombstone."""
    source, selector = found(text)
    listed = source.listed(spark, selector)
    now = S.current(snapshot(spark, where).read("files"))
    probed = S.probe_unchanged(listed, now) if not force else listed.withColumn("unchanged", F.lit(False))
    read = source.fetched(spark, selector, probed.filter("not unchanged").drop("unchanged")).select("logical_path", "bytes", "mime_type", "error")
    rows = probed.select("logical_path", "source_path", "source_mtime_ms", F.col("unchanged").alias("probed")).join(read, "logical_path", "left")
    entries = rows.withColumn("source_type", F.lit(source.source_type))
    return ingest_batch(spark, where, key, entries, version, settings, in_scope=source.covers(selector) if sync else None, force=force)


def notes_scope(text: str, name: str = "apple-notes") -> tuple[str, str]:
    """The account and folder patterns of ``name:account/folder``; what is left out or empty stands for all."""
    prefix, _, body = text.partition(":")
    if prefix != name or ":" not in text:
        raise ValueError(f"not a notes source: {text}")
    account, _, folder = body.strip().partition("/")
    return account or "*", folder if folder.strip("/") else "**"


def issues_source(name: str, landed: Callable[[SparkSession], DataFrame], markdown: Callable[[DataFrame], DataFrame]) -> Source:
    """A source of landed issue records (owner, repo, number, pull_request, state, updated_at, html_url and what markdown reads), with
    selectors ``owner/repo``, ``owner/repo#issues`` and ``owner/repo#pulls``."""
    from ..functions.text import issue_path
    from .scan import issues

    def parsed(selector: str) -> tuple[str, str, str]:
        path, _, kind = selector.partition("#")
        owner, _, repo = path.partition("/")
        if not owner or not repo or "/" in repo or kind not in ("", "issues", "pulls"):
            raise ValueError(f"invalid selector: {selector}")
        return owner, repo, kind or "all"

    def rows(spark: SparkSession, selector: str) -> DataFrame:
        owner, repo, kind = parsed(selector)
        mine = landed(spark).filter((F.lower("owner") == owner.lower()) & (F.lower("repo") == repo.lower()))
        return issues(mine, kind).withColumn("logical_path", issue_path(F.col("owner"), F.col("repo"), F.col("kind"), F.col("number")))

    def listed(spark: SparkSession, selector: str) -> DataFrame:
        return rows(spark, selector).select("logical_path", F.col("html_url").alias("source_path"), F.col("mtime_ms").alias("source_mtime_ms"))

    def fetched(spark: SparkSession, selector: str, entries: DataFrame) -> DataFrame:
        wanted = rows(spark, selector).join(entries.select("logical_path"), "logical_path", "left_semi")
        return markdown(wanted).select("logical_path", F.encode("markdown", "UTF-8").alias("bytes"), F.lit("text/markdown").alias("mime_type"), F.lit(None).cast("string").alias("error"))

    def covers(selector: str) -> Column:
        owner, repo, kind = parsed(selector)
        folder = f"github/{owner.lower()}/{repo.lower()}/" + ("" if kind == "all" else f"{kind}/")
        return F.col("logical_path").startswith(folder)

    return Source(name, listed, fetched, covers)
