"""Chunking: sections by heading, greedy packing, hard cuts and overlap.

A document is the unit of work; its lines are packed in one pass by a small helper over Arrow batches.  The hard cut
and the overlap are plain expressions and windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHORT = 200
BREAKS = ((r"\n\n+", "\n\n"), (r"\n", "\n"))
MARKED = re.compile(r"(?m)^ {0,3}#")  # what any line that is a heading begins with


@dataclass(frozen=True)
class Config:
    target: int = 1400
    longest: int = 1800
    overlap_lines: int = 2
    by_heading: bool = True


def _fence(line: str, inside: str) -> str:
    """The open fence after a line: three or more backticks or tildes, indented by three spaces at most, until a line
    of nothing but as many of the same, or more."""
    body = line.lstrip(" ")
    marks = body[: len(body) - len(body.lstrip(body[:1]))] if body[:1] in ("`", "~") else ""
    if len(line) - len(body) > 3 or len(marks) < 3:
        return inside
    if not inside:
        return marks
    return "" if marks[0] == inside[0] and len(marks) >= len(inside) and not body[len(marks) :].strip() else inside


def _heading(line: str) -> tuple[int, str] | None:
    """Level and title of an ATX heading: one to six signs, indented by three spaces at most, white space, a title."""
    body = line.lstrip(" ")
    level = len(body) - len(body.lstrip("#"))
    rest = body[level:]
    if len(line) - len(body) > 3 or not 1 <= level <= 6 or rest[:1].strip() or not rest.strip():
        return None
    title = rest.strip()
    return level, title.rstrip("#").rstrip() or title[:1]


def lines_of(text: str) -> Iterator[tuple[str, bool, tuple[int, str] | None]]:
    """(line, whether it is of a fenced block, the heading that it is) of each line."""
    fence = ""
    for line in text.split("\n"):
        before, fence = fence, _fence(line, fence)
        fenced = bool(before or fence)
        yield line, fenced, None if fenced else _heading(line)


def sections(text: str) -> list[tuple[list[str], str, str]]:
    """(ancestor headings, own heading, section text); the texts joined by newlines are the document."""
    starts: list[tuple[list[str], str, list[str]]] = [([], "", [])]
    trail: list[tuple[int, str]] = []
    for line, _, heading in lines_of(text):
        if heading:
            trail = [h for h in trail if h[0] < heading[0]]
            starts.append(([t for _, t in trail], heading[1], []))
            trail.append(heading)
        starts[-1][2].append(line)
    return [(above, own, "\n".join(lines)) for above, own, lines in starts if lines]


def split_text(text: str, longest: int) -> list[str]:
    """Pieces of at most ``longest``: paragraphs packed together, or lines where there is but one paragraph, or hard cuts
    where there is but one line.  A part that is too long itself ends the piece before it, and its own pieces stand alone."""
    if len(text) <= longest:
        return [text]
    for gap, glue in BREAKS:
        if len(parts := re.split(gap, text)) > 1:
            break
    else:
        return [text[i : i + longest] for i in range(0, len(text), longest)]
    out = [""]
    for part in parts:
        joined = out[-1] + glue + part if out[-1] else part
        if len(joined) <= longest:
            out[-1] = joined
        elif len(part) <= longest:
            out.append(part)
        else:
            out += [*split_text(part, longest), ""]
    return [piece for piece in out if piece]


def overlapped(pieces: list[str], lines: int) -> list[str]:
    """Each piece with the last lines of the one before it in front."""
    tails = ["\n".join(p.split("\n")[-lines:]) + "\n" for p in pieces[:-1]] if lines > 0 else [""] * (len(pieces) - 1)
    return [tail + p for tail, p in zip(["", *tails], pieces, strict=True)]


def crumbs(parts: Sequence[str]) -> str:
    return " > ".join(s for p in parts if (s := p.strip()))


def _packed(text: str, cfg: Config) -> Iterator[tuple[str, str]]:
    """(content, context) of sections packed up to the target; one that is longer is split, with overlap, and all its
    pieces but the first have its own heading in their context, too."""
    held: list[str] = []
    context = ""
    for above, own, body in sections(text):
        held = held if any(held) else []
        if len("\n".join([*held, body])) <= cfg.target:
            context = context if held else crumbs(above)
            held.append(body)
            continue
        if held:
            yield "\n".join(held), context
        held, context = [body], crumbs(above)
        if len(body) > cfg.target:
            held = []
            for k, piece in enumerate(overlapped(split_text(body, cfg.target), cfg.overlap_lines)):
                yield piece, crumbs([*above, own]) if k else crumbs(above)
    if any(held):
        yield "\n".join(held), context


def chunk(text: str, cfg: Config) -> list[tuple[str, str]]:
    """(content, context) of each chunk."""
    if len(text) < SHORT:
        return [(text, "")]
    if cfg.by_heading and MARKED.search(text) and any(heading for _, _, heading in lines_of(text)):
        found = list(_packed(text, cfg))
    else:
        sized = [q for p in split_text(text, cfg.target) for q in split_text(p, cfg.longest)]
        found = [(p, "") for p in overlapped(sized, cfg.overlap_lines)]
    return [(piece, context) for content, context in found for piece in split_text(content, cfg.longest)]


def chunk_documents(docs: DataFrame, cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """docs (logical_path, content) to (logical_path, chunk_index, chunk_content, context)."""

    return docs.select("logical_path", chunks_of(cfg)("content").alias("x")).select("logical_path", F.inline("x"))


def chunks_of(cfg: Config = Config()):  # noqa: B008
    """A function of a text column: its chunks as an array of (chunk_index, chunk_content, context)."""

    @F.arrow_udf("array<struct<chunk_index:int,chunk_content:string,context:string>>")
    def cut(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = {"chunk_index": pa.int32(), "chunk_content": pa.string(), "context": pa.string()}
        return by_slices(texts, lambda t: [(i, c, x) for i, (c, x) in enumerate(chunk(t or "", cfg))], names)

    return cut


SLICE = 1 << 20  # characters of texts whose rows a task holds as Python objects at once


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """An Arrow array of texts in slices of about SLICE bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > SLICE:
            yield texts.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size) + 64
    yield texts.slice(begin)


def by_slices(batches: Iterator[pa.Array], rows: Callable[[str | None], list[tuple]], names: dict[str, pa.DataType]) -> Iterator[pa.Array]:
    """A list of structs for each text, made slice by slice and column by column: what is held grows with neither the batch
    nor the table."""
    for batch in batches:
        for part in slices(batch):
            found = [rows(t) for t in part.to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = [x for some in found for x in some]
            columns = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate(names.values())]
            yield pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, list(names)))


def hard_cut(docs: DataFrame, longest: int) -> DataFrame:
    """Cuts of a fixed length."""
    n = F.greatest(F.ceil(F.char_length("content") / longest), F.lit(1)).cast("int")
    rows = docs.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("logical_path", "chunk_index", F.substring("content", F.col("chunk_index") * longest + 1, F.lit(longest)).alias("chunk_content"))


def add_overlap(chunks: DataFrame, lines: int = 2) -> DataFrame:
    """The last lines of the chunk before in front of each chunk."""
    before = F.split(F.lag("chunk_content").over(W.partitionBy("logical_path").orderBy("chunk_index")), "\n")
    tail = F.array_join(F.slice(before, F.greatest(F.size(before) - lines + 1, F.lit(1)), F.lit(lines)), "\n")
    return chunks.withColumn("chunk_content", F.when(before.isNull(), F.col("chunk_content")).otherwise(F.concat(tail, F.lit("\n"), F.col("chunk_content"))))


def section_lines(docs: DataFrame) -> DataFrame:
    """(logical_path, line_no, line, in_fence, section): the lines of the same reading as the chunks', the sections
    numbered by a running sum."""

    @F.arrow_udf("array<struct<line_no:int,line:string,in_fence:boolean,heads:int>>")
    def read(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = {"line_no": pa.int32(), "line": pa.string(), "in_fence": pa.bool_(), "heads": pa.int32()}
        return by_slices(texts, lambda t: [(i, line, fenced, int(bool(h))) for i, (line, fenced, h) in enumerate(lines_of(t or ""))], names)

    rows = docs.select("logical_path", read("content").alias("x")).select("logical_path", F.inline("x"))
    return rows.withColumn("section", F.sum("heads").over(W.partitionBy("logical_path").orderBy("line_no"))).drop("heads")


def has_headings(docs: DataFrame) -> DataFrame:
    """(logical_path, has_headings), read like the chunks, in one pass without a shuffle."""

    @F.pandas_udf("boolean")
    def any_heading(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: any(h for _, _, h in lines_of(t or "")))

    return docs.select("logical_path", any_heading("content").alias("has_headings"))
