"""Fill-in-the-middle transformation with a learned index from unit numbers to offsets.

A text's units are its lines.  Where unit number k ends is a rising function of k; it is fitted by line segments, each
as long as it can be while no boundary is further than ``error`` code points from its segment (a cone of slopes that
narrows with each boundary).  What a segment says is an integer sum, so tasks and expressions agree on it, and what it
misses is stored as one small integer a boundary.  A cut is predicted from its segment and put right by that residual,
exactly.  Segments and residuals are made in one pass over Arrow batches bounded by bytes; cutting, arranging, digests and
restoring are built-in expressions.  No rows are shuffled.

The prefix ends after the smaller, the middle after the larger of two unit numbers that a hash of the seed and doc_id
draws; further digits of the hash choose whether a text is transformed at all, and whether as suffix-prefix-middle or
prefix-suffix-middle.  A text with a mark in it stays plain, so an output can always be taken apart at its marks.

Cases: null text is empty, and an empty text stays plain; null doc_id hashes like an empty one; a text of one line can
only be cut at its ends; very long texts are one row each; repeated rows give repeated results; columns of the caller's named
like those made here are replaced or left out, other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, utf8_rows

ERROR = 512
SHIFT = 20  # slopes are counted in units of 2 ** -SHIFT code points
FIRST = 32  # boundaries that are tried at once for a segment; doubled while they fit
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
INDEX = "n long, segments array<struct<unit:int,offset:int,slope:long>>, residuals array<smallint>"
MADE = ("n", "segments", "residuals", "form", "prefix_chars", "middle_chars", "output")


def boundaries(buf: np.ndarray | None) -> np.ndarray:
    """Where each unit ends, in code points, with 0 in front; from the bytes of a text."""
    if buf is None or not len(buf):
        return np.zeros(1, np.int64)
    ends = np.flatnonzero(buf == 10) + 1
    if not len(ends) or ends[-1] < len(buf):
        ends = np.append(ends, len(buf))
    chars = np.cumsum((buf & 0xC0) != 0x80)
    return np.concatenate(([0], chars[ends - 1])).astype(np.int64)


def fit(offsets: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments (first unit, its offset, slope) such that no boundary is further than error, and one for rounding, away."""
    units, starts, slopes, at, n = np.arange(len(offsets)), [], [], 0, len(offsets)
    while at < n:
        low, high, end, width = -np.inf, np.inf, at + 1, FIRST
        while end < n:
            x = units[end : end + width] - at
            y = offsets[end : end + width] - offsets[at]
            lows = np.maximum(low, np.maximum.accumulate((y - error) / x))
            highs = np.minimum(high, np.minimum.accumulate((y + error) / x))
            open_ = lows <= highs
            fits = len(x) if open_.all() else int(np.argmin(open_))
            if fits:
                low, high, end = lows[fits - 1], highs[fits - 1], end + fits
            if fits < len(x):
                break
            width *= 2
        starts.append(at)
        slopes.append(0 if end == at + 1 else round((low + high) / 2 * (1 << SHIFT)))
        at = end
    first = np.array(starts, dtype=np.int64)
    return first, offsets[first], np.array(slopes, dtype=np.int64)


def predicted(units: np.ndarray, first: np.ndarray, offset: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """What the segments say of each unit number."""
    of = np.searchsorted(first, units, side="right") - 1
    return offset[of] + ((units - first[of]) * slope[of] >> SHIFT)


def _index(at: int, names: list[str], error: int):
    pair = pa.struct([("unit", pa.int32()), ("offset", pa.int32()), ("slope", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, segments, segment_ends, residuals, residual_ends = [], [], [0], [], [0]
            for buf in utf8_rows(batch.column(at)):
                offsets = boundaries(buf)
                parts = fit(offsets, error)
                counts.append(len(offsets) - 1)
                segments.append(np.stack(parts))
                residuals.append((offsets - predicted(np.arange(len(offsets)), *parts)).astype(np.int16))
                segment_ends.append(segment_ends[-1] + len(parts[0]))
                residual_ends.append(residual_ends[-1] + len(offsets))
            unit, offset, slope = np.concatenate(segments, axis=1) if segments else np.zeros((3, 0), np.int64)
            found = pa.StructArray.from_arrays([pa.array(unit.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(slope)], fields=list(pair))
            lists = pa.ListArray.from_arrays(pa.array(segment_ends, pa.int32()), found)
            missed = pa.ListArray.from_arrays(pa.array(residual_ends, pa.int32()), pa.array(np.concatenate(residuals) if residuals else np.zeros(0, np.int16)))
            yield pa.record_batch([*batch.columns, pa.array(counts, pa.int64()), lists, missed], [*names, "n", "segments", "residuals"])

    return run


def indexed(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """docs with n (units), segments and residuals."""
    if not 0 <= error <= 32_000:
        raise ValueError("residuals are stored in 16 bits")
    docs = docs.drop("n", "segments", "residuals")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, _index(docs.columns.index("text"), docs.columns, error), f"{schema}, {INDEX}")


def offset_of(unit: Column, segments: Column | str = "segments", residuals: Column | str = "residuals") -> Column:
    """Where a unit ends, in code points: its segment's prediction and the stored residual."""
    last = F.aggregate(segments, F.struct(F.lit(0).alias("unit"), F.lit(0).alias("offset"), F.lit(0).cast("long").alias("slope")), lambda found, s: F.when(s["unit"] <= unit, s).otherwise(found))
    said = F.get(F.transform(F.array(last), lambda s: s["offset"] + F.call_function("shiftright", (unit - s["unit"]) * s["slope"], F.lit(SHIFT))), F.lit(0))
    return (said + F.get(residuals, unit.cast("int"))).cast("long")


def _drawn(seed: int) -> list[Column]:
    """Four unsigned integers of the hash of the seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, error: int = ERROR) -> DataFrame:
    """docs (doc_id, text and any others) with n, form (plain, psm or spm), prefix_chars and middle_chars (null if plain)
    and output.  rate is the percentage of texts that are transformed, spm that of these in suffix-prefix-middle order."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MADE]
    rows = indexed(docs.select(*kept), error)
    h1, h2, h3, h4 = _drawn(seed)
    text = F.coalesce("text", F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.withColumns({"form": form, "__first": F.least(a, b), "__second": F.greatest(a, b)})
    rows = rows.withColumns({"__p": offset_of(F.col("__first")), "__m": offset_of(F.col("__second"))})
    whole = F.col("form") != "plain"
    rows = rows.withColumns({"prefix_chars": F.when(whole, F.col("__p")), "middle_chars": F.when(whole, F.col("__m") - F.col("__p"))})
    cut = lambda start, size=None: F.substring("text", (start + 1).cast("int"), size.cast("int") if size is not None else F.lit((1 << 31) - 1))
    prefix, middle, suffix = cut(F.lit(0), F.col("__p")), cut(F.col("__p"), F.col("middle_chars")), cut(F.col("__m"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    return rows.select(*kept, "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output and its form."""
    parts = F.split(output, "<[PSM]>")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


QUERIES = {"op12_fill_middle": op12_fill_middle}
ORACLE = {
    "op12_fill_middle": r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as lines, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
d as (select *, len(lines) as n, list_transform(range(0, 4), lambda i: list_reduce([0::bigint] || list_transform(range(1, 9), lambda j: (strpos('0123456789abcdef', substr(h, (i * 8 + j)::int, 1)) - 1)::bigint), lambda a, b: a * 16 + b)) as hs from t),
c as (select *, least(hs[1] % (n + 1), hs[2] % (n + 1)) as a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or hs[3] % 100 >= 100 then 'plain' when hs[4] % 100 < 50 then 'spm' else 'psm' end as form from d),
p as (select *, array_to_string(lines[1:a], '') as prefix, array_to_string(lines[a + 1:b], '') as middle, array_to_string(lines[b + 1:], '') as suffix from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from p"""
}
