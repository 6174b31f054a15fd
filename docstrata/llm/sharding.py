"""Sharding by extendible hashing.

A row's 60-bit hash holds 30 bits of its key's md5, then 30 bits of its text's md5, so that rows of one key split by
their texts.  The directory starts with one bucket for all rows; a bucket over the byte limit splits on the next bit,
and the others stay.  Spark finds all leaves at once: bytes are summed by a hash prefix that is some bits longer than
the mean shard needs, and rolled up to every shorter prefix, a few bits at a time; a row's shard is its shortest
prefix that fits.  Prefixes
that are still too large are counted again, with more bits, over their rows alone.

The directory has a row for each prefix in use, about ``2 ** SPARE`` for a shard; it is broadcast only while its
counted rows are at most ``BROADCAST_ROWS``, and joined by a shuffle of ids and sizes beyond that.

Cases: null key and null text count as empty (0 bytes); rows alike in key and text share all bits, so if they alone
pass the limit, or if one row does, their shard is over it: ``fits`` is false there and nowhere else; a very long text
is one row and is never cut; repeated rows share a shard; an empty table gives an empty result; other columns are
carried along, but those named like the new ones are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents

BITS = 60
SPARE = 6
STRIDE = 6
BROADCAST_ROWS = 500_000


def _hash30(c: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << 30) - 1))


def _prefix(c: Column, bits: Column | int) -> Column:
    shift = F.lit(BITS) - (F.lit(bits) if isinstance(bits, int) else bits)
    return F.call_function("shiftright", c, shift.cast("int"))


def _levels(depth: int, least: int) -> list[int]:
    """The levels at which sums are handed on, from depth down to least, STRIDE apart."""
    return [*range(depth, least, -STRIDE), least]


def _totals(cells: DataFrame, depth: int, least: int) -> DataFrame:
    """(level, p, total): the bytes below every prefix in use of ``least`` to ``depth`` bits.  Each step sums the prefixes
    of one level up to the next few, so no step gathers more than 2 ** STRIDE rows under a prefix."""
    now, found = cells.select(F.col("cell").alias("p"), F.col("bytes").alias("total")), []
    stops = _levels(depth, least)
    for low, high in zip(stops, stops[1:], strict=False):
        up = now.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(low - high))))
        sums = up.groupBy((F.lit(low) - F.col("up")).alias("level"), F.call_function("shiftright", "p", F.col("up").cast("int")).alias("p")).agg(F.sum("total").alias("total"))
        sums = checkpoint(sums)
        found.append(sums.filter(F.col("level") > high))
        now = sums.filter(F.col("level") == high).select("p", "total")
    return reduce(DataFrame.unionByName, [*found, now.select(F.lit(least).alias("level"), "p", "total")])


def _leaves(cells: DataFrame, depth: int, limit: int, least: int) -> DataFrame:
    """cells (cell of ``depth`` bits, bytes) with the depth of each cell's leaf, the shortest prefix that fits; null where
    even depth is too short.  A leaf is a prefix that fits below one that does not; leaves are handed down again the
    way that sums came up."""
    fit = checkpoint(_totals(cells, depth, least).filter(F.col("total") <= limit))
    above = fit.select((F.col("level") + 1).alias("level"), F.col("p").alias("half"))
    leaf = checkpoint(fit.withColumn("half", F.call_function("shiftright", "p", F.lit(1))).join(above, ["level", "half"], "left_anti").drop("half"))
    stops = _levels(depth, least)[::-1]
    own = leaf.filter(F.col("level") == least).select("p", F.struct("level", "total").alias("leaf"))
    for high, low in zip(stops, stops[1:], strict=False):
        nodes = cells.select(_shift("cell", depth - low).alias("p")).distinct() if low < depth else cells.select(F.col("cell").alias("p"))
        wide = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(low) - F.col("level")).cast("int"))
        start = F.col("p") * wide
        new = leaf.filter((F.col("level") > high) & (F.col("level") <= low)).select(F.explode(F.sequence(start, start + wide - 1)).alias("p"), F.struct("level", "total").alias("new"))
        old = own.select(F.col("p").alias("parent"), "leaf")
        own = nodes.withColumn("parent", _shift("p", low - high)).join(old, "parent", "left").join(new, "p", "left").select("p", F.coalesce("leaf", "new").alias("leaf")).filter("leaf is not null")
        own = checkpoint(own)
    return cells.join(own.withColumnRenamed("p", "cell"), "cell", "left").select("cell", F.col("leaf.level").alias("depth"), F.col("leaf.total").alias("shard_bytes"), "bytes")


def _shift(c: str, bits: int) -> Column:
    return F.call_function("shiftright", c, F.lit(bits))


MADE = ("n_bytes", "hash", "shard_depth", "shard", "shard_bytes", "fits")


def shards(docs: DataFrame, key: str, limit: int) -> DataFrame:
    """docs with hash, n_bytes, shard_depth, shard (its prefix as bits, empty for one bucket), shard_bytes and fits, in
    place of any columns of these names."""
    docs = docs.withColumn("__key", F.col(key)).drop(*MADE)
    names = [c for c in docs.columns if c != "__key"]
    docs = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    docs = docs.withColumn("hash", F.call_function("shiftleft", _hash30(F.col("__key")), F.lit(30)).bitwiseOR(_hash30(F.col("text"))))
    total = docs.agg(F.sum("n_bytes")).first()[0] or 0
    depth, least = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE), 0
    rest, out = docs, None
    while True:
        cells = checkpoint(rest.groupBy(_prefix(F.col("hash"), depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes")))
        leaves = checkpoint(_leaves(cells, depth, limit, least))
        if depth == BITS:
            leaves = leaves.select("cell", F.coalesce("depth", F.lit(BITS)).alias("depth"), F.coalesce("shard_bytes", "bytes").alias("shard_bytes"))
        leaves = leaves.select(F.col("cell").alias("__cell"), F.col("depth").alias("__depth"), "shard_bytes")
        small = leaves.count() <= BROADCAST_ROWS
        joined = rest.join(F.broadcast(leaves) if small else leaves, _prefix(F.col("hash"), depth) == F.col("__cell")).drop("__cell")
        done = joined.filter("__depth is not null")
        out = done if out is None else out.unionByName(done)
        if depth == BITS or leaves.filter("__depth is null").isEmpty():
            break
        rest, least, depth = joined.filter("__depth is null").drop("__depth", "shard_bytes"), depth + 1, min(BITS, depth + 12)
    code = F.lpad(F.conv(_prefix(F.col("hash"), F.col("__depth")).cast("string"), 10, 2), F.col("__depth"), F.lit("0"))
    made = (F.col("n_bytes"), F.col("hash"), F.col("__depth").alias("shard_depth"), F.when(F.col("__depth") == 0, "").otherwise(code).alias("shard"), F.col("shard_bytes"), (F.col("shard_bytes") <= limit).alias("fits"))
    return out.select(*[F.col(f"`{c}`") for c in names], *made)


def write_shards(docs: DataFrame, key: str, limit: int, path: str) -> None:
    """One folder for each shard; a shard is within the limit, so one task writes it."""
    shards(docs, key, limit).repartition("shard").write.partitionBy("shard").parquet(path)


LIMIT = 1 << 20


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return shards(docs, "doc_id", LIMIT).select("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes", "fits")


QUERIES = {"op8_sharding": op8_sharding}
ORACLE = {
    "op8_sharding": f"""
with hashed as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as n_bytes,
         list_reduce([0::bigint] || list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(md5(coalesce(doc_id::varchar, '')), i::int, 1)) - 1), lambda a, b: a * 16 + b) & ((1 << 30) - 1) as k,
         list_reduce([0::bigint] || list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(md5(coalesce(text, '')), i::int, 1)) - 1), lambda a, b: a * 16 + b) & ((1 << 30) - 1) as t
  from documents),
bits as (select doc_id, n_bytes, (k::bigint << 30) | t::bigint as hash from hashed),
levels as (select b.*, l.level, hash >> (60 - l.level)::int as p from bits b, (select unnest(range(0, 61))::int as level) l),
totals as (select level, p, sum(n_bytes)::bigint as total from levels group by all),
leaf as (select l.doc_id, l.hash, min(l.level) as depth from levels l join totals t using (level, p) where t.total <= {LIMIT} or l.level = 60 group by all)
select l.doc_id, l.n_bytes, case when f.depth = 0 then '' else lpad(ltrim(bin(l.p), ''), f.depth, '0') end as shard, f.depth::int as shard_depth,
       t.total as shard_bytes, t.total <= {LIMIT} as fits
from levels l join leaf f on l.doc_id is not distinct from f.doc_id and l.hash = f.hash and l.level = f.depth join totals t on t.level = l.level and t.p = l.p""",
}
