"""Mixing sources to target weights by subset-sum budget fitting.

1. Count each source's words.  Targets share ``share`` of all words by weight; a target stops at ``cap`` times its
   source's words, and what that leaves is shared again among the others until none is above.  Sources are numbered in
   ranges, and each round is one aggregate over them, so a source a domain is no special case.
2. Whole copies of a source come first.  For the rest of its budget, count its documents by exact length.  Of the
   budget but as many words as its longest document has (or half of it, if that is less), each length gets its share,
   along rising lengths: rounded down, and what rounding leaves is handed on to the next length, so that less than twice the
   longest length is left.  A bounded knapsack by dynamic programming (counts in powers of two) over the documents not yet
   taken fits that as closely as it can be.  So a source of any size is mixed from all lengths alike.
   A source's lengths are one group: as many rows as it has different lengths, not documents.
3. Of each length the planned number of documents is selected, in the order of a seeded hash of doc_id and text, and of
   rows alike in both in the order of a row number, written with the rows.  A length with very many documents is first
   cut into buckets by another hash, and only the bucket that holds the cut-off is counted by hash; very many rows of
   one hash are cut into buckets of their row numbers.  So no cut-off sorts more than about ``BUCKET_ROWS`` rows.

Cases: null or wordless text has size 0 and is never taken; null is a source of its own, last; a source without words
has target 0; rows alike in doc_id and text are taken independently of one another (a rerun takes as many of them);
texts are counted whole; columns of the caller's named like those made here are replaced where these are returned
(``repeat=False``), and otherwise kept (names that begin with two underscores are reserved); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_CLASS, checkpoint, documents, written

BUCKET_ROWS = 2_000
BROADCAST_ROWS = 500_000
SOURCE, SIZE, HASH, ROW = "__mix_source", "__mix_size", "__mix_hash", "__mix_row"


def shares(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each (rising) length are its share of the budget, handing on what rounding leaves."""
    total, take, due = int((lengths * counts).sum()), np.zeros_like(counts), 0.0
    for i, (n, c) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        due += c * n * (budget / total)
        take[i] = min(c, int(due // n))
        due -= int(take[i]) * n
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near the budget as the knapsack over what
    the shares leave can reach, never above."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    order = np.argsort(lengths)
    take = np.zeros_like(counts)
    fitting = lengths[lengths <= budget]
    if not len(fitting):
        return take
    take[order] = shares(lengths[order], counts[order], budget - min(int(fitting.max()), budget // 2))
    left = budget - int((lengths * take).sum())
    if left <= 0:
        return take
    reached = np.zeros(left + 1, dtype=bool)
    reached[0] = True
    by, items = np.full(left + 1, -1, dtype=np.int32), []
    for i in order[::-1]:
        free, part = min(int(counts[i] - take[i]), left // int(lengths[i])), 1
        while free > 0 and not reached[left]:
            n = min(part, free)
            weight = n * int(lengths[i])
            new = np.flatnonzero(reached[:-weight] & ~reached[weight:]) + weight
            reached[new], by[new] = True, len(items)
            items.append((i, n, weight))
            free, part = free - n, part * 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n, weight = items[by[at]]
        take[i] += n
        at -= weight
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    budget = float(pdf["target"].iloc[0]) - int(pdf["copies"].iloc[0]) * int(pdf["source_size"].iloc[0])
    return pdf.assign(extra=fit_budget(lengths, counts, max(0, int(budget))))[["source", "size", "n", "extra", "copies", "source_size", "target"]]


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with ``no``, from 0 in the order of a column without repeats, nulls last: ranges count their own rows, and
    only one row a range is summed up."""
    ranged = checkpoint(rows.repartitionByRange(F.asc_nulls_last(by)).withColumn("range", F.spark_partition_id()))
    before = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("range").orderBy(F.asc_nulls_last(by)))
    return ranged.join(F.broadcast(before), "range").withColumn("no", F.col("before") + within - 1).drop("range", "before")  # one row a range


def targets(totals: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """totals (source, source_size), one row a source, with its target."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("no"), F.lit(len(weights))) + 1).cast("int"))
    rows = checkpoint(numbered(totals, "source").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(cap)).alias("most")))
    every, water, full = (rows.agg(F.sum("source_size")).first()[0] or 0) * float(share), 0.0, -1
    while True:  # ends when no further source is full; each round fills one at least
        above = F.col("most") < F.col("weight") * water
        n, most, rest = rows.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not rest:
            break
        full, water = n, (every - most) / rest
    target = F.col("most") if not rest else F.least("most", F.col("weight") * water)
    return rows.select("source", "source_size", target.alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _maybe_broadcast(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def first_rows(rows: DataFrame, wanted: DataFrame, by: str, group: Sequence[str], seed: int) -> DataFrame:
    """For groups wanted (group..., extra, n), of which the first extra of n rows are to be taken, the cut-off: (group...,
    buckets, full: every bucket up to it is taken, bucket, value, take, there: of the cut-off's bucket, all rows below
    value and take of the rows at value, of which there are so many)."""
    keys = [f"__g{i}" for i in range(len(group))]
    plan = wanted.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], "extra", F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"))
    on = [_same(g, k) for g, k in zip(group, keys, strict=True)]
    here = rows.select(*group, by).join(_maybe_broadcast(plan), on).drop(*group)
    here = here.withColumn("b", F.pmod(F.xxhash64(by, F.lit(seed)), F.col("buckets")))
    counts = here.groupBy(*keys, "extra", "buckets", "b").agg(F.count("*").alias("here"))
    counts = checkpoint(counts.withColumn("before", F.sum("here").over(W.partitionBy(*keys).orderBy("b")) - F.col("here")))
    full = counts.filter("before + here <= extra").groupBy(*keys, "buckets").agg(F.max("b").alias("full"))
    part = counts.filter("before < extra and before + here > extra")
    cut = part.select(*[F.col(k).alias(f"{k}c") for k in keys], F.col("b").alias("bc"), "before")
    inside = here.join(_maybe_broadcast(cut), [*[_same(k, f"{k}c") for k in keys], F.col("b") == F.col("bc")])
    values = inside.groupBy(*keys, "extra", "before", "buckets", "b", by).agg(F.count("*").alias("there"))
    below = F.sum("there").over(W.partitionBy(*keys).orderBy(by)) - F.col("there") + F.col("before")
    at = values.withColumn("below", below).filter("below < extra and below + there >= extra")
    at = at.select(*keys, "buckets", F.col("b").alias("bucket"), F.col(by).alias("value"), (F.col("extra") - F.col("below")).alias("take"), "there", F.lit(None).cast("long").alias("full"))
    none = {c: F.lit(None).cast("long").alias(c) for c in ("bucket", "value", "take", "there")}
    both = at.unionByName(full.select(*keys, "buckets", *none.values(), "full"))
    return checkpoint(both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("buckets", "full", "bucket", "value", "take", "there")]))


def is_first(by: str, cut: dict[str, str], seed: int, tie: Column) -> Column:
    """Whether a row joined to its cut-off is taken; tie decides for rows at the cut-off's value."""
    b = F.pmod(F.xxhash64(by, F.lit(seed)), F.col(cut["buckets"]))
    inside = (b == F.col(cut["bucket"])) & ((F.col(by) < F.col(cut["value"])) | ((F.col(by) == F.col(cut["value"])) & tie))
    return F.coalesce(b <= F.col(cut["full"]), F.lit(False)) | F.coalesce(inside, F.lit(False))


CUT = ("buckets", "full", "bucket", "value", "take", "there")


def _prefixed(cut: DataFrame, prefix: str) -> DataFrame:
    return cut.select(*[F.col(c).alias(prefix + c) for c in cut.columns])


def with_size(docs: DataFrame, seed: int) -> DataFrame:
    """docs, which may have clashing columns, with source, size, hash and row number under names of our own; written, so
    that a row keeps its number."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS)), F.lit(0)).cast("long")
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.lit(seed))
    return docs.withColumns({SOURCE: F.col("source"), SIZE: size, HASH: h, ROW: F.monotonically_increasing_id()})


def apply_mix(rows: DataFrame, weights: Sequence[float], share: float, cap: float, seed: int) -> DataFrame:
    """Written rows with our columns: with size, source_size, target and copies (0 where the mix leaves a document out)
    in place of ours."""
    sized = rows.select(F.col(SOURCE).alias("source"), F.col(SIZE).alias("size"), F.col(HASH).alias("h"), F.col(ROW).alias("row"))
    hist = checkpoint(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")).withColumnRenamed("source", "s")
    joined = hist.join(goal, _same("source", "s")).drop("s")
    fitted = joined.filter("size > 0").groupBy("source").applyInPandas(_plan, "source string, size long, n long, extra long, copies int, source_size long, target double")
    plan = checkpoint(fitted.unionByName(joined.filter("size = 0").withColumn("extra", F.lit(0).cast("long"))))
    by_hash = first_rows(sized, plan.filter("extra > 0 and extra < n").select("source", "size", "extra", "n"), "h", ("source", "size"), seed)
    ties = by_hash.filter("take < there").select(F.col("__g0").alias("source"), F.col("__g1").alias("size"), F.col("value").alias("h"), F.col("take").alias("extra"), F.col("there").alias("n"))
    by_row = first_rows(sized, ties, "row", ("source", "size", "h"), seed)
    p = plan.select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("extra").alias("__extra"), F.col("n").alias("__n"), F.col("copies").alias("__c"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    a, b = _prefixed(by_hash, "__a_"), _prefixed(by_row, "__b_")
    whole = p.join(a, _same("__s", "__a___g0") & _same("__z", "__a___g1"), "left").join(b, _same("__s", "__b___g0") & _same("__z", "__b___g1"), "left")
    out = rows.join(_maybe_broadcast(checkpoint(whole)), _same(SOURCE, "__s") & _same(SIZE, "__z"))
    tie = (F.col("__a_take") == F.col("__a_there")) | is_first(ROW, {c: "__b_" + c for c in CUT}, seed, F.lit(True))
    partly = is_first(HASH, {c: "__a_" + c for c in CUT}, seed, tie)
    more = F.when(F.col("__extra") == 0, 0).when(F.col("__extra") == F.col("__n"), 1).otherwise(partly.cast("int"))
    copies = F.when(F.col(SIZE) == 0, 0).otherwise(F.col("__c") + more).cast("int")
    made = {"size": F.col(SIZE), "source_size": F.col("__source_size"), "target": F.col("__target"), "copies": copies}
    kept = [c for c in rows.columns if c not in (SOURCE, SIZE, HASH, ROW, *made)]
    return out.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in made.items()])


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2, seed: int = 17, repeat: bool = True) -> DataFrame:
    """docs as often as the mix takes them (``repeat``), or once with size, source_size, target and copies."""
    made = ("size", "source_size", "target", "copies")
    hidden = {c: f"__mix_own_{c}" for c in docs.columns if c in made} if repeat else {}
    rows = written(with_size(docs.withColumnsRenamed(hidden), seed), "mixing")
    out = apply_mix(rows, weights, share, cap, seed)
    if not repeat:
        return out
    out = out.filter("copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str, seed: int = 17) -> DataFrame:
    rows = with_size(documents(spark, sf_dir).select("doc_id", "text", "source"), seed)
    out = apply_mix(written(rows.drop("text", "source"), "mixing"), (3, 1, 2), 1.5, 2, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op9_mixing": op9_mixing}
ORACLE: dict[str, str] = {}
