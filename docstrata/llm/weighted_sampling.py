"""Document fingerprints by consistent weighted sampling, in DataFrame and SQL functions alone.

A document is a bag of words; a word's weight is its count.  For each of ``samples`` seeds, every word draws
r ~ Gamma(2, 1), c ~ Gamma(2, 1) and beta ~ U(0, 1) from its hash, t = floor(ln(weight) / r + beta) and
a = c * exp(-r * (t + 1 - beta)); the sample is the (word, t) of the least a.  Two documents draw the same sample with
the probability of their generalised Jaccard similarity (sum of least weights over sum of greatest).

Gamma(2, 1) cut at a uniform point is two independent exponentials.  So c * (a uniform) and the rest of c are
exponentials X1 and X2, and r * (1 - beta) = ln(c / X1), r * beta = E2 is an exponential, too: then
a = X1 * exp(-r * t).  a is kept as 1 - exp(-a), which is a plain uniform number while t is 0; so a word met once, the
usual case, costs one hash a seed and no logarithm.  t is 0 while (w - 1) * X1 < X2.  40 bits of that number, which
differs with t, and 23 bits of the word are packed into one long, so each seed is a plain ``min`` with partial aggregation.

The next document comes from ranges of sorted ids: each range finds its own next ids, and one row a range bridges
to the next range.

Cases: null text is empty; a text without words draws nothing, and is like another such text only; every row has its
result, rows alike in doc_id and text the same one (they are sampled once and counted); if rows share a doc_id but not a
text, the least of their heads is what the previous document gets; a null doc_id has no next document: its text is
edited with nothing and near_next is null (such rows join with nothing); a very long text is one array of its words'
hashes in a task; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, documents, written

SAMPLES = 64
_UNIT = "2.3283064365386963e-10D"  # 2 ** -32
_STEP = "9.094947017729282e-13D"  # 2 ** -40


def _draw(seed: int) -> str:
    """SQL for one seed's packed (a, word, t) of a row (h, w)."""
    q, y = f"shiftrightunsigned(xxhash64(h, {seed}), 24)", f"xxhash64(h, {seed}, 1)"
    u2 = f"((({y} & 4294967295L) + 0.5D) * {_UNIT})"
    x1, x2, e2 = f"(-log1p(-({q} + 0.5D) * {_STEP}))", f"(-ln((shiftrightunsigned({y}, 32) + 0.5D) * {_UNIT}))", f"(-ln({u2}))"
    # r * t = z - z % r with z = ln(w) + E2, and exp(-z) = u2 / w: each logarithm is written as seldom as can be.
    a = f"({x1} * exp((lw + {e2}) % (log1p({x2} / {x1}) + {e2})) * {u2} / w)"
    return f"shiftleft(case when w = 1 then {q} when (w - 1) * {x1} < {x2} then {q} else cast(-expm1(-{a}) / {_STEP} as bigint) end, 23) | (h & 8388607L)"


def with_terms(rows: DataFrame, text: str) -> DataFrame:
    """rows with one row for each distinct word of the text column (which goes): h, its hash, w, its count, lw, the
    count's logarithm, and first, 1 for one of a row's words."""
    keep = [c for c in rows.columns if c != text]
    spaced = text
    for space in (9, 10, 11, 12, 13):
        spaced = f"replace({spaced}, char({space}), ' ')"
    rows = rows.withColumn("__s", F.expr(f"sort_array(transform(array_remove(split({spaced}, ' '), ''), x -> xxhash64(x)))")).drop(text)
    rows = rows.withColumn("__p", F.expr("case when size(__s) > 0 then filter(sequence(0, size(__s) - 1), i -> i = 0 or __s[i] <> __s[i - 1]) else array() end"))
    rows = rows.withColumn("__t", F.expr("transform(__p, (p, j) -> struct(__s[p] as h, coalesce(get(__p, j + 1), size(__s)) - p as w))"))
    rows = rows.select(*keep, F.posexplode_outer("__t").alias("__i", "__x"))
    return rows.select(*keep, F.col("__x.h").alias("h"), F.col("__x.w").cast("long").alias("w"), F.ln("__x.w").alias("lw"), (F.coalesce("__i", F.lit(0)) == 0).cast("long").alias("first"))


def sample(rows: DataFrame, text: str, samples: int = SAMPLES) -> DataFrame:
    """One row for each different combination of the other columns, with ``sig``: its samples as 32-bit hashes, or
    null for a text without words, and ``rows``, the number of its rows."""
    keys = [c for c in rows.columns if c != text]
    drawn = with_terms(rows, text).groupBy(*keys).agg(F.sum("first").alias("rows"), *[F.min(F.expr(_draw(k))).alias(f"__m{k}") for k in range(samples)])
    sig = F.array(*[F.expr(f"cast(shiftright(xxhash64(__m{k}), 32) as int)") for k in range(samples)])
    return drawn.select(*keys, "rows", F.when(F.col("__m0").isNotNull(), sig).alias("sig"))


def fingerprint(sig: Column, samples: int = SAMPLES) -> Column:
    """Eight hex digits a sample; zeros for a text without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.right(F.lpad(F.hex(x), 8, "0"), F.lit(8))), ""), F.lit("0" * 8 * samples))


def likeness(a: str, b: str) -> Column:
    """Share of equal samples."""
    same = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x = y as int)), 0, (n, x) -> n + x) / cast(size({a}) as double)")
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(same)


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, n_chars) for each different id, in ascending order, the last followed by the first."""
    ids = docs.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    ids = checkpoint(ids.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()))
    ends = ids.groupBy("range").agg(F.min("doc_id").alias("least"))
    whole = W.orderBy("range")
    bridge = ends.select("range", F.coalesce(F.lead("least").over(whole), F.first("least").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    inner = ids.withColumn("within", F.lead("doc_id").over(W.partitionBy("range").orderBy("doc_id")))
    return inner.join(bridge, "range").select("doc_id", F.coalesce("within", "after").alias("next_id"), "n_chars")


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as the column (which goes) says, in two steps, so that no array is long."""
    step = 4096
    rows = rows.withColumn("__a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / step))))
    return rows.withColumn("__b", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step).cast("long"), F.col(times) - F.col("__a") * step)))).drop("__a", "__b", times)


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    # Under a name of its own, the id is read alike in both joins below, so that they share one shuffle of the texts.
    docs = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce("text", F.lit("")).alias("text"))
    named = docs.filter("__id is not null")
    following = checkpoint(next_ids(named.select(F.col("__id").alias("doc_id"), F.char_length("text").alias("n_chars"))))
    wanted = following.select(F.col("next_id").alias("__id"), F.col("doc_id").alias("prev_id"), F.floor(F.col("n_chars") / 2).cast("int").alias("take"))
    heads = named.join(wanted, "__id").groupBy("prev_id").agg(F.min(F.expr("left(text, take)")).alias("head"))
    rows = named.join(heads.withColumnRenamed("prev_id", "__id"), "__id", "left")

    def sampled(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
        edited = F.concat(F.expr("left(text, cast(n_chars as int) - half)"), F.expr("left(head, half)"))
        rows = rows.withColumn("edited", edited).select(
            F.col("__id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("same"),
            F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).alias("x"),
        )
        drawn = sample(rows.select("doc_id", "n_chars", "edited_sha256", "same", F.col("x.v").alias("v"), F.col("x.t").alias("t")), "t", samples)
        pick = lambda v: F.first(F.when(F.col("v") == v, F.col("sig")), ignorenulls=True)
        return drawn.groupBy("doc_id", "n_chars", "edited_sha256", "same").agg(pick(0).alias("sig"), pick(1).alias("edited_sig"), F.max("rows").alias("rows"))

    # The plan of a sample is long; its second half and what follows from it are only there for rows that need them.
    nameless = docs.filter("__id is null")
    some = not nameless.select("__id").isEmpty()
    both = sampled(rows).unionByName(sampled(nameless.withColumn("head", F.lit("")))) if some else sampled(rows)
    both = written(both, "fingerprints")
    named = both.filter("doc_id is not null")
    least = named.groupBy("doc_id").agg(F.min_by("sig", "same").alias("next_sig")).withColumnRenamed("doc_id", "next_id")
    linked = following.select("doc_id", "next_id").join(least, "next_id").select("doc_id", "next_sig")
    near = named.join(linked, "doc_id").withColumn("near_next", likeness("sig", "next_sig"))
    if some:
        near = near.unionByName(both.filter("doc_id is null").withColumn("next_sig", F.lit(None).cast("array<int>")).withColumn("near_next", F.lit(None).cast("double")))
    return repeated(near, "rows").select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sig"), samples).alias("fingerprint"), fingerprint(F.col("edited_sig"), samples).alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), "near_next",
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLE: dict[str, str] = {}
