"""Quality rules with risk-controlled thresholds.

Every document gets counts and a few ratios, each high in bad text.  A stratum's cut-offs are certified jointly: over
its labelled good documents, the exact (Clopper-Pearson) upper bound of the share that any of the cut-offs rejects is
at most ``risk``.  Vectors of cut-offs are tested in one fixed sequence, each tighter than the one before, until the
first that fails (fixed-sequence testing needs no further correction); the error ``delta`` is divided by strata only
(Bonferroni).  The sequence must not depend on the good documents it is tested on: a step tightens one ratio to a grid
value that rejects more of the stratum's bad documents, in the order of the share of other strata's good documents
that the ratio alone rejects there (with no other stratum, in the order of the grid).  Of the certified vectors, the
loosest with the greatest excess of bad over good rejections is used; with none, nothing is rejected in that stratum.

Strata with too few good documents to certify anything alone are one stratum together (``REST``), with all strata that
have no labels; if it is still too small, it takes the smallest others too, all but the largest.  Its risk holds over
them together, not for each.  Strata with equally many good documents are tested alone together or not at all.  Every
labelled document is counted, in Spark, and there may be any number of strata: sequences are built and certified for
each stratum by a task, from its counts; the driver gets the number of strata for each number of good documents, and one
row for each ratio and grid step.

Cases: null text has no words; null is a stratum of its own, other than the empty string; repeated rows are judged alike
(and count repeatedly in the holdout); a document that is labelled both good and bad counts as one of each; a value at a cut-off is not above it; labels may be empty or null; a text is
measured whole, however long; other columns are carried along, but those named like the new ones are replaced (names
that begin with two underscores are reserved); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, utf8_rows, window_hashes, word_hashes, word_spans, written

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
RATIOS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "bang_ratio", "pipe_ratio")
GRID = [1.0, *[round(0.95**i, 6) for i in range(1, 100)]]  # loosest first
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
REST = None
BROADCAST_ROWS = 10_000  # strata, of a few numbers each
SALTS = 32


def measure(buf: np.ndarray | None) -> tuple[list[int], list[float]]:
    """COUNTS and RATIOS of one text."""
    if buf is None or not len(buf):
        return [0] * 5, [0.0] * 6
    starts, ends = word_spans(buf)
    n = len(starts)
    if not n:
        return [0, 0, 0, 0, 0], [0.0] * 6
    histogram = np.bincount(buf, minlength=256)
    points = len(buf) - int(histogram[128:192].sum())
    word_chars = points - int(histogram[[9, 10, 11, 12, 13, 32]].sum())
    symbols = int(histogram[SYMBOLS].sum())
    seen: set[bytes] = set()
    lines = dup = 0
    for line in buf.tobytes().split(b"\n"):
        if line.strip(b" \t\v\f\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n > WINDOW:
        windows = window_hashes(word_hashes(buf, starts, ends), WINDOW)
        _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[which] > 1)
        if len(at):
            edge = np.zeros(n + 1, dtype=np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    upper = int(histogram[65:91].sum())
    letters = upper + int(histogram[97:123].sum())
    ratios = [symbols / word_chars, dup / lines, repeated / n, upper / letters if letters else 0.0, min(1.0, int(histogram[33]) / n), min(1.0, int(histogram[124]) / n)]
    return [n, word_chars, symbols, dup, repeated], ratios


def measured(docs: DataFrame) -> DataFrame:
    """docs with COUNTS (long) and RATIOS (double, 0 to 1)."""
    docs = docs.drop(*COUNTS, *RATIOS)
    names = docs.columns
    at = names.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{c} long" for c in COUNTS] + [f"{r} double" for r in RATIOS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(buf) for buf in utf8_rows(batch.column(at))]
            counts = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            ratios = [pa.array([r[1][i] for r in rows], pa.float64()) for i in range(len(RATIOS))]
            yield pa.record_batch([*batch.columns, *counts, *ratios], [*names, *COUNTS, *RATIOS])

    return map_batches(docs, run, schema)


def _log_terms(k: int, n: int) -> np.ndarray:
    """Logarithms of the binomial coefficients (n over 0) to (n over k)."""
    i = np.arange(1, k + 1, dtype=np.float64)
    return np.concatenate(([0.0], np.cumsum(np.log(n - i + 1) - np.log(i))))


def at_most(k: int, n: int, p: float) -> np.ndarray:
    """P(X <= 0) to P(X <= k) of a binomial count."""
    i = np.arange(k + 1)
    return np.cumsum(np.exp(_log_terms(k, n) + i * math.log(p) + (n - i) * math.log1p(-p)))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact binomial upper bound: the greatest p with P(X <= k) >= delta."""
    if n == 0 or k >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid in (0.0, 1.0):
            break
        low, high = (mid, high) if at_most(k, n, mid)[-1] >= delta else (low, mid)
    return high


def most_rejected(n: int, risk: float, delta: float) -> int:
    """The greatest count whose upper bound is at most the risk; -1 if there is none.  P(X <= k) falls with p, so the
    bound of k is at most the risk where P(X <= k), at the risk, is at most delta."""
    return int(np.count_nonzero(at_most(int(risk * n), n, risk) <= delta)) - 1


def certified(good: list[int], bad: list[int], n_good: int, n_bad: int, risk: float, delta: float) -> int | None:
    """The step to use of a sequence, from the rejections of good and bad documents up to each of its steps."""
    best, score, most = None, 0.0, most_rejected(n_good, risk, delta)
    for k, (g, b) in enumerate(zip(good, bad, strict=True)):
        if g > most:
            break
        gain = b / max(1, n_bad) - g / max(1, n_good)
        if gain > score + 1e-12:
            best, score = k, gain
    return best


def least_good(risk: float, delta: float) -> int:
    """The fewest good documents, none of them rejected, that certify anything."""
    return math.ceil(math.log(delta) / math.log1p(-risk))


def alone(counts: list[tuple[int, int]], risk: float, delta: float) -> int | None:
    """How many good documents a stratum needs to be tested alone, from (good documents, number of such strata), falling;
    None if no stratum can."""
    strata, every = sum(m for _, m in counts), sum(g * m for g, m in counts)
    k, inside, found = 0, 0, None
    for g, m in counts:
        k, inside = k + m, inside + g * m
        least = least_good(risk, delta / (k + (k < strata)))
        if g >= least and (k in (1, strata) or every - inside >= least):
            found = g
    return found


def sequence(bad: dict[str, list[int]], others: dict[str, list[int]]) -> list[tuple[str, int]]:
    """The steps (ratio, grid step), from own bad and others' good documents by ratio and grid step."""
    cost = {r: np.cumsum(others[r]).tolist() for r in RATIOS}
    return [(r, s) for _, s, _, r in sorted((cost[r][s], s, i, r) for i, r in enumerate(RATIOS) for s in range(len(GRID)) if bad[r][s])]


def _paths(good_of: dict[str, np.ndarray]):
    """Counts (g, q, ratio, step, n) of one stratum to its sequence and, for each ratio and step, the first place of the
    sequence that rejects it; good_of counts all good documents by ratio and step."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {q: {r: [0] * len(GRID) for r in RATIOS} for q in (0, 1)}
        sizes = {q: int(pdf.loc[(pdf["q"] == q) & (pdf["ratio"] == 0), "n"].sum()) for q in (0, 1)}
        for q, r, s, n in zip(pdf["q"], pdf["ratio"], pdf["step"], pdf["n"], strict=True):
            if s < len(GRID):
                own[q][RATIOS[r]][s] += n
        path = sequence(own[0], {r: (good_of[r] - own[1][r]).tolist() for r in RATIOS})
        place = np.full((len(RATIOS), len(GRID) + 1), len(path), dtype=np.int64)
        for k, (r, s) in reversed(list(enumerate(path))):
            place[RATIOS.index(r), : s + 1] = k
        g = pdf["g"].iloc[0]
        row = {"g": None if pd.isna(g) else g, "ratios": [RATIOS.index(r) for r, _ in path], "steps": [s for _, s in path], "place": place.tolist(), "n_good": sizes[1], "n_bad": sizes[0]}
        return pd.DataFrame([row])

    return run


def _cuts(risk: float, delta: float):
    """Rows (g, ratios, steps, n_good, n_bad, found), found with the documents (q, k, n) by the first place that rejects
    them, to the certified cut-offs (g, cuts)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                count = {0: [0] * len(r.steps), 1: [0] * len(r.steps)}
                for x in r.found:
                    if x["k"] < len(r.steps):
                        count[x["q"]][x["k"]] += x["n"]
                good, bad = (np.cumsum(count[q]).tolist() for q in (1, 0))
                k, cuts = certified(good, bad, r.n_good, r.n_bad, risk, delta), [None] * len(RATIOS)
                for ratio, step in zip(r.ratios[: k + 1], r.steps[: k + 1], strict=True) if k is not None else ():
                    cuts[ratio] = GRID[step]
                out.append({"g": r.g, "cuts": cuts})
            yield pd.DataFrame(out, columns=["g", "cuts"])

    return run


def _stratum(c: Column) -> Column:
    """A name for each stratum: null is one, and another than the empty string."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def thresholds(labelled: DataFrame, stratum: str, risk: float, delta: float) -> DataFrame:
    """(g, cuts) from labelled rows (stratum, RATIOS, quality): the cut-offs, in the order of RATIOS and null for none, of
    each stratum that is tested alone (g as ``_stratum`` names it) and of REST (g is null), if there is one."""
    # Steps at which a value is above the cut-off: those after the number of cut-offs that are at least the value.
    step = lambda r: F.expr(f"cast(size(filter(array({', '.join(f'{c}D' for c in GRID)}), c -> c >= {r})) as int)")
    rows = labelled.filter("quality in (0, 1)").select(_stratum(F.col(stratum)).alias("g"), F.col("quality").cast("int").alias("q"), F.array(*[step(r) for r in RATIOS]).alias("at"))
    rows = written(rows, "steps")
    strata = written(rows.groupBy("g").agg(F.count_if(F.col("q") == 1).alias("good")), "strata")
    counts = [(r["good"], r["count"]) for r in strata.groupBy("good").count().orderBy(F.desc("good")).collect()]
    least = alone(counts, risk, delta)
    own = strata.filter(F.col("good") >= (least if least is not None else float("inf"))).select(F.col("g").alias("own"))
    tests = sum(m for g, m in counts if least is not None and g >= least)
    tests += tests < sum(m for _, m in counts)
    rows = written(rows.join(_small(own), F.col("g") == F.col("own"), "left").select(F.col("own").alias("g"), "q", "at"), "dealt")
    counted = written(rows.select("g", "q", F.posexplode("at").alias("ratio", "step")).groupBy("g", "q", "ratio", "step").agg(F.count("*").alias("n")), "counts")
    good_of = {r: np.zeros(len(GRID), dtype=np.int64) for r in RATIOS}
    for r in counted.filter(F.col("q") == 1).groupBy("ratio", "step").agg(F.sum("n").alias("n")).collect():
        if r["step"] < len(GRID):
            good_of[RATIOS[r["ratio"]]][r["step"]] += r["n"]
    paths = written(counted.groupBy("g").applyInPandas(_paths(good_of), "g string, ratios array<int>, steps array<int>, place array<array<int>>, n_good long, n_bad long"), "paths")
    placed = rows.join(_small(paths.select(F.col("g").alias("p"), "place")), F.col("g").eqNullSafe(F.col("p")))
    first = F.array_min(F.zip_with("at", "place", lambda s, by: F.get(by, s)))
    found = placed.groupBy("g", "q", first.alias("k")).agg(F.count("*").alias("n")).groupBy(F.col("g").alias("f")).agg(F.collect_list(F.struct("q", "k", "n")).alias("found"))
    ready = paths.drop("place").join(found, F.col("g").eqNullSafe(F.col("f"))).drop("f")
    return written(ready.mapInPandas(_cuts(risk, delta / max(1, tests)), "g string, cuts array<double>"), "cuts")


def reject(rows: DataFrame, cuts: DataFrame, stratum: str) -> DataFrame:
    """rows (stratum, RATIOS) with ``__rejected``: whether a ratio is above its stratum's cut-off."""
    rest = cuts.filter("g is null").first()
    values = F.array(*RATIOS)
    above = lambda c: F.exists(F.zip_with(values, c, lambda v, cut: F.coalesce(v > cut, F.lit(False))), lambda x: x)
    other = above(F.array(*[F.lit(c).cast("double") for c in rest["cuts"]])) if rest else F.lit(False)
    own = cuts.filter("g is not null").select(F.col("g").alias("__g"), F.col("cuts").alias("__cuts"))
    if own.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(own), _stratum(F.col(stratum)) == F.col("__g"), "left")
    else:  # salted, as one stratum may hold a third of all rows
        own = own.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(own, (_stratum(F.col(stratum)) == F.col("__g")) & (F.pmod(F.xxhash64("doc_id", *RATIOS), F.lit(SALTS)) == F.col("__salt")), "left").drop("__salt")
    return rows.withColumn("__rejected", F.when(F.col("__g").isNull(), other).otherwise(above(F.col("__cuts")))).drop("__g", "__cuts")


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def verdicts(rows: DataFrame, labels: DataFrame, stratum: str, risk: float, delta: float) -> DataFrame:
    """Written, measured rows with base_failed and kept."""
    held = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__quality")).join(rows.select("doc_id", stratum, *RATIOS), F.col("doc_id") == F.col("__id"))
    held = held.select(F.col(stratum), F.col("__quality").alias("quality"), *RATIOS)
    rows = reject(rows.drop("base_failed", "kept"), thresholds(held, stratum, risk, delta), stratum)
    return rows.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & ~F.col("__rejected")).drop("__rejected")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """docs (doc_id, text, stratum) with COUNTS, RATIOS, base_failed and kept.  The measured rows are written once, for
    the thresholds and for the verdicts."""
    return verdicts(written(measured(docs), "measured"), labels, stratum, risk, delta)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(measured(documents(spark, sf_dir).select("doc_id", "text", "lang")).drop("text"), "measured")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return verdicts(rows, labels, "lang", 0.01, 0.05).select("doc_id", *COUNTS, "base_failed", "kept")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE: dict[str, str] = {}
