"""Toxicity by subword bags averaged into a linear softmax.

A text is read as its different words, in order, in segments of ``WORDS``; a segment is the mean of its words' character n-gram vectors, so a
misspelling shares most n-grams with its word.  A text is judged by its most toxic segments and words, calibrated together (see
``profile``): a few insults in a long text are not averaged away, and several words that each say little add up.  Labels are of
whole texts, so after a first pass over all segments,
each round trains on the segments of toxic texts that the last model ranks first, on the likeliest and some other
segments of clean texts, and on copies of both with random typing errors.

Fitting takes at most ``SAMPLE`` different labelled rows (doc_id and text) of each class, the least by a seeded hash; a
quarter is held back for calibration.  They are chosen by ids and hashes alone, so no text is shuffled to its label;
only the chosen texts are read again.  Tasks read these texts whole: they draw the segments of the first pass by
hash (``PIECES`` of a text) and rank all segments of a text in each round, of which the model fit gets ``TOP`` of a toxic
text and ``LIKELIEST`` and ``OTHERS`` of a clean one, and give the profiles of held
texts, and of these with typing errors, for calibration.  The calibrated offset is
shifted by the log-odds of the share of toxic labels, counted over all of them, less those of the sample, so the classes'
caps move no score.

Cases: null or wordless text gets the score of a text without evidence; null labels are not learned from; a document
that is labelled with both classes is learned as both; with labels of one class only, every score is that class's share;
repeated rows and texts that tie are scored alike; other columns are carried along, but those named ``score`` and
``predicted`` are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, documents, map_batches, utf8_rows, word_hashes, word_spans, written
from .subword import bag, grams, train

SAMPLE = 1500
PIECES = 24
BUCKETS, DIM = 1 << 15, 8
WORDS = 8
LEAST, WORD_LEAST = 30, 16  # n-grams that a segment, a word counts as having at least
TOPS, TOP_SEGMENTS = (1, 2, 3, 5, 8), 3
ROUNDS = 3
TOP, LIKELIEST, OTHERS = 3, 6, 6  # segments of a toxic text, of a clean one by rank, and by hash


def distinct_words(buf: np.ndarray) -> np.ndarray:
    """The text with spaces in place of each word (A-Z lower-cased) that it has had before."""
    low = LOWER[buf]
    starts, ends = word_spans(low)
    _, first = np.unique(word_hashes(low, starts, ends), return_index=True)
    if len(first) == len(starts):
        return low
    edge = np.zeros(len(low) + 1, dtype=np.int8)
    edge[starts[first]] += 1
    edge[ends[first]] -= 1
    return np.where(np.cumsum(edge[:-1]) > 0, low, 32).astype(np.uint8)


def segments(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of WORDS words; a rest of fewer than half as many joins the run before it."""
    starts, ends = word_spans(buf)
    if not len(starts):
        return starts, ends
    first = np.arange(0, len(starts), WORDS)
    if len(first) > 1 and len(starts) - first[-1] < WORDS // 2:
        first = first[:-1]
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def evidence(buf: np.ndarray, table: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """The logits of the segments and of the words of a text of distinct words.  One with few n-grams counts as padded with
    neutral ones."""
    starts, _ = word_spans(buf)
    if not len(starts):
        return np.array([bias]), np.zeros(0)
    at, ids = grams(buf, BUCKETS)
    which = np.searchsorted(starts, at, side="right") - 1
    n, total = np.bincount(which, minlength=len(starts)), np.bincount(which, weights=table[ids], minlength=len(starts))
    first = np.searchsorted(starts, segments(buf)[0])
    return np.add.reduceat(total, first) / np.maximum(np.add.reduceat(n, first), LEAST) + bias, total / np.maximum(n, WORD_LEAST)


def segment_logits(buf: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    return evidence(buf, table, bias)[0]


def profile(buf: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """What a text is judged by: the mean logits of its most toxic 1, 2, 3, 5 and 8 words (missing ones are 0), the logarithm of
    its number of different words, its most toxic segment, and the mean of its first three."""
    of_segments, of_words = evidence(distinct_words(buf), table, bias)
    words, best = np.sort(of_words)[::-1][: TOPS[-1]], np.sort(of_segments)[::-1][:TOP_SEGMENTS]
    return np.array([*(words[:k].sum() / k for k in TOPS), np.log1p(len(of_words)), best[0], best.mean()])


def misspell(text: bytes, rng: np.random.Generator) -> bytes:
    """One typing error in about half of the longer words."""
    words = text.split()
    for i, w in enumerate(words):
        if len(w) < 4 or rng.random() < 0.5:
            continue
        k, kind = int(rng.integers(1, len(w) - 1)), int(rng.integers(4))
        letter = bytes([int(rng.integers(97, 123))])
        words[i] = (w[:k] + w[k : k + 1] + w[k:], w[:k] + w[k + 1 :], w[:k] + letter + w[k + 1 :], w[: k - 1] + w[k : k + 1] + w[k - 1 : k] + w[k + 1 :])[kind]
    return b" ".join(words)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration of a score: (slope, offset), with a slight pull towards slope 1."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum() + 0.01 * b])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def drawn(buf: np.ndarray, y: int, model: tuple[np.ndarray, float] | None, seed: int) -> list[bytes]:
    """Segments of a whole text to learn from: without a model, some by hash; with one, the most toxic of a toxic text,
    and the likeliest and some by hash of a clean one."""
    low = distinct_words(buf)
    pieces = [low[a:b].tobytes() for a, b in zip(*segments(low), strict=True)]
    by_hash = sorted(pieces, key=lambda t: (zlib.crc32(t, seed), t))
    if model is None or not pieces:
        return by_hash[:PIECES]
    order = np.argsort(-segment_logits(low, *model), kind="stable")
    return [pieces[i] for i in order[: TOP if y else LIKELIEST]] + ([] if y else by_hash[:OTHERS])


def standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Profiles in units of the spread of those that were calibrated with, and not further out than these can tell."""
    return np.clip((x - mean) / spread, -4, 4)


def calibrated(x: np.ndarray, y: np.ndarray) -> dict:
    """Logistic regression (mean, spread, w, b) by Newton's method, with a pull of the weights towards 0."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z, w = np.column_stack([standard(x, mean, spread), np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    pull = np.append(np.full(x.shape[1], 1.0), 1e-6)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * np.maximum(p * (1 - p), 1e-9)) @ z + np.diag(pull), z.T @ (p - y) + pull * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "spread": spread, "w": w[:-1], "b": float(w[-1])}


def shifted(b: float, share: float, sample: float) -> float:
    """A calibrated offset for a population with this share of toxic texts, from a sample with another."""
    return b + float(np.log(share / (1 - share)) - np.log(sample / (1 - sample)))


def plain(odds: float) -> dict:
    """A model that says the same of each text."""
    n = len(TOPS) + 3
    return {"table": np.zeros(BUCKETS, np.float32), "bias": 0.0, "mean": np.zeros(n), "spread": np.ones(n), "w": np.zeros(n), "b": odds}


def fit(docs: DataFrame, labels: DataFrame, seed: int = 11) -> dict:
    """docs (doc_id, text), labels (doc_id, toxic)."""
    h = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(seed))
    keyed = docs.filter("text is not null and doc_id is not null").select("doc_id", h.alias("h"))
    given = labels.filter("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("y"))
    light = written(keyed.join(given, "doc_id").select("y", "h"), "labelled")
    counts = {r["y"]: r["count"] for r in light.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if not counts.get(0) or not counts.get(1):
        return plain(float(np.log((share or 1e-6) / max(1e-6, 1 - share))))
    ids = [r for c in (0, 1) for r in light.filter(F.col("y") == c).select("y", "h").distinct().orderBy("h").limit(SAMPLE).collect()]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "y int, h long"))  # at most 2 * SAMPLE
    found = docs.select(h.alias("h"), "text").join(chosen, "h").select("y", "h", "text")
    picked = written(found.dropDuplicates(["y", "h"]), "picked")  # copies of a row are one
    is_held = lambda h: h // 8 % 4 == 0
    both = {y for y, h in ids if is_held(h)} == {0, 1} and {y for y, h in ids if not is_held(h)} == {0, 1}
    rng = np.random.default_rng(seed)

    def pieces(model: tuple[np.ndarray, float] | None) -> list[tuple[int, bytes]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [
                    (y, h, k, t)
                    for y, h, buf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_rows(batch.column(2)), strict=True)
                    if not (both and is_held(h))
                    for k, t in enumerate(drawn(buf, y, model, seed))
                ]
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["y", "h", "k", "t"])

        found = map_batches(picked, run, "y int, h long, k int, t binary").collect()
        return [(r["y"], bytes(r["t"])) for r in sorted(found, key=lambda r: (r["y"], r["h"], r["k"]))]

    bag_of = lambda t: bag(grams(np.frombuffer(t, dtype=np.uint8), BUCKETS)[1], BUCKETS)

    def learn(chosen: list[tuple[int, bytes]], epochs: int):
        bags, y = [bag_of(t) for _, t in chosen], np.array([c for c, _ in chosen])
        weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        m = train(lambda i: bags[i], y, 2, BUCKETS, DIM, epochs, 20.0, seed, 64, weight)
        t = m.table()
        return t[:, 1] - t[:, 0], float(m.bias[1] - m.bias[0])

    first = pieces(None)
    if {y for y, _ in first} != {0, 1}:
        return plain(float(np.log(share / (1 - share))))
    table, bias = learn(first, 2)
    for _ in range(ROUNDS):
        table, bias = learn([x for y, t in pieces((table, bias)) for x in ((y, t), (y, misspell(t, rng)))], 4)

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (y, h, profile(t, table, bias).tolist())
                for y, h, buf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_rows(batch.column(2)), strict=True)
                if not both or is_held(h)
                for t in (buf, np.frombuffer(misspell(buf.tobytes(), np.random.default_rng(h % (1 << 32))), np.uint8))
            ]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["y", "h", "x"])

    found = sorted(map_batches(picked, profiles, "y int, h long, x array<double>").collect())  # of at most 2 * SAMPLE texts
    x, y = np.array([r["x"] for r in found]), np.array([r["y"] for r in found], dtype=float)
    found = calibrated(x, y)
    return {"table": table.astype(np.float32), "bias": bias, **found, "b": shifted(found["b"], share, float(y.mean()))}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score (0 to 1) and predicted (0 or 1)."""
    docs = docs.drop("score", "predicted")
    names = docs.columns
    at = names.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["score double", "predicted int"])
    empty = np.zeros(0, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([profile(empty if buf is None else buf, model["table"], model["bias"]) for buf in utf8_rows(batch.column(at))]).reshape(batch.num_rows, -1)
            p = 1 / (1 + np.exp(-np.clip(standard(x, model["mean"], model["spread"]) @ model["w"] + model["b"], -30, 30))) if batch.num_rows else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return map_batches(docs, run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held).select("doc_id", "toxic")
    model = fit(docs, labels)
    return score(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
