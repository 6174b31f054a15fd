"""Quality classifier by co-training two views.

The text view averages case-keeping character n-gram embeddings into a linear softmax.  The metadata view is a logistic
regression over what a page's record says without its words: language, source, length and layout (lines, their
length, shares of capitals, digits and other signs).  Both start from the labelled sample.  In each round both views
score all unlabelled documents, in Spark; each view then hands the other the ``SHARE`` of them that it is most sure of,
among those not handed over before: the most likely of each class, by cut-offs at quantiles of all scores, split as the
classes are in the labels.  Where both views are sure of a document and differ, neither gets it.  Held labelled documents
calibrate both views; the score is their combined probability.

A document is rejected below the cut-off, the lower of ``CUT`` and the score that ``REJECT`` of the held good documents
fall below, so clean documents stay.  The labelled sample is bounded: ``LABELLED`` documents, the least by a seeded hash;
the driver gets their n-gram shares and features.  What is handed over grows with the input and stays in Spark: it is dealt
by hash to fits of about ``TEACH`` documents each, in tasks, every one with the labelled sample; the model is the mean of
their logits, slot by slot.  The same functions serve fit and score.

Cases: null text, lang, source and n_chars are values of their own; null labels, and labels of a doc_id that has both
classes, are not learned from; of different rows of one labelled doc_id, the one with the least hash is learned from;
ties in the order of confidence go to the lesser hash; without both classes every score is 1 and all are kept; repeated
rows are scored alike, and learned from once; a very long text is scored whole; other columns are carried along, but
those named like the new ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, emptied, map_batches, mix, recorded, utf8_rows, word_hashes, word_spans, written
from .subword import NO_BAG, Bag, bag, gram_sums, grams, logits_of, pack, side_by_side, train, unpack
from .toxicity import platt

LABELLED = 1500
SHARE, TEACH = 0.05, 2000
BROADCAST_ROWS = 500_000  # hashes
BUCKETS, DIM, SIZES = 1 << 15, 8, (2, 3, 4)
ROUNDS = 2
SURE = 0.95
CUT, REJECT = 0.5, 0.005
SLOTS = 16
GROUP = 1 << 18  # bytes of texts that are scored at once
REPETITION, REPEATED = 0, 8  # a bucket, and how much an immediate repetition counts in n-grams
KEYED = ("h", "text", "lang", "source", "n_chars")
NOTHING = np.zeros(0, np.uint8)


def text_grams(buf: np.ndarray) -> np.ndarray:
    """The buckets of a text's n-grams, and REPEATED times that of a repetition for each word that is the one before it."""
    ids, hashes = grams(buf, BUCKETS, SIZES, fold=False)[1], word_hashes(buf, *word_spans(buf))
    again = int(np.count_nonzero(hashes[1:] == hashes[:-1]))
    return np.append(ids, np.full(again * REPEATED, REPETITION)) if again else ids


@lru_cache(1 << 12)
def _slot(value: str | None) -> int:
    """The slot of a language or a source."""
    code = np.frombuffer(("" if value is None else "=" + value).encode(), dtype=np.uint8).astype(np.uint64)
    return int(mix(np.array([len(code) + int((code * mix(np.arange(1, len(code) + 1, dtype=np.uint64))).sum()) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0] % np.uint64(SLOTS))


def metadata(texts: Sequence[np.ndarray], lang: Sequence[str | None], source: Sequence[str | None], n_chars: Sequence[int | None]) -> np.ndarray:
    """Features of records, a row each: hashed one-hot language and source, length and layout."""
    rows, length = np.arange(len(texts)), np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), 2 * SLOTS + 10))
    for k, values in enumerate((lang, source)):
        out[rows, [k * SLOTS + _slot(v) for v in values]] = 1
    h = np.array([np.bincount(t, minlength=256) for t in texts], dtype=np.int64).reshape(-1, 256)
    upper, lower, digits, spaces, wide = h[:, 65:91].sum(1), h[:, 97:123].sum(1), h[:, 48:58].sum(1), h[:, [9, 10, 11, 12, 13, 32]].sum(1), h[:, 128:].sum(1)
    n, lines = np.maximum(1, length), h[:, 10] + 1
    signs = n - upper - lower - digits - spaces - wide
    size = np.log1p([max(0, int(c)) if c is not None else k for c, k in zip(n_chars, length.tolist(), strict=True)])
    layout = [np.ones(len(texts)), size / 10, np.log1p(lines) / 5, np.log(n / lines) / 10, upper / np.maximum(1, upper + lower), np.minimum(1.0, 10 * digits / n), np.minimum(1.0, 10 * signs / n), spaces / n, wide / n, np.sqrt(np.minimum(1.0, signs / n))]
    out[:, 2 * SLOTS :] = np.column_stack(layout)
    return out


def repetitions(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often a word is the one before it, in each of the texts side by side."""
    step = np.flatnonzero((text[1:] == 32) != (text[:-1] == 32)) + 1
    starts, ends = step[::2], step[1::2]
    size = ends - starts
    k = np.flatnonzero((size[1:] == size[:-1]) & (text[starts[1:]] == text[starts[:-1]]) & (text[ends[1:] - 1] == text[ends[:-1] - 1]))
    of = np.searchsorted(first, starts[k], "right") - 1
    within = of == np.searchsorted(first, starts[k + 1], "right") - 1
    k, of = k[within], of[within]
    if not len(k):
        return np.zeros(len(first), np.int64)
    begin = np.cumsum(size[k]) - size[k]
    letter = np.arange(int(size[k].sum())) - np.repeat(begin, size[k])
    same = text[letter + np.repeat(starts[k], size[k])] == text[letter + np.repeat(starts[k + 1], size[k])]
    return np.bincount(of[np.logical_and.reduceat(same, begin)], minlength=len(first))


def text_logits(texts: Sequence[np.ndarray], table: np.ndarray, bias: float) -> np.ndarray:
    """Each text's mean of the logits of its ``text_grams``, for many short texts at once; a text over GROUP bytes stands alone."""
    out, begin, held = [], 0, 0
    for i, t in enumerate([*texts, None]):
        if i > begin and (t is None or held + len(t) > GROUP):
            text, first = side_by_side(texts[begin:i], SIZES)
            total, number = gram_sums(text, first, table, SIZES)
            again = repetitions(text, first) * REPEATED
            out.append((total + again * table[REPETITION]) / (number + again) + bias)
            begin, held = i, 0
        held += len(t) if t is not None else 0
    return np.concatenate(out) if out else np.zeros(0)


def fit_linear(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 1.0, decay: float = 1e-3, seed: int = 3) -> np.ndarray:
    rng, w = np.random.default_rng(seed), np.zeros(x.shape[1])
    for e in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 64):
            i = order[k : k + 64]
            p = 1 / (1 + np.exp(-np.clip(x[i] @ w, -30, 30)))
            w -= rate / (1 + 0.1 * e) * (x[i].T @ (p - y[i]) / len(i) + decay * w)
    return w


def record_hash(seed: int) -> Column:
    """Of all that a document is judged by."""
    parts = [x for c in ("text", "lang", "source", "n_chars") for x in (F.col(c), F.isnull(c))]
    return F.xxhash64(*parts, F.lit(seed))


def _views(batch: pa.RecordBatch, at: Sequence[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The bytes of each row of a batch, whose columns at are text, lang, source and n_chars, and their metadata, a row each."""
    texts = [NOTHING if buf is None else buf for buf in utf8_rows(batch.column(at[0]))]
    return texts, metadata(texts, *(batch.column(i).to_pylist() for i in at[1:]))


def feature_rows(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """(h, bag, meta) of the different documents whose hashes are in chosen (h), from keyed documents (h, text, lang, source,
    n_chars)."""
    few = F.broadcast(chosen) if chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, seen = [], set()
            for h, buf, meta in zip(batch.column(0).to_pylist(), *_views(batch, (1, 2, 3, 4)), strict=True):
                if h not in seen:
                    seen.add(h)
                    out.append((h, pack(bag(text_grams(buf), BUCKETS)), meta.tolist()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.list_(pa.float64())), strict=True)], ["h", "bag", "meta"])

    return map_batches(keyed.join(few, "h").select(*KEYED), run, "h long, bag binary, meta array<double>").dropDuplicates(["h"])


def features(keyed: DataFrame, chosen: Sequence[int]) -> dict[int, tuple[Bag, np.ndarray]]:
    """hash to (bag, metadata) of at most LABELLED hashes."""
    rows = feature_rows(keyed, keyed.sparkSession.createDataFrame([(h,) for h in chosen], "h long"))
    return {r["h"]: (unpack(r["bag"]), np.array(r["meta"])) for r in rows.toArrow().to_pylist()}


def fit_text(bags: list[Bag], y: np.ndarray, seed: int) -> np.ndarray:
    """The logit of each n-gram bucket, and the offset behind them."""
    weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    m = train(lambda i: bags[i], y, 2, BUCKETS, DIM, 3, 20.0, seed, 32, weight)
    table = m.table()
    return np.append(table[:, 1] - table[:, 0], m.bias[1] - m.bias[0]).astype(np.float64)


def fit_view(view: str, known: list[tuple[Bag, np.ndarray]], y: np.ndarray, seed: int) -> np.ndarray:
    return fit_text([b for b, _ in known], y, seed) if view == "text" else fit_linear(np.array([m for _, m in known]), y.astype(float))


def taught_views(taught: DataFrame, known: list[tuple[Bag, np.ndarray]], label: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """What each view learns from the labelled sample and what it has been handed (view, h, y, bag, meta): the mean of fits
    in tasks.  Sums are of decimals, so their order does not matter."""
    most = taught.groupBy("view").count().agg(F.max("count")).first()[0] or 0

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        view, rows = rows["view"].iloc[0], rows.sort_values("h")
        more = [(unpack(b) if b is not None else NO_BAG, np.asarray(m, dtype=float)) for b, m in zip(rows["bag"], rows["meta"], strict=True)]
        values = fit_view(view, [*known, *more], np.append(label, rows["y"].to_numpy()).astype(np.int64), seed)
        return pd.DataFrame({"view": view, "slot": np.arange(len(values), dtype=np.int32), "value": values})

    dealt = taught.withColumn("fit", F.pmod(F.xxhash64("h"), F.lit(max(1, -(-most // TEACH)))))
    fits = dealt.groupBy("view", "fit").applyInPandas(run, "view string, slot int, value double")
    mean = fits.groupBy("view", "slot").agg((F.sum(F.col("value").cast("decimal(24,12)")).cast("double") / F.count("*")).alias("value"))
    found = mean.toPandas().sort_values(["view", "slot"])  # a row a slot
    return {view: rows["value"].to_numpy() for view, rows in found.groupby("view")}


def fit(docs: DataFrame, labels: DataFrame, seed: int = 23) -> dict | None:
    """docs (doc_id, text, lang, source, n_chars), labels (doc_id, quality).  The model is whole when this returns, so the tables
    it was made with are emptied."""
    made: list[str] = []
    with recorded(made):
        model = _fit(docs, labels, seed)
    emptied(docs.sparkSession, made)
    return model


def _fit(docs: DataFrame, labels: DataFrame, seed: int) -> dict | None:
    keyed = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).withColumn("h", record_hash(seed))
    labels = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"), F.max("quality").cast("int").alias("z")).filter("y = z").drop("z")
    given = keyed.select("doc_id", "h").join(labels, "doc_id").groupBy("doc_id", "y").agg(F.min("h").alias("h"))
    rows = given.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), "doc_id").limit(LABELLED).select("h", "y").collect()
    label = {r["h"]: r["y"] for r in sorted(rows)}
    if len(set(label.values())) < 2:
        return None
    known = features(keyed, list(label))
    given_hashes = sorted(known)
    held = [h for h in given_hashes if h // 64 % 10 < 3]
    fit_on = [h for h in given_hashes if h // 64 % 10 >= 3]
    if len({label[h] for h in held}) < 2 or len({label[h] for h in fit_on}) < 2:
        held = fit_on = given_hashes
    share = float(np.mean([label[h] for h in fit_on]))
    goal = np.array([label[h] for h in held], dtype=float)
    learned = [known[h] for h in fit_on], np.array([label[h] for h in fit_on])

    def learn(taught: DataFrame | None) -> dict:
        views = taught_views(taught, *learned, seed) if taught is not None else {}
        text, meta = (views[v] if v in views else fit_view(v, *learned, seed) for v in ("text", "meta"))
        view = {"table": text[:-1, None].astype(np.float32), "bias": text[-1:].astype(np.float32), "meta": meta}
        tz = np.array([logits_of(known[h][0], view["table"], view["bias"])[0] for h in held])
        mz = np.array([known[h][1] @ view["meta"] for h in held])
        view["cal"] = (*platt(tz, goal), *platt(mz, goal))
        return view

    model, taught = learn(None), None
    sure = float(np.log(SURE / (1 - SURE)))
    for _ in range(ROUNDS):
        scored = written(_logits(keyed, model), "scores")
        free = scored.join(labels.select("doc_id"), "doc_id", "left_anti").groupBy("h").agg(F.first("text_z").alias("text_z"), F.first("meta_z").alias("meta_z"))
        free = free.filter(~F.col("h").isin([*known]))  # at most LABELLED
        free = written(free if taught is None else free.join(taught.select("h").distinct(), "h", "left_anti"), "free")
        at = [1 - SHARE * share, SHARE * (1 - share)]
        cuts = free.agg(*[F.percentile_approx(z, at, 100_000).alias(z) for z in ("text_z", "meta_z")]).first()
        if cuts["text_z"] is None:
            break
        said = lambda z: F.when(F.col(z) >= max(sure, cuts[z][0]), 1).when(F.col(z) <= min(-sure, cuts[z][1]), 0)  # noqa: B023, E731
        picked = free.select("h", said("text_z").alias("of_text"), said("meta_z").alias("of_meta")).filter("coalesce(of_text, of_meta) is not null and coalesce(of_text = of_meta, true)")
        picked = written(picked, "handed")
        pairs = F.explode(F.array(F.struct(F.lit("meta").alias("view"), F.col("of_text").alias("y")), F.struct(F.lit("text").alias("view"), F.col("of_meta").alias("y"))))
        rows = feature_rows(keyed, picked.select("h")).join(picked, "h").select("h", pairs.alias("x"), "bag", "meta").filter("x.y is not null")
        rows = rows.select("x.view", "h", "x.y", F.when(F.col("x.view") == "text", F.col("bag")).alias("bag"), "meta")
        fresh = written(rows, "taught")
        if fresh.isEmpty():
            break
        taught = fresh if taught is None else taught.unionByName(fresh)
        model = learn(taught)
    ta, tb, ma, mb = model["cal"]
    both = np.array([[ta * logits_of(known[h][0], model["table"], model["bias"])[0] + tb, ma * (known[h][1] @ model["meta"]) + mb] for h in held])
    model["w"] = fit_linear(np.column_stack([both / 4, np.ones(len(held))]), goal)
    s = combine(model, both[:, 0], both[:, 1])[goal == 1]
    model["cut"] = float(min(CUT, np.quantile(s, REJECT))) if len(s) else 0.0
    return model


def _logits(keyed: DataFrame, model: dict) -> DataFrame:
    """(doc_id, h, text_z, meta_z) of keyed documents: the calibrated logits of both views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = view_logits(batch, (2, 3, 4, 5), model)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(z[:, 0]), pa.array(z[:, 1])], ["doc_id", "h", "text_z", "meta_z"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return map_batches(keyed.select("doc_id", *KEYED), run, f"doc_id {kind}, h long, text_z double, meta_z double")


def view_logits(batch: pa.RecordBatch, at: Sequence[int], model: dict) -> np.ndarray:
    """The calibrated logits of both views for each row."""
    texts, meta = _views(batch, at)
    text_z = text_logits(texts, model["table"][:, 0].astype(np.float64), float(model["bias"][0]))
    ta, tb, ma, mb = model["cal"]
    return np.column_stack([text_z * ta + tb, (meta * model["meta"]).sum(1) * ma + mb])


def combine(model: dict, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    z = model["w"][0] * text / 4 + model["w"][1] * meta / 4 + model["w"][2]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


MADE = ("text_score", "meta_score", "quality_score", "accepted")


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with text_score, meta_score, quality_score (0 to 1) and accepted."""
    docs = docs.drop(*MADE)
    names = docs.columns
    at = [names.index(c) for c in ("text", "lang", "source", "n_chars")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["text_score double", "meta_score double", "quality_score double", "accepted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model is None or not n:
                ones = pa.array(np.ones(n), pa.float64())
                yield pa.record_batch([*batch.columns, ones, ones, ones, pa.array([True] * n, pa.bool_())], [*names, *MADE])
                continue
            z = view_logits(batch, at, model)
            s = combine(model, z[:, 0], z[:, 1])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch([*batch.columns, *(pa.array(x, pa.float64()) for x in (p[:, 0], p[:, 1], s)), pa.array(s >= model["cut"], pa.bool_())], [*names, *MADE])

    return map_batches(docs, run, schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text", "lang", "source", "n_chars"), model).select("doc_id", "text_score", "meta_score", "quality_score", "accepted")


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLE: dict[str, str] = {}
