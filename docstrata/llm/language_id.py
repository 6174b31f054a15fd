"""Language identification by averaged hashed subword embeddings.

Fitting takes different labelled texts of every language, the least by a seeded hash: ``SAMPLE`` of each, or fewer where
all languages together would pass ``TOTAL``, but one at least.  They are chosen by hashes alone, copies of a text being
one; tasks read the chosen texts whole and turn each into a bag of n-gram shares, which is all that the driver gets.  A
fifth of them calibrates: a temperature is fitted to the held texts' logits, and a text is accepted if its calibrated
probability is at least the cut-off that rejects ``REJECT`` of the held texts rightly told.
Prediction reads whole texts and nothing but texts.

Cases: null text, or text without a letter, is ``und`` with score 0; a null lang is not learned from; with no labelled
text every row is ``und``; a tie between languages goes to the first by name; repeated rows are predicted alike, and a
text labelled with two languages counts for both; a very long text is a bag like any other; other columns are carried
along, but those named like the new ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, map_batches, utf8_rows, written
from .subword import bag, bag_logits, grams, logits_of, pack, softmax, train, unpack

SAMPLE, TOTAL = 600, 20_000
BUCKETS, DIM = 1 << 15, 12
SIZES = (2, 3, 4)
REJECT = 0.01
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sample(labelled: DataFrame, seed: int) -> DataFrame:
    """(lang, h, bag) of the labelled (text, lang) to learn from, one row for each different text of a language."""
    labelled = labelled.filter("text is not null and lang is not null and text rlike '\\\\p{L}'").select("lang", "text", F.xxhash64("text", F.lit(seed)).alias("h"))
    texts = written(labelled.select("lang", "h").distinct(), "texts")
    counts = written(texts.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    size = max(1, min(SAMPLE, TOTAL // max(1, counts.count())))
    # A cut by another hash, at more than the sample's share, bounds what is ranked; what it leaves is never too few.
    cut = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 30)) <= (4 * size + 64) / F.col("n") * (1 << 30)
    few = texts.join(_small(counts), "lang").filter(cut)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    chosen = written(few.select("lang", "h", rank.alias("r")).filter(F.col("r") <= size).drop("r"), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            out = []
            for lang, h, buf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_rows(batch.column(2)), strict=True):
                if (lang, h) not in seen:
                    seen.add((lang, h))
                    out.append((lang, h, pack(bag(grams(buf, BUCKETS, SIZES)[1], BUCKETS))))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["lang", "h", "bag"])

    picked = labelled.join(_small(chosen), ["lang", "h"]).select("lang", "h", "text")
    return map_batches(picked, run, "lang string, h long, bag binary").dropDuplicates(["lang", "h"])


def fit(labelled: DataFrame, seed: int = 5) -> dict | None:
    """labelled: (text, lang)."""
    rows = sorted(sample(labelled, seed).toArrow().to_pylist(), key=lambda r: (r["lang"], r["h"]))
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    bags, y = [unpack(r["bag"]) for r in rows], np.array([place[r["lang"]] for r in rows])
    held = np.random.default_rng(seed).random(len(y)) < 0.2
    fit_on = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    model = train(lambda i: bags[fit_on[i]], y[fit_on], len(langs), BUCKETS, DIM, epochs=6, rate=20.0, seed=seed)
    table, at = model.table(), np.flatnonzero(held)
    heat, cut = 1.0, 0.0
    if len(at):
        z = np.array([logits_of(bags[i], table, model.bias) for i in at])
        loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(at)), y[at]], 1e-12)).mean()
        heat = min((0.25 * 1.2**i for i in range(20)), key=loss)
        p = softmax(z / heat)
        right = p.argmax(axis=1) == y[at]
        if right.any():
            cut = float(np.quantile(p.max(axis=1)[right], REJECT))
    return {"langs": langs, "table": table, "bias": model.bias, "heat": heat, "cut": cut}


def has_letter(buf: np.ndarray) -> bool:
    if ((buf | 32) >= 97).any() and (((buf | 32) >= 97) & ((buf | 32) <= 122)).any():
        return True
    return bool((buf >= 128).any()) and any(c.isalpha() for c in buf.tobytes().decode("utf-8", "ignore"))


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with lang_pred, score and accepted."""
    docs = docs.drop("lang_pred", "score", "accepted")
    names = docs.columns
    at = names.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string", "score double", "accepted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for buf in utf8_rows(batch.column(at)):
                if model is None or buf is None or not has_letter(buf):
                    lang.append("und")
                    score.append(0.0)
                    continue
                p = softmax(bag_logits(grams(buf, BUCKETS, SIZES)[1], model["table"], model["bias"]) / model["heat"])
                lang.append(model["langs"][int(p.argmax())])
                score.append(float(p.max()))
            ok = [w != "und" and s >= model["cut"] for w, s in zip(lang, score, strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], [*names, "lang_pred", "score", "accepted"])

    return map_batches(docs, run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = fit(docs.filter(~held).select("text", "lang"))
    return predict(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


QUERIES = {"op6_language_id": op6_language_id}
ORACLE: dict[str, str] = {}
