"""The corpus pipeline: each stage's rows are written as Parquet and read again as the next stage's docs.

A stage takes documents with any of their columns null, and with further columns, which it drops; it works on all that
it is given, copies and repeated rows included, as its operator says.  With an empty table every stage is empty;
without labels nothing is rejected for quality but by the fixed rules; null and empty texts fail those.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm import byte_bpe, cotraining, jaccard_join, mixing, quality_rules
from docstrata.llm.common import emptied, recorded, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    docs = _columns(docs)
    model = cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(cotraining.score(docs, model).filter("accepted"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _columns(quality_rules.judge(_columns(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group of near copies (five words, 0.8)."""
    return _columns(jaccard_join.keep_one(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return _columns(mixing.mix(_columns(docs)))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, and whether they decode to the text, which is told by its digest."""
    vocabulary = byte_bpe.public_vocabulary()
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    coded = byte_bpe.encode(docs.select("doc_id", "source", "text", digest.alias("digest")), *vocabulary, keep_text=False)
    exact = F.sha2("decoded", 256) == F.col("digest")
    return byte_bpe.decode(coded, *vocabulary).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_rules),
    ("jaccard_join", join_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path, made = f"{where}/{k}-{name}", []
        with recorded(made):
            stage(spark, docs, sf_dir).write.parquet(path)
        emptied(spark, made)  # the stage's own large tables: what it returned has been written
        docs = spark.read.parquet(path)
    return docs


ORACLE_SQL = None
