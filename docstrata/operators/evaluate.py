"""Variants of chunking, vectors and reranking, measured over one golden set."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import describe, search_text
from . import retrieval as R
from .chunks import Config, chunk_documents


@dataclass(frozen=True)
class Variant:
    name: str
    chunks: Config = field(default_factory=Config)
    vector: Callable[[Column], Column] = R.hash_vector
    scorer: Callable[[Column, Column], Column] | None = None


def searchable(docs: DataFrame, variant: Variant) -> DataFrame:
    """docs (logical_path, content) as chunks (key, logical_path, text, embedding) of a variant, with derived descriptions."""
    about = docs.select("logical_path", describe(F.col("logical_path"), F.lit("text/markdown"), F.col("content")).alias("description"))
    rows = chunk_documents(docs, variant.chunks).join(about, "logical_path")
    text = search_text(F.col("logical_path"), F.col("description"), F.col("chunk_content"), F.col("context"))
    rows = rows.select(F.struct("logical_path", "chunk_index").alias("key"), "logical_path", text.alias("text"))
    return rows.withColumn("embedding", variant.vector(F.col("text")))


def measured(docs: DataFrame, golden: DataFrame, variant: Variant, where: str, limit: int = 10, weight: float = 0.6, cap: int = 3, top: int = 3) -> DataFrame:
    """recall@1, @3, @5, MRR, answer@3 of fused and of semantic hits, overall and by kind, of golden (query_id, query, expected: a
    path, kind, answer or null).  The chunks are written below where, once, as several searches read them."""
    searchable(docs, variant).write.mode("overwrite").parquet(f"{where}/{variant.name}")
    chunks = docs.sparkSession.read.parquet(f"{where}/{variant.name}")
    queries = golden.select("query_id", "query").withColumn("vector", variant.vector(F.col("query")))
    hits = R.search(chunks.select("key", "logical_path", "text"), chunks.select("key", "embedding"), queries, limit, weight=weight, cap=cap, scorer=variant.scorer)
    hits = hits.select("query_id", "logical_path", "key", F.col("final_rank").alias("rank"))
    near = R.semantic(chunks.select("key", "embedding"), queries.select("query_id", "vector"), top)
    said = lambda rows, name: R.answered(rows.filter(F.col("rank") <= top).select("query_id", "key", "rank").join(chunks.select("key", "text"), "key"), golden, top, name)
    ranked = R.expected_rank(hits, golden.select("query_id", "expected", "kind"), "logical_path")
    return R.metrics_with_answers(ranked, said(hits, "answer_3"), said(near, "semantic_answer_3")).withColumn("variant", F.lit(variant.name))


def compared(docs: DataFrame, golden: DataFrame, variants: Sequence[Variant], where: str, **options) -> DataFrame:
    return reduce(DataFrame.unionByName, [measured(docs, golden, v, where, **options) for v in variants])
