"""Views that both engines derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File versions from events."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = read(spark, sf_dir, "events").withColumn("k", k)
    return rows.select(
        F.concat(F.col("event_type"), F.lit("/user-"), F.col("user_id").cast("string"), F.lit(".md")).alias("logical_path"),
        F.col("ts").alias("version_id"), "event_id", (F.col("k") % 10 == 0).alias("tombstone"), F.floor(F.col("value") * 100).cast("long").alias("size_bytes"),
        F.element_at(F.array(F.lit("local"), F.lit("remote"), F.lit("inline")), F.col("k") % 3 + 1).alias("source_type"),
        F.concat(F.lit("type/m"), (F.col("k") % 12).cast("string")).alias("mime_type"),
        F.when(F.col("k") % 4 != 0, F.col("k") % 4 * 3600).alias("refresh_frequency_sec"), F.col("ts").alias("refreshed_at"),
    )


V_FILES = """v_files as (
  select event_type || '/user-' || user_id || '.md' as logical_path, ts as version_id, event_id, k % 10 = 0 as tombstone, cast(floor(value * 100) as bigint) as size_bytes,
         ['local', 'remote', 'inline'][k % 3 + 1] as source_type, 'type/m' || (k % 12) as mime_type, case when k % 4 <> 0 then k % 4 * 3600 end as refresh_frequency_sec, ts as refreshed_at
  from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events)),
ranked as (select *, row_number() over (partition by logical_path order by version_id desc, event_id desc) as r from v_files),
latest as (select * from ranked where r = 1),
cur as (select * from latest where not tombstone)"""


def v_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return docs.select("doc_id", path.alias("logical_path"), F.sha2("text", 256).alias("sha256"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"), "lang")


V_DOCS = """v_docs as (select doc_id, concat_ws('/', source, lang, doc_id || '.md') as logical_path, sha256(text) as sha256, text as content,
  octet_length(encode(text)) as size_bytes, lang from documents)"""


def v_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return rows.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("logical_path"), F.col("turn").alias("version_id"), F.col("text").alias("content"))


def v_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each benchmark passage: its first 60 characters, and the vector of its number."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 60).alias("query"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return items.join(vectors, "query_id")


V_GOLDEN = """golden as (select item_id as query_id, substr(b.text, 1, 60) as query, embedding as vector from benchmark b join embeddings e on vec_id = item_id)"""

BM25 = """tok as (select doc_id as key, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') as t from documents),
corpus as (select count(*) as n, avg(len(t)) as avg_len from tok),
qterms as (select query_id, unnest(list_distinct(list_filter(string_split_regex(lower(query), '[^a-z]+'), lambda x: x <> ''))) as term from golden),
posts as (select key, len, term, count(*) as tf from (select key, len(t) as len, unnest(t) as term from tok) where term in (select term from qterms) group by all),
dfs as (select term, count(*) as df from posts group by term),
bm as (select query_id, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) as score
       from posts join dfs using (term) join qterms using (term) cross join corpus group by all),
kw as (select * from (select *, row_number() over (partition by query_id order by score desc, key) as rank from bm) where rank <= 50)"""

SEM = """sem as (select * from (select *, row_number() over (partition by query_id order by score desc, key) as rank from (
  select query_id, vec_id as key, round(list_cosine_similarity(embedding::double[], vector::double[]), 6) as score from embeddings cross join golden)) where rank <= 50)"""

FUSED = """fused as (select * from (
  select *, row_number() over (partition by query_id order by score desc, sem_rank nulls last, kw_rank nulls last) as rank from (
    select coalesce(s.query_id, k.query_id) as query_id, coalesce(s.key, k.key) as key, s.score as semantic, k.score as keyword, s.rank as sem_rank, k.rank as kw_rank,
           round((coalesce(0.6::double / (60 + s.rank), 0) + coalesce((1 - 0.6::double) / (60 + k.rank), 0)) * 61, 6) as score
    from sem s full join kw k on s.query_id = k.query_id and s.key = k.key)) where rank <= 30)"""
