"""Retrieval for batches of queries: BM25, exact cosine, reciprocal-rank fusion, diversity, rerank, evaluation.

A batch of queries is the caller's and small; its terms and vectors are broadcast after a check of their number.  All
other data stays partitioned by document, and each query keeps ``depth`` candidates: scores are made and cut to these in
tasks that hold whole documents, so that pairs of queries and documents are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from ..functions.text import make_snippet, snippet_terms
from ..session import shared_dir
from .chunks import slices
from .store import current_chunks

K1, B = 1.2, 0.75
MAX_QUERIES = 100_000
MAX_HITS = 1_000_000  # rows of a few numbers each


def candidate_depth(limit: int) -> int:
    return min(50, max(3 * limit, 20))


def _small(queries: DataFrame) -> DataFrame:
    """Broadcast hint for a batch of queries within its bound."""
    return F.broadcast(queries) if queries.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES else queries


def _bounded(hits: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """Broadcast hint for at most depth hits of each query.  The queries are counted, not the hits, which would be
    computed twice."""
    return F.broadcast(hits) if queries.limit(MAX_HITS // depth + 1).count() <= MAX_HITS // depth else hits


def tokens(text: Column, pattern: str = "[^a-z]+") -> Column:
    return F.array_remove(F.split(F.lower(text), pattern), "")


def term_counts(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep..., len, term, tf): how often each word of a text is in it.  Words are counted in place, so nothing is shuffled; rows
    alike in keep are not added up."""
    rows = rows.select(*keep, F.lower(text).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_postings(list(keep)), f"{kept}, len int, term string, tf long")


def _postings(names: list[str]):
    """Batches of (keys..., text), lower-cased, to (keys..., len, term, tf)."""

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, row, tf, _, size = _counted_words(batch, len(names))
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(names)]), pa.array(size[row].astype(np.int32)), words, pa.array(tf)], [*names, "len", "term", "tf"])

    return _by_slices(counts, len(names))


def term_lists(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep..., len, terms, tfs): the same as ``term_counts``, a row a text, which may have no word; terms are one string."""
    rows = rows.select(*keep, F.lower(text).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def lists(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, _, tf, first, size = _counted_words(batch, len(keep))
        terms, tfs = (pa.ListArray.from_arrays(pa.array(first), x) for x in (words, pa.array(tf.astype(np.int32))))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(size.astype(np.int32)), pc.binary_join(terms, " "), tfs], [*keep, "len", "terms", "tfs"])

    return rows.mapInArrow(_by_slices(lists, len(keep)), f"{kept}, len int, terms string, tfs array<int>")


def _words(batch: pa.RecordBatch, column: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of lower-cased texts, the row of each, and how many a row has.  Words are runs of the bytes a to z, as no
    other character has such a byte."""
    text = pc.fill_null(batch.column(column).cast(pa.string()), "")
    _, ends, data = text.buffers()
    ends = np.frombuffer(ends, np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    letter = (data >= ord("a")) & (data <= ord("z"))
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begin = ends[:-1][ends[:-1] < len(data)]
    first[begin] = letter[begin]  # a text does not go on with the word of the one before it
    starts = np.flatnonzero(first)
    size = np.diff(np.searchsorted(starts, ends))
    letters = np.cumsum(letter, dtype=np.int32)  # up to each byte, itself included
    offsets = np.append(letters[starts] - 1, letters[-1:] if len(starts) else 0).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[letter]))
    return words, np.repeat(np.arange(len(text)), size), size


def _counted_words(batch: pa.RecordBatch, column: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each different word of a text (its word, row and count), sorted by row; a row's first, and the rows' sizes."""
    words, row, size = _words(batch, column)
    found = words.dictionary_encode()
    n = max(1, len(found.dictionary))
    pair, tf = np.unique(row * n + found.indices.to_numpy(), return_counts=True)
    first = np.searchsorted(pair, np.arange(len(size) + 1) * n).astype(np.int32)
    return found.dictionary.take(pa.array(pair % n)), pair // n, tf, first, size


def _by_slices(counts: Callable[[pa.RecordBatch], pa.RecordBatch], column: int):
    """counts of each batch in slices of about 1 MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for part in slices(batch.column(column)):
                if len(part):
                    yield counts(batch.slice(begin, len(part)))
                begin += len(part)

    return run


def term_statistics(docs: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Postings (key, len, term, tf) and corpus statistics (n, avg_len), for a maintained index.  Postings of rows alike in
    key are added up by a search."""
    return term_counts(docs, F.col("text"), key), docs.agg(F.count("*").alias("n"), _mean_length())


def statistics_of(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """The corpus statistics of docs whose postings have been written: no text is split again."""
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    return docs.agg(F.count("*").alias("n"), F.count("text").alias("texts")).crossJoin(total).select("n", F.try_divide("total", "texts").alias("avg_len"))


def _mean_length() -> Column:
    return F.avg(F.regexp_count(F.lower("text"), F.lit("[a-z]+"))).alias("avg_len")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "key", stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, key, score, rank) of docs (key, text) for queries (query_id, query).  stem is an optional function of
    a word, used on both sides."""
    words = (lambda c: F.transform(tokens(c), stem)) if stem else tokens
    terms = _small(queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term")))
    asked = _asked(terms)
    if asked and not stem:
        return _counted(docs, asked, terms, k, key)
    tok = docs.select(key, words(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    corpus = docs.agg(F.count("*").alias("n"), _mean_length())
    hits = tok.select(key, "len", F.explode("t").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    return ranked(hits.groupBy(key, "len", "term").agg(F.count("*").alias("tf")), corpus, terms, k, key)


def _asked(terms: DataFrame) -> list:
    """The pairs of a query and its term; none if they are more than go along with a pass."""
    asked = terms.select("query_id", "term").limit(MAX_QUERIES + 1).collect()
    return asked if len(asked) <= MAX_QUERIES else []


def _counted(docs: DataFrame, asked: list, terms: DataFrame, k: int, key: str) -> DataFrame:
    """Texts are read once: their length and the counts of the asked words are written, a row a text, and nothing is shuffled
    but keys.  Only if keys are repeated are hits dealt by key, to be added up."""
    spark, fields = docs.sparkSession, _fields(docs, key)
    words, names = sorted({r["term"] for r in asked}), [name for name, *_ in fields]
    where = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    texts = docs.select(*[c.alias(name) for name, c, *_ in fields], F.lower("text").alias("text"))
    schema = ", ".join([*(f"{name} {kind}" for name, _, kind, _ in fields), "len long, t array<int>, tf array<long>"])
    texts.mapInArrow(_word_counts(words, names), schema).write.parquet(where)
    rows = spark.read.parquet(where)
    corpus = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    whole = _key(fields, docs.schema[key].dataType, key)
    if not rows.groupBy(*names).count().filter("count > 1").isEmpty():
        spelled = F.broadcast(spark.createDataFrame(list(enumerate(words)), "t int, term string"))
        hits = rows.select(whole, "len", F.explode(F.arrays_zip("t", "tf")).alias("x")).select(key, "len", "x.t", "x.tf").join(spelled, "t").drop("t")
        return ranked(hits, corpus, terms, k, key)
    own = rows.filter(F.size("t") > 0).select(*names, "t", F.array_repeat("len", F.size("t")).alias("len"), "tf")
    return _scores(own, rows.select(F.explode("t").alias("t")), corpus, asked, words, terms, k, key, fields, docs.schema[key].dataType)


def _word_counts(words: list[str], names: list[str]):
    """Batches of (keys..., text), lower-cased, to (keys..., len, t, tf): how many words a text has, and the places of those of
    words that are in it with their counts."""

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(len(names))
        flat, row, size = _words(batch, len(names))
        place = pc.fill_null(pc.index_in(flat, value_set=pa.array(words, flat.type)), -1).to_numpy(zero_copy_only=False)
        pair, tf = np.unique(row[place >= 0] * len(words) + place[place >= 0], return_counts=True)
        ends = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(words)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((pair % len(words)).astype(np.int32), tf.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(size.astype(np.int64), mask=text.is_null().to_numpy(zero_copy_only=False)), *lists], [*names, "len", "t", "tf"])

    return _by_slices(counts, len(names))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): each query's different words."""
    return _small(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")))


def bm25_of_index(postings: DataFrame, corpus: DataFrame, queries: DataFrame, k: int = 10, key: str = "key") -> DataFrame:
    """The same from a stored index (see ``term_statistics``): no text is read."""
    terms = query_terms(queries)
    return ranked(postings.join(terms.select("term").distinct(), "term", "left_semi"), corpus, terms, k, key)


def ranked(hits: DataFrame, corpus: DataFrame, terms: DataFrame, k: int, key: str, kept: Callable[[Column], Column] | None = None) -> DataFrame:
    """Scores from the postings (key, len, term, tf) of the queries' terms (query_id, term) alone.  kept says which keys
    are ranked; all count in the document frequencies.  Hits of one key and length are added up.  They are dealt by key once
    and written, a row a key; a task scores whole keys against all queries and hands on its best k of each.  Terms beyond
    MAX_QUERIES are joined instead."""
    asked = _asked(terms)
    if not asked:
        return _joined(hits.groupBy(key, "len", "term").agg(F.sum("tf").alias("tf")), corpus, terms, k, key, kept)
    spark, where = hits.sparkSession, f"{shared_dir(hits.sparkSession)}/hits-{uuid.uuid4().hex}"
    words = sorted({r["term"] for r in asked})
    fields = _fields(hits, key)
    numbered = F.broadcast(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, t int"))
    rows = hits.join(numbered, "term").select(key, "len", "t", "tf").repartition(key).groupBy(key, "len", "t").agg(F.sum("tf").alias("tf"))
    rows.groupBy(key).agg(F.collect_list(F.struct("t", "len", "tf")).alias("h")).write.parquet(where)
    rows = spark.read.parquet(where)
    found = rows.filter(kept(F.col(key))) if kept else rows
    own = found.select(*[c.alias(name) for name, c, *_ in fields], F.col("h.t").alias("t"), F.col("h.len").alias("len"), F.col("h.tf").alias("tf"))
    return _scores(own, rows.select(F.explode("h.t").alias("t")), corpus, asked, words, terms, k, key, fields, hits.schema[key].dataType)


def _scores(own: DataFrame, held: DataFrame, corpus: DataFrame, asked: list, words: list[str], terms: DataFrame, k: int, key: str, fields: list, kind: DataType) -> DataFrame:
    """The best k of each query of own (keys..., t, len, tf: arrays of a row a key); held has a row (t) for each key and word."""
    spark, ids = own.sparkSession, list(dict.fromkeys(r["query_id"] for r in asked))
    place, number = {w: i for i, w in enumerate(words)}, {q: i for i, q in enumerate(ids)}
    counted, (n, avg_len) = np.zeros(len(words)), corpus.select("n", "avg_len").first()
    for r in held.groupBy("t").agg(F.count("*").alias("df")).collect():  # at most a row a term
        counted[r["t"]] = r["df"]
    of = sorted((place[r["term"]], number[r["query_id"]]) for r in asked)
    names = [name for name, *_ in fields]
    scores = own.mapInArrow(_scored(np.array(of, dtype=np.int64), np.log(1 + (n - counted + 0.5) / (counted + 0.5)), float(avg_len or 0), len(ids), k, names), _hit_schema(fields))
    numbered = spark.createDataFrame([(i, q) for i, q in enumerate(ids)], StructType([StructField("query", IntegerType()), terms.schema["query_id"]]))
    return top_k(scores.join(F.broadcast(numbered), "query").select("query_id", _key(fields, kind, key), "score"), k, key)


def _scored(of: np.ndarray, idf: np.ndarray, avg_len: float, queries: int, k: int, names: list[str]):
    """Batches of (keys..., t, len, tf), a row a key, to the best k of each query.  of is the sorted pairs of a term and a query
    that asks for it."""
    first, asked = np.searchsorted(of[:, 0], np.arange(len(idf))), np.bincount(of[:, 0], minlength=len(idf))
    step = max(1, PAIRS // queries)

    def hits(batch: pa.RecordBatch) -> pa.Table:
        t, length, tf = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[len(names) :])
        part = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))
        row, times = np.repeat(np.arange(batch.num_rows), batch.column(len(names)).value_lengths().to_numpy(zero_copy_only=False)), asked[t]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        cell = of[np.repeat(first[t], times) + within, 1] * batch.num_rows + np.repeat(row, times)
        size = queries * batch.num_rows
        scores = rounded(np.bincount(cell, np.repeat(part, times), size))
        scores[np.bincount(cell, minlength=size) == 0] = -np.inf
        return _least(scores.reshape(queries, batch.num_rows), batch, k, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _kept((hits(b.slice(i, step)) for b in batches for i in range(0, b.num_rows, step)), queries, k, names)

    return run


def _joined(hits: DataFrame, corpus: DataFrame, terms: DataFrame, k: int, key: str, kept: Callable[[Column], Column] | None = None) -> DataFrame:
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighed = terms.join(df, "term").crossJoin(F.broadcast(corpus))  # one row of corpus statistics
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    hits = hits.filter(kept(F.col(key))) if kept else hits
    scores = hits.join(weighed, "term").groupBy("query_id", key).agg(F.sum(part).alias("score"))
    return top_k(scores, k, key)


SUFFIXES = r"(?:ational|ization|fulness|iveness|ousness|ations?|ments?|ness|ings?|edly|ers?|ies|ed|es|ly|s)$"


def light_stem(word: Column) -> Column:
    """A light English stemmer: one common suffix off, if at least three letters stay."""
    short = F.regexp_replace(word, SUFFIXES, "")
    return F.when(F.char_length(short) >= 3, short).otherwise(word)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def check_dimension(embedding: Column, dim: int) -> Column:
    return F.when(F.size(embedding) == dim, embedding).otherwise(F.raise_error(F.lit(f"embedding is not of dimension {dim}")).cast("array<float>"))


QUERY_FLOATS = 1 << 22  # of stated queries that a pass over the vectors takes along: 32 MB
PAIRS = 1 << 22  # scores that a task holds at once


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores at 6 places, halves up by their decimal form, like ``F.round``."""
    out = np.round(scores, 6)
    half = np.argwhere(np.abs(np.abs(scores * 1e6) % 1 - 0.5) < 1e-4)
    for at in map(tuple, half):
        out[at] = float(Decimal(repr(float(scores[at]))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    return out + 0.0


def _best(table: pa.Table, k: int, names: list[str]) -> pa.Table:
    """The first k rows of each query by score, ties by key, as ``top_k`` orders them."""
    order = [("query", "ascending"), ("score", "descending"), *((n, "ascending") for n in names)]
    table = table.take(pc.sort_indices(table, order, null_placement="at_start"))
    query = table.column("query").to_numpy()
    first = np.flatnonzero(np.diff(query, prepend=-1))
    within = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return table.filter(pa.array(within < k))


def _least(scores: np.ndarray, batch: pa.RecordBatch, k: int, names: list[str]) -> pa.Table:
    """The best k rows of a batch for each query, of scores (a row a query); what has the score -inf is no hit."""
    hit = scores > -np.inf
    if scores.shape[1] > k:  # whatever ties with the k-th is left to the order by key
        hit &= scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
    query, row = np.nonzero(hit)
    found = {n: c.take(pa.array(row)) for n, c in zip(names, batch.columns, strict=False)}
    return _best(pa.table({"query": pa.array(query.astype(np.int32)), **found, "score": pa.array(scores[query, row])}), k, names)


def _kept(tables: Iterator[pa.Table], queries: int, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A task's best k of each query: what each step adds is merged."""
    held: list[pa.Table] = []
    for table in tables:
        held.append(table)
        if sum(t.num_rows for t in held) > 4 * k * queries:
            held = [_best(pa.concat_tables(held), k, names)]
    if held:
        yield from _best(pa.concat_tables(held), k, names).to_batches()


def _fields(rows: DataFrame, key: str) -> list[tuple[str, Column, str, str]]:
    """(name, column, type, label) of a key, or of the fields of one that is a struct."""
    kind = rows.schema[key].dataType
    if isinstance(kind, StructType):
        return [(f"k{i}", F.col(f"{key}.`{f.name}`"), f.dataType.simpleString(), f.name) for i, f in enumerate(kind.fields)]
    return [("k0", F.col(key), kind.simpleString(), "")]


def _key(fields: list[tuple[str, Column, str, str]], kind: DataType, key: str) -> Column:
    whole = F.struct(*[F.col(name).alias(label) for name, _, _, label in fields]) if isinstance(kind, StructType) else F.col("k0")
    return whole.alias(key)


def _hit_schema(fields: list[tuple[str, Column, str, str]]) -> str:
    return ", ".join(["query int", *(f"{name} {kind}" for name, _, kind, _ in fields), "score double"])


def _nearest(asked: np.ndarray, k: int, names: list[str]):
    """Batches of (keys..., embedding) to the best k of each query (query, keys..., score).  A batch's scores are products of
    blocks of both sides; a task keeps k hits a query, and merges what each batch adds."""
    unit = asked / np.linalg.norm(asked, axis=1, keepdims=True)
    step = max(1, PAIRS // len(asked))

    def hits(batch: pa.RecordBatch) -> pa.Table:
        vectors = batch.column(batch.num_columns - 1)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(flat) != len(vectors) * asked.shape[1]:
            raise ValueError(f"a vector is not of dimension {asked.shape[1]}")
        rows = flat.reshape(len(vectors), asked.shape[1])
        return _least(rounded(unit @ (rows / np.linalg.norm(rows, axis=1, keepdims=True)).T), batch, k, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _kept((hits(b.slice(i, step)) for b in batches for i in range(0, b.num_rows, step)), len(asked), k, names)

    return run


def semantic(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "key") -> DataFrame:
    """(query_id, key, score, rank): the stated queries (query_id, vector) against every row of vectors (key, embedding), by
    cosine.  Queries go along with a pass over the vectors in blocks of a fixed size; more of them take more passes, over
    the same partitions.  A null or zero vector is like nothing."""
    fields = _fields(vectors, key)
    length = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    own = vectors.filter(length(F.col("embedding")) > 0).select(*[c.alias(n) for n, c, _, _ in fields], F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.filter(length(F.col("vector")) > 0).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    n, dim = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n * (dim or 1) // QUERY_FLOATS))
    parts = []
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect() if n else []
        if not mine:
            continue
        numbered = queries.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(mine)], StructType([StructField("query", IntegerType()), asked.schema["query_id"]]))
        found = own.mapInArrow(_nearest(np.array([r["vector"] for r in mine]), k, [name for name, *_ in fields]), _hit_schema(fields))
        parts.append(found.join(F.broadcast(numbered), "query"))  # as many rows as the block has queries
    if not parts:
        return queries.select("query_id").crossJoin(vectors.select(key).limit(0)).select("query_id", key, F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return top_k(reduce(DataFrame.unionByName, parts).select("query_id", _key(fields, vectors.schema[key].dataType, key), "score"), k, key)


def top_k(scores: DataFrame, k: int, key: str = "key") -> DataFrame:
    """The best k of each query, ties by key; scores rounded to 6 places first, so that ranks are stable."""
    rows = scores.withColumn("score", F.round("score", 6))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key)))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def hash_vector(text: Column, dim: int = 64) -> Column:
    """The default vectoriser: words hashed to buckets, counted and L2-normalised."""

    @F.arrow_udf("array<float>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for buckets in batches:
            flat, size = buckets.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False)
            counts = np.bincount(np.repeat(np.arange(len(size)), size) * dim + flat, minlength=len(size) * dim).reshape(-1, dim)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            unit = (counts / np.where(norm > 0, norm, 1)).astype(np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * dim), pa.array(unit.ravel()))

    return counted(F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int")))


def fuse(sem: DataFrame, kw: DataFrame, weight: float = 0.5, k: int = 60, depth: int = 50, key: str = "key") -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists, over its best value; ties keep the semantic order first."""
    a = sem.select("query_id", key, F.col("score").alias("semantic"), F.col("rank").alias("sem_rank"))
    b = kw.select("query_id", key, F.col("score").alias("keyword"), F.col("rank").alias("kw_rank"))
    part = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    rows = a.join(b, ["query_id", key], "full_outer").withColumn("score", F.round((part(weight, "sem_rank") + part(1 - weight, "kw_rank")) * (k + 1), 6))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("kw_rank"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def diversify(hits: DataFrame, limit: int, cap: int = 3, path: str = "logical_path") -> DataFrame:
    """At most ``cap`` hits of a file first, the rest behind; unchanged where a query has no more hits than limit."""
    within = F.row_number().over(W.partitionBy("query_id", path).orderBy("rank"))
    many = F.count("*").over(W.partitionBy("query_id")) > limit
    rows = hits.withColumn("__over", many & (F.lit(cap) > 0) & (within > cap))
    order = W.partitionBy("query_id").orderBy("__over", "rank")
    return rows.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= limit).drop("__over")


def lexical_score(query: Column, text: Column) -> Column:
    """The built-in pair scorer: the share of the query's words that the text has, as a sigmoid."""
    q = F.array_distinct(tokens(query))
    share = F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1))
    return 1 / (1 + F.exp(-(share * 8 - 4)))


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """hits (query_id, query, text, rank) in the order of a pair scorer, which may be a pandas UDF."""
    rows = hits.withColumn("rerank_score", F.round(scorer(F.col("query"), F.col("text")), 6))
    return rows.withColumn("rerank_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")))


def asked(queries: DataFrame) -> DataFrame:
    """The queries; a blank one raises."""
    blank = F.raise_error(F.lit("search requires a query")).cast("string")
    return queries.withColumn("query", F.when(F.trim(F.coalesce("query", F.lit(""))) == "", blank).otherwise(F.col("query")))


def search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 10, mode: str = "hybrid", weight: float = 0.6, cap: int = 3, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """docs (key, logical_path, text), vectors (key, embedding), queries (query_id, query, vector); a row a hit.  With a
    pair scorer, the fused hits are put in its order before they are diversified."""
    depth, queries = candidate_depth(limit), asked(queries)
    key = docs.schema["key"].dataType.simpleString()
    empty = lambda: queries.select("query_id", F.lit(None).cast(key).alias("key"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).filter("false")
    sem = semantic(vectors, queries.select("query_id", "vector"), 5 * limit) if mode != "keyword" else empty()
    kw = bm25(docs.select("key", "text"), queries.select("query_id", "query"), 5 * limit) if mode != "semantic" else empty()
    fused = fuse(sem, kw, {"semantic": 1.0, "keyword": 0.0}.get(mode, weight), depth=depth)
    rows = docs.join(_bounded(fused, queries, depth), "key").join(_small(queries.select("query_id", "query")), "query_id")
    rows = diversify(reordered(rows, scorer) if scorer else rows, limit, cap)
    shown = ["rerank_score"] if scorer else []
    return rows.select("query_id", "logical_path", "key", "final_rank", "score", "semantic", "keyword", *shown, make_snippet(F.col("text"), snippet_terms(F.col("query"))).alias("snippet"))


def reordered(hits: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """hits (query_id, query, text, rank) with rerank_score, and rank by it."""
    return rerank(hits, scorer).drop("rank").withColumnRenamed("rerank_rank", "rank")


CHUNK_KEY = ("logical_path", "version_id", "chunk_index")


def search_chunks(chunks: DataFrame, files: DataFrame, queries: DataFrame, limit: int = 10, prefix: str = "", history: bool = False, **options) -> DataFrame:
    """Search over a store's chunks (path, version_id, chunk_index, search_text, embedding): those of current versions, or
    of all with history, below a path prefix.  One hit a chunk, by (path, version_id, chunk_index)."""
    rows = chunks if history else current_chunks(chunks, files)
    rows = rows.filter(F.col("logical_path").startswith(prefix)) if prefix else rows
    rows = rows.withColumn("key", F.struct(*CHUNK_KEY))
    found = search(rows.select("key", "logical_path", F.col("search_text").alias("text")), rows.select("key", "embedding"), queries, limit, **options)
    return found.select("query_id", "key.*", *[c for c in found.columns if c not in ("query_id", "key", "logical_path")])


def compare_variants(variants: dict[str, DataFrame], golden: DataFrame) -> DataFrame:
    """The metrics of each variant's hits (query_id, key, rank) over the same golden set."""
    parts = [metrics(expected_rank(hits, golden)).withColumn("variant", F.lit(name)) for name, hits in variants.items()]
    return reduce(DataFrame.unionByName, parts)


def expected_rank(hits: DataFrame, golden: DataFrame, key: str = "key") -> DataFrame:
    """golden (query_id, expected, kind, answer) with rank, 0 for a miss."""
    found = hits.select("query_id", F.col(key).alias("expected"), "rank").groupBy("query_id", "expected").agg(F.min("rank").alias("rank"))
    return golden.join(found, ["query_id", "expected"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def containing(docs: DataFrame, passages: DataFrame, key: str = "key") -> DataFrame:
    """(query_id, key) of docs (key, text) that contain a passage (query_id, passage).  Texts are read once and not shuffled: the
    passages go along.  A passage of five or more words, as single spaces part them, has its second to fourth whole in any
    text that contains it: only documents with these three in a row are compared.  Shorter ones (few) are compared with all.
    Passages beyond MAX_QUERIES are joined instead."""
    stated = passages.select("query_id", "passage").filter("passage is not null").limit(MAX_QUERIES + 1).collect()
    if len(stated) > MAX_QUERIES:
        return _containing_joined(docs, passages, key)
    spark, fields = docs.sparkSession, _fields(docs, key)
    names, different = [name for name, *_ in fields], sorted({r["passage"] for r in stated})
    number = {p: i for i, p in enumerate(different)}
    texts = docs.select(*[c.alias(name) for name, c, *_ in fields], "text")
    schema = ", ".join([*(f"{name} {kind}" for name, _, kind, _ in fields), "passage int"])
    found = texts.mapInArrow(_holding(different, names), schema)
    asked = spark.createDataFrame([(number[r["passage"]], r["query_id"]) for r in stated], StructType([StructField("passage", IntegerType()), passages.schema["query_id"]]))
    return found.join(F.broadcast(asked), "passage").select("query_id", _key(fields, docs.schema[key].dataType, key))


def _holding(passages: list[str], names: list[str]):
    """Batches of (keys..., text) to (keys..., passage), a row for each of the different passages that is in a text, by its place."""
    parts = [p.split(" ") for p in passages]
    runs = {i: tuple(w[1:4]) for i, w in enumerate(parts) if len(w) >= 5}
    words, short = sorted({w for run in runs.values() for w in run}), [i for i in range(len(passages)) if i not in runs]
    place, size = {w: k for k, w in enumerate(words)}, len(words)  # at most 3 * MAX_QUERIES: three places fit 63 bits
    coded = {i: (place[x] * size + place[y]) * size + place[z] for i, (x, y, z) in runs.items()}
    codes, of = np.unique(np.array(list(coded.values()), np.int64)), {}
    for i, code in coded.items():
        of.setdefault(code, []).append(i)

    def hits(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, found = batch.column(len(names)), []
        if size:
            split = pc.split_pattern(pc.fill_null(text, ""), " ")
            at = pc.fill_null(pc.index_in(split.flatten(), value_set=pa.array(words, text.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(text)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
            first = np.flatnonzero((at[:-2] >= 0) & (at[1:-1] >= 0) & (at[2:] >= 0) & (row[:-2] == row[2:]))
            code = (at[first] * size + at[first + 1]) * size + at[first + 2]
            known = np.isin(code, codes)
            held, read = sorted(set(zip(row[first[known]].tolist(), code[known].tolist(), strict=True))), (-1, "")
            for r, c in held:
                if read[0] != r:
                    read = r, text[r].as_py()
                found += [(r, i) for i in of[c] if read[1] is not None and passages[i] in read[1]]
        for i in short:
            held = pc.fill_null(pc.match_substring(text, passages[i]), False).to_numpy(zero_copy_only=False)
            found += [(int(r), i) for r in np.flatnonzero(held)]
        rows = pa.array([r for r, _ in found], pa.int64())
        return pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[: len(names)]), pa.array([i for _, i in found], pa.int32())], [*names, "passage"])

    return _by_slices(hits, len(names))


def _containing_joined(docs: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    parts = F.split("passage", " ")
    three = lambda t, i: F.xxhash64(F.get(t, i), F.get(t, i + 1), F.get(t, i + 2))
    long = passages.withColumn("__n", F.size(parts)).filter("__n >= 5").select("query_id", "passage", three(parts, F.lit(1)).alias("__h"))
    words = docs.select(key, F.split("text", " ").alias("__t")).filter("size(__t) >= 3")
    runs = words.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.size("__t") - 3), lambda i: three(F.col("__t"), i))).alias("__h"))
    near = runs.join(_small(long.select("query_id", "__h")), "__h").select("query_id", key).distinct().join(long.drop("__h"), "query_id")
    found = docs.select(key, "text").join(near, key).filter(F.contains("text", "passage")).select("query_id", key)
    short = passages.filter(F.size(parts) < 5)
    return found.unionByName(docs.select(key, "text").join(_small(short), F.contains("text", "passage")).select("query_id", key))


def answered(hits: DataFrame, golden: DataFrame, top: int = 3, name: str = "answered") -> DataFrame:
    """(query_id, answered) of the queries with an answer: whether it is in the text of one of the first hits (query_id, rank,
    text)."""
    rows = golden.filter("answer is not null").select("query_id", "answer").join(hits.filter(F.col("rank") <= top).select("query_id", "text"), "query_id", "left")
    return rows.groupBy("query_id").agg(F.max(F.coalesce(F.contains("text", "answer"), F.lit(False))).alias(name))


def metrics_with_answers(ranked: DataFrame, hybrid: DataFrame, semantic: DataFrame) -> DataFrame:
    """``metrics`` with n_answers and the share of them that the fused and the semantic hits answer (null without any)."""
    told = ranked.join(hybrid, "query_id", "left").join(semantic, "query_id", "left")
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(c)
    answers = told.rollup("kind").agg(F.count("answer_3").alias("n_answers"), share("answer_3"), share("semantic_answer_3")).withColumn("kind", F.coalesce("kind", F.lit("overall")))
    return metrics(ranked).join(answers, "kind")


def metrics(ranked: DataFrame) -> DataFrame:
    """recall@1, @3, @5 and MRR, overall and by kind."""
    at = lambda n: F.round(F.avg(F.when(F.col("rank").between(1, n), 1.0).otherwise(0.0)), 6).alias(f"recall_{n}")
    mrr = F.round(F.avg(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr")
    return ranked.rollup("kind").agg(F.count("*").alias("n"), at(1), at(3), at(5), mrr).withColumn("kind", F.coalesce("kind", F.lit("overall")))


def gate(measured: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """The overall figures that are below their threshold."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(t)).alias("threshold")) for m, t in thresholds.items()])
    return measured.filter("kind = 'overall'").select(F.explode(pairs).alias("x")).select("x.*").filter("value < threshold")
