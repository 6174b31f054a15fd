"""The search index that commits maintain: signed postings and sums, so that a search reads no text.

A commit adds the postings of its chunks, a row a chunk with its different words as one string and their counts, with sign 1, and of each
chunk that is no longer current a row without words, with sign -1, and one row of how many chunks and words that makes.
N, document frequencies and lengths are sums over all parts, so no part is rewritten; ``merged`` leaves out what has been
taken out.  Words that are new go to a vocabulary with their stem, so each word is stemmed once, and a search by stems looks
up the words of its stems there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.porter import stems
from . import retrieval as R
from .snapshots import PLACE, Snapshot, chosen, placed

CHUNK = ("logical_path", "version_id", "chunk_index")


def packed(chunks: DataFrame) -> DataFrame:
    """(path, version_id, chunk_index, len, terms, tfs, sign) of chunks."""
    return R.term_lists(chunks, F.col("search_text"), *CHUNK).withColumn("sign", F.lit(1))


def spread(rows: DataFrame) -> DataFrame:
    """Packed rows as a row a word.  Rows without words are of an older layout and raise: ``reindex`` builds them anew."""
    old = F.raise_error(F.lit("the search index is of an older layout: reindex the store")).cast("string")
    rows = rows.filter("len > 0").select(*CHUNK, "len", "sign", F.split(F.coalesce("terms", old), " ").alias("term"), F.col("tfs").alias("tf"))
    rows = rows.select(*CHUNK, "len", "sign", F.inline(F.arrays_zip("term", "tf")))
    return rows.select(*CHUNK, "len", "term", F.col("tf").cast("long").alias("tf"), "sign")


def postings_of(chunks: DataFrame, sign: int) -> DataFrame:
    """(path, version_id, chunk_index, len, term, tf, sign) of chunks."""
    return spread(packed(chunks).withColumn("sign", F.lit(sign)))


def deltas(base: Snapshot, added: DataFrame | None, left: DataFrame | None) -> dict[str, list[str]]:
    """Written parts of the index for chunks that become current, and for the versions (path, version_id) that no longer are:
    their postings are not read, but for the length."""
    rows = [packed(added)] if added is not None else []
    if left is not None:
        gone = base.only("postings", left, CHUNK[:2]).filter("sign > 0")
        rows.append(gone.select(*CHUNK, "len", F.lit(None).cast("string").alias("terms"), F.lit(None).cast("array<int>").alias("tfs"), F.lit(-1).alias("sign")))
    name = base.write("postings", rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1]))
    corpus = base.part("postings", name).agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("len") * F.col("sign")), F.lit(0)).alias("total_len"))
    out = {"postings": [name], "corpus": [base.write("corpus", corpus)]}
    if added is not None:
        fresh = words(base.part("postings", name).filter("sign > 0")).join(base.read("vocabulary").select("term"), "term", "left_anti")
        out["vocabulary"] = [base.write("vocabulary", stems(fresh))]
    return out


def words(rows: DataFrame) -> DataFrame:
    """The different words of packed rows, of which each batch hands on its own."""

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pc.split_pattern(batch.column(0), " ").flatten().unique()], ["term"])

    return rows.filter("len > 0").select("terms").mapInArrow(different, "term string").distinct()


def net(postings: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The postings of current chunks, a row a word, without the chunks that were taken out; of asked words (term, and what else
    is said of each) alone."""
    rows = postings.filter("sign > 0")
    rows = rows if "term" in rows.columns else spread(rows)
    rows = rows if asked is None else rows.join(asked, "term")
    return rows.join(postings.filter("sign < 0").select(*CHUNK), list(CHUNK), "left_anti")


def merged(now: Snapshot) -> dict[str, DataFrame]:
    """The index without what was taken out; only the keys of chunks are shuffled."""
    rows = placed(now.read("postings"))
    gone = rows.filter("sign > 0").select(*CHUNK, *PLACE).join(rows.filter("sign < 0").select(*CHUNK), list(CHUNK), "left_semi")
    corpus = now.read("corpus").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total_len"), F.lit(0)).alias("total_len"))
    return {"postings": chosen(rows.filter("sign > 0"), gone, but=True), "corpus": corpus}


def search(now: Snapshot, queries: DataFrame, k: int = 10, prefix: str = "", by_stem: bool = False) -> DataFrame:
    """(query_id, path, version_id, chunk_index, score, rank) of queries (query_id, query) over the current chunks.  With a
    prefix, only chunks of paths below it are ranked; the statistics stay those of all chunks.  by_stem compares stems, a
    chunk's words of one stem being one term."""
    terms = R.query_terms(queries)
    if by_stem:
        terms = terms.join(stems(terms), "term").select("query_id", F.col("stem").alias("term")).distinct()
        asked = now.read("vocabulary").join(terms.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi")
        found = net(now.read("postings"), asked).drop("term").withColumnRenamed("stem", "term")
    else:
        found = net(now.read("postings"), terms.select("term").distinct())
    corpus = now.read("corpus").agg(F.sum("n").alias("n"), (F.sum("total_len") / F.sum("n")).alias("avg_len"))
    kept = (lambda c: c["logical_path"].startswith(prefix)) if prefix else None
    hits = found.select(F.struct(*CHUNK).alias("key"), "len", "term", "tf")
    return R.ranked(hits, corpus, terms, k, "key", kept).select("query_id", "key.*", "score", "rank")
