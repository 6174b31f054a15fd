"""How steps grow: what is shuffled, and how much of it a task holds."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest

from docstrata.llm import weighted_sampling
from docstrata.operators import chunks as C
from docstrata.operators import convert as V
from docstrata.operators import index, ingest, snapshots
from docstrata.operators import retrieval as R
from docstrata.streaming import latest
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_in_place(spark):
    """Words of a chunk are counted where it is: no word is shuffled."""
    chunks = spark.createDataFrame([("a", 1, 0, "Oak elm oak, OAK"), ("b", 1, 0, "12 !"), ("c", 1, 0, None)], "logical_path string, version_id int, chunk_index int, search_text string")
    rows = index.postings_of(chunks, -1)
    assert "Exchange" not in plan(rows)
    assert sorted((r.logical_path, r.len, r.term, r.tf, r.sign) for r in rows.collect()) == [("a", 4, "elm", 1, -1), ("a", 4, "oak", 3, -1)]


def test_scores_are_cut_in_tasks(spark):
    """Pairs of queries and documents are neither joined nor shuffled; ties go by key, and rows alike in key and length are added up."""
    docs = spark.createDataFrame([(i % 50, "oak elm" if i < 50 else "oak ash") for i in range(51)], "key long, text string").repartition(4)
    queries = spark.createDataFrame([("q", "oak"), ("r", "oak oak elm"), ("s", "none")], "query_id string, query string")
    found = R.bm25(docs, queries, 3)
    assert "MapInArrow" in plan(found)
    terms = R.query_terms(queries)
    hits, corpus = R.term_statistics(docs)
    merged = hits.groupBy("key", "len", "term").agg(F.sum("tf").alias("tf"))
    want = R._joined(merged, corpus, terms, 3, "key")
    rows = lambda df: sorted((r.query_id, r["rank"], r.key, r.score) for r in df.collect())
    assert rows(found) == rows(want) == rows(R.bm25_of_index(hits, corpus, queries, 3)) and len(rows(found)) == 6 and rows(found)[0][2] == 0


def test_a_search_reads_texts_once(spark, monkeypatch):
    """Words are counted and texts measured in one pass, and no hit is shuffled, unless a key is repeated."""
    passes, dealt, count, ranked = [], [], R._word_counts, R.ranked
    monkeypatch.setattr(R, "_word_counts", lambda *a: passes.append(1) or count(*a))
    monkeypatch.setattr(R, "ranked", lambda *a: dealt.append(1) or ranked(*a))
    texts = [(1, "Oak, oak ELM"), (2, "oak \u0130 \u212a"), (3, None), (4, ""), (5, "ash " * 3), (6, "elm" + "b" * (C.SLICE + 1)), (7, "elm")]
    docs, queries = spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([(1, "oak k"), (2, "Elm elm"), (3, "none"), (4, "...")], "query_id int, query string")
    hits, corpus = R.term_statistics(docs)
    assert R.statistics_of(docs, hits).collect() == corpus.collect() and R.statistics_of(docs.limit(0), hits.limit(0)).first().avg_len is None
    rows = lambda df: sorted((r.query_id, r["rank"], r.key, r.score) for r in df.collect())
    want = rows(R._joined(hits, corpus, R.query_terms(queries), 3, "key"))
    assert rows(R.bm25(docs, queries, 3)) == want and passes == [1] and not dealt and len(want) == 4
    R.bm25(docs.unionByName(docs), queries, 3)
    assert dealt == [1]


def test_texts_are_read_in_slices():
    """Of a large batch, a task holds the rows of few texts at once; a long text stands alone, and none is lost or moved."""
    texts = ["a" * 1000] * 3000 + [None, "b" * 3 * C.SLICE, ""]
    parts = list(C.slices(pa.array(texts)))
    assert [t for p in parts for t in p.to_pylist()] == texts and len(parts) > 4
    assert all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= C.SLICE for p in parts)
    made = list(C.by_slices(iter([pa.array(texts)]), lambda t: [(0, t)] if t else [], {"i": pa.int32(), "t": pa.string()}))
    assert len(made) == len(parts) and sum(map(len, made)) == len(texts) and max(sum(len(x["t"]) for r in m.to_pylist() for x in r) for m in made) == 3 * C.SLICE
    assert len(C.slices(pa.array([], pa.string())).__next__()) == 0


def test_latest_state_is_an_aggregate(spark, tmp_path):
    """A batch of many paths is merged by Spark's own state, not by a call of Python for each path."""
    spark.range(4).selectExpr("'a' as logical_path", "timestamp_ntz'2024-01-01' as version_id", "id as event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("logical_path string, version_id timestamp_ntz, event_id long").parquet(str(tmp_path / "in"))
    plan = latest.latest_stream(stream)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "max_by" in plan


def test_fingerprints_sample_once(spark, monkeypatch):
    """Rows without an id have a sample of their own; without such rows its long plan is not made."""
    made, sample = [], weighted_sampling.sample
    monkeypatch.setattr(weighted_sampling, "sample", lambda *a: made.append(1) or sample(*a))
    for docs, samples in (([(1, "oak elm"), (2, "ash")], 1), ([(1, "oak elm"), (None, "ash")], 2)):
        made.clear()
        rows = weighted_sampling.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), 2)
        assert len(made) == samples and rows.count() == 2


def test_rows_are_chosen_by_place(spark, tmp_path):
    """Rows are picked by bitmaps of their places, exactly, in all files and beyond the rows of one bitmap."""
    spark.range(70_000).withColumn("text", F.lit("x")).repartition(2).write.parquet(str(tmp_path / "in"))
    rows = snapshots.placed(spark.read.parquet(str(tmp_path / "in")))
    some = rows.filter("id % 3 = 0 or id in (1, 69998)").select(*snapshots.PLACE)
    got = snapshots.chosen(rows, some)
    want = {i for i in range(70_000) if i % 3 == 0 or i in (1, 69998)}
    assert {r.id for r in got.collect()} == want and got.columns == ["id", "text"]
    assert {r.id for r in snapshots.chosen(rows, some, but=True).collect()} == set(range(70_000)) - want
    assert snapshots.chosen(rows, some.limit(0)).count() == 0 and snapshots.chosen(rows, some.limit(0), but=True).count() == 70_000


def test_a_batch_shuffles_no_bytes(spark, tmp_path, monkeypatch):
    """Texts and bytes of a batch, of stored chunks and of kept blobs are neither dealt nor sorted, also where no table is small."""
    plans, write = [], snapshots.Snapshot.write
    monkeypatch.setattr(snapshots.Snapshot, "write", lambda self, table, rows: plans.append((table, plan(rows))) or write(self, table, rows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        where = str(tmp_path / "store")
        for n, (text, when) in enumerate((("oak", "2024-01-01"), ("elm", "2024-01-02"))):
            rows = spark.createDataFrame([(f"{p}.md", "text/markdown", bytearray(f"{text} {p}".encode()), p, "local", n) for p in "abb"], "logical_path string, mime_type string, bytes binary, source_path string, source_type string, source_mtime_ms long")
            ingest.ingest_batch(spark, where, n, rows, F.lit(when).cast("timestamp_ntz"))
        ingest.prune(spark, where, "prune", F.lit("2024-01-02").cast("timestamp_ntz"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [x for t, x in plans if t in ("files", "chunks", "blobs", "postings")]
    assert len(wide) > 8 and all("SortMergeJoin" not in x.split("BroadcastExchange")[0] for x in wide)
    now = snapshots.snapshot(spark, where)
    assert sorted((r.logical_path, r.content) for r in now.read("files").collect()) == [("a.md", "elm a"), ("b.md", "elm b")]
    assert now.read("blobs").count() == 2 and now.read("chunks").count() == 2
    assert sorted((r.term, r.tf) for r in index.net(now.read("postings")).collect() if r.term in ("oak", "elm")) == sorted((r.term, r.tf) for r in index.net(index.postings_of(now.read("chunks"), 1)).collect() if r.term in ("oak", "elm"))


def test_cells_are_dealt_once(spark):
    """A sheet's cells meet in one shuffle; rows and columns between them are written, also before the first and after the last."""
    cells = [("a", 3, 2, "x"), ("a", 3, 4, " y|z "), ("a", 6, 3, "w"), ("a", 9, 9, " "), ("b", 1, 1, "one"), ("b", 2, 1, "p\n q"), ("b", 2, 1, "r")]
    rows = V.cells_to_table(spark.createDataFrame([(d, "s", r, c, v) for d, r, c, v in cells], "doc string, sheet string, row int, col int, value string"))
    assert plan(rows).count("Exchange hashpartitioning") == 1
    got = {r.doc: r.markdown for r in rows.collect()}
    assert got == {"a": "| x |  | y\\|z |\n| --- | --- | --- |\n|  |  |  |\n|  |  |  |\n|  | w |  |", "b": "| one |\n| --- |\n| p q | r |"}


def test_passages_go_along_with_texts(spark):
    """Texts are read once and not shuffled to be compared with passages; the same rows as by joins, repeated and struct keys included."""
    long, gap = "one two three four five", "one  two three four"
    texts = [(1, f"x{long}y"), (2, "one two three four"), (3, None), (4, ""), (5, f"{gap} {long}"), (5, f"a {long} b {long}"), (5, "two three four"), (6, "b" * (C.SLICE + 1) + f" {long} \u00e4 \u00e4\u00e4 c d e"), (7, "%_ five")]
    docs = spark.createDataFrame(texts, "key long, text string").repartition(3)
    asked = [(1, long), (2, long), (2, "two three"), (3, gap), (4, ""), (5, None), (6, "\u00e4 \u00e4\u00e4 c d e"), (7, "_ f"), (8, "no two three four no"), (9, "e two three four f"), (1, "five")]
    passages = spark.createDataFrame(asked, "query_id int, passage string")
    found = R.containing(docs, passages)
    assert "Exchange hashpartitioning" not in plan(found) and plan(found).count("MapInArrow") == 1 and "Generate" not in plan(found)
    rows = lambda df: sorted((r.query_id, str(r.key)) for r in df.collect())
    want = sorted((q, str(k)) for k, t in texts for q, p in asked if t is not None and p is not None and p in t)
    assert rows(found) == want == rows(R._containing_joined(docs, passages, "key"))
    struct = docs.select(F.struct(F.col("key").alias("a"), F.lit("b").alias("b")).alias("key"), "text")
    assert len(rows(R.containing(struct, passages))) == len(want) and R.containing(docs, passages.limit(0)).count() == 0
    assert rows(R.containing(docs, passages.filter("query_id = 4"))) == sorted((4, str(k)) for k, t in texts if t is not None)


def test_upkeep_writes_what_changes(spark, tmp_path, monkeypatch):
    """Reindexing shuffles no text.  The index has a row a chunk, what is taken out is told without its words, and compaction leaves tables that are compact."""
    where, at = str(tmp_path / "store"), lambda n: F.lit(f"2024-01-0{n}").cast("timestamp_ntz")
    for n, text in enumerate(("oak elm oak", "ash " * 90, "12 !"), 1):
        rows = spark.createDataFrame([(f"{p}.md", "text/markdown", bytearray(f"{text}{p * (p == 'a')}".encode()), p, "local", n) for p in "abc"], "logical_path string, mime_type string, bytes binary, source_path string, source_type string, source_mtime_ms long")
        now = ingest.ingest_batch(spark, where, n, rows, at(n))
    signs = sorted((r.sign, r.version_id.day, r.terms is None) for r in now.read("postings").collect())
    assert signs == [(-1, n, True) for n in (1, 1, 1, 2, 2, 2)] + [(1, n, False) for n in (1, 1, 1, 2, 2, 2, 3, 3, 3)]
    want = lambda s: sorted((r.logical_path, r.len, r.term, r.tf) for r in index.postings_of(s.read("chunks").filter("version_id = '2024-01-03'"), 1).collect())
    assert sorted((r.logical_path, r.len, r.term, r.tf) for r in index.net(now.read("postings")).collect()) == want(now)
    merged = ingest.compact(spark, where, "compact")
    assert sorted((r.logical_path, r.len, r.term, r.tf) for r in index.net(merged.read("postings")).collect()) == want(now) and merged.read("postings").filter("sign < 0").isEmpty()
    assert merged.read("corpus").first() == (3, sum(tf for *_, tf in want(now)))
    assert ingest.compact(spark, where, "again").parts == merged.parts
    plans, write = [], snapshots.Snapshot.write
    monkeypatch.setattr(snapshots.Snapshot, "write", lambda self, table, rows: plans.append((table, plan(rows))) or write(self, table, rows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now = ingest.reindex(spark, where, "reindex", "r2", ingest.Settings(chunks=C.Config(target=40, longest=50)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("SortMergeJoin" not in x.split("BroadcastExchange")[0] for t, x in plans if t in ("chunks", "postings"))
    assert {r.version_id.day for r in now.read("postings").collect()} == {3} and {r.version_id.day for r in now.read("chunks").collect()} == {1, 2, 3}
    assert ingest.compact(spark, where, "last").parts == {**now.parts, "vocabulary": snapshots.snapshot(spark, where).parts["vocabulary"]}
    old = now.read("postings").withColumn("terms", F.lit(None).cast("string"))  # as of a store that had a row a word
    with pytest.raises(Exception, match="reindex the store"):
        index.net(old).collect()


def test_words_of_texts():
    """Words are read from the bytes of all texts at once, and none goes on in the next text."""
    texts = ["ab", "c d\u00e9e", None, "", "-f", "g\u65e5h-", "`{z", "i" * 3]
    for texts_, kind in ((texts, pa.string()), (texts[1:], pa.string()), (texts, pa.large_string()), ([], pa.string()), ([""], pa.string())):
        column = pa.array(texts, kind).slice(1) if texts_ == texts[1:] else pa.array(texts_, kind)
        found, row, size = R._words(pa.RecordBatch.from_arrays([column], ["t"]), 0)
        words = [re.findall("[a-z]+", t or "") for t in texts_]
        assert found.to_pylist() == sum(words, []) and row.tolist() == [i for i, w in enumerate(words) for _ in w] and size.tolist() == [len(w) for w in words]
