"""Small rules: landed records, paths, selectors, policies, statistics and trees, each on a few rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.operators import retrieval as R
from docstrata.operators import routes
from docstrata.operators import store as S
from docstrata.sources import scan

T0 = dt.datetime(2024, 1, 1)


def at(n):
    return T0 + dt.timedelta(hours=n)


@pytest.fixture
def one(spark):
    return lambda *columns: list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def lit(*texts):
    return [F.lit(t) for t in texts]


def test_landed_issues(spark):
    schema = "number long, pull_request string, state string, updated_at string"
    landed = spark.createDataFrame([(1, None, "open", "2024-01-01T00:00:01Z"), (2, "{}", "closed", "2024-01-02T00:00:00Z"), (3, "{}", "open", None)], schema)
    numbers = lambda **x: sorted(r.number for r in scan.issues(landed, **x).collect())
    assert numbers() == [1, 2, 3] and numbers(kind="pulls") == [2, 3] and numbers(kind="issues", state="closed") == [] and numbers(state="open") == [1, 3]
    assert {r.number: r.mtime_ms for r in scan.issues(landed).collect()} == {1: 1704067201000, 2: 1704153600000, 3: None}


def test_team_notes_and_golden(spark, tmp_path):
    projects = spark.createDataFrame([("p1", "A"), ("p1", "A"), ("p2", "B")], "project_id string, name string")
    items = spark.createDataFrame([("ENG-1",), ("ENG-2",)], "identifier string")
    assert sorted((r.project_id or "", r.identifier or "") for r in scan.team(projects, items).collect()) == [("", "ENG-1"), ("", "ENG-2"), ("p1", ""), ("p2", "")]
    table = spark.createDataFrame([("Home", "Work", "Plan A"), ("Home", "Work/Deep", "b"), ("Other", "Work", "c"), ("Home", "Recently Deleted", "d")], "account string, folder string, title string")
    paths = lambda *x: sorted(r.logical_path for r in scan.notes(table, *x).collect())
    assert paths() == ["apple-notes/home/work/deep/b.md", "apple-notes/home/work/plan-a.md", "apple-notes/other/work/c.md"]
    assert paths("Home", "Work") == ["apple-notes/home/work/plan-a.md"] and paths("*", "Recently Deleted") == ["apple-notes/home/recently-deleted/d.md"]
    (tmp_path / "golden.json").write_text(json.dumps([{"query": "q", "expect": "a.md", "kind": "fact", "answer": "x", "more": 1}, {"query": "r", "expect": "b.md", "kind": "fact"}]))
    assert sorted(tuple(r) for r in scan.golden(spark, str(tmp_path / "golden.json")).collect()) == [("q", "a.md", "fact", "x"), ("r", "b.md", "fact", None)]
    both = scan.together([scan.inline(spark, [("a", "x")]), spark.createDataFrame([("b", 1)], "logical_path string, n int")])
    assert {r.logical_path: (r.content, r.source_type, r.n) for r in both.collect()} == {"a": ("x", "inline", None), "b": (None, None, 1)}


def test_paths_keys_and_templates(one):
    none = F.lit(None).cast("string")
    assert one(T.pick_path(none, *lit("/r/a.md", "a.md", True)), T.pick_path(*lit("in/", "/r/x/a.md", "x/a.md", True)), T.pick_path(*lit("\\in\\one.md", "/r/a.md", "a.md", False))) == ["r/a.md", "in/x/a.md", "in/one.md"]
    version = F.lit(dt.datetime(2024, 1, 2, 3, 4, 5, 678_901)).cast("timestamp_ntz")
    assert one(T.version_text(version), T.row_key(F.lit("a/b"), version, F.lit(3))) == ["2024-01-02T03:04:05.678Z", "a/b::2024-01-02T03:04:05.678Z::3"]
    assert one(T.disambiguate(*lit("a/b.tar.gz", "0123456789")), T.disambiguate(*lit("a/b", "xyz"))) == ["a/b.tar-01234567.gz", "a/b-xyz"]
    assert one(T.project_id(F.lit("my-plan-abcdef12")), T.project_id(F.lit("short-12"))) == ["abcdef12", "short-12"]
    assert one(scan.args_field(*[F.lit('{"owner": "o", "n": 3}'), "n"]), scan.args_field(F.lit("broken"), "n")) == ["3", None]
    assert one(T.substitute(F.lit("hi {name}, {x}"), {"name": F.lit("Bo"), "x": none})) == ["hi Bo, "]
    with pytest.raises(Exception, match="unknown variable"):
        one(T.substitute(F.lit("hi {who}"), {}))
    assert one(T.blob_state(none, none), T.blob_state(F.lit("s"), none), T.blob_state(*lit("s", "b")), T.query_text(*lit("q"), "find: "), T.base64_bytes(F.lit(b"xyz"))) == ["none", "skipped", "available", "find: q", "eHl6"]
    assert one(T.breadcrumb(F.array(*lit(" a ", "", "b"))), T.round4(F.lit(0.123456)), T.sigmoid(F.lit(0.0))) == ["a > b", 0.1235, 0.5]


def test_selectors_and_rules(spark, one):
    got = one(*[routes.parse_selector(F.lit(x)) for x in ("o/r", "o/r#pulls", "o", "o/r#x")])
    assert [tuple(x) for x in got[:2]] == [("o", "r", "all", None), ("o", "r", "pulls", None)] and [x.error for x in got[2:]] == ["invalid selector: o", "invalid selector: o/r#x"]
    rules = [routes.Rule("a", "^x"), routes.Rule("b", "^y", post_process="docmd")]
    assert [tuple(r) for r in routes.registry(spark, rules).orderBy("priority").collect()] == [(0, "a", "^x", "text/html", "passthrough"), (1, "b", "^y", "text/html", "docmd")]
    for bad in ([routes.Rule("a", "x"), routes.Rule("a", "y")], [routes.Rule("A b", "x")], [routes.Rule("a", "x", post_process="none")]):
        with pytest.raises(ValueError):
            routes.validate(bad)
    files = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "downloader string")
    assert {r.downloader: r.n for r in routes.references(files).collect()} == {"a": 2, "b": 1}


FILES = "logical_path string, version_id timestamp_ntz, tombstone boolean, blob_sha256 string, source_mtime_ms long, size_bytes long, source_type string, mime_type string, last_refresh_status string, refresh_frequency_sec int, refreshed_at timestamp_ntz"


@pytest.fixture
def files(spark):
    return spark.createDataFrame([
        ("docs/a.md", at(0), False, "s1", 5, 10, "local", "text/markdown", "ok", 60, at(0)), ("docs/a.md", at(1), False, "s2", 6, 20, "local", "text/markdown", "failed:x", 60, at(1)), ("docs/sub/b.md", at(1), False, "s3", None, 30, "inline", "text/html", None, None, None),
        ("docsx", at(2), False, "s1", 7, 40, "remote", "text/html", "unchanged", None, None), ("gone", at(0), False, "s4", 1, 1, "local", "text/html", None, None, None), ("gone", at(3), True, None, None, None, None, None, None, None, None),
    ], FILES)


def test_views_of_versions(spark, files):
    assert sorted(r.logical_path for r in files.filter(S.under(F.col("logical_path"), "docs/")).select("logical_path").distinct().collect()) == ["docs/a.md", "docs/sub/b.md"]
    blobs = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s5",)], "sha256 string")
    assert sorted(r.sha256 for r in S.blobs_under(blobs, files, "docs/").collect()) == ["s1", "s2", "s3"] and [r.sha256 for r in S.orphan_blobs(blobs, files).collect()] == ["s5"] and S.collect_garbage(blobs, files).count() == 3
    chunks = files.select("logical_path", "version_id")
    assert S.delete_chunks(chunks, files.filter("logical_path = 'gone'")).count() == 4 and S.orphan_chunks_removed(chunks, files.filter("not tombstone")).count() == 5 and S.current_chunks(chunks, files).count() == 3
    entries = spark.createDataFrame([("docs/a.md", 6), ("docs/sub/b.md", None), ("docsx", 8), ("new", 1)], "logical_path string, source_mtime_ms long")
    assert {r.logical_path: r.unchanged for r in S.probe_unchanged(entries, S.current(files)).collect()} == {"docs/a.md": True, "docs/sub/b.md": False, "docsx": False, "new": False}
    assert {r.logical_path: r.collides for r in S.collisions(entries.union(entries.limit(1))).collect()}["docs/a.md"] and not {r.logical_path: r.collides for r in S.collisions(entries).collect()}["new"]


def test_logs_and_meta(spark, files):
    log = spark.createDataFrame([("a", at(0), at(1), "ok"), ("a", at(0), at(3), "unchanged"), ("b", at(0), at(2), "failed:x")], "logical_path string, version_id timestamp_ntz, refreshed_at timestamp_ntz, status string")
    assert {r.logical_path: r.status for r in S.latest_status(log).collect()} == {"a": "unchanged", "b": "failed:x"} and tuple(S.outcomes(log).first()) == (1, 1, 1)
    meta = spark.createDataFrame([("embedding_revision", "r1", at(0)), ("embedding_revision", "r2", at(2)), ("other", "x", at(9))], "key string, value string, updated_at timestamp_ntz")
    assert {r.key: r.value for r in S.latest_meta(meta).collect()} == {"embedding_revision": "r2", "other": "x"}
    assert S.stale_revision(meta, "r2").first().stale is False and S.stale_revision(meta, "r3").first().stale is True


def test_report_by_prefix(spark, files):
    blobs = spark.createDataFrame([("s1", 10), ("s2", 20), ("s3", 30), ("s4", 1)], "sha256 string, size_bytes long")
    chunks = files.filter("not tombstone").select("logical_path", "version_id")
    report = lambda prefix: {(r.section, r.key): r.value for r in S.report(files, blobs, chunks, F.lit(at(9)).cast("timestamp_ntz"), prefix).collect()}
    everything, docs = report(""), report("docs/")
    assert (everything["files", "versions"], everything["blobs", "count"], everything["chunks", "current"], everything["files", "tombstoned"]) == (6, 4, 3, 1)
    assert (docs["files", "versions"], docs["files", "current_bytes"], docs["blobs", "bytes"], docs["chunks", "all"], docs["chunks", "current"], docs["refresh", "due"]) == (3, 50, 60, 3, 2, 1)
    assert docs["mime_type", "text/markdown"] == 1 and docs["last_refresh_status", "failed:x"] == 1 and ("source_type", "remote") not in docs


def test_trees(spark):
    tree = S.path_tree(spark.createDataFrame([("a/b/c",), ("a/b/d",), ("a/e",)], "logical_path string"))
    assert sorted((r.node, r.depth) for r in S.lift_children(tree, "a").collect()) == [("a/b", 1), ("a/b/c", 2), ("a/b/d", 2), ("a/e", 1)]
    assert {r.node: r.children for r in S.children(tree).collect()} == {"a": 2, "a/b": 2}


def test_vectors_of_words(one):
    """One pass of the words: the same counts as by hand, of unit length; no words, no direction."""
    some, none = one(R.hash_vector(F.lit("One two two, TWO one")), R.hash_vector(F.lit("12 !")))
    counts = {}
    for w in ["one", "two", "two", "two", "one"]:
        counts[w] = counts.get(w, 0) + 1
    assert sorted(round(x, 5) for x in some if x) == [round(2 / 13**0.5, 5), round(3 / 13**0.5, 5)] and not any(none) and len(none) == 64
    with pytest.raises(Exception, match="dimension"):
        one(R.check_dimension(F.array(F.lit(1.0).cast("float")), 2))
