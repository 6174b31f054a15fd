import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from docstrata.functions import globs, porter
from docstrata.functions import text as T
from docstrata.operators import chunks as C
from docstrata.operators import convert as V
from docstrata.operators import evaluate as E
from docstrata.operators import index, ingest
from docstrata.operators import retrieval as R
from docstrata.operators import routes
from docstrata.operators import store as S
from docstrata.sources import scan

FILES = "logical_path string, version_id timestamp_ntz, tombstone boolean, source_type string, mime_type string, size_bytes long, downloader string, blob_sha256 string, last_refresh_status string, refresh_frequency_sec int, refreshed_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


@pytest.fixture
def files(spark):
    md = "text/markdown"
    return spark.createDataFrame(
        [
            ("docs/a.md", at(0), False, "local", md, 100, None, None, "ok", 3600, None), ("docs/a.md", at(10), False, "local", md, 110, None, None, "ok", 3600, None),
            ("docs/b.md", at(20), False, "remote", md, 200, "google-docs", "bbb", "failed", None, None), ("notes/c.md", at(30), False, "inline", md, 50, None, None, None, None, None),
            ("notes/d.md", at(40), False, "inline", md, 30, None, None, None, None, None), ("notes/d.md", at(50), True, "inline", None, None, None, None, None, None, None),
        ], FILES)


def test_stats(files):
    r = S.stats_counts(files).first()
    assert (r.current, r.tombstoned, r.versions, r.paths, r.current_bytes) == (3, 1, 6, 4, 360)
    docs = S.stats_counts(files.filter(F.col("logical_path").startswith("docs/"))).first()
    assert (docs.current, docs.versions, docs.current_bytes) == (2, 3, 310)


def test_report_and_versions(spark, files):
    blobs = spark.createDataFrame([("bbb", "application/pdf", 500, None)], "sha256 string, mime_type string, size_bytes long, bytes binary")
    chunks = spark.createDataFrame([("docs/a.md", at(10), 0), ("docs/a.md", at(0), 0)], "logical_path string, version_id timestamp_ntz, chunk_index int")
    got = {(r.section, r.key): r.value for r in S.report(files, blobs, chunks, F.lit(T0).cast("timestamp_ntz")).collect()}
    assert got["blobs", "bytes"] == 500 and got["chunks", "all"] == 2 and got["chunks", "current"] == 1 and got["refresh", "scheduled"] == 1
    assert got["last_refresh_status", "ok"] == 1 and got["last_refresh_status", "failed"] == 1
    assert [(r.ordinal, r.is_current) for r in S.version_list(files).filter("logical_path = 'notes/d.md'").orderBy("ordinal").collect()] == [(1, False), (2, True)]


def test_prune_and_blobs(spark, files):
    three = spark.createDataFrame([("p", at(0), False), ("p", at(1000), False), ("p", at(2000), False)], "logical_path string, version_id timestamp_ntz, tombstone boolean")
    cutoff = F.lit(at(1500)).cast("timestamp_ntz")
    assert S.prunable(three, cutoff).count() == 2 and S.prune(three, cutoff).count() == 1
    blobs = spark.createDataFrame([("bbb", "a/b", 10), ("ccc", "a/b", 10)], "sha256 string, mime_type string, size_bytes long")
    assert [r.sha256 for r in S.orphan_blobs(blobs, files).collect()] == ["ccc"]
    assert [r.sha256 for r in S.collect_garbage(blobs, files).collect()] == ["bbb"]


def test_move_conflict_and_guard(spark, files):
    now = S.current(files)
    moved = S.move(now, spark.createDataFrame([("docs/a.md", "docs/z.md")], "old_path string, new_path string"), F.lit(at(99)).cast("timestamp_ntz"))
    assert sorted((r.logical_path, r.tombstone) for r in moved.collect()) == [("docs/a.md", True), ("docs/z.md", False)]
    with pytest.raises(Exception, match="path exists"):
        S.move(now, spark.createDataFrame([("docs/a.md", "docs/b.md")], "old_path string, new_path string"), F.lit(at(99)).cast("timestamp_ntz")).collect()
    with pytest.raises(ValueError):
        S.remove_guard(now, now, ["**"])
    with pytest.raises(LookupError, match="folder"):
        S.remove_guard(now, now.limit(0), ["docs"])


def test_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(T.normalize_path(F.lit("\\a\\b"))) == "a/b"
    assert one(T.path_for_url(F.lit("https://Ex.org/a/b?q#f"))) == "remotes/ex.org/a/b" and one(T.path_for_url(F.lit("https://ex.org"))) == "remotes/ex.org/index"
    assert one(T.slug(F.lit("  Héllo, World! "))) == "he-llo-world" and one(T.slug(F.lit("Ünï"))) == "u-ni" and one(T.slug(F.lit("!!"))) == "untitled"
    assert one(T.disambiguate(F.lit("a/b.md"), F.lit("0123456789"))) == "a/b-01234567.md"
    assert one(T.project_id(F.lit("roadmap-0a1b2c3d"))) == "0a1b2c3d" and one(T.project_id(F.lit("roadmap"))) == "roadmap"
    assert one(T.duration_seconds(F.lit("7d"))) == 604800
    with pytest.raises(Exception, match="invalid duration"):
        one(T.duration_seconds(F.lit("7w")))
    assert one(T.truncate_at_word(F.lit("aaaa bbbb cccc"), 11)) == "aaaa bbbb…" and one(T.truncate_at_word(F.lit("aaaa"), 11)) == "aaaa"
    assert one(T.persist_reason(F.lit("image/png"), F.lit(5), 5, ["video/*"])) is None and one(T.persist_reason(F.lit("video/mp4"), F.lit(9), 5, ["video/*"])) == "mime"
    assert one(T.persist_reason(F.lit("a/b"), F.lit(6), 5)) == "size"
    assert one(T.normalize_docmd(F.lit("a\r\nb  \n\n\n\n“c”–d "))) == 'a\nb\n\n"c"-d'
    assert one(T.strip_html_blocks(F.lit("a<script>x</script>b<STYLE>\ny</STYLE>c"))) == "abc"
    assert one(T.substitute(F.lit("{a}-{b}"), {"a": F.lit("1"), "b": F.lit("2")})) == "1-2"
    with pytest.raises(Exception, match="unknown variable"):
        one(T.substitute(F.lit("{c}"), {}))
    assert one(T.title_description(F.lit("text/markdown"), F.lit("\n# A good title\nbody text"))) == "A good title — body text"
    assert one(T.mime_from_name(F.lit("X.PDF"))) == "application/pdf" and one(T.human_bytes(F.lit(2048))) == "2.0 KB"
    assert one(T.slice_lines(F.lit("a\nb\nc"), 2, 5)) == "b\nc"


@pytest.mark.parametrize("pattern,path,dot,want", [
    ("*.md", "a.md", True, True), ("*.md", "x/a.md", True, False), ("**/*.md", "x/y/a.md", True, True), ("**/*.md", "a.md", True, True), ("a?c", "abc", True, True),
    ("{a,b}/*", "b/x", True, True), ("[ab].md", "c.md", True, False), ("**/*.md", ".hid/a.md", False, False), ("**/*.md", ".hid/a.md", True, True), ("*", ".x", False, False),
])
def test_globs(pattern, path, dot, want):
    import re

    assert bool(re.search(globs.glob_regex(pattern, dot), path)) is want


def test_scan(spark, tmp_path):
    for name, text in (("a.md", "# A"), ("sub/b.txt", "b"), ("node_modules/c.md", "c"), (".git/d.md", "d")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.rel_path: r for r in scan.scan_files(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.md", "sub/b.txt"] and got["a.md"].mime_type == "text/markdown" and got["a.md"].size_bytes == 3
    assert [r.rel_path for r in scan.scan_files(spark, f"{tmp_path}/**/*.txt").collect()] == ["sub/b.txt"]
    assert scan.scan_files(spark, str(tmp_path / "a.md"), includes=["*.txt"]).count() == 0
    log = scan.parse_log(spark.createDataFrame([('{"tool": "x", "duration_ms": 2}',), ("oops",)], "value string")).collect()
    assert log[0].record.tool == "x" and log[1].raw == "oops"


def test_chunks(spark):
    text = "intro\n\n# A\nalpha\n## B\n```\n# no\n```\nbeta\n# C\n" + "\n".join(f"line {i} of a long section" for i in range(120))
    found = C.sections(text)
    assert "\n".join(s for _, _, s in found) == text and [own for _, own, _ in found] == ["", "A", "B", "C"] and found[2][0] == ["A"]
    cfg = C.Config()
    parts = C.chunk(text, cfg)
    assert all(len(c) <= cfg.longest for c, _ in parts) and any(x == "C" for _, x in parts)
    assert C.chunk("short", cfg) == [("short", "")] and C.chunk("", cfg) == [("", "")]
    rows = C.section_lines(spark.createDataFrame([("p", text)], "logical_path string, content string"))
    assert rows.agg(F.max("section")).first()[0] == 3
    long = C.chunk("x" * 5000, cfg)
    assert all(len(c) <= cfg.longest for c, _ in long)


def test_convert(spark):
    html = "<h1>T</h1><script>x</script><p>a <b>b</b> <a href='u'>l</a></p><ul><li>i</li></ul><pre>c\n d</pre>"
    got = spark.range(1).select(V.html_to_markdown(F.lit(html)).alias("x")).first().x
    assert "# T" in got and "**b**" in got and "[l](u)" in got and "-   i" in got and "```\nc\n d" in got and "x" not in got.split("\n")[0][3:]


def test_sheets(spark):
    cells = spark.createDataFrame([("d", "s", 1, 1, "h"), ("d", "s", 1, 2, "k|"), ("d", "s", 3, 2, "v"), ("d", "e", 1, 1, " "), ("d", "t", 7, 4, "a\n b"), ("d", "t", 7, 9, "z"), ("d", "t", 10, 6, "m"), ("x", "s", 1_000_000, 5, "far")], "doc string, sheet string, row int, col int, value string")
    out = {(r.doc, r.sheet): r.markdown for r in V.cells_to_table(cells).collect()}
    assert out == {
        ("d", "s"): "| h | k\\| |\n| --- | --- |\n|  |  |\n|  | v |", ("x", "s"): "| far |\n| --- |",
        ("d", "t"): "| a b |  |  |  |  | z |\n|" + " --- |" * 6 + "\n|" + "  |" * 6 + "\n|" + "  |" * 6 + "\n|  |  | m |  |  |  |",
    }


SHAPES = "doc string, slide int, position int, part int, kind string, placeholder string, level int, bullet boolean, text string, cells array<string>"


def test_slides(spark):
    shape = lambda slide, position, part, placeholder, text, bullet=False, level=0: ("d", slide, position, part, "shape", placeholder, level, bullet, text, None)
    rows = [
        shape(1, 0, 0, None, "first words"), shape(1, 1, 0, "title", "  "), shape(1, 1, 1, "title", " Deck "), shape(1, 1, 2, "title", "also used up"), shape(1, 2, 0, "body", "one\ntwo"), shape(1, 2, 1, "body", "sub", level=1), shape(1, 2, 2, "body", ""),
        shape(2, 0, 0, "body", "promoted"), shape(2, 0, 1, "body", "alone"), ("d", 2, 1, 0, "table", None, 0, None, None, ["a|b", None]), ("d", 2, 1, 1, "table", None, 0, None, None, ["c\nd", "e", "f"]), ("d", 2, 2, 0, "picture", None, 0, None, "a chart", None),
        shape(3, 0, 0, "ctrTitle", "T"), shape(3, 1, 0, None, "point", bullet=True, level=2), shape(3, 1, 1, None, "plain"), ("d", 3, 9, 0, "notes", None, 0, None, "say this", None), ("d", 3, 9, 1, "notes", None, 0, None, "then that", None),
        ("d", 4, 0, 0, "picture", None, 0, None, None, None),
    ]
    assert V.slides_to_markdown(spark.createDataFrame(rows, SHAPES)).first().markdown.split("\n\n---\n\n") == [
        "## Slide 1: Deck\n\nfirst words\n\n- one two\n  - sub",
        "## Slide 2: promoted\n\nalone\n\n| a\\|b |  |  |\n| --- | --- | --- |\n| c d | e | f |\n\n*Image:* a chart",
        "## Slide 3: T\n\n    - point\nplain\n\n### Notes\n\nsay this\nthen that",
        "## Slide 4\n\n*Image:* ",
    ]
    assert V.slides_to_markdown(spark.createDataFrame([], SHAPES)).collect() == []


def test_evaluation(spark, tmp_path):
    """answer@3 and ranks of two variants against counting by hand."""
    docs = spark.createDataFrame([(f"{w}.md", f"the {w} stone is here. " * 3) for w in ("red", "blue", "green", "grey")], "logical_path string, content string")
    golden = spark.createDataFrame([(1, "red stone", "red.md", "a", "red stone is"), (2, "blue", "blue.md", "a", None), (3, "grey stone", "green.md", "b", "nowhere")], "query_id int, query string, expected string, kind string, answer string")
    got = {(r.variant, r.kind): r for r in E.compared(docs, golden, [E.Variant("plain"), E.Variant("again", C.Config(target=30, longest=40), scorer=R.lexical_score)], str(tmp_path)).collect()}
    assert {k[1] for k in got} == {"a", "b", "overall"} and len(got) == 6
    for variant in ("plain", "again"):
        a, b, overall = (got[variant, k] for k in ("a", "b", "overall"))
        assert (a.n, a.n_answers, a.answer_3, a.recall_1) == (2, 1, 1.0, 1.0) and (b.n_answers, b.answer_3, b.recall_1) == (1, 0.0, 0.0) and (overall.n_answers, overall.answer_3) == (2, 0.5)


def test_porter():
    """Published pairs of words and stems, a few of each step."""
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
        "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "radicalli": "radic",
        "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv",
        "allowance": "allow", "gyroscopic": "gyroscop", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "homologou": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
        "controll": "control", "roll": "roll", "as": "as", "generalizations": "gener", "oscillators": "oscil", "": "",
    }
    assert {w: porter.stem(w) for w in pairs} == pairs


def test_search_by_stem(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(p, "text/plain", bytearray(t.encode()), p, "local", 0) for p, t in x], "logical_path string, mime_type string, bytes binary, source_path string, source_type string, source_mtime_ms long")
    v = lambda n: F.lit(dt.datetime(2024, 1, n)).cast("timestamp_ntz")
    where = str(tmp_path / "s")
    ingest.ingest_batch(spark, where, 0, rows(("a", "walked far"), ("b", "walls"), ("c", "running walks walking")), v(1))
    now = ingest.ingest_batch(spark, where, 1, rows(("b", "walker"), ("d", "walks home")), v(2))
    queries = spark.createDataFrame([(1, "walk"), (2, "homes runs")], "query_id int, query string")
    assert index.search(now, queries).isEmpty()
    got = {(r.query_id, r.logical_path) for r in index.search(now, queries, by_stem=True).collect()}
    assert got == {(1, "a"), (1, "c"), (1, "d"), (2, "c"), (2, "d")}
    words = {r.term: r.stem for r in now.read("vocabulary").collect()}
    assert words["walked"] == "walk" and words["walls"] == "wall" and now.read("vocabulary").count() == len(words)
    docs = S.current_chunks(now.read("chunks"), now.read("files")).select(F.col("logical_path").alias("key"), F.col("search_text").alias("text")).collect()
    stemmed = spark.createDataFrame([(r.key, " ".join(porter.stem(w) for w in re.findall("[a-z]+", r.text.lower()))) for r in docs], "key string, text string")
    want = R.bm25(stemmed, spark.createDataFrame([(1, "walk"), (2, "home run")], "query_id int, query string")).collect()
    assert sorted((r.query_id, r.logical_path, r.score) for r in index.search(now, queries, by_stem=True).collect()) == sorted((r.query_id, r.key, r.score) for r in want)


def test_vectors_by_blocks(spark, monkeypatch):
    """Exact hits whatever the blocks are, with ties by key, keys of several columns, and vectors that are like nothing."""
    rng = random.Random(2)
    rows = [(i % 7, f"k{i}", [rng.choice([0.0, 0.5, 1.0, -1.0]) for _ in range(3)]) for i in range(300)] + [(9, "zero", [0.0] * 3), (9, "null", None)]
    vectors = spark.createDataFrame(rows, "a int, b string, embedding array<float>").select(F.struct("a", "b").alias("key"), "embedding")
    asked = [(f"q{i}", [rng.choice([0.0, 1.0, -0.5]) for _ in range(3)]) for i in range(9)] + [("none", [0.0] * 3), ("null", None)]
    queries = spark.createDataFrame(asked, "query_id string, vector array<float>")
    want = []
    for q, v in asked:
        if v and any(v):
            cos = lambda e: sum(x * y for x, y in zip(v, e)) / (sum(x * x for x in v) * sum(x * x for x in e)) ** 0.5  # noqa: B023, E731
            found = sorted((-round(cos(e) + 1e-12, 6), a, b) for a, b, e in rows if e and any(e))
            want += [(q, a, b, i) for i, (_, a, b) in enumerate(found[:12], 1)]
    for floats, pairs in ((1 << 22, 1 << 22), (9, 40)):
        monkeypatch.setattr(R, "QUERY_FLOATS", floats)
        monkeypatch.setattr(R, "PAIRS", pairs)
        got = [(r.query_id, r.key.a, r.key.b, r["rank"]) for r in R.semantic(vectors.repartition(3), queries, 12).collect()]
        assert sorted(got) == sorted(want)
    assert R.semantic(vectors, queries.limit(0)).collect() == [] and R.semantic(vectors.limit(0), queries).collect() == []
    with pytest.raises(Exception, match="dimension"):
        R.semantic(vectors, spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, vector array<float>")).collect()


def test_fusion(spark):
    cols = "query_id int, key long, score double, rank int"
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], cols)
    b = spark.createDataFrame([(1, 10, 5.0, 1), (1, 12, 4.0, 2)], cols)
    got = [(r.key, r.score) for r in R.fuse(a, b).orderBy("rank").collect()]
    assert got[0] == (10, 1.0) and [k for k, _ in got] == [10, 11, 12]
    hits = spark.createDataFrame([(1, "a", i) for i in range(1, 6)] + [(1, "b", 6)], "query_id int, logical_path string, rank int")
    assert [r.rank for r in R.diversify(hits, 4, 2).orderBy("final_rank").collect()] == [1, 2, 6, 3]
    assert [r.rank for r in R.diversify(hits, 6, 2).orderBy("final_rank").collect()] == [1, 2, 3, 4, 5, 6]


def test_route_arguments(spark):
    rule = routes.Rule("wiki", r"^https?://(?<lang>[a-z]+)\.w\.org/(?<page>.+)$", args={"q": "{lang}:{page}", "from": "{url}", "fixed": "x"})
    routes.validate([rule])
    got = [r.a for r in spark.createDataFrame([("https://en.w.org/A/b",), ("https://other/",)], "u string").select(routes.arguments(F.col("u"), rule).alias("a")).collect()]
    assert got == [{"q": "en:A/b", "from": "https://en.w.org/A/b", "fixed": "x"}, {}]
    with pytest.raises(ValueError, match="argument q names title"):
        routes.validate([routes.Rule("wiki", rule.url_pattern, args={"q": "{title}"})])


def test_small_rules(spark):
    one = lambda *c: list(spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first())
    now = F.lit(dt.datetime(2024, 1, 8)).cast("timestamp_ntz")
    assert one(T.resolve_cutoff("7D", now), T.resolve_cutoff(" 24h ", now)) == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 7)]
    assert one(T.ticket_path(F.lit("Acme"), F.lit("ENG-1")), T.project_path(F.lit("Acme"), F.lit("plan-abcd1234"))) == ["linear/acme/issues/ENG-1.md", "linear/acme/projects/plan-abcd1234.md"]


def test_routes(spark):
    rules = [routes.Rule("one", r"^https://x\.org/(?<id>\d+)"), routes.Rule("two", r"^https://")]
    routes.validate(rules)
    df = spark.createDataFrame([("https://x.org/7",), ("https://y",), ("ftp://z",)], "url string")
    assert [r[0] for r in df.select(routes.route(F.col("url"), rules)).collect()] == ["one", "two", None]
    assert df.select(routes.variables(F.col("url"), rules[0])).first()[0] == {"id": "7"}
    with pytest.raises(ValueError):
        routes.validate([rules[0], rules[0]])
