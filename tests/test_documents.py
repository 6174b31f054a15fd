"""Paths, descriptions, snippets, chunks, diffs, renderers, the write path and its streams, on small texts."""

import datetime as dt
import functools
import random
import re
import shutil
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docstrata.functions import globs
from docstrata.functions import text as T
from docstrata.operators import chunks as C
from docstrata.operators import convert as V
from docstrata.operators import index, ingest, snapshots
from docstrata.operators import retrieval as R
from docstrata.operators import store as S
from docstrata.operators.html import markdown
from docstrata.sources import contract, scan
from docstrata.streaming import follow, latest
from docstrata.streaming import ingest as streams

T0 = dt.datetime(2024, 1, 1)
VERSIONS = "logical_path string, version_id timestamp_ntz, tombstone boolean"


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


@pytest.fixture
def one(spark):
    return lambda *columns: [x for x in spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()]


def lit(*texts):
    return [F.lit(t) for t in texts]


def test_paths_and_sizes(one):
    assert one(*[T.path_for_url(u) for u in lit("http://u@E.org:8080/a/", "no url!")]) == ["remotes/e.org/a", "remotes/no_url_"]
    assert one(T.note_path(*lit("My Mac", "Work/Ideas", "To do")), T.slug_path(F.lit("")), T.issue_path(*lit("Org", "Repo", "pull", 7))) == ["apple-notes/my-mac/work/ideas/to-do.md", "untitled", "github/org/repo/pulls/7.md"]
    assert one(*[T.duration_seconds(d) for d in lit(" 2H ", "  ", "7d")]) == [7200, None, 604800]
    assert one(*[T.human_bytes(n) for n in lit(5, 5654, 150 * 1024, 3 * 1024**4, -1)]) == ["5 B", "5.5 KB", "150 KB", "3.0 TB", "0 B"]
    assert one(T.normalize_docmd(F.lit("\n\t ‚a‛ „b‟ \n"))) == ["'a' \"b\""]
    none = F.lit(None).cast("string")
    assert one(T.search_text(F.lit("p"), none, F.lit("body")), T.search_text(*lit("p", " d ", "body", "A > B"))) == ["p\n\n\nbody", "p\nd\nA > B\n\nbody"]
    assert len(one(T.search_text(*lit("p", "word " * 100, "b")))[0].split("\n")[1]) <= 240


def test_descriptions(one):
    """A title of 5 to 200 characters within 40 lines that say something, and what is left; else heading and start, or a size."""
    title = lambda mime, text: one(T.title_description(*lit(mime, text)))[0]
    filler = lambda n: "\n\n".join(f"verse {i}" for i in range(n))
    assert title("text/markdown", "# Tide tables\n\nHigh water\tat  noon.") == "Tide tables — High water at noon."
    assert title("application/yaml", "#   Harbour rules  ###\nmoor: north") == "Harbour rules — moor: north"
    assert title("text/markdown", filler(39) + "\n# Lantern\nend").startswith("Lantern — verse 0 verse 1") and title("text/markdown", filler(40) + "\n# Lantern\nend") is None
    assert title("text/plain", "# Gulls") == "Gulls" and title("text/plain", "# Gull\nfly") is None and title("text/plain", "# " + "g" * 200) == "g" * 200 and title("text/plain", "# " + "g" * 201) is None
    assert title("image/png", "# Gulls over sand") is None and title("text/markdown", "### Gulls over sand") is None and title("text/markdown", "no heading at all") is None
    fallback = lambda mime, text: one(T.fallback_description(*lit("shore/log.txt", mime, text)))[0]
    assert fallback("text/markdown", "wind\n\n## Swell \nrising") == "Swell — wind ## Swell rising" and fallback("application/json", ' {"sea":\n 1} ') == '{"sea": 1}'
    assert fallback("text/csv", "\n \n") == "shore/log.txt (text/csv)" and fallback("audio/ogg", "12345") == "audio/ogg · 5 chars" and len(fallback("text/plain", "n" * 999)) == 200


def test_snippets(one):
    """300 characters from the start, or from a word about 100 before the first term that is found behind that."""

    def snippet(text, *terms):
        return one(T.make_snippet(F.lit(text), F.array(*lit(*terms)) if terms else F.array().cast("array<string>")))[0]

    sea = "".join(f"wave{i:04d} " for i in range(200))  # nine characters each
    assert snippet(sea) == snippet(sea, "absent") == sea[:300] + "…" and snippet("calm") == "calm" and snippet(sea, "WAVE0003") == sea[:300] + "…"
    begin = sea.index("wave0100") - 100
    begin = sea.index(" ", begin - 1) + 1
    assert snippet(sea, "absent", "Wave0100", "wave0150") == "…" + sea[begin : begin + 300] + "…"
    assert snippet(sea, "wave0199") == "…" + sea[sea.index(" ", sea.index("wave0199") - 101) + 1 :]
    dense = "~" * 150 + "buoy" + "~" * 10
    assert snippet(dense, "buoy") == "…" + dense[50:]
    terms = lambda t: one(T.snippet_terms(F.lit(t)))[0]
    assert terms("Why are the Lighthouse_keepers at sea, and AT Sea again") == ["lighthouse_keepers", "sea", "again"] and terms("to be or: ?") == []
    assert terms(" ".join(f"knot{i}" for i in range(30))) == [f"knot{i}" for i in range(10)]


SPELLINGS = [
    ("*.md", "a.md", True), ("*.md", "x/a.md", False), ("foo/bar", "foo/bar", True), ("foo/bar", "x/foo/bar", True), ("foo/bar", "foo/bar/z", False), ("dist", "x/dist/y", True), ("dist", "x/dist", True),
    ("dist/", "x/dist/y/z", True), ("dist/*", "dist/y/z", True), ("dist/*", "x/dist/y/z", True), ("./a/*", "x/a/b", False), ("./a/*", "a/b/c", True), ("**/q/**", "q/z", True),
]


def test_filter_spellings(one):
    assert one(*[globs.any_match(F.lit(path), [pattern]) for pattern, path, _ in SPELLINGS]) == [want for _, _, want in SPELLINGS]


def test_reading_of_markdown(spark):
    heads = lambda t: [own for _, own, _ in C.sections(t)]
    assert heads("pre\n  ### Oak ###\n     # deep\n#Elm\n######  Ash\n####### Fir\n# ##") == ["", "Oak", "Ash", "#"]
    fences = [("```", "````", True), ("~~~~", "~~~", False), ("```py", "~~~", False), ("   ```", "```  ", True), ("```", "``` end", False)]
    for opened, closed, ends in fences:  # a fence ends with as many of its own marks, and nothing else
        assert heads(f"# Oak\n{opened}\n# Elm\n{closed}\n# Ash") == (["Oak", "Ash"] if ends else ["Oak"])
    grove = "## Oak\na\n#### Acorn\nb\n### Leaf\nc\n## Elm\nd\n# Wood\ne\n### Bark"
    assert [(above, own) for above, own, _ in C.sections(grove)] == [([], "Oak"), (["Oak"], "Acorn"), (["Oak"], "Leaf"), ([], "Elm"), ([], "Wood"), (["Wood"], "Bark")]
    assert "\n".join(body for _, _, body in C.sections(grove)) == grove
    rows = spark.createDataFrame([("a", "bark\n## Oak"), ("b", "~~~\n## Oak"), ("c", None), ("d", "")], "logical_path string, content string")
    assert {r.logical_path: r.has_headings for r in C.has_headings(rows).collect()} == {"a": True, "b": False, "c": False, "d": False}
    lines = C.section_lines(spark.createDataFrame([("p", "## Oak\n~~~\n## Elm\n~~~\nsap\n# Ash")], "logical_path string, content string")).orderBy("line_no").collect()
    assert [(r.in_fence, r.section) for r in lines] == [(False, 1), (True, 1), (True, 1), (True, 1), (False, 1), (False, 2)]


def test_packing():
    """Sections are packed up to the target; a longer one is split, and its later pieces say whose they are."""
    page = lambda n: "\n".join(["# Herbal", *(f"## Herb {i}\n" + f"leaf {i} " * 12 for i in range(n))])
    assert C.chunk(page(1), C.Config()) == [(page(1), "")]  # short enough for one chunk
    out = C.chunk(page(30), C.Config(target=500, longest=700))
    assert "\n".join(c for c, _ in out) == page(30) and all(len(c) <= 500 for c, _ in out) and [x for _, x in out] == [""] + ["Herbal"] * (len(out) - 1)
    fits = [len(a) + 1 + len(b.split("\n## ")[0]) for (a, _), (b, _) in zip(out, out[1:])]
    assert all(n > 500 for n in fits)  # no chunk could have taken the next section, too
    tall = "# Herbal\n## Mint\n" + "\n".join(f"row {i:03d} " + "m" * 30 for i in range(60)) + "\n## Sage\nshort"
    out = C.chunk(tall, C.Config(target=400, longest=600, overlap_lines=1))
    mint = [c for c, x in out if x == "Herbal > Mint"]
    assert len(mint) > 3 and all(b.split("\n")[0] == a.split("\n")[-1] for a, b in zip(mint, mint[1:])) and out[-1] == ("## Sage\nshort", "Herbal")
    code = "# Herbal\n\n" + "t" * 300 + "\n\n## Still\n```\n# not a herb\n```\n" + "s" * 250
    assert [c.count("```") for c, _ in C.chunk(code, C.Config(target=330, longest=500)) if "```" in c] == [2]
    flat = C.chunk(page(30), C.Config(target=300, longest=400, by_heading=False, overlap_lines=0))
    assert {x for _, x in flat} == {""} and max(len(c) for c, _ in flat) <= 300
    assert C.split_text("st\nst\n\n" + "o" * 9 + "\n\np\n\nq", 5) == ["st\nst", "o" * 5, "o" * 4, "p\n\nq"]  # a part that is too long stands alone
    assert C.split_text("one\ntwo\nthree", 8) == ["one\ntwo", "three"] and C.split_text("abcdefg", 3) == ["abc", "def", "g"]


def brute_diff(a, b):
    """The longest common subsequence by definition, a deletion first where either would do."""

    @functools.cache
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        return best(i + 1, j + 1) + 1 if a[i] == b[j] else max(best(i + 1, j), best(i, j + 1))

    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(" " + a[i])
            i, j = i + 1, j + 1
        elif best(i + 1, j) >= best(i, j + 1):
            out.append("-" + a[i])
            i += 1
        else:
            out.append("+" + b[j])
            j += 1
    return out + ["-" + x for x in a[i:]] + ["+" + x for x in b[j:]]


def test_diff(spark):
    assert S.line_diff("a\nb\nc", "a\nx\nc") == [" a", "-b", "+x", " c"] and S.line_diff(None, "a") == ["-", "+a"]
    rng = random.Random(3)
    for n in [9] * 300 + [60] * 20:
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, n))] for _ in range(2))
        assert S.line_diff("\n".join(a), "\n".join(b)) == brute_diff(a, b)
    rows = spark.createDataFrame([("p", at(0), False, "x\ny"), ("p", at(10), False, "x\nz"), ("p", at(20), False, "z")], VERSIONS + ", content string")
    got = [r.diff for r in S.diff_versions(rows).orderBy("from_version").collect()]
    assert got[0].split("\n") == ["--- 2024-01-01 00:00:00", "+++ 2024-01-01 00:00:00.01", " x", "-y", "+z"]
    wanted = spark.createDataFrame([("p", at(0), None)], "logical_path string, a timestamp_ntz, b timestamp_ntz")
    assert S.diff_with_current(rows, wanted).first().diff.split("\n")[2:] == ["-x", "-y", "+z"]


def test_diff_of_long_texts():
    """Memory grows with the lines of one text and the root of the other's."""
    rng = random.Random(8)
    a = [str(rng.randrange(50)) for _ in range(6000)]
    b = [x if rng.random() < 0.9 else "new" for x in a[100:]]
    tracemalloc.start()
    out = S.line_diff("\n".join(a), "\n".join(b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6 and [s[1:] for s in out if s[0] != "+"] == a and [s[1:] for s in out if s[0] != "-"] == b


def test_tree_and_counts(spark):
    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "logical_path string")
    assert sorted((r.node, r.is_file, r.files) for r in S.path_tree(paths("a/b/c/d", "a/b", "x"), 2).collect()) == [("a", False, 2), ("a/b", True, 2), ("x", True, 1)]
    wide = S.truncate_tree(S.path_tree(paths(*[f"f/{i:03d}" for i in range(50)])), 3)
    assert sorted((r.node, r.dropped) for r in wide.collect()) == [("f", 0), ("f/000", 47), ("f/001", 47), ("f/002", 47)]
    rows = spark.createDataFrame([(x,) for x in ["a"] * 3 + [None] * 2 + ["b", "c"]], "m string")
    assert {r.m: r.n for r in S.top_and_other(rows, "m", 2).collect()} == {"a": 3, "(null)": 2, "(other)": 2}


HTML = [
    ("<h1>Ice &amp; snow</h1><p>One <b>bold</b> and <em>soft</em><br>line.</p>", "# Ice & snow\n\nOne **bold** and _soft_  \nline."),
    ("<ol start=3><li>three<li>four<ul><li>deep</ul></ol>", "3.  three\n4.  four\n    -   deep"),
    ("<ul><li><p>a</p><p>b</p></li><li></li><li>c</li></ul>", "-   a\n\n    b\n-\n-   c"),
    ("<blockquote><p>said</p><blockquote>twice</blockquote></blockquote>after", "> said\n> \n> > twice\n\nafter"),
    ("<table><tr><th>k<th>v</tr><tr><td>a|b<td><p>1</p><p>2</p></table>", "| k | v |\n| --- | --- |\n| a\\|b | 1 2 |"),
    ("<table><tbody><tr><td>x</td></tr><tr><td>y</td><td>z</td></tr></tbody></table>", "| x |  |\n| --- | --- |\n| y | z |"),
    ("<h2><a href='/p(1)' title='t &quot;q&quot;'>Link</a></h2><hr><img src=i.png alt='an  [x]'>", '## [Link](/p\\(1\\) "t \\"q\\"")\n\n* * *\n\n![an x](i.png)'),
    ("<pre><code class='language-py'>a  *b*\n\n  # c &lt;</code></pre>", "```py\na  *b*\n\n  # c <\n```"),
    ("<pre>```\nx</pre><p>use <code>a`b</code> and <code>`</code></p>", "````\n```\nx\n````\n\nuse ``a`b`` and `` ` ``"),
    ("<p># no * heading_1</p><p>1. not</p><p>- dash</p><p>> q</p><p>+ p [x]</p><p>a - b</p>", "\\# no \\* heading\\_1\n\n1\\. not\n\n\\- dash\n\n\\> q\n\n\\+ p \\[x\\]\n\na - b"),
    ("<p>“curly” – it’s</p>", "“curly” – it’s"),
    ("<script>x</script><title>t</title><style>s</style>body<noscript>n</noscript>", "body"),
    ("<p><b>open<br><p>next</b> end</div></p><b></b><i> </i>!", "**open**\n\nnext end\n\n!"),
    ("<div>a<div>b<span> c </span>d</div>e</div>", "a\n\nb c d\n\ne"),
    ("<li>alone</li><td>cell", "alone\n\ncell"),
    ("<a href='x'></a><a>plain</a> <a href=' u v '>w</a>", "plain [w](uv)"),
    ("", ""), ("<p>  </p>", ""), ("a < b & c", "a < b & c"),
]


@pytest.mark.parametrize(("html", "want"), HTML)
def test_html(html, want):
    assert markdown(html)[0] == want


def test_html_loses_no_text():
    """Whatever is open or closed, each word of a text is there, in order."""
    rng = random.Random(5)
    tags = ["p", "div", "b", "a href=x", "ul", "ol", "li", "table", "tr", "td", "th", "h2", "blockquote", "pre", "code", "em", "dl", "dt", "dd", "br", "hr"]
    for _ in range(400):
        n, out = 0, ""
        for _ in range(rng.randrange(25)):
            tag = rng.choice(tags)
            out += rng.choice([f"<{tag}>", f"</{tag.split()[0]}>"])
            if rng.random() < 0.7:
                out += f" w{n} "
                n += 1
        got = re.findall(r"w\d+", markdown(out)[0])
        assert sorted(got) == sorted(f"w{i}" for i in range(n)), out


def test_images(spark):
    html = "<p>a <img alt='x' src=\"data:image/png;base64,QU JD\"> b <IMG SRC='data:image/gif;base64,REVG'>\n<img src='u.png'><img src=data:image/png;base64,QUJD alt='x'><img src='data:text/plain,no'></p>"
    pages = spark.createDataFrame([("p", html), ("q", "none"), ("r", "<img src='data:image/png;base64,QUJD'><img alt='own' src='embedded-image:7'>"), ("n", None)], "logical_path string, content string")
    assert [(r.logical_path, r.image_no, r.mime_type, bytes(r.bytes), r.captioned) for r in V.image_table(pages, 1).orderBy("logical_path", "image_no").collect()] == [
        ("p", 1, "image/png", b"ABC", True), ("p", 2, "image/gif", b"DEF", False), ("p", 3, "image/png", b"ABC", False), ("r", 1, "image/png", b"ABC", True)]
    parts = lambda text: [x.strip() for x in text.split("\n\n")]
    plain = {r.logical_path: r.m for r in pages.select("logical_path", V.html_to_markdown(F.col("content")).alias("m")).collect()}
    assert plain["n"] is None and plain["q"] == "none" and parts(plain["p"]) == ["a", "<!-- image: x -->", "(image, image/png, 3 bytes)", "b", "<!-- image -->", "(image, image/gif, 3 bytes)", "![](u.png)", "<!-- image: x -->", "(image, image/png, 3 bytes)"]
    rows = pages.select("logical_path", F.lit("text/html").alias("mime_type"), F.encode("content", "UTF-8").alias("bytes"))
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def seen(data: pd.Series, mime: pd.Series) -> pd.Series:
        calls.add(len(data))
        return pd.Series([None if m == "image/gif" else f"seen {len(d)}" for d, m in zip(data, mime, strict=True)])

    got = {r.logical_path: r.content for r in V.converted(rows, "logical_path", caption=seen, cap=2).collect()}
    assert calls.value == 2  # each different image once
    assert got["q"] == "none" and parts(got["p"]) == ["a", "<!-- image: x -->", "seen 3", "b", "<!-- image -->", "(image, image/gif, no caption available)", "![](u.png)", "<!-- image: x -->", "(image, image/png, 3 bytes — caption skipped, exceeded max_inline_image_captions)"]
    assert parts(got["r"]) == ["<!-- image -->", "seen 3", "<!-- image: own -->", "(image, no caption available)"]


def test_hooks_of_the_write_path(spark, tmp_path):
    """Captions, structured text and descriptions by hooks."""
    rows = entries(spark, [("a.html", "text/html", "<p>x</p><img src='data:image/png;base64,QUJD'>"), ("b.json", "application/json", '{"k": 1}'), ("c.html", "text/html", "<p>only</p>")])
    said = lambda text: lambda a, b: F.concat(F.lit(text), F.octet_length(a).cast("string"))
    settings = ingest.Settings(caption=said("picture of "), structured=lambda t: F.concat(F.lit("```json\n"), t, F.lit("\n```")), model=lambda mime, text: F.concat(F.lit("about "), mime))
    now = ingest.ingest_batch(spark, str(tmp_path / "s"), "k", rows, ms(0), settings)
    got = {r.logical_path: (r.content, r.description) for r in now.read("files").collect()}
    assert got == {"a.html": ("x\n\n<!-- image -->\n\npicture of 3", "about text/html"), "b.json": ('```json\n{"k": 1}\n```', "about application/json"), "c.html": ("only", "about text/html")}


USER = "struct<name:string,email:string>"
ISSUE = "html_url string, number long, is_pull boolean, title string, body string, state string, draft boolean, author string, assignees array<string>, labels array<string>, milestone string, due_date string, created_at string, updated_at string, closed_at string, links array<struct<kind:string,number:long>>, comments array<struct<author:string,created_at:string,body:string>>"
ITEM = f"url string, identifier string, title string, state string, priority string, assignee {USER}, creator {USER}, team string, project string, cycle string, labels array<string>, estimate int, due_date string, blocks array<string>, blocked_by array<string>, created_at string, updated_at string, description string, comments array<struct<user:{USER},created_at:string,body:string>>"
PROJECT = f"url string, name string, state string, lead {USER}, members array<{USER}>, teams array<string>, progress double, start_date string, target_date string, created_at string, updated_at string, description string, content string"


def test_records(spark):
    rows = spark.createDataFrame([
        ("https://e.org/1", 1, True, "Fix: it", " body ", "open", False, "ann", ["bob"], [], "v1", None, "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z", None, [("references", 9), ("references", 3), ("references", 9), ("closes", 4)], [("cy", "2024-01-04", " hi ")]),
        ("https://e.org/2", 2, False, "Plain", None, "closed", None, None, [], ["a b", "- c"], None, None, "x", "y", "z", [("closes", 4)], []),
    ], ISSUE)
    one, two = [r.markdown for r in V.issues_to_markdown(rows).orderBy("number").collect()]
    assert one == (
        "---\nsource_url: https://e.org/1\nnumber: 1\nkind: pull\ntitle: 'Fix: it'\nstate: open\ndraft: false\nauthor: ann\nassignees:\n  - bob\nmilestone: v1\nreferences:\n  - 3\n  - 9\ncloses:\n  - 4\n"
        "created_at: '2024-01-02T00:00:00Z'\nupdated_at: '2024-01-03T00:00:00Z'\n---\n# PR #1: Fix: it\n\n## Description\n\nbody\n\n## Comments (1)\n\n### @cy — 2024-01-04\n\nhi"
    )
    assert "closes" not in two and "labels:\n  - a b\n  - '- c'\n" in two and two.endswith("closed_at: z\n---\n# Issue #2: Plain")
    item = spark.createDataFrame([("u", "ENG-1", "T", "Todo", None, ("Ann", "a@e.org"), None, "ENG", None, None, ["x"], 3, None, ["ENG-2"], [], "c", "d", "text", [(None, "when", "b")])], ITEM)
    text = V.tracker_to_markdown(item).first().markdown
    assert "assignee: Ann <a@e.org>\nteam: ENG\nlabels:\n  - x\nestimate: 3\nblocks:\n  - ENG-2\n" in text and text.endswith("# ENG-1: T\n\n## Description\n\ntext\n\n## Comments (1)\n\n### (unknown) — when\n\nb")
    text = V.projects_to_markdown(spark.createDataFrame([("u", "P", "started", None, [("Ann", None)], ["ENG"], 0.5, None, None, "c", "d", "sum", " over ")], PROJECT)).first().markdown
    assert "members:\n  - Ann\nteams:\n  - ENG\nprogress: 0.5\n" in text and text.endswith("# P\n\n## Summary\n\nsum\n\n## Overview\n\nover")


def test_moves_and_bytes(spark):
    rows = [("docs/a.md", at(0), False), ("docs/a.md", at(10), False), ("docs/b.md", at(20), False)]
    now = S.current(spark.createDataFrame(rows, VERSIONS).withColumn("description", F.lit("about"))).withColumn("change_note", F.lit(None).cast("string"))
    renames, version = spark.createDataFrame([("docs/a.md", "docs/z.md")], "old_path string, new_path string"), F.lit(at(99)).cast("timestamp_ntz")
    assert sorted((r.logical_path, r.change_note) for r in S.move(now, renames, version).collect()) == [("docs/a.md", "moved to docs/z.md"), ("docs/z.md", "move from docs/a.md")]
    with pytest.raises(Exception, match="several renames"):
        S.move(now, renames.union(spark.createDataFrame([("docs/b.md", "docs/z.md")], renames.schema)), version).collect()
    chunks = spark.createDataFrame([("docs/a.md", at(10), 0, "body", "A", "old", 1), ("docs/a.md", at(0), 0, "older", "", "old", 2)], "logical_path string, version_id timestamp_ntz, chunk_index int, chunk_content string, context string, search_text string, extra int")
    assert [(r.logical_path, r.version_id, r.search_text, r.extra) for r in S.moved_chunks(chunks, now, renames, version).collect()] == [("docs/z.md", at(99), "docs/z.md\nabout\nA\n\nbody", 1)]
    blobs = spark.createDataFrame([("s1", "a/b", 9, bytearray(b"xyz")), ("s2", "a/b", 1, None)], ingest.BLOBS)
    assert tuple(S.reclaimable(blobs, 5, []).first()) == (1, 3) and S.read_bytes(blobs.filter("sha256 = 's1'")).first().bytes_base64 == "eHl6"
    with pytest.raises(Exception, match="not kept"):
        S.read_bytes(blobs).collect()


def entries(spark, rows):
    return spark.createDataFrame([(p, m, bytearray(t.encode()), "local", p, 0) for p, m, t in rows], "logical_path string, mime_type string, bytes binary, source_type string, source_path string, source_mtime_ms long")


def ms(n):
    return F.lit(at(n)).cast("timestamp_ntz")


def test_write_path(spark, tmp_path):
    """Two batches: gate, convert, describe, chunk, search text, vectors, blobs, tombstones, outcomes."""
    where = str(tmp_path / "store")
    body = "# First file\n\n" + "alpha beta gamma.\n" * 40
    ingest.ingest_batch(spark, where, 0, entries(spark, [("d/a.md", "text/markdown", body), ("d/b.html", "text/html", "<h1>Second page</h1><p>text</p>"), ("d/c.bin", "application/zip", "zzzz")]), ms(0), ingest.Settings(skip_mimes=["application/*"]))
    ingest.ingest_batch(spark, where, 1, entries(spark, [("d/a.md", "text/markdown", body), ("d/b.html", "text/html", "<h1>Second page</h1><p>new</p>")]), ms(50), in_scope="d/")
    store = ingest.read_store(spark, where)
    files = store["files"].orderBy("logical_path", "version_id").collect()
    assert [(r.logical_path, r.version_id, r.tombstone) for r in files] == [("d/a.md", at(0), False), ("d/b.html", at(0), False), ("d/b.html", at(50), False), ("d/c.bin", at(0), False), ("d/c.bin", at(50), True)]
    assert files[0].description.startswith("First file — alpha") and files[1].content == "# Second page\n\ntext" and files[4].change_note == "source gone"
    blobs = [(r.mime_type, r.bytes and bytes(r.bytes)[:5]) for r in store["blobs"].collect()]
    assert sorted(blobs, key=str) == [("application/zip", None), ("text/html", b"<h1>S"), ("text/html", b"<h1>S"), ("text/markdown", b"# Fir")]
    told = store["outcomes"].filter("key = '1'").collect()
    assert sorted((r.logical_path, r.version_id, r.status, r.change) for r in told) == [("d/a.md", at(0), "unchanged", None), ("d/b.html", at(50), "ok", "changed")]
    now = S.current_chunks(store["chunks"], store["files"])
    found = now.collect()
    assert {r.logical_path for r in found} == {"d/a.md", "d/b.html"} and all(r.search_text.startswith(r.logical_path + "\n") and len(r.embedding) == 64 for r in found)
    small = ingest.rechunk(store["files"], ingest.Settings(chunks=C.Config(target=200, longest=300)))
    assert small.filter("logical_path = 'd/a.md'").count() > now.filter("logical_path = 'd/a.md'").count() and small.filter("length(chunk_content) > 300").count() == 0
    queries = spark.createDataFrame([(1, "gamma alpha")], "query_id int, query string").withColumn("vector", R.hash_vector(F.col("query")))
    hits = R.search_chunks(store["chunks"], store["files"], queries, prefix="d/a").collect()
    assert {(r.logical_path, r.version_id) for r in hits} == {("d/a.md", at(0))} and "gamma" in hits[0].snippet
    assert {r.version_id for r in R.search_chunks(store["chunks"], store["files"], queries, prefix="d/b", history=True, mode="semantic").collect()} == {at(0), at(50)}
    assert R.search_chunks(store["chunks"], store["files"], queries, scorer=R.lexical_score, mode="keyword").first().rerank_score > 0.9
    with pytest.raises(Exception, match="requires a query"):
        R.search_chunks(store["chunks"], store["files"], queries.withColumn("query", F.lit(" "))).collect()


def state(store):
    return {r.logical_path: r.content for r in S.current(store["files"]).collect()}


def test_a_batch_is_taken_once(spark, tmp_path):
    """A replayed batch, a stream that begins on an existing store, a failed try, and entries of one path."""
    where = str(tmp_path / "store")
    take = lambda key, rows, v, **more: ingest.ingest_batch(spark, where, key, entries(spark, [(p, "text/plain", t) for p, t in rows]), ms(v), **more)
    take("s#0", [("a", "one"), ("b", "two")], 0)
    take("s#1", [("a", "ONE"), ("c", "three")], 10)
    again = take("s#1", [("a", "ONE"), ("c", "three")], 10)
    assert state(ingest.read_store(spark, where)) == {"a": "ONE", "b": "two", "c": "three"} and again.seq == 1
    take("t#0", [("d", "four")], 20)  # another stream's first batch
    assert set(state(ingest.read_store(spark, where))) == {"a", "b", "c", "d"} and state(ingest.read_store(spark, where, at=0)) == {"a": "one", "b": "two"}
    base = snapshots.snapshot(spark, where)
    base.write("files", base.read("files"))  # a try that failed before its commit
    assert ingest.read_store(spark, where)["files"].count() == 5
    doubled = entries(spark, [("e", "text/plain", "x"), ("e", "text/plain", "y"), ("e", "text/plain", "y"), ("f", "text/plain", "z")]).withColumn("source_mtime_ms", F.when(F.col("bytes") == F.lit(b"x"), 9).otherwise(1).cast("long"))
    ingest.ingest_batch(spark, where, "u", doubled, ms(30))
    store = ingest.read_store(spark, where)
    assert state(store)["e"] == "x" and store["files"].filter("logical_path = 'e'").count() == 1 and store["chunks"].filter("logical_path = 'e'").count() == 1
    assert store["outcomes"].filter("key = 'u' and logical_path = 'e'").first().duplicates == 2
    with pytest.raises(Exception, match="not later"):
        take("late", [("a", "older")], 5)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(base, "other", {})  # its number has been taken meanwhile
    assert take("same", [("a", "ONE")], 40).read("files").count() == 7 and take("force", [("a", "ONE")], 41, force=True).read("files").count() == 8
    assert take("plain", [("a", "ONE")], 42, gated=False).read("files").count() == 9
    done = ingest.write_texts(spark, where, "note", spark.createDataFrame([("n.md", "# Some note\nbody")], "logical_path string, content string"), ms(50))
    note = done.read("files").filter("logical_path = 'n.md'").first()
    assert (note.source_type, note.blob_sha256, note.description) == ("inline", None, "Some note — body") and done.read("blobs").filter(F.col("sha256") == note.source_sha256).isEmpty()
    assert take("empty", [], 60).seq == done.seq + 1


def test_failed_entries(spark, tmp_path):
    rows = [("ok.txt", bytearray(b"fine"), None), ("bad.txt", None, "unreadable"), ("none.txt", None, None), ("odd.txt", bytearray(b"a\xffb"), None)]
    df = spark.createDataFrame([(p, "text/plain", b, p, "local", 0, e) for p, b, e in rows], "logical_path string, mime_type string, bytes binary, source_path string, source_type string, source_mtime_ms long, error string")
    store = ingest.ingest_batch(spark, str(tmp_path / "s"), "k", df, ms(0))
    assert {r.logical_path: (r.status, r.error) for r in store.read("outcomes").collect()} == {"ok.txt": ("ok", None), "bad.txt": ("failed", "unreadable"), "none.txt": ("failed", "no bytes"), "odd.txt": ("ok", None)}
    assert {r.logical_path: r.content for r in store.read("files").collect()} == {"ok.txt": "fine", "odd.txt": "a\ufffdb"}
    assert tuple(S.outcomes(store.read("outcomes")).first()) == (2, 0, 2)


def test_refresh(spark, tmp_path):
    """Ticks: what is due is read again, changed sources get versions, and nothing is due again before its time."""
    where, hour = str(tmp_path / "store"), 3_600_000
    rows = entries(spark, [(p, "text/plain", p) for p in ("same", "new", "gone", "down")]).withColumn("refresh_frequency_sec", F.lit(3600))
    ingest.ingest_batch(spark, where, "in", rows, ms(0))
    ingest.write_texts(spark, where, "note", spark.createDataFrame([("note", "text")], "logical_path string, content string"), ms(1), ingest.Settings(refresh_frequency_sec=3600))
    ingest.ingest_batch(spark, where, "never", entries(spark, [("never", "text/plain", "x")]), ms(2))
    asked = []

    def live(due):
        asked.append({r.logical_path for r in due.collect()})
        found = [("same", bytearray(b"same"), None), ("new", bytearray(b"NEW"), None), ("down", None, "timeout"), ("never", bytearray(b"changed"), None)]
        return spark.createDataFrame([(p, b, None, 7, e) for p, b, e in found], "logical_path string, bytes binary, mime_type string, source_mtime_ms long, error string")

    now = ingest.refresh(spark, where, "t0", live, ms(hour // 2))
    assert asked[-1] == set() and now.read("refreshes").isEmpty()
    now = ingest.refresh(spark, where, "t1", live, ms(2 * hour))
    assert asked[-1] == {"same", "new", "gone", "down", "note"}
    status = {r.logical_path: (r.last_refresh_status, r.refreshed_at) for r in S.current(ingest.with_status(now)).collect()}
    t1 = at(2 * hour)
    assert status == {"same": ("unchanged", t1), "new": ("ok", t1), "gone": ("failed:source gone", t1), "down": ("failed:timeout", t1), "note": ("unchanged", t1), "never": ("ok", at(2))}
    assert ingest.due(now, ms(2 * hour + 5)).isEmpty() and state({"files": now.read("files")})["new"] == "NEW" and now.read("files").filter("logical_path = 'new'").count() == 2
    assert ingest.refresh(spark, where, "t1", live, ms(9 * hour)).seq == now.seq and len(asked) == 2  # the tick has been done
    after = ingest.refresh(spark, where, "t2", live, ms(4 * hour))
    assert {r.logical_path for r in ingest.due(after, ms(6 * hour)).collect()} == {"same", "new", "gone", "down", "note"} and after.read("files").count() == now.read("files").count()
    forced = ingest.refresh(spark, where, "t3", live, ms(6 * hour), force=True)
    assert forced.read("files").filter("logical_path = 'same'").count() == 2


def test_upkeep(spark, tmp_path):
    """Prune, strip, collect, reindex, move, remove and compact, with the index as if built anew after each."""
    where = str(tmp_path / "store")
    take = lambda key, rows, v: ingest.ingest_batch(spark, where, key, entries(spark, [(p, "text/plain", t) for p, t in rows]), ms(v))
    take("0", [("a", "red red fox"), ("b", "blue jay"), ("c", "red kite " * 60)], 0)
    old = take("1", [("a", "grey fox"), ("d", "red deer")], 10)

    def searched(now):
        queries = spark.createDataFrame([(1, "red fox"), (2, "blue deer kite"), (3, "none")], "query_id int, query string")
        chunks = S.current_chunks(now.read("chunks"), now.read("files")).withColumn("key", F.struct(*index.CHUNK))
        fresh = R.bm25(chunks.select("key", F.col("search_text").alias("text")), queries).select("query_id", "key.*", "score", "rank")
        got = sorted(tuple(r) for r in index.search(now, queries).collect())
        assert got and got == sorted(tuple(r) for r in fresh.collect())
        return got

    assert {r[1] for r in searched(old) if r[0] == 1} == {"a", "c", "d"}
    now = ingest.prune(spark, where, "prune", ms(5))
    assert sorted((r.logical_path, r.version_id) for r in now.read("files").collect()) == [("a", at(10)), ("b", at(0)), ("c", at(0)), ("d", at(10))]
    assert now.read("chunks").filter("logical_path = 'a'").count() == 1 and now.read("blobs").count() == 4 and searched(now)
    assert old.read("files").count() == 5 and old.read("blobs").count() == 5  # the older snapshot still has all
    assert len(now.parts["files"]) == 2 and now.parts["files"][0] in old.parts["files"]  # the part without old versions stays
    now = ingest.strip_blobs(spark, where, "strip", 100)
    assert {r.size_bytes: r.bytes is None for r in now.read("blobs").collect()}[540]
    assert ingest.strip_blobs(spark, where, "strip again", 100).parts == now.parts
    now = ingest.move(spark, where, "move", spark.createDataFrame([("b", "z/b")], "old_path string, new_path string"), ms(20))
    assert {r.logical_path for r in S.current(now.read("files")).collect()} == {"a", "c", "d", "z/b"} and any(r[1] == "z/b" for r in searched(now))
    now = ingest.remove(spark, where, "rm", spark.createDataFrame([("c",)], "logical_path string"), ms(30))
    assert {r[1] for r in searched(now)} == {"a", "d", "z/b"}
    now = ingest.reindex(spark, where, "reindex", "r2", ingest.Settings(chunks=C.Config(target=40, longest=50)))
    assert now.revision == "r2" and now.read("chunks").filter("logical_path = 'c'").count() > 5 and searched(now)
    take("2", [("e", "red fox blue deer")], 40)
    before = snapshots.snapshot(spark, where)
    now = ingest.compact(spark, where, "compact")
    assert all(len(p) == 1 for p in now.parts.values()) and now.revision == "r2" and searched(now) == searched(before) and now.read("postings").filter("sign < 0").isEmpty()
    assert ingest.collect_blobs(spark, where, "collect").read("blobs").count() == now.read("blobs").count()
    assert snapshots.vacuum(spark, where, now.seq) > 5 and searched(snapshots.snapshot(spark, where)) == searched(now)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        old.read("files").collect()


def test_streams(spark, tmp_path):
    source, where = str(tmp_path / "in"), str(tmp_path / "store")
    for k, text in enumerate(("one", "two")):
        rows = entries(spark, [("p.txt", "text/plain", text), (f"q{k}.txt", "text/plain", "same")]).withColumn("refresh_frequency_sec", F.lit(60))
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: streams.ingest_stream(stream, where, str(tmp_path / "c1"), lambda b: ms(b)).awaitTermination()
    run()
    store = ingest.read_store(spark, where)
    assert store["files"].filter("logical_path = 'p.txt'").count() == 2 and S.current(store["files"]).count() == 3
    shutil.rmtree(tmp_path / "c1" / "commits")  # as if the query had stopped between the store's commit and its own
    run()
    assert ingest.read_store(spark, where)["files"].count() == 4
    live = lambda due: spark.createDataFrame([("p.txt", bytearray(b"three"), None, 1, None), ("q0.txt", None, None, 1, "down")], "logical_path string, bytes binary, mime_type string, source_mtime_ms long, error string")
    spark.createDataFrame([(at(10_000_000),)], "now timestamp_ntz").write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("now timestamp_ntz").parquet(str(tmp_path / "ticks"))
    streams.refresh_stream(ticks, where, live, str(tmp_path / "c2")).awaitTermination()
    now = snapshots.snapshot(spark, where)
    assert {r.logical_path: r.status for r in now.read("refreshes").collect()} == {"p.txt": "ok", "q0.txt": "failed:down", "q1.txt": "failed:source gone"}
    assert state({"files": now.read("files")})["p.txt"] == "three" and ingest.due(now, ms(10_000_001)).isEmpty()


def test_log_follow(spark, tmp_path):
    """Lines that are appended, rotated away and written anew, over restarts: each once."""
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    live, told = logs / "app.log", []

    def say(n, end="\n"):
        for i in range(n):
            told.append(f"line {len(told)}")
            with live.open("a") as f:
                f.write(f'{{"msg": "{told[-1]}"}}' + ("\n" if i + 1 < n else end))

    def read():
        rows = follow.follow_log(spark, f"{logs}/app.log*")
        q = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r.msg for r in spark.read.parquet(out).select("record.msg").collect())

    say(3)
    assert read() == sorted(told)
    say(2, end="")  # the last line is not complete
    assert read() == sorted(told[:-1])
    with live.open("a") as f:
        f.write("\n")
    live.rename(logs / "app.log.1")
    say(4)
    assert read() == sorted(told)
    (logs / "app.log.1").rename(logs / "app.log.2")
    live.rename(logs / "app.log.1")
    with (logs / "app.log.1").open("a") as f:
        f.write('{"msg": "late"}\n')
    say(1)
    assert read() == sorted([*told, "late"]) == read()


def test_log_ranges(tmp_path, monkeypatch):
    """Each line is in one range, wherever the ranges begin."""
    path = tmp_path / "x.log"
    lines = ["", "é" * 9, "b", "", "c" * 40, "d"]
    path.write_text("\n".join(lines) + "\nopen")
    for size in range(1, 70, 3):
        monkeypatch.setattr(follow, "SPLIT", size)
        monkeypatch.setattr(follow, "TAIL", size)
        reader = follow._Reader(str(path))
        got = [row for p in reader.partitions({}, reader.latestOffset()) for row in reader.read(p)]
        assert [r[3] for r in got] == lines and [r[2] for r in got] == [len("\n".join([*lines[:i], ""]).encode()) for i in range(len(lines))]


def test_audit_log(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"tool": "x"}\nnot json\n')
    assert [(r.line_no, r.raw) for r in scan.last_records(scan.audit_log(spark, str(tmp_path)), 1).collect()] == [(1, "not json")]


def test_latest_state(spark, tmp_path):
    """Versions in any order, late and repeated ones included, and a restart."""
    rows = [("a", at(1), 1), ("a", at(3), 2), ("b", at(5), 3), ("a", at(2), 4), ("b", at(5), 9), ("b", at(5), 8), ("c", at(0), 1)]
    schema, source = "logical_path string, version_id timestamp_ntz, event_id long", str(tmp_path / "in")
    out = str(tmp_path / "out")

    def run(more):
        for r in more:
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
        held = spark.conf.get(latest.PROVIDER[0])
        spark.conf.set(*latest.PROVIDER)
        try:
            streams.append_stream(latest.latest_stream(stream), out, str(tmp_path / "check")).awaitTermination()
        finally:
            spark.conf.set(latest.PROVIDER[0], held)
        return sorted((r.logical_path, r.version_id, r.event_id) for r in latest.last_updates(spark.read.parquet(out)).collect())

    assert run(rows) == [("a", at(3), 2), ("b", at(5), 9), ("c", at(0), 1)]
    assert run([("a", at(2), 7), ("b", at(4), 99), ("c", at(9), 1), ("d", at(1), 1)]) == [("a", at(3), 2), ("b", at(5), 9), ("c", at(9), 1), ("d", at(1), 1)]


def test_source_contract(spark, tmp_path):
    """Listing, probe, reading and sync of landed issue records, by selector."""
    landed = {"rows": [("Org", "Re", 1, None, "open", "2024-01-01T00:00:00Z", "u1", "first"), ("org", "re", 2, "{}", "open", "2024-01-01T00:00:00Z", "u2", "pull"), ("org", "other", 3, None, "open", "2024-01-01T00:00:00Z", "u3", "no")]}
    schema = "owner string, repo string, number long, pull_request string, state string, updated_at string, html_url string, body string"
    read = []

    def markdown(rows):
        read.append({r.number for r in rows.collect()})
        return rows.withColumn("markdown", F.concat(F.lit("# Issue\n"), "body"))

    contract.register(contract.issues_source("tracker", lambda s: s.createDataFrame(landed["rows"], schema), markdown))
    where = str(tmp_path / "s")
    now = contract.add(spark, where, "a", "tracker:org/re", ms(0))
    assert {r.logical_path for r in now.read("files").collect()} == {"github/org/re/issues/1.md", "github/org/re/pulls/2.md"} and read[-1] == {1, 2}
    landed["rows"] = [("org", "re", 1, None, "open", "2024-01-01T00:00:00Z", "u1", "edited, same time"), ("org", "re", 4, None, "open", "2024-02-01T00:00:00Z", "u4", "new")]
    now = contract.add(spark, where, "b", "tracker:org/re#issues", ms(10), sync=True)
    assert read[-1] == {4} and {r.logical_path for r in S.current(now.read("files")).collect()} == {"github/org/re/issues/1.md", "github/org/re/pulls/2.md", "github/org/re/issues/4.md"}  # pulls are not of this selector
    now = contract.add(spark, where, "c", "tracker:org/re", ms(20), sync=True, force=True)
    current = {r.logical_path: r.content for r in S.current(now.read("files")).collect()}
    assert current == {"github/org/re/issues/1.md": "# Issue\nedited, same time", "github/org/re/issues/4.md": "# Issue\nnew"} and read[-1] == {1, 4}
    for text, error in (("nobody:x", LookupError), ("tracker:org", ValueError), ("tracker:a/b/c", ValueError), ("tracker:a/b#x", ValueError)):
        with pytest.raises(error):
            contract.add(spark, where, "d", text, ms(30))
    assert [contract.notes_scope(f"apple-notes:{x}") for x in ("", "Me", "Me/", "/Work", "Me/Work/Ideas")] == [("*", "**"), ("Me", "**"), ("Me", "**"), ("*", "Work"), ("Me", "Work/Ideas")]
    with pytest.raises(ValueError):
        contract.notes_scope("notes:Me")


def test_containing(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "one two three four fivesix"), (3, "none"), (4, None)], "key long, text string")
    passages = spark.createDataFrame([(1, "ne two three four fi"), (2, "two three four five six"), (3, "two th"), (4, "no")], "query_id long, passage string")
    want = {(q.query_id, d.key) for q in passages.collect() for d in docs.collect() if d.text and q.passage in d.text}
    assert {tuple(r) for r in R.containing(docs, passages).collect()} == want and len(want) == 6
    walks = spark.createDataFrame([(1, "walking home"), (2, "a wall")], "key long, text string")
    assert [r.key for r in R.bm25(walks, spark.createDataFrame([(1, "walked")], "query_id int, query string"), stem=R.light_stem).collect()] == [1]


def test_scan_reads_only_what_it_keeps(spark, tmp_path):
    for name in ("a b[1].md", "x/keep.md", "node_modules/pkg/no.md", "x/y.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = scan.scan_files(spark, f"file:{tmp_path}", includes=["**/*.md"])
    assert {r.rel_path: bytes(r.content).decode() for r in got.collect()} == {"a b[1].md": "a b[1].md", "x/keep.md": "x/keep.md"}
    text = {r.logical_path.rsplit("/", 1)[1]: r.content for r in scan.corpus(spark, str(tmp_path / "x")).collect()}
    (tmp_path / "x" / "two.md").write_text("a\nb")
    assert text == {"keep.md": "x/keep.md"} and scan.corpus(spark, str(tmp_path / "x")).filter("content = 'a\nb'").count() == 1
