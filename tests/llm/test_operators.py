"""The corpus operators against brute force, on small tables and on the awkward cases of their docstrings."""

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.llm import byte_bpe, catalog, common, cotraining, jaccard_join, language_id, mixing, quality_rules, sharding, subword, toxicity, url_filter, weighted_sampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, size string"
LONG = "word another " * 3000 + "end"
ODD = [
    (1, None, None, None, None, 1, "x"), (2, "", "en", "a", 0, 2, "x"), (3, " \n\t ", "en", None, 4, 3, "x"), (4, "one", "fr", "a", 3, 4, "x"), (5, "one", "fr", "a", 3, 5, "x"), (5, "one", "fr", "a", 3, 5, "x"),
    (6, LONG, "de", "b", len(LONG), 6, "x"), (7, LONG + " extra", "de", "b", 1, 7, "x"), (None, "no id here", "es", "c", 2, 8, "x"), (8, "émoji 😀😀 ñandú " * 40, "es", "c", 5, 9, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def brute_components(rows, k, num, den):
    sets, up = {}, {}
    for i, x in rows:
        w = WORD.findall(low(x or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        up[i] = i

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den", "block"), [(3, 9, 10, 1024), (5, 8, 10, 1024), (2, 6, 10, 4), (3, 8, 10, 2), (3, 4, 10, 64)])
def test_jaccard_join(docs, k, num, den, block):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_components(docs, k, num, den, block).collect()}
    assert got == brute_components(rows, k, num, den)


def test_all_links_by_bits_and_by_sets(monkeypatch):
    rng = np.random.default_rng(6)
    base = [np.unique(common.mix(rng.integers(0, 1 << 40, n).astype(np.uint64))) for n in (5, 40, 90)]
    sets = [np.unique(s[rng.random(len(s)) < 0.95]) for s in base for _ in range(30)]
    sets = [s for s in sets if len(s)]
    maps, sizes = np.stack([jaccard_join.bitmap(s, 256) for s in sets]), np.array([len(s) for s in sets])
    true = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i < j and 10 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 9 * (len(sets[i]) + len(sets[j]) - both)}
    tree = lambda lo, hi: jaccard_join.SignatureTree(maps[lo:hi], sizes[lo:hi], sets[lo:hi])
    for vocabulary in (1 << 18, 0):
        monkeypatch.setattr(jaccard_join, "VOCABULARY", vocabulary)
        one, n, found = tree(0, None), len(sets), []
        for x, y, p, q in ((one, one, 0, 0), (tree(0, 50), tree(50, n), 0, 50)):
            found.append([(min(i + p, j + q), max(i + p, j + q)) for a, b in jaccard_join.all_links(x, y, 9, 10) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        assert sorted(found[0]) == sorted(true) and sorted(found[1]) == sorted((i, j) for i, j in true if i < 50 <= j)


@pytest.mark.parametrize(("k", "num", "den", "block"), [(3, 9, 10, 1024), (3, 8, 10, 4)])
def test_jaccard_counts_every_link(spark, docs, odd, k, num, den, block):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(120).union(odd.select(F.col("doc_id") + 10_000_000, "text").filter("doc_id is not null")).collect()]
    base = max((x for _, x in rows if x and 200 < len(x.split()) < 400), key=len).split()
    rows += [(20_000_000 + i, " ".join(w + ("x" if j == 9 * i else "") for j, w in enumerate(base))) for i in range(20)] + [(20_000_000 + i, " ".join(base)) for i in range(20, 24)]
    sets = []
    for _, x in rows:
        w = WORD.findall(low(x or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    want = [sum(i != j and bool(a) and bool(b) and den * (both := len(a & b)) >= num * (len(a) + len(b) - both) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = jaccard_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den, block, every=True).collect()
    assert max(want) >= 23 and sorted((r.doc_id, r.n_links) for r in got) == sorted((i, n) for (i, _), n in zip(rows, want, strict=True))


def test_jaccard_odd(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_components(odd, 3, 9, 10).collect()]
    assert len(got) == len(ODD)
    by = {i: (n, c) for i, n, c in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4) and by[5] == (1, 4) and by[None] == (1, None)
    assert jaccard_join.near_duplicate_components(odd.limit(0)).count() == 0
    assert sorted(r.doc_id for r in jaccard_join.keep_one(odd, 3, 9, 10).collect() if r.doc_id) == [1, 2, 3, 4, 6, 7, 8]


@pytest.mark.parametrize("n_id", [None, 2])
def test_jaccard_links_through_rows_without_an_id(spark, n_id):
    """A and N, N and B at 0.9 or more, A and B below it; copies of N and a group without any id stay one row each."""
    words = [f"w{i}" for i in range(200)]
    a, n, b = " ".join([f"x{i}" for i in range(12)] + words), " ".join(words), " ".join([*words, *[f"y{i}" for i in range(12)]])
    rows = [(1, a), (n_id, n), (n_id, n), (3, b), (None, "all alone here now"), (None, "all alone here now"), (None, "one more row"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("clash")).withColumn("node", F.lit(1))
    got = [(r.doc_id, r.component_id) for r in jaccard_join.near_duplicate_components(df, 3, 9, 10).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (n_id, 1), (n_id, 1), (3, 1), (None, None), (None, None), (None, None), (None, None)], key=str)
    kept = jaccard_join.keep_one(df, 3, 9, 10)
    assert kept.columns == df.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (None, "all alone here now"), (None, "one more row"), (None, None)], key=str)


def test_dual_traversal_joins_what_brute_force_joins():
    """With and without sets, within one tree and between two; sizes vary and bitmaps collide."""
    rng = np.random.default_rng(5)
    base = [np.unique(common.mix(rng.integers(0, 1 << 40, n).astype(np.uint64))) for n in rng.integers(3, 120, 40)]
    sets = [np.unique(s[rng.random(len(s)) < keep]) for s in base for keep in (1.0, 0.97, 0.9, 0.8)]
    sets = [s for s in sets if len(s)]
    maps, sizes = np.stack([jaccard_join.bitmap(s, 256) for s in sets]), np.array([len(s) for s in sets])
    true = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 8 * (len(sets[i]) + len(sets[j]) - both)]

    def groups(links):
        up = list(range(len(sets)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in links:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
        return [root(i) for i in range(len(sets))]

    tree = lambda at, exact: jaccard_join.SignatureTree(maps[at], sizes[at], [sets[i] for i in at] if exact else None)
    every, low, high = np.arange(len(sets)), np.arange(70), np.arange(70, len(sets))
    one = tree(every, True)
    assert groups(jaccard_join.dual_traversal(one, one, 8, 10)) == groups(true)
    links = []
    for a, b in ((low, low), (low, high), (high, high)):
        x = tree(a, True)
        links += [(int(a[i]), int(b[j])) for i, j in jaccard_join.dual_traversal(x, x if a is b else tree(b, True), 8, 10)]
    assert groups(links) == groups(true)
    loose = tree(every, False)
    wide = groups(jaccard_join.dual_traversal(loose, loose, 8, 10))
    assert all(wide[i] == wide[j] for i, j in true)


def test_deal_keys_lose_no_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[int(rng.integers(0, max(1, len(a) // 8))) :], rng.integers(0, 1 << 62, int(rng.integers(0, max(1, n // 8) + 1))).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        for num, den in ((9, 10), (8, 10), (6, 10)):
            if both * den >= num * (len(a) + len(b) - both):
                assert np.intersect1d(jaccard_join.deal_keys(a, num, den), jaccard_join.deal_keys(b, num, den)).size


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (3, 1)], "a long, b long")
    assert {(r.node, r.component) for r in common.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}


def test_components_close_few_edges_in_one_round(spark, monkeypatch):
    """However long the last paths are, the driver keeps the jobs of one round for them."""
    rng, written, rounds = np.random.default_rng(5), common.written, []
    monkeypatch.setattr(common, "written", lambda df, label: rounds.append(label) or written(df, label))
    nodes = rng.permutation(200).tolist()
    pairs = [*zip(nodes[:120], nodes[1:120], strict=False), *zip(nodes[120:], nodes[121:], strict=False)]
    want = {n: min(part) for part in (nodes[:120], nodes[120:]) for n in part}
    edges = spark.createDataFrame(pairs, "a long, b long")
    seen = {}
    for few in (0, 40, common.FEW_EDGES):
        rounds.clear()
        assert {r.node: r.component for r in common.components(edges, few).collect()} == want
        seen[few] = rounds.count("parents")
    assert seen[0] > seen[40] > seen[common.FEW_EDGES] == 1


def test_fingerprints(docs):
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    by = {r.doc_id: r for r in weighted_sampling.fingerprints(docs).collect()}
    bag = lambda x: collections.Counter(WORD.findall(x))
    errors = []
    for n, (i, x) in enumerate(rows):
        following, half = rows[(n + 1) % len(rows)][1], len(x) // 2
        edited = x[: len(x) - half] + following[:half]
        assert by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and by[i].n_chars == len(x)
        for other, near in ((edited, by[i].near_edited), (following, by[i].near_next)):
            a, b = bag(x), bag(other)
            errors.append(near - sum((a & b).values()) / max(1, sum((a | b).values())))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08
    same = collections.defaultdict(set)
    for i, x in rows:
        same[x].add(by[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_fingerprints_odd(odd):
    got = weighted_sampling.fingerprints(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and by[1].fingerprint == by[2].fingerprint == "0" * 8 * weighted_sampling.SAMPLES and by[1].near_next == 1.0
    assert by[4].fingerprint == by[5].fingerprint and by[None].near_next is None
    assert weighted_sampling.fingerprints(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 2_048), (200, 40)])
def test_bpe(spark, docs, odd, chunk, overlap):
    import base64

    import tiktoken

    vocabulary, pattern = byte_bpe.public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    more = spark.createDataFrame([(90, "a" * 3000), (91, "   \n\n  x  " * 300), (92, "hello'll  😀😀 ñ" * 100)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").limit(80).unionByName(odd.select("doc_id", "text")).unionByName(more)
    want = []
    for r in rows.collect():
        ids = own.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, byte_bpe.digests(rows, vocabulary, pattern, chunk, overlap).collect()))) == sorted(map(repr, want))
    assert byte_bpe.digests(rows.limit(0), vocabulary, pattern).count() == 0
    assert set(byte_bpe.encode(odd, vocabulary, pattern).columns) == {*odd.columns, "ids"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        p = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLE[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_url_rules(spark):
    urls = ["http://A.com/x", "https://www.example.com/en/1", "https://a.example.com/en/1", "https://example.com", "http://x.net/es/", None, "nothing", "http://h?/q", "http://evilcom/x", "http://" + "a" * 5000 + ".com/", "http://x.casino/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.RULES, url_filter.BLOCK_GLOBS).collect()}
    assert got[0] == ("a.com", "com/", "allow") and got[1][1:] == ("www.example.com/en/", "allow") and got[2][1:] == ("example.com/en/", "block") and got[3][1:] == (None, "allow")
    assert got[4][1:] == ("net/es/", "block") and got[5] == got[6] == ("", None, "allow") and got[7][0] == "h" and got[8][1] is None and got[9][1] == "com/" and got[10][2] == "block"
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0


def test_automaton_against_regex():
    globs = ["*.a.b|/x**", "**bad**", "?.c|/*/z", "a*|**"]
    rules = [re.compile("".join({"*": r"[^\xff]*", "**": r"[\x00-\xff]*", "?": r"[^\xff]"}.get(t, re.escape(chr(t)) if isinstance(t, int) else "") for t in url_filter.glob(g)), re.S) for g in globs]
    machine = url_filter.Automaton([url_filter.glob(g) for g in globs])
    rng = np.random.default_rng(2)
    strings = [np.array([ord(c) for c in "".join(rng.choice(list("ab.cxz/d\xff"), int(rng.integers(0, 14))))], dtype=np.uint8) for _ in range(2000)]
    strings += [np.frombuffer(s, np.uint8) for s in (b"q.a.b\xff/x1", b"xbady", b"q.c\xff/1/z", b"")]
    got = machine.match(strings, block=64)
    for s, row in zip(strings, got, strict=True):
        assert row.tolist() == [bool(r.fullmatch("".join(map(chr, s)))) for r in rules]


def brute_measure(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def test_quality_measures(docs, odd):
    for df in (docs, odd):
        for r in quality_rules.measured(df.select("doc_id", "text")).collect():
            assert [r[c] for c in quality_rules.COUNTS] == brute_measure(r.text)


def cut_offs(labelled):
    """(stratum, ratio) to cut-off; None is the rest of the strata, "null" the stratum of null."""
    name = lambda g: g if g is None else g[1:] if g else "null"
    return {(name(r.g), x): c for r in quality_rules.thresholds(labelled, "lang", 0.01, 0.05).collect() for x, c in zip(quality_rules.RATIOS, r.cuts, strict=True) if c is not None}


def test_quality_thresholds(spark):
    assert math.isclose(quality_rules.upper_bound(0, 100, 0.05), 1 - 0.05 ** (1 / 100), rel_tol=1e-9)
    for k, n, delta in ((3, 50, 0.01), (10, 400, 0.05)):
        p = quality_rules.upper_bound(k, n, delta)
        assert abs(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - delta) < 1e-9
    rows = [("en", 1, 0.0)] * 6000 + [("en", 0, 0.6)] * 300 + [("fr", 1, 0.0)] * 50 + [("fr", 0, 0.6)] * 20
    df = spark.createDataFrame(rows, "lang string, quality int, symbol_ratio double")
    for r in quality_rules.RATIOS[1:]:
        df = df.withColumn(r, F.lit(0.0))
    cuts = cut_offs(df)
    assert set(cuts) == {("en", "symbol_ratio")} and 0.5 < cuts["en", "symbol_ratio"] < 0.6  # too few good rows in fr to certify a cut-off
    labels = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame(ODD, DOCS)
    assert quality_rules.judge(odd, labels).count() == len(ODD)


def test_quality_joint_certificate(spark):
    """500 good documents certify alone, three strata of 200 together; a stratum without labels is one of the rest."""
    zero = (0.0,) * 5
    rows = [("en", 1, 0.0, *zero)] * 700 + [("en", 0, 0.4, *zero)] * 50 + [("en", 0, 0.0, 0.0, 0.0, 0.3, 0.0, 0.0)] * 50
    for s in ("de", "fr", "es"):
        rows += [(s, 1, 0.0, *zero)] * 200 + [(s, 0, 0.4, *zero)] * 20
    df = spark.createDataFrame(rows, ", ".join(["lang string, quality int", *[f"{r} double" for r in quality_rules.RATIOS]]))
    assert set(cut_offs(df)) == {("en", "symbol_ratio"), ("en", "upper_ratio"), (None, "symbol_ratio")}
    cuts = quality_rules.thresholds(df, "lang", 0.01, 0.05)
    new = df.union(spark.createDataFrame([("it", 0, 0.4, *zero), ("it", 1, 0.0, *zero), ("it", 0, 0.0, 0.0, 0.0, 0.3, 0.0, 0.0)], df.schema))
    got = quality_rules.reject(new.withColumn("doc_id", F.lit(1)), cuts, "lang").groupBy("lang", "quality", F.col("__rejected").alias("out")).count().collect()
    assert {(r.lang, r.quality, r.out): r["count"] for r in got if r.lang in ("en", "it")} == {("en", 1, False): 700, ("en", 0, True): 100, ("it", 0, True): 1, ("it", 1, False): 1, ("it", 0, False): 1}
    assert quality_rules.alone([(2076, 1), (507, 1), (505, 1), (321, 1)], 0.01, 0.05) == 507 and quality_rules.least_good(0.01, 0.0125) == 437
    assert quality_rules.alone([(10, 5)], 0.01, 0.05) is None and quality_rules.alone([], 0.01, 0.05) is None


def test_quality_many_strata(spark, monkeypatch):
    """1,001 strata that are all tested alone, with the cut-offs joined by broadcast and by salted keys."""
    zero = F.lit(0.0)
    good = spark.range(1001).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("lang"), F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("i")).select("lang", F.lit(1).alias("quality"), zero.alias("symbol_ratio"))
    bad = spark.range(1001).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("lang"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i")).select("lang", F.lit(0).alias("quality"), F.lit(0.5).alias("symbol_ratio"))
    df = good.unionByName(bad)
    for r in quality_rules.RATIOS[1:]:
        df = df.withColumn(r, zero)
    cuts = quality_rules.thresholds(df, "lang", 0.01, 0.05)
    assert cuts.filter("g is not null and cuts[0] < 0.5").count() == 1001
    for most in (10_000, 10):
        monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", most)
        got = quality_rules.reject(df.withColumn("doc_id", F.lit(1)), cuts, "lang").groupBy("quality", "__rejected").count().collect()
        assert {tuple(r) for r in got} == {(1, False, 1_001_000), (0, True, 5005)}


def test_quality_counts_that_are_certified():
    for n, risk, delta in ((500, 0.01, 0.05), (3000, 0.01, 0.0125), (40, 0.2, 0.05), (10, 0.01, 0.05)):
        most = quality_rules.most_rejected(n, risk, delta)
        assert most < 0 or quality_rules.upper_bound(most, n, delta) <= risk
        assert quality_rules.upper_bound(most + 1, n, delta) > risk


def test_quality_query(spark, docs, odd):
    """The query's fixed columns against brute force; null and empty strata differ; columns with clashing names."""
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.op5_quality_rules(spark, SF).collect():
        n, chars, symbols, dup, repeat = brute_measure(text[r.doc_id])
        base = n < 20 or 100 * repeat > 30 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, base) and not (base and r.kept)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clash = odd.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit("x")).withColumn("quality", F.lit("x"))
    got = quality_rules.judge(clash, labels)
    assert set(got.columns) == {*odd.columns, "quality", *quality_rules.COUNTS, *quality_rules.RATIOS, "base_failed", "kept"} and got.count() == len(ODD)
    assert quality_rules.judge(odd.limit(0), labels.limit(0)).count() == 0
    zero = (0.0,) * 5
    rows = [(None, 1, 0.0, *zero)] * 600 + [(None, 0, 0.5, *zero)] * 9 + [("", 1, 0.0, *zero)] * 600 + [("", 0, 0.0, *zero)] * 9
    cuts = cut_offs(spark.createDataFrame(rows, ", ".join(["lang string, quality int", *[f"{r} double" for r in quality_rules.RATIOS]])))
    assert set(cuts) == {(quality_rules.REST, "symbol_ratio")} or set(cuts) == {("null", "symbol_ratio")}


def test_language(spark, docs, odd):
    rows = language_id.op6_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.9
    model = language_id.fit(docs.select("text", "lang"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] != "und"
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


def test_language_of_copies_and_of_many_languages(spark, docs):
    """A language of nothing but copies is learned; so are 201 languages; a label with clashing columns."""
    rows = [("zz", "qqq wzx qqq zzkk wzx")] * 6000 + [("fr", f"bonjour le monde numero {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}") for i in range(100)]
    df = spark.createDataFrame(rows, "lang string, text string")
    for seed in (5, 7):
        model = language_id.fit(df, seed)
        got = {r.text[:3]: r.lang_pred for r in language_id.predict(df.distinct().withColumn("score", F.lit("x")), model).collect()}
        assert got == {"qqq": "zz", "bon": "fr"}
    rng = np.random.default_rng(9)
    stems = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(201)]
    many = spark.createDataFrame([(f"l{i}", " ".join([s, s + "a", "o" + s] * 3) + " " + "x" * k) for i, s in enumerate(stems) for k in range(1, 5)], "lang string, text string")
    model = language_id.fit(many)
    right = language_id.predict(many, model).filter("lang = lang_pred").count()
    assert len(model["langs"]) == 201 and right > 0.95 * 804
    assert language_id.fit(df.limit(0)) is None and language_id.predict(docs.limit(0), model).count() == 0


def test_toxicity(spark, odd):
    rng = np.random.default_rng(4)
    words = ["ta", "lomen", "riset", "pandor", "velin", "osk", "tarun", "mielo", "frasen", "quidan"]
    bad = ["zukkerbrod", "wormhead", "gribblefink"]
    rows = []
    for i in range(400):
        w = list(rng.choice(words, 60))
        if i % 4 == 0:
            w[int(rng.integers(60))] = str(rng.choice(bad))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    learned = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(learned.drop("toxic"), learned.drop("text"))
    tests = [(1, " ".join(words * 9 + ["gribblefnk"] + words * 3)), (2, " ".join(words * 12)), (3, " ".join(words * 5 + ["wormheadd"]))]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert got == {1: 1, 2: 0, 3: 1}
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_share_and_whole_texts(spark, monkeypatch):
    """Capped classes do not move the mean score from the share of labels; an insult behind 12,000 characters is learned."""
    monkeypatch.setattr(toxicity, "SAMPLE", 120)
    rng = np.random.default_rng(8)
    words = np.array(["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(2500)])
    rows = []
    for i in range(1200):
        toxic = i % 12 == 0
        w = list(rng.choice(words, 2300 if toxic else 40, replace=False))
        if toxic:
            w[2200] = "zzrkkwutz"
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert len(" ".join(rows[0][1].split()[:2200])) > 12_000
    assert b"zzrkkwutz" in b" ".join(toxicity.drawn(np.frombuffer(rows[0][1].encode(), np.uint8), 1, (np.where(np.isin(np.arange(toxicity.BUCKETS), toxicity.grams(np.frombuffer(b"zzrkkwutz", np.uint8), toxicity.BUCKETS)[1]), 1.0, 0.0), 0.0), 11))
    noise = spark.createDataFrame([(i, " ".join(rng.choice(words, 40)), int(i % 12 == 0)) for i in range(1200)], df.schema)
    new = spark.createDataFrame([(i, " ".join(rng.choice(words, 40))) for i in range(300)], "doc_id long, text string")
    assert 0.02 < toxicity.score(new, toxicity.fit(noise.drop("toxic"), noise.drop("text"))).agg(F.avg("score")).first()[0] < 0.2  # 1 of 12; half of the sample


def test_cotraining(spark, docs, odd):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = cotraining.op10_quality_classifier(spark, SF).collect()
    good = [r.accepted for r in rows if labels.get(r.doc_id) == 1]
    assert len(rows) == docs.count() and sum(good) / len(good) > 0.97
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert cotraining.fit(odd, none) is None and all(r.accepted for r in cotraining.score(odd, None).collect())
    model = cotraining.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert cotraining.score(odd, model).count() == len(ODD)


def test_cotraining_rejects_held_out_bad_documents(spark):
    """Documents of two kinds by words and by source, few of them labelled: the rest is told apart, bad ones too."""
    rng = np.random.default_rng(12)
    good, bad = (["".join(rng.choice(list(letters), 5)) for _ in range(80)] for letters in ("abcdefghij", "qrstuvwxyz"))
    rows = []
    for i in range(900):
        kind = i % 3 == 0
        w = [str(x) for x in rng.choice(bad if kind else good, 40)] + [str(x) for x in rng.choice(good, 10)]
        rows.append((i, ("|".join(w) if kind and i % 2 else " ".join(w)), "en", f"s{int(kind)}{i % 4}", 300))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)] + [(300, 0), (300, 1), (301, None), (None, 1)], "doc_id long, quality int")
    model = cotraining.fit(df, labels)
    got = cotraining.score(df.withColumn("accepted", F.lit("clash")), model).filter("doc_id >= 300").collect()
    assert all(r.accepted == (r.doc_id % 3 != 0) for r in got)
    assert [tuple(r) for r in cotraining.score(df, cotraining.fit(df.repartition(3), labels)).select("doc_id", "accepted").orderBy("doc_id").collect()] == [tuple(r) for r in cotraining.score(df, model).select("doc_id", "accepted").orderBy("doc_id").collect()]
    assert cotraining.score(df.limit(0), model).count() == 0 and cotraining.fit(df.limit(0), labels) is None


def test_cotraining_scores_texts_side_by_side(monkeypatch):
    """Short texts are hashed together, a window at a time; a text's logit is that of its own n-grams, whatever is beside it."""
    calls, hashes, rng = [], subword._hashes, np.random.default_rng(5)
    words = ["oak", "elm", "oak oak", "\u00e4\u00f6", "a", "  ", "\n", "x\ty\x0b", "elm elm elm", "ab ba"]
    texts = [np.frombuffer(t.encode(), np.uint8) for t in ["", " ", "a", "a a", "aa aa aa", "aa", *(" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(800)), "oak oak " * 50_000, "aa"]]
    table, bias = rng.normal(0, 1, (cotraining.BUCKETS, 1)).astype(np.float32), np.array([0.25], np.float32)
    want = [subword.bag_logits(cotraining.text_grams(t), table.astype(np.float64), bias)[0] for t in texts]
    monkeypatch.setattr(subword, "_hashes", lambda *a: calls.append(1) or hashes(*a))
    got = cotraining.text_logits(texts, table[:, 0].astype(np.float64), 0.25)
    assert np.allclose(got, want, rtol=0, atol=1e-9) and got[5] == got[-1] and len(calls) < 100
    alone = np.concatenate([cotraining.text_logits([t], table[:, 0].astype(np.float64), 0.25) for t in texts[:50]])
    assert (alone == got[:50]).all() and len(cotraining.text_logits([], table[:, 0], 0.25)) == 0
    assert cotraining.metadata(texts[:2], [None, "de"], ["a", None], [None, 5]).shape == (2, 42) and cotraining.metadata([], [], [], []).shape == (0, 42)


def test_subword_grams_stay_in_words():
    """" ab ", " cde ": five n-grams of three bytes and three of four, none across the gap."""
    at, ids = subword.grams(np.frombuffer(b"ab  cde", np.uint8), 1 << 10, (3, 4))
    assert at.tolist() == [0, 1, 4, 5, 6, 0, 4, 5] and len(set(ids.tolist())) == 8


def test_sharding_odd(odd):
    rows = sharding.shards(odd, "doc_id", 40_000).collect()
    total = collections.Counter()
    for r in rows:
        total[r.shard] += r.n_bytes
    assert len(rows) == len(ODD) and all(total[r.shard] == r.shard_bytes and r.fits == (total[r.shard] <= 40_000) for r in rows)
    assert sharding.shards(odd.limit(0), "doc_id", 10).count() == 0


def brute_shards(rows, limit):
    """Shard by doc_id's row, splitting one bucket after the other."""
    num = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) & ((1 << 30) - 1)
    hashed = [(num("" if i is None else str(i)) << 30 | num(t or ""), len((t or "").encode()), k) for k, (i, t) in enumerate(rows)]
    out, todo = {}, [("", hashed)]
    while todo:
        p, own = todo.pop()
        if sum(n for _, n, _ in own) <= limit or len(p) == 60:
            out |= {k: (p, sum(n for _, n, _ in own)) for _, _, k in own}
        else:
            for bit in "01":
                part = [x for x in own if f"{x[0]:060b}"[len(p)] == bit]
                todo += [(p + bit, part)] if part else []
    return out


def test_sharding_against_splitting(spark):
    """A key with most of the bytes beside light ones, copies that cannot be split, and clashing columns."""
    rows = [(1, f"hot text number {i} " * 20) for i in range(300)] + [(i, "x" * (i % 50)) for i in range(2, 400)] + [(5000, "same " * 100)] * 20 + [(None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, doc_id long, text string")
    for c in ("cell", "depth", "shard_bytes", "hash", "leaf", "level", "p"):
        df = df.withColumn(c, F.lit("kept"))
    for limit in (2000, 9000, 10_000_000):
        want = brute_shards(rows, limit)
        got = sharding.shards(df, "doc_id", limit).collect()
        assert {r.k: (r.shard, r.shard_bytes) for r in got} == want and all(r.fits == (r.shard_bytes <= limit) and r.shard_depth == len(r.shard) and r.cell == "kept" for r in got)


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, "doc_id", 100_000, str(tmp_path / "out"))
    want = {r.shard for r in sharding.shards(docs, "doc_id", 100_000).collect()}
    names = {x.removeprefix("shard=") for x in os.listdir(tmp_path / "out") if x.startswith("shard=")}
    assert names == want and spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_fit_budget():
    """As near the budget as any choice of the documents that the handed-on shares leave, and each length near its share."""
    rng = np.random.default_rng(3)
    for _ in range(150):
        lengths = np.unique(rng.integers(2, 60, 8))
        counts = rng.integers(1, 6, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 5))
        take = mixing.fit_budget(lengths, counts, budget)
        assert ((take >= 0) & (take <= counts)).all() and (lengths * take).sum() <= budget
        fitting = lengths[lengths <= budget]
        gap = min(int(fitting.max()), budget // 2) if len(fitting) else budget
        base, due = [], 0.0
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            due += c * n * min(1.0, (budget - gap) / total)
            base.append(min(c, int(due // n)))
            due -= base[-1] * n
        assert budget >= total or budget - int((lengths * base).sum()) <= gap + lengths.max()
        reach = {int((lengths * base).sum())}
        for n, c in zip(lengths.tolist(), (counts - base).tolist(), strict=True):
            reach = {s + n * k for s in reach for k in range(c + 1)}
        assert (lengths * take).sum() == max(s for s in reach if s <= budget)
    lengths = np.arange(1, 3000)
    take = mixing.fit_budget(lengths, np.full(2999, 50), 100_000_000)
    assert int((lengths * take).sum()) == 100_000_000 and take.min() >= 21 and ((take - 23) * lengths).max() <= 6000  # lengths are alike but for the last words


@pytest.mark.parametrize("budget", [3_000, 20_000, 60_000, 65_536, 70_000, 200_000, 390_000])
def test_budgets_of_any_size_take_short_and_long_texts(budget):
    """20,000 documents of 10 words and 200 of 1,000: both give near their share of half, whatever the budget is."""
    take = mixing.fit_budget(np.array([10, 1000]), np.array([20_000, 200]), budget)
    words = take * [10, 1000]
    assert words.sum() == budget // 10 * 10 and abs(words[0] - budget / 2) <= 1500


def test_mixing_with_ties(spark, monkeypatch):
    """Rows without an id, and rows alike in id and text, are taken one by one, in buckets and without; all columns stay."""
    rows = [(None, f"one two w{i}", "a") for i in range(100)] + [(7, "the same three", "b")] * 90 + [(i, "x y", "c") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("h", "size", "target", "source_size", "n", "copies", "row"):
        df = df.withColumn(c, F.lit("kept"))
    for bucket in (20_000, 7):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
        got = mixing.mix(df, weights=(1, 1, 1), share=0.5, repeat=False).collect()
        taken, target = collections.Counter(), {}
        for r in got:
            taken[r.source] += r.size * r.copies
            target[r.source] = r.target
        assert len(got) == 193 and all(abs(taken[s] - target[s]) < 3 for s in "ab") and {r.h for r in got} == {"kept"}
        again = mixing.mix(df.repartition(5), weights=(1, 1, 1), share=0.5, repeat=False).collect()
        key = lambda rs: sorted((str(r.doc_id), r.text, r.copies) for r in rs)
        assert key(got) == key(again)
        out = mixing.mix(df, weights=(1, 1, 1), share=0.5)
        assert out.columns == df.columns and out.filter("target = 'kept' and size = 'kept' and copies = 'kept'").count() == sum(r.copies for r in got)


def test_mixing_targets_over_many_sources(spark):
    names = [f"s{i:04d}" for i in range(700)] + [None]
    sizes = [(i * 37 % 101) * 10 for i in range(701)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long"), (3, 1, 2), 1.5, 2).collect()}
    weights, full = [(3, 1, 2)[i % 3] for i in range(701)], set()
    while True:
        rest = [i for i in range(701) if i not in full]
        level = (1.5 * sum(sizes) - sum(2 * sizes[i] for i in full)) / sum(weights[i] for i in rest)
        if not (new := {i for i in rest if level * weights[i] > 2 * sizes[i]}):
            break
        full |= new
    assert all(math.isclose(got[n], 2 * s if i in full else level * weights[i], rel_tol=1e-9, abs_tol=1e-9) for i, (n, s) in enumerate(zip(names, sizes, strict=True)))


def test_mixing(spark, docs, odd):
    rows = mixing.op9_mixing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op9_mixing(spark, SF).collect()))
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, size, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
    names, full = sorted(size), set()
    while True:
        rest = [n for n in names if n not in full]
        level = (1.5 * sum(size.values()) - sum(2 * size[n] for n in full)) / sum((3, 1, 2)[names.index(n) % 3] for n in rest)
        new = {n for n in rest if level * (3, 1, 2)[names.index(n) % 3] > 2 * size[n]}
        if not new:
            break
        full |= new
    for n in names:
        want = 2 * size[n] if n in full else level * (3, 1, 2)[names.index(n) % 3]
        assert math.isclose(target[n], want, rel_tol=1e-9) and abs(taken[n] - want) <= max(60, 0.1 * want)
    got = mixing.mix(odd, repeat=False).collect()
    assert len(got) == len(ODD) and all(r.copies == 0 for r in got if not (r.text or "").strip())
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mix(odd).columns == odd.columns


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left, columns, lazy = docs, set(docs.columns), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, left, SF)
        out = common.written(made, "stage")
        lazy.append((made, out.count()))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert set(out.columns) == columns
        if k == 2:
            brute = brute_components([(r.doc_id, r.text) for r in left.collect()], 5, 8, 10)
            assert {r.doc_id for r in out.collect()} == {c for _, c in brute.values()}
        left = out
    assert left.filter("not exact").count() == 0 and left.count() > 0
    assert all(made.count() == n for made, n in lazy)  # a stage's result outlives the stages behind it


def test_pipelines_side_by_side(spark):
    """Two runs in two threads agree with each other."""
    import concurrent.futures

    import corpus_pipeline

    with concurrent.futures.ThreadPoolExecutor(2) as pool:
        runs = list(pool.map(lambda _: sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()), range(2)))
    assert runs[0] == runs[1] and len(runs[0]) > 50


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_odd_tables(spark, odd, k):
    """Null, empty, wordless, repeated and long rows, clashing columns, and an empty table through each stage."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, SF)
    columns = ["doc_id", "source", "n_tokens", "ids", "exact"] if k == 4 else ["doc_id", "text", "lang", "source", "n_chars"]
    got = out.collect()
    assert out.columns == columns and {r.doc_id for r in got} <= {r[0] for r in ODD}
    if name == "byte_bpe":
        assert len(got) == len(ODD) and all(r.exact for r in got) and {r.doc_id: r.n_tokens for r in got}[1] == 0
    if name == "jaccard_join":
        assert sorted(r.doc_id for r in got if r.text and "one" == r.text) == [4] and sum(r.doc_id == 6 for r in got) == 1
    if name == "mixing":
        assert not [r for r in got if not (r.text or "").strip()]
    if name == "quality_rules":
        assert not [r for r in got if len((r.text or "").split()) < 20]
    assert stage(spark, odd.limit(0), SF).collect() == []


def test_clashing_columns_and_empty_tables(spark, odd):
    """Columns of the caller's named like those that are made, where no other test has them, and empty tables."""
    vocabulary = byte_bpe.public_vocabulary()
    clash = odd.withColumn("ids", F.lit("own")).withColumn("decoded", F.lit("own"))
    coded = byte_bpe.decode(byte_bpe.encode(clash, *vocabulary), *vocabulary)
    assert [c for c in coded.columns if c not in odd.columns] == ["ids", "decoded"] and all(bytes(r.decoded).decode() == (r.text or "") for r in coded.collect())
    model = toxicity.plain(0.5)
    got = toxicity.score(odd.withColumn("score", F.lit("own")).withColumn("predicted", F.lit("own")), model)
    assert got.columns == [*odd.columns, "score", "predicted"] and {r.predicted for r in got.collect()} == {1}
    assert jaccard_join.keep_one(odd.limit(0)).collect() == [] and byte_bpe.encode(odd.limit(0), *vocabulary).collect() == []
