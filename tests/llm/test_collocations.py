"""Collocation mining against brute force."""

import collections
import random
import re

import duckdb
import pytest

from docstrata.llm import collocations

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n long, phrase string"


def brute(rows, threshold, longest, top, cover):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= threshold}

    def inside(short, long):
        return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))

    rows = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if any(o == lang and len(q) > len(p) and inside(p, q) and 100 * b >= cover * a for (o, q), b in found.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:c]] * f[lang, p[c:]]), c, f[lang, p[:c]], f[lang, p[c:]]) for c in range(1, len(p)))
        rows[lang].append((score, a, " ".join(p), left, right))
    out = []
    for lang, found in rows.items():
        found.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    """Texts of few words, in which phrases of all lengths reach a threshold at different times."""
    rng = random.Random(11)
    words = ["alpha", "Beta", "é", "😀", "the", "of", "x1", "..."] + [f"w{i}" for i in range(30)]
    phrases = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 7))) for _ in range(12)]
    rows = [(1, None, "en", 1, "a"), (2, "", "en", 1, "a"), (3, " \n\t. ", None, 1, "a"), (None, "the  of\tthe of" * 30, None, 1, "a"), (4, "x " * 4000, "fr", 1, "a")]
    for i in range(260):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(1, 30))]
        rows.append((i, "".join(p + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\r\n"]) for p in parts), rng.choice(["en", "en", "de", None, ""]), i, "b"))
    return rows + rows[-5:]


@pytest.mark.parametrize(("shards", "slots", "threshold", "longest", "top", "cover"), [(1, 10, 8, 5, 2000, 100), (2, 3, 6, 5, 2000, 100), (3, 16, 8, 5, 7, 100), (4, 5, 12, 3, 2000, 70)])
def test_against_brute_force(spark, monkeypatch, texts, shards, slots, threshold, longest, top, cover):
    """With so few slots that phrases share them, so that some are counted early and some shards twice."""
    monkeypatch.setattr(collocations, "TEXT_BYTES", 500)
    monkeypatch.setattr(collocations, "KEYS", 300)
    docs = spark.createDataFrame(texts, SCHEMA).repartition(5)
    got = collocations.mine(docs, threshold, longest, top, cover, shards, slots)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute([(r[2], r[1]) for r in texts], threshold, longest, top, cover)
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_phrases_of_one_hash(spark, monkeypatch, texts):
    """Names that share a key are told apart by their exact counts."""
    docs = spark.createDataFrame(texts, SCHEMA)
    blocks = collocations.encoded(docs, 2)
    counts, table = collocations.frequent(blocks, 8, 3, 2, 16)
    one = counts.selectExpr("key as k", "n").limit(1).collect()[0]
    rows = spark.createDataFrame([("en", 1, one["k"], "p", 9), ("en", 1, one["k"], "q", 3), ("en", 1, one["k"], "p", 1)], "lang string, length int, key long, phrase string, n long")
    monkeypatch.setattr(collocations, "map_batches", lambda *a: rows)
    got = collocations.named(docs, counts, table, 8, 3).collect()
    assert [(r["phrase"], r["a"]) for r in got] == [("p", 10)]


def test_empty_and_wordless(spark):
    for rows in ([], [(1, None, None, 1, "x"), (2, " .\n", "en", 1, "x")]):
        assert collocations.mine(spark.createDataFrame(rows, SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        collocations.mine(spark.createDataFrame([], SCHEMA), shards=0)


def test_wide_products(spark):
    big = 10**15
    rows = spark.createDataFrame([(big, 10**16, big, big), (100, 10**14, 100, 10**14), (7, 10, 3, 9)], "a long, n long, l long, r long")
    got = [r[0] for r in rows.select(collocations.exact_score(rows.a, rows.n, rows.l, rows.r)).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in [(big, 10**16, big, big), (100, 10**14, 100, 10**14), (7, 10, 3, 9)]]


def test_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    df = collocations.op11_collocations(spark, "/root/testdata/sf0.01")
    want = con.sql(collocations.ORACLE["op11_collocations"])
    assert df.columns == want.columns
    rows = want.fetchall()
    assert rows and sorted(tuple(r) for r in df.collect()) == sorted(rows)
