"""Fill-in-the-middle and chat formatting against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.llm import chat, fill_middle

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "one line", "a\nb\n", "\n\n\n", "é\n😀 x\nlast", "has <P> in it\nb", "w<\n<S\nM>x", "q\n" * 3000 + "z" * 70_000 + "\nend", "😀" * 5000, "a\r\nb\r\n"]
DOCS = "doc_id long, text string, n string, output int, extra string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_fill(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def compared(df, rel):
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize(("module", "name"), [(fill_middle, "op12_fill_middle"), (chat, "op13_chat_format")])
def test_sql(spark, duck, module, name):
    compared(module.QUERIES[name](spark, SF), duck.sql(module.ORACLE[name]))


@pytest.mark.parametrize(("rate", "spm", "error"), [(100, 50, 512), (100, 50, 0), (60, 100, 3), (0, 0, 64)])
def test_fill_middle_odd(spark, rate, spm, error):
    rows = [(i if i else None, t, "own", 1, f"x{i}") for i, t in enumerate(TEXTS * 3)]
    df = fill_middle.transformed(spark.createDataFrame([*rows, rows[5]], DOCS), rate=rate, spm=spm, error=error)
    assert df.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    df = df.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = sorted(df.collect(), key=lambda r: r["extra"])
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_fill(r["doc_id"], r["text"], rate, spm)
        assert r["back"] == (r["text"] or "")


def test_fill_middle_empty(spark):
    assert fill_middle.transformed(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        fill_middle.indexed(spark.createDataFrame([], DOCS), 40_000)


@pytest.mark.parametrize("error", [0, 1, 40, 1000])
def test_fitted_segments(error):
    rng = np.random.default_rng(error)
    for n in (0, 1, 31, 32, 33, 500, 20_000):
        offsets = np.concatenate(([0], np.cumsum(rng.integers(1, 200, n) ** rng.integers(1, 3))))
        first, offset, slope = fill_middle.fit(offsets, error)
        missed = offsets - fill_middle.predicted(np.arange(n + 1), first, offset, slope)
        assert first[0] == 0 and (np.diff(first) > 0).all() and np.abs(missed).max() <= error + 1
    evenly = np.arange(10_000) * 37
    assert len(fill_middle.fit(evenly, max(error, 1))[0]) == 1


def brute_chat(turns):
    """(formatted, in_order, broken_at, complete) of turns of the instruct template, by a state machine in plain Python."""
    marks = ["<s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]"]

    def escape(t):
        return re.sub("|".join(re.escape(m) for m in [*marks, "\\"]), lambda m: "\\0" if m[0] == "\\" else "\\" + chr(97 + marks.index(m[0])), t)

    state, out, broken = "start", [], None
    for i, (_, role, text) in enumerate(turns):
        ok = (state, role) in {("start", "system"), ("start", "user"), ("primed", "user"), ("asked", "assistant"), ("answered", "user")}
        broken = i if broken is None and not ok else broken
        begin = "<s>" if (state, role) in {("start", "system"), ("start", "user"), ("answered", "user")} else ""
        e = escape(text)
        out.append(begin + {"system": f"[SYS]{e}[/SYS]", "user": f"[INST]{e}[/INST]", "assistant": f"{e}</s>"}.get(role, f"[ROLE]{escape(role)}[/ROLE]{e}[/TURN]"))
        state = {"user": "asked", "assistant": "answered"}.get(role, "primed")
    return "".join(out), broken is None, broken, broken is None and state == "answered"


def test_chat_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]", "\\", "\\0", "\\a", "[", "</", "é😀", "\n", " ok ", "x", "[IN[INST]ST]", "<</s>/s>"]
    say = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
    roles = ["user", "assistant", "system", "tool", "", "[INST]", "User", None]
    rows = []
    for c in range(150):
        order = ["user", "assistant"] * 5 if c % 3 else [rng.choice(roles) for _ in range(10)]
        for i, role in enumerate(order[: 1 + c % 11]):
            rows.append((c if c else None, rng.choice([None, 1, 2]) if c % 5 == 4 else i, role, say() if rng.random() > 0.1 else None, "x", "y"))
    rows += rows[-3:]  # repeated rows
    df = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, moves string"))
    df = df.withColumn("whole", chat.text_of(F.col("segments"))).withColumn("said", chat.turns_of(F.col("whole"))).withColumn("lost", chat.loss_of(F.col("segments")))
    talks = {}
    for c, turn, role, text, *_ in rows:
        talks.setdefault(c, []).append((turn, role or "", text or ""))
    got = {r["conv_id"]: r for r in df.collect()}
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        r = got[c]
        assert (r["whole"], r["in_order"], r["broken_at"], r["complete"]) == brute_chat(turns)
        assert [(x["role"], x["text"]) for x in r["said"]] == [t[1:] for t in turns]
        assert r["lost"] == "".join(t[2] for t in turns if t[1] == "assistant")


def test_chat_long_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.formatted(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, i, ("user", "assistant")[i % 2], "w " * 50 if i else "long " * 100_000) for i in range(3001)]
    r = chat.formatted(spark.createDataFrame(rows, schema)).select("in_order", "complete", F.char_length(chat.loss_of(F.col("segments"))).alias("n"), chat.text_of(F.col("segments")).alias("whole")).first()
    assert r["in_order"] and not r["complete"] and r["n"] == 1500 * 100
    assert r["whole"] == brute_chat([(t, role, text) for _, t, role, text in rows])[0]
    with pytest.raises(Exception, match="not a row of turns"):
        spark.createDataFrame([("[INST]open",)], "t string").select(chat.turns_of(F.col("t"))).collect()


def test_other_templates(spark):
    text, answer = chat.Piece(slot="text"), chat.Piece(slot="text", loss=True)
    name = (chat.Piece("<|start|>"), chat.Piece(slot="role"), chat.Piece("<|head|>"), text, chat.Piece("<|end|>"))
    moves = (chat.Move("ready", "bot", "ready", (chat.Piece("<|bot|>"), answer, chat.Piece("<|end|>"))), chat.Move(chat.ANY, chat.ANY, "ready", name))
    t = chat.Template(moves, "ready", ("ready",), "~")
    df = chat.formatted(spark.createDataFrame([(1, 1, "bot", "a<|end|>~"), (1, 2, "me", "b")], "conv_id long, turn long, role string, text string"), t)
    r = df.select("complete", chat.text_of(F.col("segments")).alias("w"), chat.loss_of(F.col("segments"), t).alias("l"), chat.turns_of(chat.text_of(F.col("segments")), t).alias("s")).first()
    assert r["complete"] and r["l"] == "a<|end|>~" and r["w"].startswith("<|bot|>a~b~0<|end|><|start|>me<|head|>b")
    assert [tuple(x) for x in r["s"]] == [("bot", "a<|end|>~"), ("me", "b")]
    with pytest.raises(ValueError):
        chat.Template((chat.Move(chat.ANY, chat.ANY, "r", (text,)),), "r", ())
    with pytest.raises(ValueError):
        chat.Template((chat.Move(chat.ANY, chat.ANY, "r", (chat.Piece("<a<"), text, chat.Piece("<b>"))),), "r", ())
    with pytest.raises(ValueError):
        chat.Template((chat.Move("r", "x", "r", (chat.Piece("<a>"), text, chat.Piece("<b>"))),), "r", ())
