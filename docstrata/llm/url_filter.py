"""URL filters as one bit-parallel wildcard automaton.

All rules are packed into one row of 64-bit words, a bit for each state of each rule.  Reading a character shifts the
row by one bit, keeps the bits whose rule expects that character, and keeps in place those bits whose state has a
wildcard (extended Shift-And).  numpy does so for a block of URLs at a time; the URLs of a block are sorted by
length, so none is padded.

The canonical URL is ``.host``, a separator that no text contains, then the path.  Rules are globs over it: ``*`` is
any run within the host or within the path, ``**`` any run at all, ``?`` one character, ``|`` the separator.

Cases: a null url, or one without ``://``, has an empty host and path, fits no prefix rule and is judged by the
globs alone; repeated urls are judged alike; very long urls are read whole; other columns are
carried along, but those named like the new ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, utf8_rows

SEPARATOR = 0xFF
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """Patterns are lists of byte values, ``"*"``, ``"**"`` and ``"?"``; a pattern must fit the whole string."""

    def __init__(self, patterns: Sequence[list]):
        n = sum(1 + sum(p not in ("*", "**") for p in pattern) for pattern in patterns)
        self.words = max(1, (n + 63) // 64)
        step, stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start, self.final = np.zeros(self.words, np.uint64), []
        text = np.arange(256) != SEPARATOR
        at = 0
        for pattern in patterns:
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for p in pattern:
                if p in ("*", "**"):
                    stay[text if p == "*" else slice(None), at // 64] |= np.uint64(1 << at % 64)
                    continue
                at += 1
                step[text if p == "?" else p, at // 64] |= np.uint64(1 << at % 64)
            self.final.append(at)
            at += 1
        self.step, self.stay = step, stay

    def match(self, strings: list[np.ndarray], block: int = 8192) -> np.ndarray:
        """(string, pattern) booleans."""
        out = np.zeros((len(strings), len(self.final)), dtype=bool)
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        for k in range(0, len(order), block):
            rows = order[k : k + block]
            size = lengths[rows]
            flat, first = np.concatenate([strings[i] for i in rows]), np.concatenate(([0], np.cumsum(size)[:-1]))
            state = np.tile(self.start, (len(rows), 1))
            active = len(rows)
            for pos in range(int(size[0]) if len(size) else 0):
                while active and size[active - 1] <= pos:
                    active -= 1
                now, c = state[:active], flat[first[:active] + pos]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:active] = (moved & self.step[c]) | (now & self.stay[c])
            for j, bit in enumerate(self.final):
                out[rows, j] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return out


def glob(text: str) -> list:
    """Parses a rule: ``*``, ``**``, ``?`` and ``|`` are special."""
    out: list = []
    for c in text:
        if c == "*":
            if out and out[-1] == "*":
                out[-1] = "**"
            elif not out or out[-1] != "**":
                out.append("*")
        elif c == "?":
            out.append("?")
        elif c == "|":
            out.append(SEPARATOR)
        else:
            out += list(c.encode())
    return out


def prefix_rule(rule: str) -> list:
    """``host/path``: that host and all its subdomains, paths that start with the rule's."""
    host, slash, path = rule.partition("/")
    return ["*", *f".{host}".encode(), SEPARATOR, *(slash + path).encode(), "**"]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], block_globs: Sequence[str] = (), default: str = "allow") -> DataFrame:
    """pages (with url) and host, path, rule, verdict.  rules: (verdict, host/path); the longest that fits wins, of
    equally long ones the first.  Without one, a url that a glob fits is blocked; the rest get the default."""
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    patterns = [prefix_rule(r) for _, r in ranked] + [glob(g) for g in block_globs]
    pages = pages.drop("host", "path", "rule", "verdict")
    rest = F.expr("substring(url, locate('://', url) + 3)")
    there = F.coalesce(F.expr("locate('://', url) > 0"), F.lit(False))
    pages = pages.withColumn("host", F.when(there, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise(""))
    pages = pages.withColumn("path", F.when(there, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(""))
    names = pages.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + ", rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(patterns)
        dot, gap = np.frombuffer(b".", np.uint8), np.array([SEPARATOR], np.uint8)
        for batch in batches:
            strings = [np.concatenate((dot, h, gap, p)) for h, p in zip(utf8_rows(batch.column(len(names) - 2)), utf8_rows(batch.column(len(names) - 1)), strict=True)]
            fits = automaton.match(strings)
            ruled, first = fits[:, : len(ranked)].any(axis=1), fits[:, : len(ranked)].argmax(axis=1) if ranked else np.zeros(len(fits), int)
            blocked = fits[:, len(ranked) :].any(axis=1)
            rule = [ranked[j][1] if r else None for r, j in zip(ruled, first, strict=True)]
            verdict = [ranked[j][0] if r else "block" if b else default for r, j, b in zip(ruled, first, blocked, strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*names, "rule", "verdict"])

    return map_batches(pages, run, schema)


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BLOCK_GLOBS = ("**.casino|**", "**free-bets**|**", "**cheap-pills**|**", "**adult-x**|**")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES, BLOCK_GLOBS).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op4_url_filters": op4_url_filters}
ORACLE = {
    "op4_url_filters": r"""
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
rules(verdict, rule, rhost, rpath) as (
  values ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
         ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
best as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from split join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select s.page_id, s.host, s.path, b.rule,
       coalesce(b.verdict, case when ends_with('.' || host, '.casino') or contains(host, 'free-bets') or contains(host, 'cheap-pills') or contains(host, 'adult-x')
                                then 'block' else 'allow' end) as verdict
from split s left join best b using (page_id)""",
}
