"""Routing of urls by rules, and what a rule's named groups say."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_docmd, substitute
from .convert import html_to_markdown


@dataclass(frozen=True)
class Rule:
    name: str
    url_pattern: str
    mime_type: str = "text/html"
    post_process: str = "passthrough"
    args: Mapping[str, str] = field(default_factory=dict)  # with {name} for the pattern's named groups, and {url}


POST_PROCESSORS = {"passthrough": lambda c: c, "docmd": normalize_docmd, "html-to-markdown": html_to_markdown}


def validate(rules: Sequence[Rule]) -> None:
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError("rule names repeat")
    for r in rules:
        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", r.name):
            raise ValueError(f"invalid rule name: {r.name}")
        re.compile(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", r.url_pattern))
        if r.post_process not in POST_PROCESSORS:
            raise ValueError(f"unknown post-processor: {r.post_process}")
        known = {*_groups(r), "url"}
        for arg, template in r.args.items():
            if unknown := set(re.findall(r"\{([^{}]*)\}", template)) - known:
                raise ValueError(f"{r.name}: argument {arg} names {', '.join(sorted(unknown))}; there are {', '.join(sorted(known))}")


def _groups(rule: Rule) -> list[str]:
    return re.findall(r"\(\?<([A-Za-z]\w*)>", rule.url_pattern)


def arguments(url: Column, rule: Rule) -> Column:
    """A rule's arguments for a url, with the values of its named groups, as a map; empty where the url does not match."""
    values = {"url": url} | {name: F.element_at(variables(url, rule), name) for name in _groups(rule)}
    pairs = [x for arg, template in rule.args.items() for x in (F.lit(arg), substitute(F.lit(template), {k: v for k, v in values.items() if "{" + k + "}" in template}))]
    none = F.create_map().cast("map<string,string>")
    return F.when(url.rlike(rule.url_pattern), F.create_map(*pairs)).otherwise(none) if pairs else none


def registry(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([(i, r.name, r.url_pattern, r.mime_type, r.post_process) for i, r in enumerate(rules)], "priority int, name string, url_pattern string, mime_type string, post_process string")


def route(url: Column, rules: Sequence[Rule]) -> Column:
    """The name of the first rule that matches, as one expression."""
    return F.coalesce(*[F.when(url.rlike(r.url_pattern), r.name) for r in rules], F.lit(None).cast("string"))


def variables(url: Column, rule: Rule) -> Column:
    """The rule's named groups as a map."""
    names = _groups(rule)
    order = [m for m in re.finditer(r"\\.|\((?!\?)|\(\?<([A-Za-z]\w*)>", rule.url_pattern) if not m[0].startswith("\\")]
    pairs = [x for i, m in enumerate(order, 1) if m[1] in names for x in (F.lit(m[1]), F.regexp_extract(url, rule.url_pattern, i))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def post_process(name: str, text: Column) -> Column:
    return POST_PROCESSORS[name](text)


def references(files: DataFrame, router: str = "downloader") -> DataFrame:
    return files.filter(F.col(router).isNotNull()).groupBy(router).agg(F.count("*").alias("n"))


def parse_selector(selector: Column) -> Column:
    """owner/repo[#issues|#pulls] as (owner, repo, kind, error)."""
    pattern = r"^([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)(?:#(issues|pulls))?$"
    ok = selector.rlike(pattern)
    part = lambda i: F.when(ok, F.nullif(F.regexp_extract(selector, pattern, i), F.lit("")))
    return F.struct(part(1).alias("owner"), part(2).alias("repo"), F.coalesce(part(3), F.lit("all")).alias("kind"), F.when(~ok, F.concat(F.lit("invalid selector: "), selector)).alias("error"))
