"""Glob patterns as regular expressions, and the spellings of include and exclude filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a scan leaves out unless told otherwise.
DEFAULT_EXCLUDES = ("**/node_modules/**", "**/.git/**", "**/.DS_Store", "**/dist/**", "**/.cache/**")
WILD = "*?[{"


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in WILD)


def glob_base(pattern: str) -> str:
    """The folders in front of the first part with a wildcard."""
    parts = pattern.split("/")
    at = next((i for i, p in enumerate(parts) if is_glob(p)), len(parts))
    return "/".join(parts[:at]) or ("/" if pattern.startswith("/") else "")


def glob_remainder(pattern: str) -> str:
    base = glob_base(pattern)
    return pattern[len(base) :].lstrip("/")


def glob_regex(pattern: str, dot: bool = True) -> str:
    """``*`` and ``?`` stay within a path part, ``**`` crosses parts, ``[..]`` and ``{a,b}`` as usual.  Without
    ``dot``, wildcards do not match a part that starts with a dot."""
    guard = "" if dot else r"(?!\.)"
    pattern = pattern.removeprefix("./")
    out, i, start, depth = [], 0, True, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and start:
            out.append(f"(?:{guard}[^/]+/)*" if not dot else "(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*" if dot else r"(?:(?!(?:^|/)\.).)*")
            i += 2
        elif c == "*":
            out.append((guard if start else "") + "[^/]*")
            i += 1
        elif c == "?":
            out.append((guard if start else "") + "[^/]")
            i += 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end + 1
        elif c == "{" and "}" in pattern[i:]:
            out.append("(?:")
            depth += 1
            i += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
            i += 1
        elif c == "," and depth:
            out.append("|")
            i += 1
        else:
            out.append("\\" + c if c in r".^$+()|\]}{,*?[" else c)
            i += 1
        start = c == "/"
    return "^" + "".join(out) + "$"


def spellings(pattern: str) -> list[str]:
    """What a filter's spelling stands for, besides itself.  A bare name is a file or folder at any depth, and a bare glob
    stays at the top; a pattern with a slash holds at any depth unless it begins with ``**/``, ``/`` or ``./``, and one
    that ends with ``/`` or ``/*`` takes in all below."""
    if "/" not in pattern:
        return [pattern] if any(c in "*?[]{}!" for c in pattern) else [pattern, f"**/{pattern}", f"**/{pattern}/**"]
    ends = [pattern]
    if pattern.endswith("/"):
        ends.append(pattern + "**")
    elif pattern.endswith("/*") and not pattern.endswith("/**/*"):
        ends.append(pattern + "*")
    return [depth + p for p in ends for depth in (("",) if pattern.startswith(("**/", "/", "./")) else ("", "**/"))]


def any_match(path: Column, patterns: Sequence[str], dot: bool = True, expand: bool = True) -> Column:
    """True where the path fits one of the patterns; one regular expression for the set."""
    found = [g for p in patterns for g in (spellings(p) if expand else [p])]
    return path.rlike("|".join(glob_regex(g, dot) for g in found)) if found else F.lit(False)


def selected(path: Column, includes: Sequence[Sequence[str]] = (), excludes: Sequence[str] = DEFAULT_EXCLUDES, dot: bool = False) -> Column:
    """In every include set that is not empty, and in no exclude."""
    out = F.lit(True)
    for patterns in includes:
        if patterns:
            out = out & any_match(path, patterns, dot)
    return out & ~any_match(path, excludes) if excludes else out
