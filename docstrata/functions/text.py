"""Column functions on paths, texts, durations, sizes and policies.  All are built-in expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that no snippet looks for.  What a snippet shows depends on exactly these.
STOPWORDS = (
    "the", "and", "for", "that", "with", "this", "from", "what", "when", "where", "which", "who", "how", "does", "why", "are", "was", "were", "can", "could", "should",
    "would", "will", "into", "about", "than", "then", "them", "they", "their", "your", "you", "our", "its", "has", "have", "had", "not", "but", "all", "any",
)
MIME_TYPES = {
    "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", "json": "application/json", "xml": "application/xml",
    "yaml": "text/yaml", "yml": "text/yaml", "csv": "text/csv", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml",
    "js": "text/javascript", "css": "text/css", "zip": "application/zip",
}


def normalize_path(p: Column) -> Column:
    return F.regexp_replace(F.translate(p, "\\", "/"), "^/+", "")


def pick_path(explicit: Column, absolute: Column, relative: Column, multi: Column) -> Column:
    """The logical path of an entry: its own, the given name, or the given prefix and the relative path."""
    prefix = F.regexp_replace(explicit, "/+$", "")
    return normalize_path(F.when(F.coalesce(explicit, F.lit("")) == "", absolute).when(multi, F.concat_ws("/", prefix, relative)).otherwise(explicit))


def path_for_url(url: Column) -> Column:
    """``remotes/host/path`` without port, query and fragment; ``index`` for an empty path; else the url, sanitised."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?#]*)"
    host, path = F.lower(F.regexp_extract(url, pattern, 1)), F.regexp_replace(F.regexp_extract(url, pattern, 2), "^/+|/+$", "")
    named = F.concat(F.lit("remotes/"), host, F.lit("/"), F.when(path == "", "index").otherwise(path))
    return F.when(host != "", named).otherwise(F.concat(F.lit("remotes/"), F.regexp_replace(url, "[^A-Za-z0-9.-]", "_")))


def _plain_letters() -> tuple[str, str]:
    """Letters up to U+024F that decompose to an ASCII letter and marks, and those ASCII letters."""
    found = [(chr(i), d) for i in range(0xC0, 0x250) if (d := unicodedata.normalize("NFKD", chr(i))[0]) != chr(i) and d.isascii() and d.isalpha()]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


PLAIN = _plain_letters()


def slug(s: Column, limit: int = 80) -> Column:
    """Lower case, other characters as single dashes, at most ``limit`` of them; ``untitled`` if nothing is left.  An
    accented letter is its plain letter and a mark, and marks are other characters."""
    plain = F.lower(F.regexp_replace(F.translate(_marked(s), *PLAIN), "\u0300", "-"))
    cut = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit), "-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", "untitled").otherwise(cut)


def _marked(s: Column) -> Column:
    """A mark behind each letter that has one when decomposed."""
    return F.regexp_replace(s, f"([{PLAIN[0]}])", "$1\u0300")


def slug_path(p: Column) -> Column:
    return F.array_join(F.transform(F.split(p, "/"), lambda x: slug(x)), "/")


def note_path(account: Column, folder: Column, title: Column) -> Column:
    return F.concat_ws("/", F.lit("apple-notes"), slug(account), slug_path(folder), F.concat(slug(title), F.lit(".md")))


def issue_path(owner: Column, repo: Column, kind: Column, number: Column) -> Column:
    """kind is issues or pull, as in urls; the path says pulls."""
    return F.concat(F.lit("github/"), F.lower(F.concat_ws("/", owner, repo)), F.lit("/"), F.when(kind.isin("pull", "pulls"), "pulls").otherwise("issues"), F.lit("/"), number.cast("string"), F.lit(".md"))


def ticket_path(workspace: Column, identifier: Column) -> Column:
    """A tracker issue's path, by its key."""
    return F.concat(F.lit("linear/"), F.lower(workspace), F.lit("/issues/"), identifier, F.lit(".md"))


def project_path(workspace: Column, slugged: Column) -> Column:
    """A tracker project's path, by its full slug."""
    return F.concat(F.lit("linear/"), F.lower(workspace), F.lit("/projects/"), slugged, F.lit(".md"))


def disambiguate(path: Column, suffix: Column) -> Column:
    """``-suffix`` (8 characters) before the last dot, or at the end."""
    stem, ext = F.regexp_extract(path, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(path, r"^(.*?)(\.[^.]*)?$", 2)
    return F.concat(stem, F.lit("-"), F.substring(suffix, 1, 8), ext)


def project_id(slugged: Column) -> Column:
    """The trailing run of at least eight hex digits after a dash, else the whole."""
    return F.coalesce(F.nullif(F.regexp_extract(slugged, "-([0-9a-fA-F]{8,})$", 1), F.lit("")), slugged)


def mime_from_name(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def duration_seconds(d: Column) -> Column:
    """``30s``, ``5M``, ``1h``, ``7d``; null if blank; anything else raises."""
    given, shape = F.lower(trimmed(d)), r"^(\d+)([smhd])$"
    n, unit = F.nullif(F.regexp_extract(given, shape, 1), F.lit("")).cast("long"), F.regexp_extract(given, shape, 2)
    scale = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when(given != "", F.coalesce(n * scale, F.raise_error(F.concat(F.lit("invalid duration: "), d)).cast("long")))


def resolve_cutoff(value: str, now: Column) -> Column:
    """A duration before ``now``, or an ISO timestamp."""
    if re.fullmatch(r"\s*\d+\s*[smhdSMHD]\s*", value):
        scale = {"s": 1, "m": 60, "h": 3600, "d": 86400}[value.strip()[-1].lower()]
        return now - F.make_dt_interval(secs=F.lit(int(re.sub(r"\D", "", value)) * scale))
    return F.lit(value).cast("timestamp_ntz")


def version_text(v: Column) -> Column:
    """ISO with milliseconds."""
    return F.date_format(F.date_trunc("MILLISECOND", v), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def row_key(path: Column, version: Column, index: Column) -> Column:
    return F.concat_ws("::", path, version_text(version), index.cast("string"))


def slice_lines(text: Column, offset: int, limit: int) -> Column:
    """Lines from the 1-based offset on."""
    return F.array_join(F.slice(F.split(text, "\n"), max(1, offset), limit), "\n")


def search_text(path: Column, description: Column, body: Column, context: Column | None = None, limit: int = 240) -> Column:
    """What is searched of a chunk: path, description (one line, empty or not, cut to its limit), context if any, body."""
    lines = [path, truncate_at_word(trimmed(F.coalesce(description, F.lit(""))), limit)]
    if context is not None:
        lines.append(F.nullif(trimmed(context), F.lit("")))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), body)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(" \t\n\v\f\r"))


def one_line(text: Column, limit: int = 200) -> Column:
    """The start of a text with its white space as single spaces."""
    return trimmed(F.regexp_replace(F.substring(trimmed(text), 1, limit), r"\s+", " "))


def truncate_at_word(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last space if that is past the middle, with an ellipsis."""
    cut = F.substring(text, 1, limit)
    at = F.lit(limit) - F.locate(" ", F.reverse(cut))
    short = F.when((F.locate(" ", cut) > 0) & (at > limit / 2), F.substring(cut, F.lit(1), at)).otherwise(cut)
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.rtrim(short), F.lit("…")))


def _textual(mime: Column, *others: str) -> Column:
    return mime.startswith("text/") | mime.isin(*others)


# What a title and a heading are, which descriptions depend on.
TITLE = r"^#\s+(.+?)\s*#*$"
HEADING = r"(?m)^#+\s+(.+)$"


def title_description(mime: Column, text: Column) -> Column:
    """The first H1 of the first 40 lines that are not blank, 5 to 200 characters long, and the start of the text
    without it; null for other types and without such a heading."""
    marked = F.when(F.contains(text, F.lit("#")), text)  # most texts have no heading, and no line of them is looked at
    lines = F.slice(F.filter(F.transform(F.split(marked, r"\r?\n"), trimmed), lambda x: x != ""), 1, 40)
    heading = F.get(F.filter(lines, lambda x: x.rlike(r"^#\s+.")), F.lit(0))
    title = trimmed(F.regexp_extract(heading, TITLE, 1))
    body = one_line(F.regexp_replace(text, r"(?m)\A((?s:.*?))^#\s+.+$", "$1"))
    fits = _textual(mime, "application/json", "application/yaml", "application/x-yaml") & F.char_length(title).between(5, 200)
    return F.when(fits, F.concat_ws(" — ", title, F.nullif(body, F.lit(""))))


def fallback_description(path: Column, mime: Column, text: Column) -> Column:
    """Heading and start of a text, or whichever it has; type and length of anything else."""
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  read once, used often
    or_null = lambda value: bound(value, lambda x: F.when(x != "", x))
    shown = bound(trimmed(F.coalesce(text, F.lit(""))), lambda body: or_null(F.concat_ws(" — ", or_null(F.when(F.contains(body, F.lit("#")), trimmed(F.regexp_extract(body, HEADING, 1)))), or_null(one_line(body)))))
    other = F.concat(mime, F.lit(" · "), F.char_length(F.coalesce(text, F.lit(""))).cast("string"), F.lit(" chars"))
    return F.when(_textual(mime, "application/json", "application/yaml"), F.coalesce(shown, F.concat(path, F.lit(" ("), mime, F.lit(")")))).otherwise(other)


def describe(path: Column, mime: Column, text: Column, model: Column | None = None) -> Column:
    options = [title_description(mime, text), *([model] if model is not None else []), fallback_description(path, mime, text)]
    return F.coalesce(*options)


def snippet_terms(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """The first ten different words of at least three characters that are not stopwords."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda x: (F.char_length(x) >= 3) & ~x.isin(*stopwords))
    return F.slice(F.array_distinct(words), 1, 10)


def make_snippet(content: Column, terms: Column, lead: int = 100, window: int = 300) -> Column:
    """The start of the content or, if the first term found is behind ``lead`` characters, a window from so many before
    it on, opened at a word; with ellipses where cut."""
    low = F.lower(content)
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.position(F.lower(t), low)), lambda i: i > 0))
    start = at - lead
    gap = F.position(F.lit(" "), content, start)
    begin = F.when(F.coalesce(at <= lead + 1, F.lit(True)), 1).when((gap > 0) & (gap < at), gap + 1).otherwise(start)
    tail = F.when(begin + window <= F.char_length(content), F.lit("…")).otherwise("")
    return F.concat(F.when(begin > 1, F.lit("…")).otherwise(""), F.substring(content, begin, F.lit(window)), tail)


def round4(x: Column) -> Column:
    return F.round(x, 4)


def persist_reason(mime: Column, size: Column, max_size: int | None = None, skip_mimes: Sequence[str] = ()) -> Column:
    """Null to keep the bytes, else ``mime`` or ``size``; a size at the limit is kept."""
    skip = F.lit(False)
    for p in skip_mimes:
        skip = skip | (F.lit(True) if p == "*" else mime.startswith(p[:-1]) if p.endswith("/*") else mime == p)
    out = F.when(skip, "mime")
    return out.when(size > max_size, "size") if max_size is not None else out


def human_bytes(n: Column) -> Column:
    """In units of 1024 up to TB: one decimal below 100, none from there on; ``0 B`` if negative."""
    out = F.when(n < 0, "0 B").when(n < 1024, F.format_string("%d B", n.cast("long")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        value = n / float(1024**power)
        shown = F.when(value < 100, F.format_string(f"%.1f {unit}", value)).otherwise(F.format_string(f"%d {unit}", F.floor(value + 0.5)))
        out = out.when(n < 1024.0 ** (power + 1), shown) if unit != "TB" else out.otherwise(shown)
    return out


# What exported documents have for spaces, quotes and dashes, and their plain forms.
EXPORTED = {"\u00a0": " ", "‘’‚‛": "'", "“”„‟": '"', "–—": "-"}


def normalize_docmd(text: Column) -> Column:
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.translate(t, "".join(EXPORTED), "".join(v * len(k) for k, v in EXPORTED.items()))
    t = F.regexp_replace(t, "(?m)[ \t]+$", "")
    return trimmed(F.regexp_replace(t, "\n{3,}", "\n\n"))


def strip_html_blocks(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", "")


def base64_bytes(data: Column) -> Column:
    return F.base64(data)


def substitute(template: Column, variables: Mapping[str, Column]) -> Column:
    """``{name}`` by its value; a name without one raises."""
    out = template
    for k, v in variables.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
    return F.when(out.rlike(r"\{[a-z_]+\}"), F.raise_error(F.concat(F.lit("unknown variable in "), out)).cast("string")).otherwise(out)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def query_text(query: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), query)


def blob_state(sha: Column, data: Column) -> Column:
    return F.when(sha.isNull(), "none").when(data.isNull(), "skipped").otherwise("available")


def relations(links: Column, kind: str) -> Column:
    """Sorted different ids of one kind from an array of (kind, id)."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(links, lambda x: x["kind"] == kind), lambda x: x["id"])))


def breadcrumb(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, lambda x: trimmed(x)), lambda x: x != ""), " > ")
