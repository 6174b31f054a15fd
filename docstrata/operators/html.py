"""HTML to markdown by blocks.

The parser keeps a stack of open elements.  An element gathers finished blocks and a line of inline text; when it closes,
what it gathered becomes a block or a piece of inline text of the element around it.  A block that begins ends open inline
elements and an open paragraph; an end tag closes what is open inside its element, and one without an element is
ignored.  So broken markup loses no text.

ATX headings, fenced code, ``-`` bullets, numbers as the list says, quotes, pipe tables, rules, images and links; signs that
markdown would take for markup are escaped in texts.  Images that the page holds itself become tokens (``IMAGE``), and
their types and bytes are given beside the markdown.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

IMAGE = "embedded-image:"
SKIPPED = {"script", "style", "noscript", "title", "template"}
INLINE = {"a", "b", "strong", "i", "em", "code", "span", "small", "sub", "sup", "u", "s", "del", "ins", "mark", "abbr", "cite", "q", "label", "kbd", "samp", "var", "font", "time", "tt", "big"}
VOID = {"br", "hr", "img", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr"}
# What a new element of a kind closes, if it is open within the nearest of the others.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
_ANYWHERE = re.compile(r"([\\*_`\[\]])")
_AT_START = re.compile(r"(?:[-+](?=\s)|#{1,6}(?=\s)|=+\s*$|>|~~~)|(\d+)(?=\.\s)")


@dataclass
class _Open:
    tag: str
    attrs: dict[str, str | None]
    blocks: list[tuple[str, bool]] = field(default_factory=list)  # text, and whether it is a list
    line: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)  # of a table, or a row's cells, or a list's items

    def end_line(self) -> None:
        text = re.sub(r"[ \t\r\f\n]*\x00[ \t\r\f\n]*", "  \n", re.sub(r"[ \t\r\f\n]+", " ", "".join(self.line))).strip()
        self.line.clear()
        if text:
            self.blocks.append((text, False))

    def text(self, glue: str = "\n\n") -> str:
        """The finished blocks; a list stands right below what is before it in an item."""
        self.end_line()
        out = ""
        for text, is_list in self.blocks:
            out += ("\n" if is_list and self.tag == "li" else glue) + text if out else text
        return out


BREAK = "\x00"  # a line break within inline text; HTML has no such character


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [_Open("", {})]
        self.skip = self.pre = 0
        self.images: list[dict] = []

    # Elements.

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        given = dict(attrs)
        if tag == "br":
            self.stack[-1].line.append("\n" if self.pre else BREAK)
        elif tag == "img":
            self.stack[-1].line.append(self._image(given))
        elif tag == "hr" and not self.pre:
            self._end_inline()
            self._add("* * *")
        elif tag in VOID or (self.pre and tag not in INLINE):
            return
        elif tag in INLINE:
            self.stack.append(_Open(tag, given))
        else:
            self._end_inline()
            for closed, within in (CLOSES[tag],) if tag in CLOSES else ():
                while (at := self._find(closed, within)) is not None:
                    self._close_to(at)
            self.pre += tag == "pre"
            self.stack.append(_Open(tag, given))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SKIPPED:
            self.skip -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and (at := self._find({tag}, {"table"} if tag in INLINE | {"p"} else set())) is not None:
            self._close_to(at)
        elif tag == "br":
            self.stack[-1].line.append(BREAK)

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        top, data = self.stack[-1], data.replace(BREAK, "")
        if self.pre or top.tag in ("code", "tt", "kbd", "samp"):
            top.line.append(data)
            return
        first = not "".join(top.line).strip() and top.tag not in INLINE
        data = _ANYWHERE.sub(r"\\\1", data)
        if first and (m := _AT_START.match(data.lstrip())):
            at = len(data) - len(data.lstrip()) + len(m[1] or "")
            data = data[:at] + "\\" + data[at:]
        top.line.append(data)

    def _find(self, tags: set[str], within: set[str]) -> int | None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in within:
                return None
        return None

    def _close_to(self, at: int) -> None:
        while len(self.stack) > at:
            self._close()

    def _end_inline(self) -> None:
        while self.stack[-1].tag in INLINE or self.stack[-1].tag == "p":
            self._close()

    def _add(self, text: str, is_list: bool = False) -> None:
        self.stack[-1].end_line()
        if text.strip():
            self.stack[-1].blocks.append((text, is_list))

    def _close(self) -> None:
        e = self.stack.pop()
        if e.tag in INLINE:
            self.stack[-1].line.append(self._inline(e))
        elif e.tag == "pre":
            self.pre -= 1
            self._add(_fenced("".join(e.line), e.attrs))
        elif e.tag in ("td", "th"):
            self._into({"tr"}, [" ".join(e.text(" ").split()).replace("|", "\\|")])
        elif e.tag == "tr":
            e.end_line()
            self.stack[-1].end_line()
            self.stack[-1].blocks += e.blocks  # what stands in a row outside its cells
            self._into({"table"}, e.rows[0] if e.rows else [])
        elif e.tag == "table":
            self._add(_table(e))
        elif e.tag == "li":
            self._into({"ul", "ol"}, [e.text()])
        elif e.tag in ("ul", "ol"):
            self._add(_list(e), is_list=True)
        elif e.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            title = " ".join(e.text(" ").split())
            self._add(f"{'#' * int(e.tag[1])} {title}" if title else "")
        elif e.tag == "blockquote":
            self._add("\n".join("> " + x for x in e.text().split("\n")) if e.text() else "")
        else:
            e.end_line()
            self.stack[-1].end_line()
            self.stack[-1].blocks += e.blocks

    def _into(self, tags: set[str], row: list[str]) -> None:
        """A row, cell or item to what it is part of; one that stands alone is a block."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                rows = self.stack[i].rows
                if tags == {"tr"}:
                    rows[:] = [(rows[0] if rows else []) + row]
                else:
                    rows.append(row)
                return
        self._add(" ".join(row))

    # Inline text.

    def _inline(self, e: _Open) -> str:
        text = "".join(e.line)
        if self.pre:
            self.stack[-1].attrs.setdefault("class", e.attrs.get("class"))
            return text
        body = text.strip(" \t\r\n\f" + BREAK)
        if not body:
            return text
        before, after = text[: text.index(body)], text[text.index(body) + len(body) :]
        if e.tag in ("b", "strong"):
            body = f"**{body}**"
        elif e.tag in ("i", "em"):
            body = f"_{body}_"
        elif e.tag in ("code", "tt", "kbd", "samp"):
            marks = "`" * (1 + max(map(len, re.findall("`+", body)), default=0))
            pad = " " if "`" in (body[0], body[-1]) else ""
            body = f"{marks}{pad}{body}{pad}{marks}"
        elif e.tag == "a" and e.attrs.get("href"):
            body = f"[{body}]({_target(e.attrs['href'], e.attrs.get('title'))})"
        return before + body + after

    def _image(self, attrs: dict[str, str | None]) -> str:
        src, alt = (attrs.get("src") or "").strip(), " ".join((attrs.get("alt") or "").split())
        if not src:
            return ""
        alt = alt.replace("[", "").replace("]", "")
        if src[:5].lower() == "data:":
            kind, _, data = src[5:].partition(",")
            if not kind.lower().endswith(";base64"):
                return ""
            try:
                content = base64.b64decode("".join(data.split()), validate=True)
            except (binascii.Error, ValueError):
                return ""
            token = f"![{alt}]({IMAGE}{len(self.images)})"
            self.images.append({"token": token, "alt": alt, "mime_type": kind[:-7].split(";")[0].strip().lower() or "image/png", "bytes": content})
            return token
        return f"![{alt}]({_target(src, attrs.get('title'))})"


def _target(href: str, title: str | None) -> str:
    href = "".join(href.split()).replace("(", "\\(").replace(")", "\\)")
    shown = " ".join((title or "").split()).replace('"', '\\"')
    return f'{href} "{shown}"' if shown else href


def _fenced(text: str, attrs: dict[str, str | None]) -> str:
    language = re.search(r"(?:^|\s)language-(\S+)", attrs.get("class") or "")
    marks = "`" * max(3, 1 + max(map(len, re.findall("`{3,}", text)), default=0))
    return f"{marks}{language[1] if language else ''}\n{text.strip(chr(10))}\n{marks}"


def _list(e: _Open) -> str:
    """Items with their marks; further lines of an item are indented below its text."""
    e.end_line()
    start = e.attrs.get("start") or ""
    first = int(start) if re.fullmatch(r"\d{1,9}", start) else 1
    items = []
    for i, (text,) in enumerate(e.rows):
        mark = f"{first + i}.  " if e.tag == "ol" else "-   "
        items.append((mark + text.replace("\n", "\n    ")).rstrip(" ") if text else mark.rstrip(" "))
    loose = [text for text, _ in e.blocks]  # what stands in a list outside its items
    return "\n".join([re.sub(r"(?m)^ +$", "", x) for x in items]) + ("\n\n" + "\n\n".join(loose) if loose else "")


def _table(e: _Open) -> str:
    e.end_line()
    rows, loose = [r for r in e.rows if r], [text for text, _ in e.blocks]
    lines: Sequence[str] = []
    if rows:
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        lines = [lines[0], "|" + " --- |" * width, *lines[1:]]
    return "\n\n".join([*loose, *(["\n".join(lines)] if lines else [])])


def markdown(html: str) -> tuple[str, list[dict]]:
    """A page's markdown, and the images it holds itself: token, alt, mime_type, bytes."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._close_to(1)
    return reader.stack[0].text().strip(), reader.images
