"""HTML as rows, by the standard library's parser: one row per block, anchored to its element and line.

Hidden elements are left out, nav and footer are kept, tables keep their columns under colspan, and unknown tags are
looked through, so that broken pages still give their text."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

from .rows import Rows, plain, span, squash

BLOCKS = frozenset("p div section article header footer main nav aside li h1 h2 h3 h4 h5 h6 blockquote pre tr table ul ol hr figure figcaption dt dd form label button details summary".split())
HIDDEN = frozenset("script style head title template svg noscript".split())
_LOOKS = {"b": "b", "strong": "b", "th": "b", "i": "i", "em": "i", "cite": "i", "code": "c", "kbd": "c", "samp": "c", "pre": "c", "a": "l", "s": "s", "del": "s", "strike": "s"}
_TONE = re.compile(r"\b(info|note|warning|error|success|tip|alert|callout)\b", re.I)
# The names that are read; other names stay as written.
NAMES = frozenset("amp lt gt quot apos nbsp mdash ndash hellip copy reg trade rsquo lsquo rdquo ldquo laquo raquo bull middot deg plusmn times divide minus le ge ne larr rarr uarr darr harr euro pound yen cent sect para frac12 frac14 frac34 check hearts".split())


class _Reader(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ()  # a script that is never closed must not hide the page

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.rows = Rows("element")
        self.heading, self.tone = "", None
        self.spans: list[dict] = []
        self.block, self.block_line = "p", 1
        self.open: list[str] = []
        self.lists: list[list] = []
        self.grid: dict | None = None
        self.cell: list[dict] | None = None
        self.width, self.pictures = 1, 0
        self.named: dict[tuple, int] = {}

    def line(self) -> int:
        return self.getpos()[0]

    def where(self, tag: str, line: int, also: str = "") -> str:
        n = self.named[tag, line] = self.named.get((tag, line), 0) + 1
        return f"<{tag}>{f' #{n}' if n > 1 else ''} at line {line}{also}" + (f' (under "{self.heading}")' if self.heading else "")

    def add(self, text: str) -> None:
        looks = {_LOOKS[t]: True for t in self.open if t in _LOOKS}
        (self.spans if self.cell is None else self.cell).append(span(text, **looks))

    def handle_data(self, data: str) -> None:
        self.add(data)

    def handle_entityref(self, name: str) -> None:
        self.add(html.unescape(f"&{name.lower()};").replace("\xa0", " ") if name.lower() in NAMES else f"&{name};")

    def handle_charref(self, name: str) -> None:
        try:
            code = int(name[1:], 16) if name[0] in "xX" else int(name)
            self.add(chr(code))
        except (ValueError, OverflowError):
            self.add("\ufffd")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tag(tag, {k: v or "" for k, v in attrs}, False)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in HIDDEN:
            self.tag(tag, {k: v or "" for k, v in attrs}, False)

    def handle_endtag(self, tag: str) -> None:
        self.tag(tag, {}, True)

    def tag(self, tag: str, attrs: dict, closing: bool) -> None:
        if tag in HIDDEN:
            return
        if tag == "br":
            if self.cell is not None:
                self.cell.append(span(" "))
            else:
                self.flush()
                self.block_line = self.line()
        elif tag == "img" and not closing:
            self.picture(attrs)
        elif tag == "hr" and not closing:
            self.flush()
            self.rows.gap()
            self.rows.put("", self.where("hr", self.line()), "rule")
        elif tag == "table" or (self.grid is not None and tag in ("td", "th", "tr", "thead")):
            self.table_tag(tag, attrs, closing)
        elif tag in BLOCKS:
            self.block_tag(tag, attrs, closing)
        elif not closing:
            self.open = [*self.open, tag][-100:]
        elif tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag)]

    def block_tag(self, tag: str, attrs: dict, closing: bool) -> None:
        self.flush()
        if tag in ("ul", "ol"):
            if not closing:
                self.lists.append([tag == "ol", 0])
            elif self.lists:
                self.lists.pop()
        if not closing and tag == "li" and self.lists:
            self.lists[-1][1] += 1
        if tag == "pre":
            self.open = [t for t in self.open if t != "pre"] + [tag] * (not closing)
        if not closing and (m := _TONE.search(attrs.get("class", ""))):
            kinds = re.findall(r"\b(info|note|warning|error|success|tip)\b", attrs["class"], re.I)
            self.tone = kinds[0].lower() if kinds else "note" if m else None
        elif closing and tag in ("div", "aside", "section"):
            self.tone = None
        self.block, self.block_line = ("p" if closing else tag), self.line()

    def picture(self, attrs: dict) -> None:
        alt = attrs.get("alt", "").strip()
        if self.cell is not None:
            self.cell.append(span(f"▣ {alt or 'picture'}", d=True))
            return
        self.flush()
        self.pictures += 1
        name = f"Picture {self.pictures}" + (f": {alt[:200]}" if alt else "")
        self.rows.gap()
        self.rows.put(f"[{name}]", self.where("img", self.line()) + f", picture {self.pictures}", "p", [span(f"▣ {name}", d=True)], pic=attrs.get("src", "").strip())

    def table_tag(self, tag: str, attrs: dict, closing: bool) -> None:
        if tag == "table":
            if not closing:
                self.flush()
                self.grid = {"cells": [], "lines": [], "header": 0, "th": False, "line": self.line()}
            elif self.grid is not None:
                grid, self.grid, self.cell = self.grid, None, None
                kept = [(row, line) for row, line in zip(grid["cells"], grid["lines"], strict=True) if row]
                self.rows.table([row for row, _ in kept], grid["header"] or int(grid["th"]), lambda r: self.where("tr", kept[r][1]))
        elif tag == "tr" and not closing:
            self.grid["cells"].append([])
            self.grid["lines"].append(self.line())
        elif tag == "thead" and closing:
            self.grid["header"] = len(self.grid["cells"])
        elif tag in ("td", "th"):
            if not closing:
                self.cell = []
                digits = re.match(r"\s*(\d+)", attrs.get("colspan", ""))
                self.width = min(10, max(1, int(digits[1]) if digits else 1))
                self.grid["th"] |= tag == "th" and len(self.grid["cells"]) == 1
                self.open = [*self.open, tag][-100:]
            else:
                if self.grid["cells"] and self.cell is not None:
                    self.grid["cells"][-1] += [squash(self.cell), *[[]] * (self.width - 1)]
                self.cell, self.width = None, 1
                if self.open and self.open[-1] == tag:
                    self.open.pop()

    def flush(self) -> None:
        spans, self.spans = (self.spans if self.block == "pre" else squash(self.spans)), []
        text = plain(spans)
        if not text.strip():
            return
        tag, line = self.block, self.block_line
        if tag == "pre":
            self.rows.gap()
            for k, code in enumerate(text.removeprefix("\n").split("\n")):
                self.rows.put(code, self.where("pre", line + k), "code", [span(code or " ", c=True)])
            self.rows.gap()
        elif re.fullmatch("h[1-6]", tag):
            level = int(tag[1])
            self.heading = text.strip()
            self.rows.gap()
            anchor = self.where(tag, line)
            self.rows.put(self.heading, anchor, f"h{min(level, 3)}", spans)
            if level == 1:
                self.rows.put("", anchor, "rule")
        elif tag == "li":
            ordered, n = self.lists[-1] if self.lists else (False, 0)
            if self.rows and self.rows[-1]["style"] not in ("li", "space"):
                self.rows.gap()
            self.rows.put(text, self.where("li", line), "li", spans, indent=max(0, len(self.lists) - 1), marker=f"{n}." if ordered else "•")
        else:
            self.rows.gap()
            style = "panel" if self.tone else "quote" if tag == "blockquote" else "p"
            self.rows.put(text, self.where(tag, line), style, spans, tone=self.tone)


def _without_hidden(source: str) -> str:
    """Closed hidden elements blanked, their line breaks kept; one that is never closed stays, so as not to hide the page."""
    lower, out, at, gone = source.lower(), [], 0, set()
    for m in re.finditer(r"<(" + "|".join(HIDDEN) + r")(?=[\s>/])[^>]*>", lower):
        if m.start() < at or m[1] in gone or m[0].endswith("/>"):
            continue
        end = lower.find(f"</{m[1]}", m.end())
        if end < 0:
            gone.add(m[1])
            continue
        close = lower.find(">", end)
        close = len(source) if close < 0 else close + 1
        out += [source[at : m.start()], "\n" * source.count("\n", m.start(), close)]
        at = close
    return "".join([*out, source[at:]])


def html_rows(source: str) -> list[dict]:
    source = re.sub(r"<!--.*?(?:-->|$)", lambda m: "\n" * m[0].count("\n"), source, flags=re.S)
    source = _without_hidden(source)
    body = re.search(r"<body[\s>]", source, re.I)
    if body:
        source = "\n" * source.count("\n", 0, body.start()) + source[body.start() :]
    reader = _Reader()
    reader.feed(source)
    reader.close()
    reader.flush()
    return reader.rows.done()
