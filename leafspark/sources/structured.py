"""Structured-page JSON (a tree of typed nodes with marks) as rows, anchored to the path of each node."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from .rows import Rows, plain, span, squash, tidy

DEPTH = 50
BULLETS = ("•", "◦", "▪")
_MARKS = {"strong": "b", "em": "i", "code": "c", "link": "l", "strike": "s"}
_TONES = {"info": "info", "note": "note", "warning": "warning", "error": "error", "success": "success", "tip": "tip"}


def is_page(value: object) -> bool:
    return isinstance(value, dict) and value.get("type") == "doc" and isinstance(value.get("content"), list)


def _nodes(node: dict) -> list[dict]:
    content = node.get("content")
    return [n for n in content if isinstance(n, dict)] if isinstance(content, list) else []


def _attr(node: dict, name: str, default: object = "") -> object:
    attrs = node.get("attrs")
    value = attrs.get(name) if isinstance(attrs, dict) else None
    return default if value is None else value


def inline(nodes: list[dict]) -> list[dict]:
    out = []
    for n in nodes:
        match n.get("type"):
            case "text":
                marks = [m.get("type") for m in n.get("marks") or [] if isinstance(m, dict)]
                out.append(span(str(n.get("text", "")), **{_MARKS[m]: True for m in marks if m in _MARKS}))
            case "hardBreak":
                out.append(span(" "))
            case "mention":
                out.append(span("@" + str(_attr(n, "text") or _attr(n, "id")).removeprefix("@"), l=True))
            case "emoji":
                out.append(span(str(_attr(n, "text") or _attr(n, "shortName"))))
            case "status":
                out.append(span(f" {str(_attr(n, 'text')).upper()} ", b=True))
            case "date":
                stamp = str(_attr(n, "timestamp"))
                out.append(span(datetime.fromtimestamp(int(stamp) / 1000, UTC).date().isoformat() if stamp.lstrip("-").isdigit() else stamp))
            case "inlineCard":
                out.append(span(str(_attr(n, "url", "link")), l=True))
            case "placeholder":
                out.append(span(str(_attr(n, "text")), d=True))
            case _:
                out += inline(_nodes(n)) if n.get("content") else [span(str(n["text"]))] if n.get("text") else []
    return tidy(out)


class _Reader:
    def __init__(self) -> None:
        self.rows = Rows("block")
        self.heading = ""

    def where(self, path: str) -> str:
        return path + (f' (under "{self.heading}")' if self.heading else "")

    def put(self, style: str, spans: list[dict], path: str, **more) -> None:
        spans = squash(spans)
        self.rows.put(plain(spans), self.where(path), style, spans, **more)

    def children(self, node: dict, path: str, depth: int, tone: str | None = None) -> None:
        for i, child in enumerate(_nodes(node)):
            self.block(child, f"{path}.content[{i}]" if path else f"content[{i}]", depth + 1, tone)

    def block(self, node: dict, path: str, depth: int = 0, tone: str | None = None) -> None:
        if depth > DEPTH:
            return
        kind = str(node.get("type"))
        match kind:
            case "heading":
                level = int(_attr(node, "level", 1) or 1)
                self.rows.gap()
                self.heading = plain(inline(_nodes(node))).strip() or self.heading
                self.put(f"h{min(max(level, 1), 3)}", inline(_nodes(node)), path)
                if level == 1:
                    self.rows.put("", self.where(path), "rule")
            case "paragraph":
                if plain(spans := inline(_nodes(node))).strip():
                    self.rows.gap()
                    self.put("panel" if tone else "p", spans, path, tone=tone)
            case "rule":
                self.rows.gap()
                self.rows.put("", self.where(path), "rule")
            case "codeBlock":
                self.rows.gap()
                for line in plain(inline(_nodes(node))).split("\n"):
                    self.rows.put(line, self.where(path), "code", [span(line or " ", c=True)])
                self.rows.gap()
            case "blockquote":
                self.rows.gap()
                self.put("quote", inline(_nodes(node)), path)
            case "panel":
                self.children(node, path, depth, _TONES.get(str(_attr(node, "panelType")), "note"))
            case "expand" | "nestedExpand":
                if title := str(_attr(node, "title")):
                    self.rows.gap()
                    self.put("h3", [span(title, b=True)], path)
                self.children(node, path, depth, tone)
            case "bulletList" | "orderedList" | "taskList" | "decisionList":
                self.items(node, path, depth, 0)
            case "table":
                self.table(node, path)
            case "mediaSingle" | "mediaGroup" | "media":
                self.rows.gap()
                self.put("p", [span(f"▣ {_attr(node, 'alt', 'media')}", d=True)], path)
            case "blockCard" | "embedCard":
                self.rows.gap()
                self.put("p", [span(str(_attr(node, "url", "link")), l=True)], path)
            case "extension" | "inlineExtension":
                self.rows.gap()
                self.put("p", [span(f"[{_attr(node, 'extensionKey', 'extension')}]", d=True)], path)
            case _:
                inside = _nodes(node)
                if inside and any(n.get("type") in ("text", "mention", "emoji", "hardBreak") for n in inside):
                    self.rows.gap()
                    self.put("p", inline(inside), path)
                else:
                    self.children(node, path, depth, tone)

    def items(self, node: dict, path: str, depth: int, level: int) -> None:
        if depth > DEPTH:
            return
        order = int(_attr(node, "order", 1) or 1)
        if self.rows and self.rows[-1]["style"] not in ("li", "space"):
            self.rows.gap()
        for i, item in enumerate(_nodes(node)):
            at = f"{path}.content[{i}]"
            kind = str(item.get("type"))
            if kind in ("taskList", "bulletList", "orderedList", "decisionList"):
                self.items(item, at, depth + 1, level + 1)
                continue
            marker = {"taskList": "☑" if _attr(item, "state") == "DONE" else "☐", "decisionList": "◆", "orderedList": f"{order + i}."}.get(str(node.get("type")), BULLETS[level % 3])
            first = True
            plain_nodes = _nodes(item)
            if kind in ("taskItem", "decisionItem"):
                self.put("li", inline(plain_nodes), at, indent=level, marker=marker)
                continue
            for k, child in enumerate(plain_nodes):
                if str(child.get("type")).endswith("List"):
                    self.items(child, f"{at}.content[{k}]", depth + 1, level + 1)
                elif first:
                    self.put("li", inline(_nodes(child)), at, indent=level, marker=marker)
                    first = False
                else:
                    self.put("li", inline(_nodes(child)), f"{at}.content[{k}]", indent=level, marker=" ")

    def table(self, node: dict, path: str) -> None:
        found, header = [], 0
        for i, row in enumerate(_nodes(node)):
            cells = []
            for c in _nodes(row):
                cells.append(squash([s for n in _nodes(c) for s in [*inline(_nodes(n)), span(" ")]]))
                cells += [[]] * (min(10, max(1, int(_attr(c, "colspan", 1) or 1))) - 1)
            if cells:
                header += int(len(found) == header and all(c.get("type") == "tableHeader" for c in _nodes(row)))
                found.append((cells, f"{path}.content[{i}]"))
        self.rows.table([c for c, _ in found], header, lambda r: self.where(found[r][1]))


def page_rows(source: str) -> list[dict]:
    value = json.loads(source)
    if not is_page(value):
        raise ValueError("not a structured page")
    reader = _Reader()
    for i, node in enumerate(value["content"]):
        if isinstance(node, dict):
            reader.block(node, f"content[{i}]")
    return reader.rows.done()
