"""Word documents as rows: headings, paragraphs, lists, tables and pictures, in document order."""

from __future__ import annotations

import re

from .package import Node, Package, whole
from .rows import Rows, plain, span, squash

BODY_BYTES, ROW_LIMIT = 24 << 20, 4_000
_DROPPED = ("del", "moveFrom", "Fallback")


def _on(node: Node | None) -> bool:
    return node is not None and node.attrs.get("val", "1") not in ("0", "false", "none")


class _Reader:
    def __init__(self, content: bytes):
        package = Package(content)
        self.part = next((t for kind, t in package.relations("").values() if kind == "officeDocument"), "word/document.xml")
        self.relations = package.relations(self.part)
        self.body = package.tree(self.part, BODY_BYTES).first("body") or Node("body", {})
        by_kind = {kind: target for kind, target in self.relations.values()}
        styles = package.tree(by_kind["styles"]) if "styles" in by_kind else Node("", {})
        self.styles = {s.attrs.get("styleId", ""): (s.first("name") or s).attrs.get("val", "") for s in styles.all("style")}
        self.default = next((s.attrs.get("styleId", "") for s in styles.all("style") if s.attrs.get("default") == "1" and s.attrs.get("type") == "paragraph"), "")
        self.levels = self._numbering(package.tree(by_kind["numbering"])) if "numbering" in by_kind else {}
        self.rows = Rows("paragraph")
        self.heading, self.title_seen = "", False
        self.paragraphs = self.tables = self.pictures = 0
        self.counters: dict[tuple, int] = {}

    @staticmethod
    def _numbering(tree: Node) -> dict[tuple[str, int], tuple[str, int]]:
        """(numId, level) to (number format, start)."""
        kinds = {}
        for a in tree.all("abstractNum"):
            for level in a.all("lvl"):
                fmt, start = level.first("numFmt"), level.first("start")
                kinds[a.attrs.get("abstractNumId"), whole(level.attrs.get("ilvl"))] = (fmt.attrs.get("val", "") if fmt else "", whole(start.attrs.get("val"), 1) if start else 1)
        out = {}
        for n in tree.all("num"):
            abstract = n.first("abstractNumId")
            for (a, level), kind in kinds.items():
                if abstract is not None and a == abstract.attrs.get("val"):
                    out[n.attrs.get("numId", ""), level] = kind
        return out

    def where(self, place: str) -> str:
        return place + (f' (under "{self.heading}")' if self.heading else "")

    def run(self) -> list[dict]:
        for block in self._blocks(self.body):
            if len(self.rows) >= ROW_LIMIT:
                break
            if block.name == "p":
                self.paragraph(block)
            else:
                self.table(block)
        return self.rows.done()

    def _blocks(self, node: Node):
        """Paragraphs and tables, looking into content controls."""
        for c in node.elements():
            if c.name in ("p", "tbl"):
                yield c
            elif c.name not in _DROPPED:
                yield from self._blocks(c)

    def spans(self, node: Node, linked: bool = False) -> tuple[list[dict], list[str]]:
        """Text with its looks, and the pictures in it."""
        out, pictures = [], []
        for c in node.elements():
            if c.name in _DROPPED or c.name == "tbl":
                continue
            if c.name == "r":
                pr = c.first("rPr")
                looks = {k: _on(pr.first(n)) for k, n in (("b", "b"), ("i", "i"), ("s", "strike"))} if pr is not None else {}
                for piece in c.elements():
                    if piece.name == "t":
                        out.append(span(piece.text(), l=linked, **looks))
                    elif piece.name in ("tab", "br", "cr"):
                        out.append(span(" "))
                    elif piece.name in ("drawing", "pict", "AlternateContent"):
                        about = piece.first("docPr")
                        pictures.append(about.attrs.get("descr", "") if about is not None else "")
            else:
                more, also = self.spans(c, linked or c.name == "hyperlink")
                out += more
                pictures += also
        return out, pictures

    def paragraph(self, p: Node) -> None:
        self.paragraphs += 1
        place = f"paragraph {self.paragraphs}"
        spans, pictures = self.spans(p)
        spans = squash(spans)
        pr = p.first("pPr") or Node("", {})
        style = pr.first("pStyle")
        name = self.styles.get(style.attrs.get("val", "") if style is not None else self.default, "")
        level = self._heading(name)
        if plain(spans).strip():
            if level:
                self.counters.clear()
                self.heading = plain(spans).strip()
                self.rows.gap()
                self.rows.put(plain(spans), self.where(place), f"h{level}", spans)
                if level == 1:
                    self.rows.put("", self.where(place), "rule")
            elif item := self._item(pr, name):
                if self.rows and self.rows[-1]["style"] not in ("li", "space"):
                    self.rows.gap()
                self.rows.put(plain(spans), self.where(place), "li", spans, indent=item[0], marker=item[1])
            else:
                self.counters.clear()
                self.rows.gap()
                self.rows.put(plain(spans), self.where(place), "quote" if "quote" in name.lower() else "p", spans)
        for alt in pictures:
            self.pictures += 1
            label = f"Picture {self.pictures}" + (f": {alt}" if alt else "")
            self.rows.gap()
            self.rows.put(f"[{label}]", self.where(f"{place}, picture {self.pictures}"), "p", [span(f"▣ {label}", d=True)], pic=label)

    def _heading(self, name: str) -> int:
        if name.lower() == "title":
            self.title_seen = True
            return 1
        m = re.fullmatch(r"heading (\d)", name.lower())
        return min(3, int(m[1]) + self.title_seen) if m else 0

    def _item(self, pr: Node, name: str) -> tuple[int, str] | None:
        num = pr.first("numPr")
        if num is not None and num.first("numId") is not None:
            number, level = num.first("numId").attrs.get("val", ""), num.first("ilvl")
            depth = whole(level.attrs.get("val")) if level is not None else 0
            kind, start = self.levels.get((number, depth), ("bullet", 1))
            if number == "0":
                return None
            for key in [k for k in self.counters if k[0] == number and k[1] > depth]:
                del self.counters[key]
            n = self.counters[number, depth] = self.counters.get((number, depth), start - 1) + 1
            return depth, "•" if kind in ("bullet", "none") else f"{n}."
        if "list" in name.lower():
            if "number" in name.lower():
                n = self.counters["", 0] = self.counters.get(("", 0), 0) + 1
                return 0, f"{n}."
            return 0, "•"
        return None

    def table(self, t: Node) -> None:
        self.tables += 1
        self.counters.clear()
        number, above, cells = self.tables, {}, []
        for row in t.all("tr"):
            line: list[list[dict]] = []
            for tc in row.all("tc"):
                pr = tc.first("tcPr") or Node("", {})
                grid, merge = pr.first("gridSpan"), pr.first("vMerge")
                spans = squash([s for p in tc.all("p") for s in [*self.spans(p)[0], span(" ")]])
                if merge is not None and merge.attrs.get("val") != "restart":
                    spans = above.get(len(line), spans)
                above[len(line)] = spans
                line += [spans, *[[]] * (min(64, max(1, whole(grid.attrs.get("val"), 1) if grid is not None else 1)) - 1)]
            if line:
                cells.append(line)
        self.rows.table(cells, min(1, len(cells)), lambda r: self.where(f"table {number}, row {r + 1}"))


def word_rows(content: bytes) -> list[dict]:
    return _Reader(content).run()
