"""Workbooks as cells: values, formulas and formats from the package, results by the formula engine."""

from __future__ import annotations

import re

from ..functions.numbers import BUILTIN_FORMATS
from ..plans.formula import Workbook, col_index, shift
from .package import Node, Package, whole

SHEETS, CELLS, ROWS, COLUMNS = 256, 200_000, 500, 40
SHEET_BYTES, BOOK_BYTES, LEAST_BYTES = 16 << 20, 48 << 20, 2 << 20


def _rich_text(node: Node | None) -> str:
    """Text of runs; phonetic guides are left out."""
    if node is None:
        return ""
    return "".join(c.text() if c.name == "t" else _rich_text(c) for c in node.elements() if c.name != "rPh")


def _place(ref: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"([A-Za-z]{1,3})(\d+)", ref)
    return (int(m[2]), col_index(m[1])) if m else None


class _Book:
    def __init__(self, content: bytes):
        self.package = Package(content)
        root = self.package.relations("")
        self.part = next((t for kind, t in root.values() if kind == "officeDocument"), "xl/workbook.xml")
        self.tree = self.package.tree(self.part)
        relations = self.package.relations(self.part)
        pr = self.tree.first("workbookPr")
        self.is_1904 = pr is not None and pr.attrs.get("date1904") in ("1", "true")
        shared = next((t for kind, t in relations.values() if kind == "sharedStrings"), "")
        self.strings = [_rich_text(si) for si in self.package.tree(shared).all("si")] if shared else []
        styles = next((t for kind, t in relations.values() if kind == "styles"), "")
        self.formats = self._formats(self.package.tree(styles)) if styles else []
        self.sheets = [(s.attrs.get("name", ""), relations[s.attrs["id"]][1], s.attrs.get("state", "visible") != "visible") for s in self.tree.all("sheet") if relations.get(s.attrs.get("id", ""), ("", ""))[0] == "worksheet"][:SHEETS]

    @staticmethod
    def _formats(styles: Node) -> list[str]:
        own = {whole(n.attrs.get("numFmtId"), -1): n.attrs.get("formatCode", "General") for n in styles.all("numFmt")}
        used = styles.first("cellXfs")
        ids = [whole(x.attrs.get("numFmtId")) for x in used.all("xf")] if used else []
        return [own.get(i) or BUILTIN_FORMATS.get(i, "General") for i in ids]

    def cells(self) -> list[dict]:
        """All cells kept: sheet, row and column from 1, value or formula, saved result, format."""
        out: list[dict] = []
        left = BOOK_BYTES
        for index, (name, part, hidden) in enumerate(self.sheets):
            budget = max(LEAST_BYTES, min(SHEET_BYTES, left))
            data = self.package.read(part, budget) or b""
            left -= len(data)
            out += self._sheet(index, name, hidden, parse_sheet(data), CELLS - len(out))
        return out

    def _sheet(self, index: int, name: str, hidden: bool, tree: Node, most: int) -> list[dict]:
        out: list[dict] = []
        masters: dict[str, tuple[str, int, int]] = {}
        r = 0
        for row in tree.all("row"):
            r = whole(row.attrs.get("r"), r + 1)
            c = 0
            for cell in row.all("c"):
                at = _place(cell.attrs.get("r", ""))
                r, c = at or (r, c + 1)
                if len(out) >= most:
                    return out
                value, f = self._value(cell), self._formula(cell, r, c, masters)
                if value is None and f is None:
                    continue
                style = whole(cell.attrs.get("s"))
                fmt = self.formats[style] if style < len(self.formats) else "General"
                out.append({"sheet_idx": index, "sheet": name, "is_hidden": hidden, "r": r, "c": c, "value": value, "f": f, "fmt": fmt})
        return out

    def _value(self, cell: Node):
        kind, v = cell.attrs.get("t", "n"), cell.first("v")
        if kind == "inlineStr":
            return _rich_text(cell.first("is"))
        if v is None:
            return None
        text = v.text()
        if kind == "s":
            i = whole(text, -1)
            return self.strings[i] if 0 <= i < len(self.strings) else ""
        if kind == "b":
            return text.strip() in ("1", "true")
        if kind in ("str", "e", "d"):
            return text
        try:
            return float(text)
        except ValueError:
            return text or None

    @staticmethod
    def _formula(cell: Node, r: int, c: int, masters: dict) -> str | None:
        node = cell.first("f")
        if node is None or node.attrs.get("t") == "dataTable":
            return None
        text, group = node.text(), node.attrs.get("si")
        if node.attrs.get("t") == "shared" and group is not None:
            if text:
                masters[group] = (text, r, c)
            elif group in masters:
                master, r0, c0 = masters[group]
                text = shift(master, r - r0, c - c0)
        return f"={text}" if text else None


def parse_sheet(data: bytes) -> Node:
    from .package import parse

    return parse(data)


def workbook_cells(content: bytes) -> list[dict]:
    """(sheet_idx, sheet, is_hidden, r, c, x, v, f, fmt, is_1904, status) of the shown window of each sheet, from 0.
    A saved result wins over calculating; what can't be calculated has status ``unsupported``."""
    book = _Book(content)
    cells = book.cells()
    values = {(c["sheet"], c["r"], c["c"]): c["f"] or c["value"] for c in cells}
    saved = {(c["sheet"], c["r"], c["c"]): c["value"] for c in cells if c["f"] and c["value"] is not None}
    engine = Workbook(values, saved)
    out = []
    for c in cells:
        if c["r"] > ROWS or c["c"] > COLUMNS:
            continue
        value, status = engine.evaluate(c["sheet"], c["r"], c["c"])
        number = value if isinstance(value, float) else None
        text = value if isinstance(value, str) else {True: "TRUE", False: "FALSE"}[value] if isinstance(value, bool) else None
        out.append({"sheet_idx": c["sheet_idx"], "sheet": c["sheet"], "is_hidden": c["is_hidden"], "r": c["r"] - 1, "c": c["c"] - 1, "x": number, "v": text, "f": c["f"], "fmt": c["fmt"], "is_1904": book.is_1904, "status": status if c["f"] else "ok"})
    return out
