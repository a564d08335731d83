"""Zip packages of office documents: parts read up to a limit, and XML as small trees."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

PART_LIMIT, TOTAL_LIMIT, DEPTH = 200 << 20, 300 << 20, 256


class Node:
    """An element: name without prefix, attributes without prefixes, and children (elements and texts)."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def all(self, *names: str) -> Iterator[Node]:
        """Elements below of these names, outermost first; not inside one another."""
        for c in self.children:
            if isinstance(c, Node):
                if c.name in names:
                    yield c
                else:
                    yield from c.all(*names)

    def first(self, name: str) -> Node | None:
        return next(self.all(name), None)

    def elements(self) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node))

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


def parse(data: bytes) -> Node:
    """A tree of what could be read: text that breaks off leaves its elements open. Entities of a DOCTYPE are refused."""
    root = Node("", {})
    stack = [root]
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(name: str, attrs: dict) -> None:
        if len(stack) > DEPTH:
            raise ValueError("too deeply nested")
        node = Node(name.rpartition(":")[2], {k.rpartition(":")[2]: v for k, v in attrs.items()})
        stack[-1].children.append(node)
        stack.append(node)

    def refuse(*_: object) -> None:
        raise ValueError("entity declarations aren't read")

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: stack.pop()
    parser.CharacterDataHandler = lambda text: stack[-1].children.append(text)
    parser.EntityDeclHandler = refuse
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        pass
    return root


class Package:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        if sum(i.file_size for i in self.zip.infolist()) > TOTAL_LIMIT:
            raise ValueError("the package is too large unpacked")

    def read(self, name: str, most: int = PART_LIMIT) -> bytes | None:
        """A part's first bytes, or None if there is none."""
        try:
            info = self.zip.getinfo(name.lstrip("/"))
        except KeyError:
            return None
        if info.flag_bits & 1:
            raise ValueError("the package is encrypted")
        with self.zip.open(info) as f:
            return f.read(most)

    def tree(self, name: str, most: int = PART_LIMIT) -> Node:
        return parse(self.read(name, most) or b"")

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Id to (type's last word, target) of a part's relations; targets are names in the package."""
        folder, _, name = part.rpartition("/")
        out = {}
        for r in self.tree(f"{folder}/_rels/{name}.rels".lstrip("/")).all("Relationship"):
            target = r.attrs.get("Target", "")
            if r.attrs.get("TargetMode") != "External":
                parts: list[str] = [] if target.startswith("/") else [p for p in folder.split("/") if p]
                for p in target.split("/"):
                    parts = parts[:-1] if p == ".." else [*parts, p] if p not in ("", ".") else parts
                target = "/".join(parts)
            out[r.attrs.get("Id", "")] = (r.attrs.get("Type", "").rpartition("/")[2], target)
        return out


def whole(text: str | None, otherwise: int = 0) -> int:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else otherwise
