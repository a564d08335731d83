"""What the document readers share: rows, spans, spacers, and running a reader over a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from .. import schema

FLAGS = ("b", "i", "c", "l", "s", "d")  # bold, italic, code, link, strike, dim
FIELDS = ("text", "anchor", "style", "unit", "spans", "indent", "marker", "tone", "pic", "cells", "is_header")


def span(text: str, **flags: bool) -> dict:
    return {"t": text} | {k: flags.get(k, False) for k in FLAGS}


def tidy(spans: list[dict]) -> list[dict]:
    """Neighbours that look alike are one, and empty ones go."""
    out: list[dict] = []
    for s in spans:
        if out and all(out[-1][k] == s[k] for k in FLAGS):
            out[-1] = out[-1] | {"t": out[-1]["t"] + s["t"]}
        elif s["t"]:
            out.append(dict(s))
    return out


def squash(spans: list[dict]) -> list[dict]:
    """Whitespace as a page shows it: runs are one space but in code, none at the ends."""
    out = [s if s["c"] else s | {"t": re.sub(r"\s+", " ", s["t"])} for s in spans]
    if out:
        out[0] = out[0] | {"t": out[0]["t"].lstrip()}
        out[-1] = out[-1] | {"t": out[-1]["t"].rstrip()}
    return tidy(out)


def plain(spans: list[dict]) -> str:
    return "".join(s["t"] for s in spans)


class Rows(list):
    """Rows of one document, with a blank one between blocks where asked."""

    def __init__(self, unit: str):
        super().__init__()
        self.unit = unit

    def put(self, text: str, anchor: str, style: str, spans: list[dict] | None = None, **more) -> None:
        self.append({"text": text, "anchor": anchor, "style": style, "unit": self.unit, "spans": spans} | more)

    def gap(self) -> None:
        if self and self[-1]["style"] != "space":
            self.append({"text": "", "anchor": self[-1]["anchor"], "style": "space", "unit": self.unit, "spans": None})

    def table(self, cells: list[list[list[dict]]], header: int, anchor: Callable[[int], str]) -> None:
        """Table rows; their layout is a later step over all rows of a run."""
        width = max(map(len, cells), default=0)
        self.gap()
        for r, row in enumerate(cells):
            texts = [plain(c) for c in row] + [""] * (width - len(row))
            self.put(" | ".join(texts), anchor(r), "th" if r < header else "td", cells=texts, is_header=r < header)
        self.gap()

    def done(self) -> list[dict]:
        start, end = 0, len(self)
        while start < end and self[start]["style"] == "space":
            start += 1
        while end > start and self[end - 1]["style"] == "space":
            end -= 1
        return self[start:end]


def read_rows(docs: DataFrame, key: str, content: str, reader: Callable[[object], list[dict]]) -> DataFrame:
    """The rows of each document, numbered: (key, src, ...). A reader that fails gives one row of style ``error``, so
    that one bad file doesn't end a job. Documents are read one by one as they arrive, in Arrow batches."""
    import pandas as pd

    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, value in zip(frame[key], frame[content], strict=True):
                try:
                    rows = reader(value) if value is not None else []
                except Exception as e:  # any malformed file; its message is its result
                    rows = [{"text": f"{type(e).__name__}: {e}", "anchor": "", "style": "error", "unit": None}]
                out += [(k, i, *(row.get(f) for f in FIELDS)) for i, row in enumerate(rows)]
                if len(out) > 20_000:
                    yield frame_of(out)
                    out = []
            yield frame_of(out)

    def frame_of(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=[key, "src", *FIELDS])
        frame["indent"] = frame["indent"].astype("Int32")
        frame["src"] = frame["src"].astype("int32")
        return frame

    return docs.select(key, content).mapInPandas(run, f"{key} {kind}, {schema.ROW}")
