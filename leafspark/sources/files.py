"""Files of a folder as one table, and each kind's rows or cells.

``scan`` reads names and sizes first and contents only of files that pass the gates; Spark prunes the content column
where it isn't asked for. A file that can't be read is a row in ``errors``, never a failed job."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from .excel import workbook_cells
from .markdown import markdown_rows
from .rows import read_rows
from .structured import page_rows
from .webpage import html_rows
from .word import word_rows

SKIPPED = ("node_modules", ".git", ".venv", "venv", "dist", "build", "__pycache__", ".next", ".cache")
CELLS = "sheet_idx int, sheet string, is_hidden boolean, r int, c int, x double, v string, f string, fmt string, is_1904 boolean, status string"


def scan(spark: SparkSession, path: str, since: datetime.datetime | None = None) -> DataFrame:
    """(path, ext, kind, size, mtime, content, problem) of the files below a folder that are of a known kind; hidden
    and tool folders are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if since:
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    files = reader.load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    kind = F.when(ext.isin(*schema.TEXT_KINDS), "text").when(ext.isin(*schema.OFFICE_KINDS), "office").when(ext.isin(*schema.PICTURE_KINDS), "picture")
    limit = F.when(F.col("kind") == "text", schema.TEXT_LIMIT).when(F.col("kind") == "office", schema.OFFICE_LIMIT).otherwise(schema.PICTURE_LIMIT)
    skipped = F.col("path").rlike(r"/(\.[^/]+|" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/")
    files = files.withColumns({"ext": ext, "kind": kind}).where(F.col("kind").isNotNull() & ~skipped)
    problem = F.when(F.col("length") > limit, F.format_string("too large: %d bytes", "length"))
    return files.select("path", "ext", "kind", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content", problem.alias("problem"))


def errors(files: DataFrame) -> DataFrame:
    return files.where("problem is not null").select("path", F.col("problem").alias("message"), F.lit(True).alias("is_notice"))


def _decoded(reader: Callable[[str], list[dict]]) -> Callable[[bytes], list[dict]]:
    return lambda content: reader(bytes(content).decode("utf-8", "replace").removeprefix("﻿"))


def _pdf(content: bytes) -> list[dict]:
    from .pdf import pdf_rows

    return pdf_rows(bytes(content))


READERS: dict[str, Callable[[bytes], list[dict]]] = {
    "md": _decoded(markdown_rows),
    "markdown": _decoded(markdown_rows),
    "html": _decoded(html_rows),
    "htm": _decoded(html_rows),
    "adf": _decoded(page_rows),
    "docx": lambda content: word_rows(bytes(content)),
    "pdf": _pdf,
}


def _reader_of(files: DataFrame) -> DataFrame:
    """``files`` without problems and the name of their reader, null if they are shown as lines: a .json file that holds a
    page is read as one, and texts beyond the limit of formatting have none."""
    text = F.col("content").cast("string")
    page = (F.get_json_object(text, "$.type") == "doc") & F.get_json_object(text, "$.content").isNotNull()
    name = F.when(F.col("ext") == "json", F.when(page, "adf")).when(F.col("ext").isin(*READERS), F.col("ext"))
    good = files.where(F.col("problem").isNull())
    return good.withColumn("reader", F.when((F.col("kind") != "text") | (F.col("size") <= schema.FORMATTED_LIMIT), name))


def document_rows(files: DataFrame, most: int = schema.ROW_LIMIT) -> DataFrame:
    """The rows of every document, by its reader or as lines; the first ``most`` of each, as notes() says."""
    from ..operators.lines import text_lines

    plain = _reader_of(files).where(F.col("reader").isNull() & (F.col("kind") == "text"))
    plain = text_lines(plain.select("path", F.col("content").cast("string").alias("text")), "path", most=None)
    return rows(files).unionByName(plain.withColumn("unit", F.lit("line")), allowMissingColumns=True).where(F.col("src") < most)


def notes(files: DataFrame, most: int = schema.ROW_LIMIT) -> DataFrame:
    """(path, note) of what document_rows() leaves out of a document or shows otherwise than asked."""
    text = F.col("content").cast("string")
    seen = _reader_of(files).where("kind = 'text'")
    big = seen.where(F.col("size") > schema.FORMATTED_LIMIT).select("path", F.lit(1).alias("place"), F.lit("This file is over 2 MB, so it is shown as plain text.").alias("said"))
    long_ = seen.where(F.col("reader").isNull() & F.exists(F.split(text, "\n"), lambda line: F.length(line) > schema.LINE_LIMIT))
    long_ = long_.select("path", F.lit(2).alias("place"), F.lit(f"Lines over {schema.LINE_LIMIT:,} characters are cut short.").alias("said"))
    counted = document_rows(files, 1 << 30).groupBy("path").agg((F.max("src") + 1).alias("n")).where(F.col("n") > most)
    capped = counted.select("path", F.lit(3).alias("place"), F.format_string(f"Only the first {most:,} of %,d rows are shown.", "n").alias("said"))
    said = big.unionByName(long_).unionByName(capped).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "said"))).alias("all"))
    return said.select("path", F.array_join(F.transform("all", lambda x: x.said), " ").alias("note"))


def rows(files: DataFrame) -> DataFrame:
    """The rows of all documents that have a reader."""
    out = None
    good = _reader_of(files)
    for ext, reader in READERS.items():
        part = read_rows(good.where(F.col("reader") == ext), "path", "content", reader)
        out = part if out is None else out.unionByName(part)
    return out


def plain_lines(files: DataFrame) -> DataFrame:
    """The numbered lines of all text files, as they are."""
    from ..operators.lines import text_lines

    texts = files.where((F.col("kind") == "text") & F.col("problem").isNull())
    return text_lines(texts.select("path", F.col("content").cast("string").alias("text")), "path")


def cells(files: DataFrame) -> DataFrame:
    """The cells of all workbooks, with calculated values and shown texts."""
    import pandas as pd

    from ..functions.numbers import cell_text
    from ..functions.text import clean_cell

    names = [f.split()[0] for f in CELLS.split(", ")]

    def run(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    found = workbook_cells(bytes(content))
                except Exception as e:  # any malformed file; its message is its result
                    found = [{"status": f"error: {e}"}]
                yield pd.DataFrame([(path, *(c.get(n) for n in names)) for c in found], columns=["path", *names]).astype({"sheet_idx": "Int32", "r": "Int32", "c": "Int32", "x": "Float64"})

    books = files.where((F.col("ext") == "xlsx") & F.col("problem").isNull())
    out = books.select("path", "content").mapInPandas(run, f"path string, {CELLS}")
    shown = F.when(F.col("x").isNotNull(), F.when(F.col("is_1904"), cell_text(F.col("x"), F.col("fmt"), True)).otherwise(cell_text(F.col("x"), F.col("fmt")))).otherwise(F.replace(clean_cell(F.coalesce("v", F.lit(""))), F.lit("\n"), F.lit(" ⏎ ")))
    return out.withColumn("shown", shown)
