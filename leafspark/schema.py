"""The tables that sources make and operators take.

Rows and cells count from 0; formula references and line anchors count from 1.
"""

from __future__ import annotations

SPANS = "array<struct<t string, b boolean, i boolean, c boolean, l boolean, s boolean, d boolean>>"
ROW = f"src int, text string, anchor string, style string, unit string, spans {SPANS}, indent int, marker string, tone string, pic string, cells array<string>, is_header boolean"
CELL = "sheet_idx int, sheet string, r int, c int, v string, f string, x double, status string"
FILES = "path string, ext string, kind string, size long, mtime timestamp, content binary"

#: Extensions that are read, by kind of result.
TEXT_KINDS = ("md", "markdown", "txt", "html", "htm", "csv", "json", "yaml", "yml", "adf")
OFFICE_KINDS = ("docx", "pdf", "xlsx")
PICTURE_KINDS = ("png",)
#: Bytes that a file may have.
TEXT_LIMIT, FORMATTED_LIMIT, OFFICE_LIMIT, PICTURE_LIMIT = 4 << 20, 2_000_000, 50 << 20, 4 << 20
#: Lines of a text and characters of a line that are shown.
ROW_LIMIT, LINE_LIMIT = 20_000, 20_000
