"""A table as a sheet: one long row per cell, and queries over ranges of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers

QUOTED_CELLS = 60
WIDTH_ROWS = 300


def table_cells(table: DataFrame, key: list[str], columns: list[str], sheet: str) -> DataFrame:
    """(sheet, k, c, v, x) for each cell; ``k`` is the key as a struct, so that no global row number is needed."""
    pieces = []
    for c, name in enumerate(columns):
        kind = table.schema[name].dataType.typeName()
        x = F.col(name).cast("double") if kind in ("integer", "long", "double", "float", "short", "byte") or kind.startswith("decimal") else F.lit(None).cast("double")
        pieces.append(F.struct(F.lit(c).alias("c"), F.coalesce(F.col(name).cast("string"), F.lit("")).alias("v"), x.alias("x")))
    cells = table.select(F.struct(*key).alias("k"), F.explode(F.array(*pieces)).alias("cell"))
    return cells.select(F.lit(sheet).alias("sheet"), "k", "cell.c", "cell.v", "cell.x")


def numbered(table: DataFrame, order: list[str], name: str = "r") -> DataFrame:
    """``table`` with row numbers from 0 in an order, by per-partition counts rather than one global window."""
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("__id", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id").persist()
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # A row for each partition: bounded by the exchange above.
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (F.col("__at") + F.col("__before")).cast("int")).drop("__part", "__at", "__n", "__before")


def in_range(rows: tuple[int, int], columns: tuple[int, int]) -> Column:
    return F.col("r").between(*rows) & F.col("c").between(*columns)


def range_stats(cells: DataFrame, rows: tuple[int, int], columns: tuple[int, int], by: list[str]) -> DataFrame:
    """Filled cells, and the sum and average of those with a number (none: null)."""
    inside = cells.where(in_range(rows, columns)).groupBy(*by)
    return inside.agg(F.count_if(F.col("v") != "").alias("filled"), F.sum("x").alias("total"), F.avg("x").alias("average"))


def cell_ref(r: Column, c: Column) -> Column:
    return F.concat(numbers.col_letters(c + 1), (r + 1).cast("string"))


def quote_range(cells: DataFrame, rows: tuple[int, int], columns: tuple[int, int], by: list[str]) -> DataFrame:
    """What a comment quotes: the first 60 filled cells row by row, and how many more there are. Numbering is per
    sheet; the rows collected are bounded."""
    order = Window.partitionBy(*by).orderBy("r", "c")
    f = F.col("f") if "f" in cells.columns else F.lit(None).cast("string")
    line = F.concat(cell_ref(F.col("r"), F.col("c")), F.lit(": "), F.col("v"), F.when(f.isNotNull() & (f != ""), F.concat(F.lit("  (formula "), f, F.lit(")"))).otherwise(""))
    inside = cells.where(in_range(rows, columns) & (F.col("v") != "")).select(*by, "r", "c", line.alias("line"))
    inside = inside.withColumn("n", F.row_number().over(order))
    one = inside.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("n") <= QUOTED_CELLS, F.struct("n", "line")))).alias("lines"), F.count("*").alias("cells"))
    text = F.array_join(F.transform("lines", lambda x: x.line), "\n")
    more = F.when(F.col("cells") > QUOTED_CELLS, F.format_string("\n… and %d more cells", F.col("cells") - QUOTED_CELLS)).otherwise("")
    return one.select(*by, F.concat(text, more).alias("quote"))


def range_label(sheet: Column, rows: tuple[int, int], columns: tuple[int, int]) -> Column:
    a, b = cell_ref(F.lit(rows[0]), F.lit(columns[0])), cell_ref(F.lit(rows[1]), F.lit(columns[1]))
    return F.concat(numbers.quote_sheet(sheet), F.lit("!"), a if rows[0] == rows[1] and columns[0] == columns[1] else F.concat(a, F.lit(":"), b))


def has_header(cells: DataFrame, by: list[str]) -> DataFrame:
    """Whether a sheet's first row is all text: some cell filled there, none with a number or formula, and a row below."""
    top = F.col("r") == 0
    f = F.col("f") if "f" in cells.columns else F.lit(None).cast("string")
    filled = top & (F.col("v") != "")
    test = (F.max("r") >= 1) & (F.count_if(filled) > 0) & (F.count_if(filled & (F.col("x").isNotNull() | f.isNotNull())) == 0)
    return cells.groupBy(*by).agg(test.alias("has_header"))


def cell_classes(cells: DataFrame) -> DataFrame:
    """Flags that decide how a cell is drawn."""
    f = F.col("f") if "f" in cells.columns else F.lit(None).cast("string")
    return cells.select("*", f.isNotNull().alias("is_formula"), F.col("x").isNotNull().alias("is_number"), F.coalesce(F.col("x") < 0, F.lit(False)).alias("is_negative"), F.col("v").startswith("#").alias("is_error"))


def column_widths(cells: DataFrame, width: Column, by: list[str]) -> DataFrame:
    """Cells a column takes: its widest value in the first rows, from 3 to 16."""
    return cells.where(F.col("r") < WIDTH_ROWS).groupBy(*by, "c").agg(F.greatest(F.lit(3), F.least(F.lit(16), F.max(width))).alias("width"))
