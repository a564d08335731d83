"""Texts as numbered lines, and what is asked of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T


def text_lines(docs: DataFrame, key: str, text: str = "text", most: int | None = schema.ROW_LIMIT) -> DataFrame:
    """(key, src, text, anchor) for each line of each text: controls dropped, tabs as two spaces, long lines cut, and one
    empty line at the end dropped. All within a row: no shuffle."""
    safe = F.replace(T.strip_controls(F.coalesce(F.col(text), F.lit(""))), F.lit("\t"), F.lit("  "))
    lines = docs.select(key, F.split(safe, "\n").alias("__lines"))
    size = F.size("__lines")
    shown = F.when((size > 1) & (F.element_at("__lines", -1) == ""), size - 1).otherwise(size)
    shown = F.least(shown, F.lit(most)) if most else shown
    lines = lines.select(key, F.slice("__lines", F.lit(1), shown).alias("__lines"))
    # The array has an entry always. Of the outer form Spark infers no filter, which would repeat the clean-up in the scan.
    lines = lines.select(key, F.posexplode_outer("__lines").alias("src", "line"))
    return lines.select(key, "src", T.cut(F.col("line"), schema.LINE_LIMIT).alias("text"), F.format_string("line %d", F.col("src") + 1).alias("anchor"))


def row_cap_notes(docs: DataFrame, key: str, text: str = "text", most: int = schema.ROW_LIMIT) -> DataFrame:
    """The note of each text of more lines than are shown."""
    safe = T.strip_controls(F.coalesce(F.col(text), F.lit("")))
    found = docs.select(key, F.split(safe, "\n").alias("__lines"))
    n = F.when((F.size("__lines") > 1) & (F.element_at("__lines", -1) == ""), F.size("__lines") - 1).otherwise(F.size("__lines"))
    notes = found.select(key, n.alias("n")).where(F.col("n") > most)
    return notes.select(key, F.format_string(f"Only the first {most:,} of %,d rows are shown.", "n").alias("message"))


def is_content(style: Column) -> Column:
    return ~F.coalesce(style, F.lit("")).isin("space", "rule")


def row_quote(style: Column, text: Column, indent: Column, marker: Column) -> Column:
    """A row as a comment quotes it: a list item keeps its bullet and depth."""
    lead = F.concat(F.repeat(F.lit("  "), F.least(F.coalesce(indent, F.lit(0)), F.lit(8))), F.coalesce(marker, F.lit("•")), F.lit(" "))
    return F.when(style == "li", F.concat(lead, text)).otherwise(text)


def overlay_marks(rows: DataFrame, comments: DataFrame, key: str) -> DataFrame:
    """Rows under a comment's interval, with the strongest mark: waiting (2) before sent (3). Intervals are turned into
    the rows that they cover, so the range join is an equi-join on (key, src)."""
    mark = F.when(F.col("status") == "sent", 3).otherwise(2)
    covered = comments.select(key, mark.alias("mark"), F.explode(F.sequence("from", "to")).alias("src"))
    best = covered.groupBy(key, "src").agg(F.min("mark").alias("mark"))
    return rows.join(best, [key, "src"], "left").withColumn("mark", F.coalesce("mark", F.lit(0)))


def status_counts(comments: DataFrame, by: list[str]) -> DataFrame:
    return comments.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("draft", "queued", "sent")))


def note_label(sheet: Column, label: Column, path: Column, open_path: str) -> Column:
    """A comment's place without its sheet, or with its file in front if another is open."""
    from ..functions.numbers import quote_sheet

    prefix = F.concat(quote_sheet(sheet), F.lit("!"))
    short = F.when(sheet.isNotNull() & F.startswith(label, prefix), F.substr(label, F.length(prefix) + 1)).otherwise(label)
    return F.when(path == open_path, T.capitalise(short)).otherwise(F.concat(F.substring_index(path, "/", -1), F.lit(" · "), short))


def merged_label(first: Column, last: Column) -> Column:
    """The name of a range of rows by its ends' anchors; the first one's heading stays."""
    split = F.locate(' (under "', first)
    core = F.when(split > 0, F.substr(first, F.lit(1), split - 1)).otherwise(first)
    suffix = F.when(split > 0, F.substr(first, split)).otherwise("")
    cut = F.locate(' (under "', last)
    end = F.when(cut > 0, F.substr(last, F.lit(1), cut - 1)).otherwise(last)
    line, paragraph = r"^lines? (\d+)(?:–(\d+))?$", r"^paragraph (\d+)$"
    upper = F.when(F.regexp_extract(end, line, 2) != "", F.regexp_extract(end, line, 2)).otherwise(F.regexp_extract(end, line, 1))
    lines = F.concat(F.lit("lines "), F.regexp_extract(core, line, 1), F.lit("–"), upper, suffix)
    paragraphs = F.concat(F.lit("paragraphs "), F.regexp_extract(core, paragraph, 1), F.lit("–"), F.regexp_extract(end, paragraph, 1), suffix)
    other = F.concat(core, F.lit(" to "), end, suffix)
    return F.when(core == end, first).when(core.rlike(line) & end.rlike(line), lines).when(core.rlike(paragraph) & end.rlike(paragraph), paragraphs).otherwise(other)


def table_islands(rows: DataFrame, key: str, order: str, inside: Column) -> DataFrame:
    """Runs of consecutive rows inside a table, numbered per key."""
    w = Window.partitionBy(key).orderBy(order)
    starts = inside & ~F.coalesce(F.lag(inside).over(w), F.lit(False))
    numbered = rows.withColumn("__inside", inside).withColumn("island", F.sum(starts.cast("int")).over(w))
    return numbered.where("__inside").drop("__inside")


def layout_tables(rows: DataFrame, key: str, most: int = 36) -> DataFrame:
    """Table rows with every column padded to its widest cell in the run (``most`` at most) and joined by bars."""
    runs = table_islands(rows, key, "src", F.col("cells").isNotNull())
    each = runs.select(key, "island", "src", F.posexplode("cells").alias("pos", "cell"))
    widest = F.least(F.lit(most), F.max(T.str_width(F.col("cell"))).over(Window.partitionBy(key, "island", "pos")))
    each = each.withColumn("w", widest)
    shown = F.when(T.str_width(F.col("cell")) <= F.col("w"), F.col("cell")).otherwise(F.concat(T.fit_start(F.col("cell"), F.col("w") - 1), F.lit("…")))
    each = each.withColumn("shown", F.concat(shown, F.repeat(F.lit(" "), F.col("w") - T.str_width(shown))))
    one = each.groupBy(key, "island", "src").agg(F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("parts"))
    return one.select(key, "island", "src", F.array_join(F.transform("parts", lambda p: p.shown), " | ").alias("text"))


def spaced(rows: DataFrame, key: str) -> DataFrame:
    """Rows with blank spacers trimmed at both ends, and at most one between blocks."""
    w = Window.partitionBy(key).orderBy("src")
    is_space = F.col("style").eqNullSafe("space")
    before = F.max(F.when(~is_space, F.col("src"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(~is_space, F.col("src"))).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    doubled = is_space & F.coalesce(F.lag(is_space).over(w), F.lit(False))
    marked = rows.withColumn("__drop", is_space & (before.isNull() | after.isNull() | doubled))
    return marked.where(~F.col("__drop")).drop("__drop")


def unit_counts(rows: DataFrame, key: str) -> DataFrame:
    """How many rows a document counts, without spacers, rules and table rows."""
    counted = ~F.coalesce(F.col("style"), F.lit("")).isin("space", "rule", "th", "td")
    return rows.groupBy(key).agg(F.count_if(counted).alias("units"))


def viewport(rows: DataFrame, top: int, height: int) -> DataFrame:
    return rows.where(F.col("src").between(top, top + height - 1))


def describe_selections(rows: DataFrame, selections: DataFrame, key: str) -> DataFrame:
    """(id, from, to, label, quote) of selections (key, id, from, to) on rows (key, src, anchor, style, quote): ends on
    spacers and rules move inwards; a selection of spacers only goes to the content above, else below. Only the rows
    of a selection are joined to it, apart from the nearest content on either side, which are two aggregates."""
    content = rows.where(is_content(F.col("style"))).select(key, "src", "anchor", "quote")
    near = selections.select(key, "id", "from", "to").join(content.select(key, "src"), key)
    inside = F.col("src").between(F.col("from"), F.col("to"))
    ends = near.groupBy(key, "id", "from", "to").agg(
        F.min(F.when(inside, F.col("src"))).alias("a"),
        F.max(F.when(inside, F.col("src"))).alias("b"),
        F.max(F.when(F.col("src") < F.col("from"), F.col("src"))).alias("above"),
        F.min(F.when(F.col("src") > F.col("to"), F.col("src"))).alias("below"),
    )
    other = F.coalesce("above", "below")
    ends = ends.select(key, "id", F.coalesce("a", other).alias("from"), F.coalesce("b", other).alias("to"))
    said = ends.withColumn("src", F.explode(F.sequence("from", "to"))).join(content, [key, "src"])
    one = said.groupBy(key, "id", "from", "to").agg(F.array_sort(F.collect_list(F.struct("src", "quote", "anchor"))).alias("said"))
    label = merged_label(F.element_at("said", 1).anchor, F.element_at("said", -1).anchor)
    return one.select(key, "id", "from", "to", label.alias("label"), F.array_join(F.transform("said", lambda x: x.quote), "\n").alias("quote"))


def list_head(comments: DataFrame, by: list[str], most: int = 12) -> DataFrame:
    """The first comments of each list, and how many more there are."""
    place = Window.partitionBy(*by).orderBy("id")
    counted = comments.withColumns({"place": F.row_number().over(place), "in_all": F.count("*").over(Window.partitionBy(*by))})
    return counted.where(F.col("place") <= most).withColumn("more", F.greatest(F.lit(0), F.col("in_all") - most)).drop("in_all")
