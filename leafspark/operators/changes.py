"""What changed between two versions, and where a quoted place is now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from .lines import is_content

CHANGES = 2_000
SHIFT = 50
#: Rows to a block, in which comments look for their rows.
BLOCK = 128



def row_changes(before: DataFrame, after: DataFrame, key: str, most: int = CHANGES) -> DataFrame:
    """(key, src) of rows of ``after`` that ``before`` doesn't hold: as multisets, each text uses up one equal one, and
    blank rows don't count. Texts are hashed together with the key, so a text that many documents hold is spread."""
    had = before.groupBy(key, "text").agg(F.count("*").alias("had"))
    nth = F.row_number().over(Window.partitionBy(key, "text").orderBy("src"))
    new = after.withColumn("nth", nth).join(had, [key, "text"], "left")
    new = new.where((F.col("nth") > F.coalesce("had", F.lit(0))) & (F.trim("text") != ""))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("src"))
    return new.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "src")


def cell_changes(before: DataFrame, after: DataFrame, key: list[str], most: int = CHANGES) -> DataFrame:
    """(key, r, c) of cells of ``after`` that differ in value or formula, where either has a value; in order, capped."""
    old = before.select(*key, "r", "c", F.col("v").alias("old_v"), F.col("f").alias("old_f"), F.lit(True).alias("there"))
    both = after.join(old, [*key, "r", "c"], "left")
    differs = F.col("there").isNull() | (F.col("v") != F.col("old_v")) | ~F.col("f").eqNullSafe(F.col("old_f"))
    shown = (F.col("v") != "") | (F.coalesce("old_v", F.lit("")) != "")
    rank = F.row_number().over(Window.partitionBy(key[0]).orderBy(*key[1:], "r", "c"))
    return both.where(differs & shown).withColumn("rank", rank).where(F.col("rank") <= most).select(*key, "r", "c")


def nearest_rows(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, id, src): for each wanted (key, id, quote, near[, floor]) the content row of that quote nearest to ``near``, not
    before ``floor``; of two as near, the first. Rows and questions of a quote stand in one order of places, in which the
    nearest are the last row up to a question and the first behind it: two running windows, and no pairs however often a
    line repeats."""
    floor = F.col("floor") if "floor" in wanted.columns else F.lit(0)
    here = F.greatest(F.col("near"), floor.cast(wanted.schema["near"].dataType))
    none = F.lit(None)
    asked = wanted.select(key, "quote", here.alias("at"), F.lit(1).alias("kind"), "id", "near", floor.alias("floor"), none.cast("int").alias("src"))
    found = rows.where(is_content(F.col("style")))
    found = found.select(key, "quote", F.col("src").alias("at"), F.lit(0).alias("kind"), none.cast(wanted.schema["id"].dataType).alias("id"), none.cast("int").alias("near"), none.cast("int").alias("floor"), F.col("src").cast("int").alias("src"))
    up, down = (Window.partitionBy(key, "quote").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (["at", "kind"], [F.desc("at"), F.desc("kind")]))
    last = F.last("src", ignorenulls=True)
    both = found.unionByName(asked).withColumns({"before": last.over(up), "after": last.over(down)}).where("kind = 1")
    before, after = F.when(F.col("before") >= F.col("floor"), F.col("before")), F.col("after")
    nearer = F.when(before.isNull() | (F.abs(after - F.col("near")) < F.abs(before - F.col("near"))), F.coalesce(after, before)).otherwise(before)
    return both.select(key, "id", nearer.alias("src")).where("src is not null")


def reanchor_rows(rows: DataFrame, comments: DataFrame, key: str) -> DataFrame:
    """(id, from, to, is_stale) of comments (key, id, quote, from, to) on the rows (key, src, quote, style) of a new
    version: found by first line, by last line if the first is gone; stale if the text between isn't what was quoted."""
    lines = F.split("quote", "\n")
    asked = comments.select(key, "id", "quote", F.col("from").alias("a"), F.col("to").alias("b"), F.get(lines, F.lit(0)).alias("first"), F.element_at(lines, -1).alias("last"), F.size(lines).alias("n"))
    asked = asked.where(F.col("quote") != "")
    span = F.col("b") - F.col("a")
    head = nearest_rows(rows, asked.select(key, "id", F.col("first").alias("quote"), F.col("a").alias("near")), key).withColumnRenamed("src", "head")
    asked = asked.join(head, [key, "id"], "left")
    many = asked.where("n > 1")
    tail = nearest_rows(rows, many.where("head is not null").select(key, "id", F.col("last").alias("quote"), (F.col("head") + span).alias("near"), (F.col("head") + 1).alias("floor")), key)
    alone = nearest_rows(rows, many.where("head is null").select(key, "id", F.col("last").alias("quote"), F.col("b").alias("near")), key)
    asked = asked.join(tail.withColumnRenamed("src", "tail"), [key, "id"], "left").join(alone.withColumnRenamed("src", "alone"), [key, "id"], "left")
    last_row = rows.groupBy(key).agg(F.max("src").alias("last_row"))
    near_tail = F.col("tail").isNotNull() & (F.col("tail") - F.col("head") <= span * 2 + 20)
    start = F.coalesce("head", F.when(F.col("alone").isNotNull(), F.greatest(F.lit(0), F.col("alone") - span)))
    end = F.when(F.col("head").isNull(), F.col("alone")).when((F.col("n") > 1) & near_tail, F.col("tail")).otherwise(F.col("head") + span)
    placed = asked.join(last_row, key).select(key, "id", "quote", "a", "b", start.alias("start"), F.when(start.isNotNull(), F.least(end, F.col("last_row"))).alias("end"))
    covered = placed.where("start is not null").select(key, "id", F.explode(F.sequence("start", "end")).alias("src"))
    text = covered.join(rows.where(is_content(F.col("style"))).select(key, "src", F.col("quote").alias("line")), [key, "src"]).groupBy(key, "id")
    text = text.agg(F.array_sort(F.collect_list(F.struct("src", "line"))).alias("said"))
    text = text.select(key, "id", F.array_join(F.transform("said", lambda x: x.line), "\n").alias("now"))
    placed = placed.join(text, [key, "id"], "left")
    found = comments.select(key, "id", F.col("from").alias("old_from"), F.col("to").alias("old_to")).join(placed.select(key, "id", "quote", "start", "end", "now"), [key, "id"], "left")
    stale = F.col("start").isNull() | ~F.col("now").eqNullSafe(F.col("quote"))
    return found.select(key, "id", F.coalesce("start", "old_from").alias("from"), F.coalesce("end", "old_to").alias("to"), stale.alias("is_stale"))


def reanchor_shift(values: DataFrame, comments: DataFrame, key: str, most: int = SHIFT) -> DataFrame:
    """(key, id, shift) of comments (key, id, from, to, was): 0 if the rows' values are as they were; otherwise the one shift
    of up to ``most`` rows at which they are, or 0 if none or several match. ``values`` has (key, r, value), a row's
    values joined and each r once in a key. Rows go in blocks; each comment takes the blocks around it once and tries its
    shifts on that array, so there are no rows for shifts. What explode makes is not in Spark's estimate of a table's size:
    joins are by merging, lest such a table be broadcast."""
    n, low, high = F.col("n"), F.greatest(F.col("from") - most, F.lit(0)), F.col("to") + most
    asked = comments.where("to >= from").select(key, "id", F.col("from").alias("a"), F.expr("int(to - from + 1)").alias("n"), "was", low.alias("low"), high.alias("high")).where("low <= high")
    near = asked.withColumn("block", F.explode(F.expr(f"sequence(low div {BLOCK}, high div {BLOCK})")))
    held = values.groupBy(key, F.expr(f"r div {BLOCK}").alias("block")).agg(F.collect_list(F.struct("r", "value")).alias("held"))
    there = near.join(held.hint("merge"), [key, "block"]).groupBy(*asked.columns).agg(F.flatten(F.collect_list("held")).alias("rows"))
    rows = F.array_sort(F.filter("rows", lambda x: x.r.between(F.col("low"), F.col("high"))))
    there = there.withColumn("rows", rows).where("size(rows) >= n")
    whole = lambda i: F.get("rows", i + n - 1).r - F.get("rows", i).r == n - 1
    now = lambda i: F.array_join(F.transform(F.slice("rows", i + 1, n), lambda x: x.value), "\n")
    starts = F.filter(F.sequence(F.lit(0), F.size("rows") - n), lambda i: whole(i) & (now(i) == F.col("was")))
    hits = there.select(key, "id", F.transform(starts, lambda i: (F.get("rows", i).r - F.col("a")).cast("int")).alias("shifts")).where("size(shifts) > 0")
    out = comments.select(key, "id").join(hits.hint("merge"), [key, "id"], "left")
    one = (F.size("shifts") == 1) & ~F.array_contains("shifts", 0)
    return out.select(key, "id", F.when(one, F.get("shifts", F.lit(0))).otherwise(0).alias("shift"))


def quoted_values(quote: Column) -> Column:
    """The values that a quote of cells names, in order."""
    lines = F.filter(F.split(quote, "\n"), lambda x: x.rlike(r"^[A-Z]+\d+: "))
    return F.transform(lines, lambda x: F.regexp_extract(x, r"^[A-Z]+\d+: (.*?)(?: {2}\(formula .*\))?$", 1))


