"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded Bernoulli copy.

Sizes are word counts (runs of characters other than 0x20 and 0x09-0x0D). Sources, by code point with null last,
weigh 1, 2, 3 in turn and share all words; a target stops at ``most`` times its source, and the excess is shared
again by weight. That is water filling: with sources in order of size by weight, the capped ones come first, so two
running sums give the level at which the rest stand. A document of a source with rate r is taken floor(r) times and
once more if a hash of its doc_id, its text and its number among equal rows, read as a number from 0 to 1, is below the
fraction of r. So rows that share a doc_id, or have none, are drawn each on its own, and a source comes near its target
even if one row makes up most of it.

Texts aren't shuffled but for rows that occur several times: the source table is written, its size is then known, and
Spark broadcasts it if it is below spark.sql.autoBroadcastJoinThreshold and otherwise splits the join by AQE.

Defined results: a null text has size 0 and is drawn as an empty one; a source without words has target 0 and is never
taken; of equal rows each has its own draw, and reruns take as many of them; null ids hash as the empty string; an empty
table gives no rows; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import with_ordinal
from .store import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) for each source."""
    sizes = docs.select(F.col("source").cast("string"), word_count(F.col("text").cast("string")).alias("size"))
    sizes = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*map(F.lit, weights))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sizes.select("source", "source_size", rank.alias("rank"), F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")).alias("weight"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.select(
        "*",
        F.coalesce(F.sum(F.col("source_size") * most).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        F.sum("source_size").over(everything).alias("total"),
    )
    ranked = ranked.withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("source_size") * most, F.col("level"))
    # Levels only rise while sources are capped; the first that fits is the least that fits.
    level = F.first(fits, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.select("source", "source_size", F.least((F.col("source_size") * most).cast("double"), level * F.col("weight")).alias("target"))


def repetition_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, with size, source_size, target and copies."""
    targets = materialize(source_targets(docs, weights, most)).withColumnRenamed("source", "__source")
    text, doc_id = F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("__own"), word_count(text).alias("size"), doc_id.alias("__id"), F.md5(F.coalesce(text, F.lit(""))).alias("__text"))
    rows = with_ordinal(rows, ["__id", "__text"], "__nth").join(targets, F.col("__own").eqNullSafe(F.col("__source")))
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "__id", "__text", F.col("__nth").cast("string"))), 1, 13), 16, 10).cast("long")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    once_more = digits / F.lit(float(1 << 52)) < rate - F.floor(rate)
    return rows.select("row", "size", "source_size", "target", (F.floor(rate) + once_more.cast("long")).alias("copies"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with the same columns."""
    plan = repetition_plan(docs, weights, most, seed).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
