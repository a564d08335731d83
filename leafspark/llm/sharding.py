"""Contiguous shards of near-equal bytes, from global prefix sums; DataFrame functions only.

Rows are put in order of doc_id (nulls last), then size, checksum and arrival, and dealt into ranges. Each range's
total is summed, the few totals are accumulated, and a running sum within a range gives each row's place among all
bytes. A row goes to the shard in which the middle of its bytes falls, so shards are contiguous and no cut is more
than half a document off its target. Only (doc_id, size, checksum) is shuffled, never a text; a range is split by
arrival if all its ids are equal, so one id may hold any share of the rows.

Defined results: a null text has 0 bytes, and every row adds ``overhead``; repeated rows each get a place; an empty
table gives no rows; other columns are ignored by shard_documents() and kept by write_shards().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import with_ordinal
from .store import materialize


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, before, shard, slot) for each row; ``before`` is the bytes ahead of it in the whole order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = materialize(rows).withColumn("arrival", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32"), F.col("arrival")]
    ranged = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_ahead"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    # One row per range of the exchange above: its size is bounded by the number of partitions.
    placed = ranged.join(F.broadcast(totals), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        "all_bytes",
        (F.col("bytes_ahead") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"),
        (F.col("rows_ahead") + F.row_number().over(within) - 1).alias("place"),
    )
    cut = F.expr(f"cast(least({shards - 1}, ((2 * before + size) * {shards}) div (2 * all_bytes)) as int)")
    placed = materialize(placed.withColumn("shard", cut).drop("all_bytes"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    out = placed.join(F.broadcast(first), "shard")  # a row per shard
    return out.select("doc_id", "size", "text_crc32", "before", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, overhead: int = 8) -> None:
    """Write the rows of ``docs``, all columns, as Parquet in folders ``shard=N``, as many equal rows to each shard as
    shard_documents() puts there. Equal rows are numbered on both sides, so no key gathers them."""
    key = ["__id", "__bytes", "__crc"]
    plan = shard_documents(docs, shards, overhead).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("size").alias("__bytes"), F.col("text_crc32").alias("__crc"), "shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("__id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("__bytes"), F.crc32(text).alias("__crc"))
    both = with_ordinal(rows, key).join(with_ordinal(plan, key), [*key, "nth"])
    both.select("row.*", "shard").write.partitionBy("shard").parquet(path)
