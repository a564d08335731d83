"""Files watched and comments kept, with Structured Streaming.

``versions`` numbers what each path looked like over time and keeps the last good read; ``watch`` does so for a folder
with a file source and a trigger. ``comment_states`` folds comment events into a state per place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POLL = "2 seconds"
RECENT = 30


def versions(snapshots: DataFrame) -> DataFrame:
    """(path, seq, mtime, content, problem) to versions: a snapshot counts when its time differs from the one before,
    either way; ``shown`` is the last content that was read without a problem."""
    w = Window.partitionBy("path").orderBy("seq")
    changed = ~F.col("mtime").eqNullSafe(F.lag("mtime").over(w)) | (F.row_number().over(w) == 1)
    kept = snapshots.withColumn("__changed", changed).where("__changed").drop("__changed")
    good = F.when(F.col("problem").isNull(), F.col("content"))
    return kept.withColumn("version", F.row_number().over(w)).withColumn("shown", F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def watch(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = False):
    """A query that hands new and changed text files of a folder to ``each``(rows, batch), polling every two seconds."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("content"))
    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def recent(opened: DataFrame, most: int = RECENT) -> DataFrame:
    """The list of recently opened paths, newest last; ``shown`` ones are never evicted."""
    last = opened.groupBy("path").agg(F.min("seq").alias("seq"), F.max("shown").alias("shown"))
    rank = F.row_number().over(Window.orderBy(F.desc("shown"), F.desc("seq")))
    return last.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank").orderBy("seq")


def step(state: tuple | None, event: str, text: str | None, batch: int | None) -> tuple | None:
    """A comment's state (status, text, batch) after an event: save, queue, unqueue, send, done, restart."""
    status, old, in_batch = state or (None, None, None)
    if event == "save":
        if not text:
            return None if status == "draft" else state
        return ("draft", text, None) if status in (None, "draft") else state
    if event == "queue" and status == "draft":
        return ("queued", old, None)
    if event == "unqueue" and status == "queued":
        return ("draft", old, None)
    if event == "send" and status in ("draft", "queued"):
        return ("sent", old, batch)
    if event == "done" and status == "sent" and in_batch == batch:
        return None
    if event == "restart" and status == "sent":
        return None
    return state


_STATE = "status string, text string, batch long"
_OUT = f"place string, {_STATE}"


def comment_states(events: DataFrame) -> DataFrame:
    """(place, status, text, batch) after each batch of events (place, seq, event, text, batch) of a stream. A comment
    that is gone has a null status. Events of one place are folded in order of seq; its state is one small row."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        for row in rows.itertuples():
            batch = None if row.batch is None or row.batch != row.batch else int(row.batch)
            now = step(now, row.event, row.text, batch)
        if now is None:
            state.remove() if state.exists else None
        else:
            state.update(now)
        yield pd.DataFrame([(key[0], *(now or (None, None, None)))], columns=["place", "status", "text", "batch"]).astype({"batch": "Int64"})

    return events.groupBy("place").applyInPandasWithState(fold, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def fold_comments(events: DataFrame) -> DataFrame:
    """The same over a finished table: the ordered fold as one aggregate expression."""
    said = F.array_sort(F.collect_list(F.struct("seq", "event", "text", "batch")))
    none = F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("batch"))

    def state(status: Column, text: Column, batch: Column) -> Column:
        return F.struct(status.alias("status"), text.alias("text"), batch.cast("long").alias("batch"))

    def merge(a: Column, e: Column) -> Column:
        nothing = F.lit(None).cast("long")
        is_draft, full = a.status.isNull() | (a.status == "draft"), F.coalesce(e.text, F.lit("")) != ""
        out = F.when((e.event == "save") & is_draft & full, state(F.lit("draft"), e.text, nothing)).when((e.event == "save") & is_draft, none)
        out = out.when((e.event == "queue") & (a.status == "draft"), state(F.lit("queued"), a.text, nothing)).when((e.event == "unqueue") & (a.status == "queued"), state(F.lit("draft"), a.text, nothing))
        out = out.when((e.event == "send") & a.status.isin("draft", "queued"), state(F.lit("sent"), a.text, e.batch))
        return out.when((a.status == "sent") & ((e.event == "restart") | ((e.event == "done") & (a.batch == e.batch))), none).otherwise(a)

    return events.groupBy("place").agg(F.aggregate(said, none, merge).alias("s")).select("place", "s.*")
