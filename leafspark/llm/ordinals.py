"""Numbers for rows that have a key in common, whatever share of all rows one key holds; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize


def with_ordinal(rows: DataFrame, key: list[str], name: str = "nth") -> DataFrame:
    """``rows`` and a number from 0 among the rows with the same ``key`` (columns without nulls), in no set order.

    Rows whose key stands alone, mostly all, are neither written nor shuffled more than the one join needs. The others are
    written with the number of their task; counts by key and task give where each task's share of a key begins, so
    numbering needs no more than one task's rows of a key together.
    """
    again = materialize(rows.groupBy(*key).agg(F.count("*").alias("__rows")).where("__rows > 1"))
    if again.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    marked = rows.join(again, key, "left")
    alone = marked.where("__rows is null").drop("__rows").withColumn(name, F.lit(0).cast("long"))
    several = materialize(marked.where("__rows is not null").drop("__rows").withColumn("__task", F.spark_partition_id()))
    of_task = [*key, "__task"]
    counts = several.groupBy(*of_task).agg(F.count("*").alias("__here"))
    before = F.sum("__here").over(Window.partitionBy(*key).orderBy("__task")) - F.col("__here")
    counts = materialize(counts.select(*of_task, before.alias("__before")))
    here = F.row_number().over(Window.partitionBy(*of_task).orderBy(F.lit(0))) - 1
    several = several.withColumn("__here", here).join(counts, of_task)
    return alone.unionByName(several.withColumn(name, (F.col("__here") + F.col("__before")).cast("long")).drop("__task", "__here", "__before"))
