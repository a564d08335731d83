"""Tables as the queries read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A Parquet table. With ``spread``, one that lies in fewer files than there are cores is dealt out to all of them once, for
    work that costs far more than that exchange; tables in many files are left as they are."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if spread and len(found.inputFiles()) < cores else found
