"""Intermediate tables in the folder that driver and executors share.

A written Parquet table cuts lineage, survives lost executors and is computed once; ``checkpoint()`` would compute
its plan twice. The folder is ``spark.checkpoint.dir``; only a local session without it gets a temporary folder.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="leafspark-")
        _roots[app] = f"{base.rstrip('/')}/leafspark-{app}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    """Best effort: the session may have ended before the interpreter does."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM is gone, and there is nothing left to report to
        pass


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, with the same columns."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark find the shuffle files that nothing does: it removes
    those of collected plans only, and a driver with little to do collects seldom."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()
