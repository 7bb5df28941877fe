"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Intermediate tables of this process that have not been removed, in the order in which they were written.
_MADE: list[str] = []
#: When the driver last collected what it no longer refers to.
_COLLECTED = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only in a local session that lacks it, as in tests, a folder of
    this machine is set; a cluster's executors would not see one, so there it must be given."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def place(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, which ``clear`` will remove."""
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _MADE.append(at)
    return at


def settle(df: DataFrame, what: str, *past: DataFrame) -> DataFrame:
    """Cuts the lineage: ``df`` written as Parquet to the shared folder and read back.

    ``past``: tables settled before that nobody reads any more once this one is written; they are removed.
    Every few seconds the driver is asked to collect what it no longer refers to, since only then Spark
    removes the shuffle files of the jobs that are over.
    """
    at = place(df.sparkSession, what)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._settled_at = at
    forget(*past)
    if time.monotonic() - _COLLECTED[0] > 5:
        df.sparkSession.sparkContext._jvm.System.gc()
        _COLLECTED[0] = time.monotonic()
    return out


def forget(*tables: DataFrame) -> None:
    """Removes settled tables that nobody reads any more; others are left alone."""
    for df in tables:
        at = getattr(df, "_settled_at", None)
        if at in _MADE:
            _MADE.remove(at)
            _remove(df.sparkSession, at)


def _remove(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession, since: int = 0) -> int:
    """Removes the intermediate tables that were written after the first ``since``; how many there were.

    Only once all results that rest on them have been written: a query's result reads them.
    """
    gone = _MADE[since:]
    del _MADE[since:]
    for at in gone:
        _remove(spark, at)
    return len(gone)


@contextmanager
def scope(spark: SparkSession):
    """Removes at its end, also after an error, the intermediate tables written and the tables cached inside::

        with scope(spark):
            queries()["exact_neighbours"](spark, folder).write.parquet(out)
    """
    since = len(_MADE)
    try:
        yield
    finally:
        clear(spark, since)
        spark.catalog.clearCache()
