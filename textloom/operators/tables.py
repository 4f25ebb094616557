"""Intermediate tables: written once to a folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Spark removes a query's shuffle files when the query ends, where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, on one machine alone (tests), a new local folder."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(f"file://{tempfile.mkdtemp(prefix='textloom-')}")
    return _own_dir[0]


def checkpointed(df: DataFrame, after: Iterable[DataFrame] = ()) -> DataFrame:
    """df written and read again: what comes next starts from a table whose size is known, not from the plan that made it.

    after: results of this function that nothing reads any more; they are removed.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path := f"{shared_dir(spark)}/table-{uuid.uuid4().hex}")
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    for done in after:
        drop(spark, done.written_at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
