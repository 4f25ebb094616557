"""Record files as a stream: each batch of new files is merged into the tables of a bank, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.sources import records as R


def record_stream(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, value) of the JSON lines of new files under path."""
    return spark.readStream.format("text").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def run_available(spark: SparkSession, path: str, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Merge what has come since the last run and end. The checkpoint is the cursor: a batch that was merged isn't read again.

    merge gets valid records, ordered by seq, and the batch number; it has to be idempotent for a batch number, as a run that is
    lost between merge and commit gives the same batch again.
    """

    def batch(lines: DataFrame, number: int) -> None:
        n = F.monotonically_increasing_id()  # in order within a file, which one task reads or neighbouring ones do
        seq = F.struct("modified", "file", n.alias("n"))
        numbered = lines.select(seq.alias("seq"), "value")
        merge(R.valid(R.parsed(numbered)), number)

    return record_stream(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
