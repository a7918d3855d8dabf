"""Continuous replay of a change log with Structured Streaming.

A directory of change files is read as a stream.  Each micro-batch is folded
to the newest change of its keys and merged with the state so far, which is a
Parquet folder for each batch number; a batch that runs again writes the same
folder, so the state is exact after failures.  There is no event time: the
sequence number orders everything, so nothing is ever late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.operators.read import newest


def change_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """Files of a directory as a stream; ``files_per_batch`` is the back pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class LatestState:
    """The newest change of every key, kept under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.batch = spark, root.rstrip("/"), -1

    def path(self, batch: int) -> str:
        return f"{self.root}/state/{batch:09d}"

    def merge(self, changes: DataFrame, batch: int) -> None:
        """The sink: folds a micro-batch into the state before it."""
        rows = changes.select("key", "seq", "type", "value")
        if batch > 0:
            rows = rows.unionByName(self.spark.read.parquet(self.path(batch - 1)))
        newest(rows).write.mode("overwrite").parquet(self.path(batch))
        self.batch = batch

    def run(self, log: DataFrame) -> LatestState:
        """Replays all that is there and ends; a later call goes on from there."""
        query = log.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.root}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path(self.batch))


def grouped_counts(log: DataFrame) -> DataFrame:
    """Running counts of puts and deletions, for complete-mode sinks."""
    return log.groupBy("type").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))
