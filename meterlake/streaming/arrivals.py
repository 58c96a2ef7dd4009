"""Bills as they arrive: an extension, as the batch operators applied to streams of files or rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import dedupe


def files(spark: SparkSession, folder: str, largest: int) -> DataFrame:
    """New files of a folder, with their hash; larger ones are left out before their content is read."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return dedupe.with_hash(found.filter(F.col("length") <= largest))


def once_each(files: DataFrame, time: str = "modificationTime", late: str = "7 days") -> DataFrame:
    """The first file of each hash within the watermark; state older than that is dropped."""
    return files.withWatermark(time, late).dropDuplicatesWithinWatermark(["file_hash"])


def rejected_by_hour(bills: DataFrame, time: str = "created_at", late: str = "1 hour") -> DataFrame:
    """Bills by status and hour, closed when the watermark passes."""
    return bills.withWatermark(time, late).groupBy(F.window(time, "1 hour"), "validation_status").agg(F.count(F.lit(1)).alias("n"))


def into_store(events: DataFrame, path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataStreamWriter:
    """Append each micro-batch of events to the store's log. A batch that is tried again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
