"""Run files as a stream: parsed as they arrive, each run once, latest state by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumflow.operators import drift

FILES = "file_id long, series string, path string, modified_at timestamp, collected_at timestamp, body string"


def run_stream(spark: SparkSession, path: str, schema: str = FILES, late: str = "45 days") -> DataFrame:
    """Run files of a growing folder, typed; one that is collected again within the watermark is dropped."""
    files = spark.readStream.schema(schema).parquet(path).withWatermark("modified_at", late)
    return drift.unified(files.dropDuplicatesWithinWatermark(["path", "modified_at"]))


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a table; exactly once by its checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by event-time window and keys, late rows taken up to the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).count()
