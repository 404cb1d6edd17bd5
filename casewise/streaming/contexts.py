"""Sources of live event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def read_stream_log(spark, path: str, schema: str, to_log, *, fmt: str = "parquet", files_per_batch: int | None = None, options: dict | None = None) -> DataFrame:
    """A growing folder as a stream of events; ``to_log`` maps its rows to the event log."""
    reader = spark.readStream.format(fmt).schema(schema).options(**(options or {}))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return to_log(reader.load(path))


def with_lateness(stream: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Accept events up to ``delay`` late."""
    return stream.withWatermark(ts, delay)
