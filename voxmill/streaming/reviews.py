"""An extension: the same pipeline over a stream of review rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: str = "id", event_time: str = "seen_at", lateness: str = "1 hour") -> DataFrame:
    """Rows whose key wasn't seen within the watermark; state is dropped behind it."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_ratings(stream: DataFrame, event_time: str = "seen_at", window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Reviews and mean rating per window."""
    return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, window)).agg(F.count("*").alias("reviews"), F.avg("rating").alias("average_rating"))


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Run `sink` on every micro-batch; it must be idempotent by batch number, as batches repeat after a failure."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
