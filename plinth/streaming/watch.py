"""Streams: windowed activity of events, and files analysed as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plinth.operators import code


def activity(events: DataFrame, time: str, key: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows of each key and time window; works on streams (with a watermark) and tables."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_t", late) if events.isStreaming else timed
    counts = timed.groupBy(F.window("_t", window), key).agg(F.count("*").alias("churn"))
    return counts.select(F.col("window.start").alias("window_start"), key, "churn")


def file_stream(spark: SparkSession, folder: str, schema: str = "path string, content string") -> DataFrame:
    """JSON lines of ``path, content`` that arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)


def analyze_stream(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Definitions of each micro-batch's files go to ``sink(definitions, batch)``."""

    def each(batch: DataFrame, number: int) -> None:
        sink(code.definitions(code.files(batch)), number)

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
