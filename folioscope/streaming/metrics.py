"""Continuous request metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators.telemetry import histogram, status_class


def stream_metrics(requests: DataFrame, by: Sequence[str], window: str = "1 hour", watermark: str = "10 minutes",
                   ts: str = "ts", seconds: str = "seconds") -> DataFrame:
    """Request counters and latency histogram per tumbling window; works on streams and tables.

    On a stream a window is final once the watermark passes its end; later rows are dropped.
    """
    if requests.isStreaming:
        requests = requests.withWatermark(ts, watermark)
    tagged = requests.withColumn("status_class", status_class(F.col("status_code")))
    return (
        histogram(
            tagged.withColumn("_w", F.window(ts, window)), ["_w", *by, "status_class"], F.col(seconds)
        )
        .withColumn("window_start", F.col("_w.start")).withColumn("window_end", F.col("_w.end")).drop("_w")
    )


def start_metrics(metrics: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a table folder, working off what is there."""
    return (
        metrics.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
