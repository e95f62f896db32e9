"""Continuous routing: a stream, one of the routing functions, a day-partitioned table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def start_route(stream: DataFrame, route: Callable[[DataFrame], DataFrame], out: str,
                checkpoint: str, available_now: bool = True,
                interval: str = "1 minute") -> StreamingQuery:
    writer = (route(stream).writeStream.format("parquet").outputMode("append")
              .partitionBy("dt").option("path", out).option("checkpointLocation", checkpoint))
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
