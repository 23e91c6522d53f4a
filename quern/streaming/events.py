"""Rename events as a stream (R17, R18): append to the log, or push each batch to a sink of one's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.schema import TABLES


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of rename events that other processes write into folder as Parquet."""
    return spark.readStream.schema(TABLES["renames"]).parquet(folder)


def append_log(events: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each event once to the log's folder."""
    writer = events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def push(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hands each micro-batch, with its number, to send: at least once."""
    writer = events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
