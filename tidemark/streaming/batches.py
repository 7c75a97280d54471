"""Micro-batches that each own a folder: exactly once, whatever a batch writes and however often it runs."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def triggered(writer: DataStreamWriter, interval: str, available_now: bool) -> DataStreamWriter:
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)


def batch_folder(path: str, stream_id: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/stream_id={stream_id}/batch_id={batch_id}"


def each_batch(
    stream: DataFrame,
    checkpoint: str,
    take: Callable[[DataFrame, str, int], None],
    interval: str,
    available_now: bool,
) -> StreamingQuery:
    """Start a stream that calls ``take(batch, stream_id, batch_id)``; the id is kept in the checkpoint, so that a new
    checkpoint, which counts its batches from zero, does not meet the folders of an older one."""

    @cache
    def stream_id() -> str:
        return stream.sparkSession.read.json(f"{checkpoint}/metadata").first().id

    writer = stream.writeStream.foreachBatch(lambda batch, number: take(batch, stream_id(), number))
    return triggered(writer.option("checkpointLocation", checkpoint), interval, available_now).start()


def written(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Parquet below a path with the given schema, partition columns included; no rows where nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
