"""Streaming sources."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.orders import ORDERS_PER_TICK, TICKS_PER_SECOND, order_fields
from tidemark.sources.files import later_folders

# Files may still arrive in the folder of the hour before.
UNDER_WAY = timedelta(hours=1)


def _check_start(start: str) -> None:
    if start not in ("earliest", "latest"):
        raise ValueError(f"start must be earliest or latest, not {start}")


def _written(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def stream_source(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    start: str = "earliest",
    max_files: int | None = None,
    max_bytes: int | None = None,
    data_format: str = "json",
    glob: str | None = None,
    marker: str | None = None,
    arrival_keys: Sequence[str] = (),
    since: datetime | None = None,
) -> DataFrame:
    """Stream of files below a folder. ``max_files`` or ``max_bytes`` (not both) bounds a micro-batch.

    ``latest`` takes only files that appear after the stream is first started. That
    time is kept in the folder ``marker``, so a restarted stream does not skip what
    arrived while it was down. Older files are listed once, in the first batch, and not
    read: the bound on a micro-batch holds from the next start on, or the history would
    be walked in batches of that size.

    Where files lie in time folders of their arrival, name these as ``arrival_keys`` (the last fields of ``schema``,
    in UTC). ``latest`` then starts at the folder of the first start, and of the hour before for files under way;
    older folders are never listed, and the bound holds from the first batch. ``since`` starts at the folder of a
    given time instead, with all its files.
    """
    _check_start(start)
    if start == "latest" and marker is None:
        raise ValueError("start='latest' needs a marker folder to keep the time of the first start")
    if since is not None and not arrival_keys:
        raise ValueError("since needs the time folders named by arrival_keys")
    first = start == "latest" and not _written(spark, marker)
    if first:
        now = spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("started"))
        now.write.mode("ignore").parquet(marker)
    started = spark.read.parquet(marker).first().started if start == "latest" else None
    if first and not arrival_keys:
        max_files = max_bytes = None
    reader = spark.readStream.format(data_format).schema(schema)
    options = {"maxFilesPerTrigger": max_files, "maxBytesPerTrigger": max_bytes, "pathGlobFilter": glob}
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, value)
    if arrival_keys and (since is not None or started is not None):
        frontier = since or datetime.fromtimestamp(started / 1e6, UTC) - UNDER_WAY
        reader, path = reader.option("basePath", path), f"{path.rstrip('/')}/{later_folders(frontier, arrival_keys)}"
    stream = reader.load(path)
    if started is not None:
        stream = stream.filter(F.col("_metadata.file_modification_time") >= F.timestamp_micros(F.lit(started)))
    return stream


def topic_source(
    spark: SparkSession,
    servers: str,
    topic: str,
    start: str = "earliest",
    max_records: int | None = None,
) -> DataFrame:
    """Stream of text records ``(value, timestamp)`` from a topic; needs the Kafka connector on the class path."""
    _check_start(start)
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
    )
    if max_records is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_records)
    return reader.load().select(F.col("value").cast("string").alias("value"), "timestamp")


def order_stream(
    spark: SparkSession,
    rows_per_second: int = ORDERS_PER_TICK * TICKS_PER_SECOND,
    seed: int = 0,
    **options,
) -> DataFrame:
    """Steady stream of synthetic orders. Draws follow the row number, so a replayed batch is the same."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    ticks = ticks.withColumnRenamed("value", "order_id")
    return order_fields(ticks, "order_id", F.col("timestamp"), seed, **options).drop("timestamp")
