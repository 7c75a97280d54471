"""Landing of record streams: curated Parquet, raw copy and error route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.json_text import STRICT, ends_there, may_go_on
from tidemark.functions.once import computed_once
from tidemark.functions.partitions import time_parts
from tidemark.streaming.batches import batch_folder, each_batch, triggered

# Buffering of the landing stream.
BUFFER_INTERVAL = "60 seconds"
BUFFER_BYTES = 128 * 1024 * 1024
CORRUPT = "_corrupt_record"


def stream_to_parquet(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = (),
    interval: str = BUFFER_INTERVAL,
    available_now: bool = False,
) -> StreamingQuery:
    """Append a stream to Parquet, exactly once.

    The time trigger is set here; bound the bytes of a batch at the source
    (``max_bytes=BUFFER_BYTES``).
    """
    if keys:
        # Else every task of a batch writes into every folder. Where a batch fills one folder, use land_sized.
        stream = stream.repartition(*keys)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if keys:
        writer = writer.partitionBy(*keys)
    return triggered(writer, interval, available_now).start()


def _parse_records(df: DataFrame, schema: T.StructType, value: str) -> DataFrame:
    """Add the parsed record ``_r`` and the flag ``_failed``."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = computed_once(df, "_r", F.from_json(F.col(value), with_corrupt, {**STRICT, **options}))
    wrong = F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull()
    # What comes after the object is looked at only where something may.
    failed = F.when(wrong, True).when(may_go_on(F.col(value)), ~ends_there(F.col(value))).otherwise(False)
    return computed_once(parsed, "_failed", failed)


def _split_records(
    parsed: DataFrame, schema: T.StructType, value: str, keep: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    fields = [F.col("_r").getField(f.name).alias(f.name) for f in schema.fields]
    return parsed.filter(~F.col("_failed")).select(*keep, *fields), parsed.filter("_failed").select(*keep, value)


def route_malformed(
    df: DataFrame, schema: T.StructType, value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Split text records into parsed ones and those that do not convert.

    A record fails when it is not exactly one JSON value (also when more text follows the
    value) or when any field has the wrong type.
    Unknown fields are ignored, missing ones are null, of a repeated key the last one counts. Other columns are kept on
    both sides; failed records keep their text.
    """
    keep = [c for c in df.columns if c != value]
    return _split_records(_parse_records(df, schema, value), schema, value, keep)


def stream_raw_backup(
    batch: DataFrame,
    path: str,
    stream_id: str,
    batch_id: int,
    value: str = "value",
    arrival: Column | None = None,
) -> None:
    """Unconverted copy of every record of a micro-batch, under its arrival time.

    A batch owns its folder and overwrites it, so a replayed batch leaves one copy
    even when it replays in another hour.
    """
    parts = time_parts(F.current_timestamp() if arrival is None else arrival)
    lines = batch.select(F.col(value).alias("value"), *[c.alias(k) for k, c in parts.items()])
    lines.write.mode("overwrite").partitionBy(*parts).text(batch_folder(path, stream_id, batch_id))


def land_stream(
    stream: DataFrame,
    schema: T.StructType,
    curated: str,
    raw: str,
    failed: str,
    checkpoint: str,
    value: str = "value",
    arrival: Column | None = None,
    interval: str = BUFFER_INTERVAL,
    available_now: bool = False,
) -> StreamingQuery:
    """Text records to curated Parquet, a raw copy and an error route.

    Each micro-batch is read and parsed once and feeds three writes. They are separate, so
    each overwrites the folder of its batch: a batch that is replayed after a
    failure replaces what the first attempt left. The folder also carries the id
    Spark keeps in the checkpoint, as a new checkpoint counts its batches from zero.
    """

    def land(batch: DataFrame, stream_id: str, batch_id: int) -> None:
        arrived = F.current_timestamp() if arrival is None else arrival
        stamped = batch.select(F.col(value).alias("value"), arrived.alias("_arrived"))
        parsed = _parse_records(stamped, schema, "value").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            stream_raw_backup(parsed, raw, stream_id, batch_id, arrival=F.col("_arrived"))
            good, bad = _split_records(parsed, schema, "value", ["_arrived"])
            keys = time_parts(F.col("_arrived"))
            for part, path, data_format in ((good, curated, "parquet"), (bad, failed, "text")):
                rows = part.withColumns(keys).drop("_arrived")
                rows.write.format(data_format).mode("overwrite").partitionBy(*keys).save(
                    batch_folder(path, stream_id, batch_id)
                )
        finally:
            parsed.unpersist()

    return each_batch(stream, checkpoint, land, interval, available_now)
