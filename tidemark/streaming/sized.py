"""Landing in files of a wanted size: batches as they come, closed folders written again as large files.

Below a path lie ``batches/stream_id=/batch_id=/<keys>``, ``compacted/run=/<keys>`` and ``manifest/run=``. The manifest
names what a run has written again, and is written last: readers take a run once it is there, and leave out the batch
folders it covers. So a run that fails leaves nothing to see, and late rows of a closed folder stay in their batch until
the next run.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.partitions import partition_values_from_path
from tidemark.sources.files import object_listing
from tidemark.streaming.batches import batch_folder, each_batch, written
from tidemark.streaming.landing import BUFFER_INTERVAL

OWNER = ("stream_id", "batch_id")


def land_sized(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    interval: str = BUFFER_INTERVAL,
    available_now: bool = False,
) -> StreamingQuery:
    """Land a stream below ``keys`` folders of each batch.

    The rows of a batch are rebalanced by folder: nearly all have one hour, and adaptive execution deals a folder out
    to as many tasks as its bytes need, by the advisory partition size. A batch that runs again overwrites itself.
    """

    def take(batch: DataFrame, stream_id: str, batch_id: int) -> None:
        rows = batch.hint("rebalance", *[F.col(k) for k in keys])
        rows.write.mode("overwrite").partitionBy(*keys).parquet(batch_folder(f"{path}/batches", stream_id, batch_id))

    return each_batch(stream, checkpoint, take, interval, available_now)


def _with(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, T.StringType()) for n in names]])


def _folders(schema: T.StructType, keys: Sequence[str]) -> T.StructType:
    return T.StructType([*[T.StructField(n, T.StringType()) for n in OWNER], *[schema[k] for k in keys]])


def _manifest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    return written(spark, f"{path}/manifest", _with(_folders(schema, keys), "run"))


def read_landed(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Rows landed by :func:`land_sized`, each once, whatever has been compacted. ``schema`` has all columns."""
    manifest = _manifest(spark, path, schema, keys)
    fresh = written(spark, f"{path}/batches", _with(schema, *OWNER)).join(manifest, [*OWNER, *keys], "left_anti")
    large = written(spark, f"{path}/compacted", _with(schema, "run"))
    large = large.join(manifest.select("run").distinct(), "run", "left_semi")
    return fresh.select(*schema.names).unionByName(large.select(*schema.names))


def compact_landed(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], closed: Column) -> int:
    """Write the folders that ``closed`` (a condition on the keys) holds for again as large files; their number.

    Only batch folders that no run covers yet are read. They are found by a listing, not by reading rows.
    """
    manifest = _manifest(spark, path, schema, keys).drop("run")
    there = written(spark, f"{path}/batches", _with(schema, *OWNER))
    if there.isEmpty():
        return 0
    listed = partition_values_from_path(object_listing(spark, f"{path}/batches"), "path", [*OWNER, *keys])
    found = listed.select(*[F.col(f.name).cast(f.dataType) for f in _folders(schema, keys)]).distinct()
    pending = found.filter(closed).join(manifest, [*OWNER, *keys], "left_anti").cache()
    try:
        number = pending.count()
        if number:
            run = uuid.uuid4().hex
            rows = there.join(pending, [*OWNER, *keys], "left_semi").select(*schema.names)
            rows.hint("rebalance", *[F.col(k) for k in keys]).write.partitionBy(*keys).parquet(f"{path}/compacted/run={run}")
            # One file, which appears at once or not at all.
            pending.coalesce(1).write.parquet(f"{path}/manifest/run={run}")
        return number
    finally:
        pending.unpersist()
