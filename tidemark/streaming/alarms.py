"""The M-of-N alarm on a running stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.metrics import (
    ALARM_PERIOD,
    ALARM_PERIODS,
    ALARM_POINTS,
    ALARM_THRESHOLD,
    alarm_states,
    period_averages,
)
from tidemark.streaming.batches import batch_folder, each_batch, written
from tidemark.streaming.landing import BUFFER_INTERVAL


def _states_schema(averages: DataFrame) -> T.StructType:
    extra = [T.StructField("breaches", T.LongType()), T.StructField("alarm", T.BooleanType())]
    return T.StructType([*averages.schema.fields, *extra])


def stream_alarm(
    stream: DataFrame,
    ts: str,
    value: str,
    path: str,
    checkpoint: str,
    watermark: str,
    keys: Sequence[str] = (),
    period: str = ALARM_PERIOD,
    m: int = ALARM_POINTS,
    n: int = ALARM_PERIODS,
    threshold: float = ALARM_THRESHOLD,
    interval: str = BUFFER_INTERVAL,
    available_now: bool = False,
) -> StreamingQuery:
    """Alarm states of closed periods, once each, below ``path`` (see :func:`read_alarms`).

    A period closes when the watermark passes its end; event time alone decides. Rows that come later do not change
    it. Periods close in their order, so what a batch needs of the past are the last ``n - 1`` averages of each key:
    every batch keeps these in a folder, from which the next one goes on. Its size is that of the keys, whatever the
    length of the stream. A batch that runs again reads the same folder and overwrites its own.
    """
    averages = period_averages(stream, ts, value, keys, period, watermark)
    kept = averages.schema

    def take(batch: DataFrame, stream_id: str, batch_id: int) -> None:
        spark = batch.sparkSession
        before = written(spark, batch_folder(f"{path}/last", stream_id, batch_id - 1), kept).withColumn("_new", F.lit(False))
        rows = before.unionByName(batch.filter(F.col("average").isNotNull()).withColumn("_new", F.lit(True)))
        states = alarm_states(rows, keys, m, n, threshold)
        newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("period")))
        states = states.withColumn("_from_end", newest)
        now = batch_folder(f"{path}/batches", stream_id, batch_id)
        states.write.mode("overwrite").parquet(now)
        made = spark.read.schema(states.schema).parquet(now)
        last = made.filter(F.col("_from_end") < n).select(*kept.names)
        last.write.mode("overwrite").parquet(batch_folder(f"{path}/last", stream_id, batch_id))

    return each_batch(averages, checkpoint, take, interval, available_now)


def read_alarms(spark: SparkSession, path: str, stream: DataFrame, ts: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The states that :func:`stream_alarm` has written, one row per closed period and key."""
    schema = _states_schema(period_averages(stream, ts, value, keys)).add("_new", T.BooleanType())
    rows = written(spark, f"{path}/batches", schema)
    return rows.filter("_new").drop("_new")
