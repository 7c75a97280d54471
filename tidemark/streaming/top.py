"""The most frequent values of a stream of unknown keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.orders import top_sku
from tidemark.streaming.batches import batch_folder, each_batch, written
from tidemark.streaming.landing import BUFFER_INTERVAL

TRACKED = 10_000


def _schema(kind: T.DataType) -> T.StructType:
    long = T.LongType()
    return T.StructType([T.StructField("item", kind), T.StructField("seen", long), T.StructField("lost", long)])


def merged_counts(parts: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """A summary ``(item, seen, lost)`` of several: the ``tracked`` most counted items, and what others may have.

    ``seen`` never exceeds the true count, and no true count exceeds ``seen`` (0 for items that are not there) by
    more than ``lost``, which is the same in all rows. Summaries of any parts of the data merge in any order; a row
    without an item carries ``lost`` alone. Counts are added before they are sorted, so a hot item is one row a task.
    """
    counts = parts.filter(F.col("item").isNotNull()).groupBy("item").agg(F.sum("seen").alias("seen"))
    ranked = counts.orderBy(F.desc("seen"), "item").limit(tracked + 1)
    # One row more than is kept: its count bounds every item left out.
    numbered = ranked.agg(F.array_sort(F.collect_list(F.struct((-F.col("seen")).alias("minus"), "item"))).alias("top"))
    before = parts.groupBy("part").agg(F.max("lost").alias("lost")).agg(F.coalesce(F.sum("lost"), F.lit(0)).alias("before"))
    cut = F.coalesce(-F.get("top", F.lit(tracked)).getField("minus"), F.lit(0))
    one = numbered.select("top", cut.alias("lost")).unionByName(before.select(F.col("before").alias("lost")), allowMissingColumns=True)
    both = one.agg(F.first("top", ignorenulls=True).alias("top"), F.sum("lost").alias("lost"))
    kept = F.slice("top", 1, tracked)
    rows = both.select("lost", F.explode_outer(F.when(F.size("top") > 0, kept)).alias("t"))
    return rows.select(F.col("t.item").alias("item"), (-F.col("t.minus")).alias("seen"), "lost")


def stream_top(
    stream: DataFrame,
    item: str,
    path: str,
    checkpoint: str,
    tracked: int = TRACKED,
    interval: str = BUFFER_INTERVAL,
    available_now: bool = False,
) -> StreamingQuery:
    """Keep a summary of the values of a column below ``path``; each batch merges its counts into the last one.

    The summary has ``tracked`` rows however many values there are. A batch that runs again starts from the same
    summary and overwrites its own.
    """
    schema = _schema(stream.schema[item].dataType)

    def take(batch: DataFrame, stream_id: str, batch_id: int) -> None:
        before = written(batch.sparkSession, batch_folder(path, stream_id, batch_id - 1), schema)
        counts = batch.filter(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.count("*").alias("seen"))
        parts = before.withColumn("part", F.lit(0)).unionByName(
            counts.withColumns({"lost": F.lit(0).cast("bigint"), "part": F.lit(1)})
        )
        merged_counts(parts, tracked).coalesce(1).write.mode("overwrite").parquet(batch_folder(path, stream_id, batch_id))

    return each_batch(stream, checkpoint, take, interval, available_now)


def read_summary(spark: SparkSession, path: str, kind: T.DataType) -> DataFrame:
    """The newest summary of each stream below ``path``: rows ``(part, item, seen, lost)``."""
    schema = T.StructType([*_schema(kind).fields, T.StructField("stream_id", T.StringType()), T.StructField("batch_id", T.LongType())])
    rows = written(spark, path, schema)
    newest = rows.groupBy("stream_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, ["stream_id", "batch_id"]).select(F.col("stream_id").alias("part"), "item", "seen", "lost")


def exact_top(summary: DataFrame, landed: DataFrame, item: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values with exact counts ``(item, sold)``, ties in order of the values.

    Only values that the summary cannot rule out are counted in ``landed``, the rows that the stream has taken. Where
    the k-th count is not above what a value outside the summary may have, all values are counted.
    """
    tracked = summary.groupBy("item").agg(F.sum("seen").alias("seen"))
    lost = summary.groupBy("part").agg(F.max("lost").alias("lost")).agg(F.coalesce(F.sum("lost"), F.lit(0)).alias("n")).first().n
    best = [r.seen for r in tracked.filter(F.col("item").isNotNull()).orderBy(F.desc("seen")).limit(k).collect()]
    floor = best[-1] if len(best) == k else 0
    if lost >= floor and lost > 0:
        return top_sku(landed.filter(F.col(item).isNotNull()), item, k)
    possible = tracked.filter(F.col("seen") + lost >= floor).select(F.col("item").alias(item))
    # No more rows than the summary has.
    return top_sku(landed.join(F.broadcast(possible), item, "left_semi"), item, k)
