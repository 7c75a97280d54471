"""Failed records and their next tries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.streaming.batches import written

DONE, WAITING, DEAD = "done", "waiting", "dead"
MAX_TRIES = 3


def _ledger_schema(records: T.StructType) -> T.StructType:
    extra = [
        T.StructField("record_id", T.StringType()),
        T.StructField("tries", T.IntegerType()),
        T.StructField("state", T.StringType()),
        T.StructField("cause", T.StringType()),
        T.StructField("round", T.LongType()),
    ]
    return T.StructType([*records.fields, *extra])


def read_ledger(spark: SparkSession, path: str, records: T.StructType) -> DataFrame:
    """The newest entry of every record: its columns, tries, state and the cause of its last failure."""
    schema = _ledger_schema(records)
    entries = written(spark, path, schema)
    newest = entries.groupBy("record_id").agg(F.max_by(F.struct(*entries.columns), "round").alias("e"))
    return newest.select("e.*")


def try_records(
    spark: SparkSession,
    path: str,
    fresh: DataFrame,
    attempt: Callable[[DataFrame], DataFrame],
    number: int,
    repairs: DataFrame | None = None,
    max_tries: int = MAX_TRIES,
) -> DataFrame:
    """Round ``number`` of tries: records that are new, and those waiting since earlier rounds; its ledger entries.

    ``attempt`` gets records and returns the same rows with a column ``cause``, null for success. A record that has
    failed ``max_tries`` times is dead and stays in the ledger with its cause. ``repairs`` holds corrected records
    under the ``record_id`` of the broken ones (dead ones too, which get one more try). A record is known by a digest
    of its columns, so that one delivered twice is tried once. A round is a folder of its own that depends on earlier
    rounds only: run again, it replaces what its first run left.
    """
    schema = fresh.schema
    ledger = written(spark, path, _ledger_schema(schema)).filter(F.col("round") < number)
    newest = ledger.groupBy("record_id").agg(F.max_by(F.struct(*ledger.columns), "round").alias("e")).select("e.*")
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in schema.names]), {"ignoreNullFields": "false"}), 256)
    new = fresh.withColumn("record_id", digest).dropDuplicates(["record_id"])
    new = new.join(newest.select("record_id"), "record_id", "left_anti").withColumn("tries", F.lit(0))
    again = newest.filter(F.col("state") == WAITING)
    if repairs is not None:
        mended = repairs.select("record_id", F.struct(*schema.names).alias("_mended"))
        again = newest.filter(F.col("state") != DONE).join(mended, "record_id", "left")
        again = again.filter((F.col("state") == WAITING) | F.col("_mended").isNotNull())
        for name in schema.names:
            again = again.withColumn(name, F.when(F.col("_mended").isNotNull(), F.col("_mended")[name]).otherwise(F.col(name)))
    columns = [*schema.names, "record_id", "tries"]
    tried = attempt(new.select(*columns).unionByName(again.select(*columns)))
    tries = F.col("tries") + 1
    state = F.when(F.col("cause").isNull(), DONE).when(tries >= max_tries, DEAD).otherwise(WAITING)
    entries = tried.select(*schema.names, "record_id", tries.alias("tries"), state.alias("state"), "cause")
    entries.write.mode("overwrite").parquet(f"{path}/round={number}")
    return written(spark, path, _ledger_schema(schema)).filter(F.col("round") == number)
