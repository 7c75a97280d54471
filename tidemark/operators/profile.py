"""Table statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import object_listing


def table_profile(spark: SparkSession, path: str) -> DataFrame:
    """One row: objects, records, total bytes and average record size of line-based files.

    ``record_bytes`` leaves out line ends; the average counts them.

    Objects and bytes come from the listing, records from one scan that keeps only
    running totals, so each task sends a single row.
    """
    objects = object_listing(spark, path).agg(
        F.count("*").alias("objects"), F.sum("length").alias("total_bytes")
    )
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    records = lines.agg(
        F.count("*").alias("records"), F.sum(F.octet_length("value")).alias("record_bytes")
    )
    both = objects.unionByName(records, allowMissingColumns=True)
    totals = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])
    average = F.try_divide("total_bytes", "records").alias("average_record_size")
    return totals.select("objects", "records", "total_bytes", "record_bytes", average)
