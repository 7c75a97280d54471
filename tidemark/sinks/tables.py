"""Catalog registration."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime
from itertools import batched

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.partitions import distinct_partitions, partition_gaps, partition_values_from_path
from tidemark.session import scratch_dir
from tidemark.sources.files import later_folders, object_listing

PARTITIONS_PER_CALL = 200
# Partitions that the driver holds at once.
PARTITIONS_HELD = 10_000


def _quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table_partitions(spark: SparkSession, name: str, keys: Sequence[str]) -> DataFrame:
    """Partitions that the catalog has, one text column per key."""
    shown = spark.sql(f"SHOW PARTITIONS {_quoted(name)}").withColumn("partition", F.concat("partition", F.lit("/")))
    return partition_values_from_path(shown, "partition", keys).select(*keys)


def add_partitions(
    spark: SparkSession, name: str, partitions: DataFrame, keys: Sequence[str], known: DataFrame | None = None
) -> int:
    """Add partitions that the catalog does not have yet; the number added.

    The table stays readable meanwhile. ``known`` (those of the catalog unless given) are left out. The rest are fed to
    the catalog in calls of bounded size, each from a part of the rows, so that the driver never holds all of them.
    """
    found = distinct_partitions(partitions.select(*[F.col(k).cast("string").alias(k) for k in keys]), keys)
    known = table_partitions(spark, name, keys) if known is None else known
    path = scratch_dir(spark, "partitions")
    partition_gaps(found, known, keys).write.parquet(path)
    new = spark.read.schema(T.StructType([T.StructField(k, T.StringType()) for k in keys])).parquet(path)
    count = new.count()
    rows = new.repartition(max(1, -(-count // PARTITIONS_HELD))).toLocalIterator()
    for chunk in batched(rows, PARTITIONS_PER_CALL):
        specs = (
            "PARTITION (" + ", ".join(f"{_quoted(k)} = {_text(row[k])}" for k in keys) + ")" for row in chunk
        )
        spark.sql(f"ALTER TABLE {_quoted(name)} ADD IF NOT EXISTS {' '.join(specs)}")
    return count


def register_external_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    keys: Sequence[str],
    location: str,
    data_format: str = "json",
    since: datetime | None = None,
) -> DataFrame:
    """External table over a location, with all partitions found there.

    ``schema`` holds data and partition columns. A table that is there already with this
    schema and location is kept and gets the new partitions only; another definition replaces it (its files stay).
    With ``since`` only time folders at or after that time are listed and added, and neither older folders nor the
    partitions of the catalog are gone through: for calls after the first, where ``keys`` are time keys from the year down.
    """
    if spark.catalog.tableExists(name):
        described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(name)}").collect()}
        same = {f.name: f.dataType for f in spark.table(name).schema} == {f.name: f.dataType for f in schema}
        if not same or _bare(described.get("Location", "")) != _bare(location):
            spark.sql(f"DROP TABLE {_quoted(name)}")
    partitioned = f" PARTITIONED BY ({', '.join(_quoted(k) for k in keys)})" if keys else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({schema.toDDL()}) USING {data_format}{partitioned} "
        f"LOCATION {_text(location)}"
    )
    if keys and since is not None:
        # A pattern that matches no folder yet is an error to the reader.
        try:
            listed = object_listing(spark, f"{location.rstrip('/')}/{later_folders(since, keys)}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.table(name)
        found = partition_values_from_path(listed, "path", keys).select(*keys)
        add_partitions(spark, name, found, keys, known=found.limit(0))
    elif keys:
        add_partitions(spark, name, partition_values_from_path(object_listing(spark, location), "path", keys), keys)
    return spark.table(name)


def _bare(location: str) -> str:
    return re.sub("^file:/+", "/", location).rstrip("/")
