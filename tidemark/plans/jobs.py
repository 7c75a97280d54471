"""Whole jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.detections import (
    SCORE_THRESHOLD,
    best_scores_in_record,
    decode_payload,
    label_lookup,
)
from tidemark.operators.notices import EVENT_STATUS, require_fields, unnest_notifications
from tidemark.operators.partitions import stale_partitions
from tidemark.operators.shape import Mapping4, apply_mapping, drop_null_fields, resolve_choice
from tidemark.sinks.files import write_partitioned_parquet
from tidemark.sinks.tables import register_external_table
from tidemark.sources.files import object_listing, scan_headed_files, scan_partitioned_json

# Columns and types of the curated sensor table.
SENSOR_MAPPING: list[Mapping4] = [
    ("datetime", "string", "datetime", "string"),
    ("sensorid", "int", "sensorid", "int"),
    ("temp", "int", "temp", "int"),
    ("battery", "string", "battery", "string"),
    ("year", "int", "year", "int"),
    ("month", "int", "month", "int"),
    ("day", "int", "day", "int"),
    ("hour", "int", "hour", "int"),
]


def curate(
    spark: SparkSession,
    source: str,
    target: str,
    schema: T.StructType,
    partition_schema: T.StructType,
    mappings: Iterable[Mapping4],
    keys: Sequence[str] = ("year", "month", "day"),
    choices: Sequence[str] = (),
    folders: str | None = None,
    mode: str = "append",
    compact: bool = True,
) -> None:
    """Raw JSON to curated Parquet: scan, map, resolve conflicts, drop empty columns, write.

    ``choices`` names fields declared ``variant`` in the schema. Rows are rebalanced by the
    keys, or each task would leave a small file in many folders; without ``compact`` they are
    written where they were read, which saves the shuffle for files of one folder each.
    """
    raw = scan_partitioned_json(spark, source, schema, partition_schema, folders)
    mapped = apply_mapping(raw, mappings)
    for field in choices:
        mapped = resolve_choice(mapped, field)
    keep = [c for c in mapped.columns if c not in keys]
    filled = drop_null_fields(mapped.select(*keep)).columns
    write_partitioned_parquet(mapped.select(*filled, *keys), target, keys, mode, rebalance=compact)


def refresh_tables(
    spark: SparkSession,
    sources: DataFrame,
    loads: DataFrame,
    key: str,
    source_time: str,
    load_time: str,
    definitions: dict[str, tuple[T.StructType, Sequence[str], str]],
) -> list[str]:
    """Register again the defined tables that were never loaded or changed since.

    ``definitions`` maps a table name to ``(schema, partition keys, location)``. Only
    names in it are asked for, so what reaches the driver is as small as the program.
    """
    wanted = sources.filter(F.col(key).isin(*definitions))
    stale = stale_partitions(wanted, loads, [key], source_time, load_time)
    names = sorted(r[0] for r in stale.select(key).collect())
    for name in names:
        register_external_table(spark, name, *definitions[name])
    return names


def ingest_uploads(
    spark: SparkSession, notices: DataFrame, root: str, body: str = "body", multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """CSV files named by file-arrival notices, as row events; and the notices that name none, with their body.

    Each event has the header of its own file and all values of its row. A file announced twice is read
    once. Rejected are notices without key, bucket or arn, and those of objects that are not there.
    Names are matched by joins, so that there is one way for any number of files and none pass through the driver.
    """
    found = unnest_notifications(notices, body, keep_body=True)
    kept, rejected = require_fields(found, ["key", "bucket", "arn"])
    there = object_listing(spark, root)
    there = there.select(F.substring_index("path", f"{root.rstrip('/')}/", -1).alias("_object"))
    kept = kept.withColumn("_object", F.concat_ws("/", "bucket", "key"))
    absent = kept.join(there, "_object", "left_anti").drop("_object")
    wanted = kept.select("_object").distinct()
    rows = scan_headed_files(spark, root, multi_line, wanted)
    events = rows.select(
        F.lit(EVENT_STATUS).alias("status"), "headers", F.array_join("fields", ",").alias("data"), "fields"
    )
    return events, rejected.unionByName(absent)


def detections_report(
    records: DataFrame, payload: str = "payload", threshold: float = SCORE_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """Encoded detection records to the best score of every named class in each record.

    Nothing is shuffled: a record carries all its predictions. The second result
    holds the records whose payload does not decode, as they came.
    """
    decoded = decode_payload(records, payload, keep_payload=True)
    good, bad = require_fields(decoded, ["prediction"])
    best = best_scores_in_record(good.drop(payload), "prediction", threshold)
    return label_lookup(best), bad.select(*records.columns)
