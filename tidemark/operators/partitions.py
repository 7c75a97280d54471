"""Time partitions: values, layouts, expected and missing ones, stale ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.partitions import (
    TIME_KEYS,
    partition_path,
    path_value,
    path_values,
    time_parts,
    zero_padded,
)

# Ranges the raw sensor layout may hold.
SENSOR_RANGES: dict[str, tuple[int, int]] = {
    "year": (2017, 2020),
    "month": (1, 12),
    "day": (1, 31),
    "hour": (0, 23),
}


def time_partition_columns(df: DataFrame, ts: str, keys: Sequence[str] = tuple(TIME_KEYS)) -> DataFrame:
    """Add zero-padded text columns ``year, month, day, hour`` taken from a timestamp."""
    return df.withColumns(time_parts(F.col(ts), keys))


def partition_values_from_path(
    df: DataFrame, path_col: str, keys: Sequence[str] = tuple(TIME_KEYS), values_col: str | None = None
) -> DataFrame:
    """Add one text column per partition key found in an object path.

    ``values_col`` also adds all values as an array, in path order, for layouts
    whose keys are not known.
    """
    added = {k: path_value(F.col(path_col), k) for k in keys}
    if values_col:
        added[values_col] = path_values(F.col(path_col))
    return df.withColumns(added)


def normalise_partition_keys(
    df: DataFrame, style: str = "padded", keys: Sequence[str] = tuple(TIME_KEYS)
) -> DataFrame:
    """Bring ``08``, ``8`` and the number 8 to one form: ``padded`` text or ``int``.

    Numbers wider than their key stay whole; what is not a number becomes null.
    """
    if style not in ("padded", "int"):
        raise ValueError(f"unknown style: {style}")

    def form(key: str) -> Column:
        number = F.col(key).try_cast("int")
        return number if style == "int" else zero_padded(number.cast("string"), TIME_KEYS[key][1])

    return df.withColumns({k: form(k) for k in keys})


def partition_grid(
    source: SparkSession | DataFrame,
    ranges: Mapping[str, tuple[int | Column, int | Column]] = SENSOR_RANGES,
    template: Mapping[str, int] | None = None,
    root: str = "",
) -> DataFrame:
    """Every combination of the key ranges, with the folder it lives in.

    ``source`` is a session for constant ranges, or a table of ranges whose other
    columns are kept (bounds may then be its columns). Rows are generated, not
    joined. ``template`` gives padded widths per key; days such as February 31 are
    part of the grid.
    """
    grid = source.range(1).select() if isinstance(source, SparkSession) else source
    for key, (low, high) in ranges.items():
        bounds = [b if isinstance(b, Column) else F.lit(b) for b in (low, high)]
        grid = grid.select("*", F.explode(F.sequence(*bounds)).alias(key))
    widths = template or {}
    parts = {
        k: zero_padded(F.col(k).cast("string"), widths[k]) if k in widths else F.col(k) for k in ranges
    }
    return grid.withColumn("location", partition_path(parts, root))


def distinct_partitions(df: DataFrame, keys: Sequence[str] = tuple(TIME_KEYS)) -> DataFrame:
    """Distinct partition values. Duplicates are removed before the shuffle too."""
    return df.select(*keys).distinct()


def distinct_time_partitions(
    df: DataFrame, ts: str, by: Sequence[str] = (), keys: Sequence[str] = tuple(TIME_KEYS)
) -> DataFrame:
    """Time partitions present in a table, per ``by``; ``keys`` run from coarse to fine.

    Timestamps are cut to the finest key before duplicates are removed, so that text
    is made once per partition instead of once per row.
    """
    cut = df.select(*by, F.date_trunc(keys[-1], ts).alias("_ts")).distinct()
    return time_partition_columns(cut, "_ts", keys).drop("_ts")


def expected_hours(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Every hour from the first to the last one present, per ``by``, as integer time keys.

    Hours follow the calendar, so that no impossible date is among them.
    """
    hour = F.date_trunc("hour", ts)
    bounds = df.groupBy(*by).agg(F.min(hour).alias("_first"), F.max(hour).alias("_last"))
    step = F.expr("INTERVAL 1 HOUR")
    hours = bounds.select(*by, F.explode(F.sequence("_first", "_last", step)).alias("_ts"))
    return normalise_partition_keys(time_partition_columns(hours, "_ts").drop("_ts"), "int")


def partition_gaps(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected partitions that are absent.

    ``actual`` may be a whole table: it is reduced to its distinct keys first, so a
    partition holding most rows weighs no more in the join than any other.
    """
    return expected.join(distinct_partitions(actual, keys), list(keys), "left_anti")


def stale_partitions(
    sources: DataFrame, loads: DataFrame, keys: Sequence[str], source_time: str, load_time: str
) -> DataFrame:
    """Partitions to load again: never loaded, or changed after the last load.

    Both sides are reduced to one row per partition before they meet.
    """
    newest = sources.groupBy(*keys).agg(F.max(source_time).alias("newest_source"))
    last = loads.groupBy(*keys).agg(F.max(load_time).alias("last_load"))
    stale = F.col("last_load").isNull() | (F.col("last_load") < F.col("newest_source"))
    return newest.join(last, list(keys), "left").filter(stale)
