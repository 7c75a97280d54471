"""Partition values: from a timestamp, from an object path, and back to a path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time partition keys with their format and padded width.
TIME_KEYS: dict[str, tuple[str, int]] = {
    "year": ("yyyy", 4),
    "month": ("MM", 2),
    "day": ("dd", 2),
    "hour": ("HH", 2),
}


def time_parts(ts: Column, keys: Sequence[str] = tuple(TIME_KEYS)) -> dict[str, Column]:
    """Zero-padded text parts of a timestamp, one column per key."""
    return {k: F.date_format(ts, TIME_KEYS[k][0]) for k in keys}


def zero_padded(text: Column, width: int) -> Column:
    """Text with zeros put before it up to ``width``; longer text stays whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def path_values(path: Column) -> Column:
    """``root/a=1/b=2/file`` to ``["1", "2"]``: text after ``=`` of every inner folder."""
    folders = F.filter(F.split(path, "/"), lambda part: part.contains("="))
    return F.transform(folders, lambda part: F.substring_index(part, "=", -1))


def path_value(path: Column, key: str) -> Column:
    """Value of one partition key in an object path, null when the key is absent."""
    return F.nullif(F.regexp_extract(path, rf"(?:^|/){key}=([^/]*)/", 1), F.lit(""))


def partition_path(parts: Mapping[str, Column], root: str = "") -> Column:
    """Folder for a set of partition values, e.g. ``year=2024/month=01``."""
    folders = [F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in parts.items()]
    prefix = [F.lit(root.rstrip("/"))] if root else []
    return F.concat_ws("/", *prefix, *folders)
