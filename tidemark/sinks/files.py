"""File sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitioned_parquet(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    mode: str = "append",
    rebalance: bool = True,
) -> None:
    """Parquet below ``key=value`` folders.

    Unless the input already arrives folder by folder (``rebalance=False``), rows
    are rebalanced by the keys first. Otherwise every task writes a small file into
    every folder. Adaptive execution splits a hot folder over several tasks and
    merges tiny ones, both towards the advisory partition size.
    """
    if rebalance:
        df = df.hint("rebalance", *[F.col(k) for k in keys])
    df.write.mode(mode).partitionBy(*keys).parquet(path)


def write_json_events(
    df: DataFrame, path: str, keys: Sequence[str] = (), mode: str = "append", rebalance: bool = False
) -> None:
    """One JSON object per line, nulls written out; ``keys`` become folders, not fields."""
    fields = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")
    lines = df.select(*keys, line)
    if rebalance and keys:
        lines = lines.hint("rebalance", *[F.col(k) for k in keys])
    writer = lines.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).text(path)
