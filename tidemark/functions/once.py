"""Expensive columns that later filters refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column through a one-element generator.

    A filter is pushed below a plain column by copying its expression, and each copy
    parses the record again. Filters are not pushed below a generator they depend on.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
