"""Schemas of JSON records, found by aggregation, and how they differ between partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.json_text import one_variant
from tidemark.functions.once import computed_once

MAX_FIELDS = 2_000
_WHOLE, _REAL = "BIGINT", "DOUBLE"


def field_types(df: DataFrame, json_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``(keys, field, type, records)`` of the top-level fields; one row per type that a field has.

    Types are those of the values: ``BIGINT``, ``DOUBLE`` for all other numbers, ``STRING``, ``BOOLEAN``, ``VOID`` for
    null, ``ARRAY``, ``OBJECT``. Counts merge, so partitions and later loads can be added up. Text that is not
    exactly one JSON object counts under a null field.
    """
    rows = computed_once(df.select(*keys, json_col), "_v", one_variant(F.col(json_col)))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    fields = df.sparkSession.tvf.variant_explode_outer(F.when(F.col("_object"), F.col("_v")).outer())
    rows = rows.withColumn("_object", is_object).lateralJoin(fields)
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    kind = F.when(kind.isin("DECIMAL", "FLOAT"), _REAL).otherwise(kind)
    kind = F.when(~F.col("_object"), F.lit(None)).otherwise(kind)
    rows = rows.filter(F.col("key").isNotNull() | ~F.col("_object"))
    return rows.groupBy(*keys, F.col("key").alias("field"), kind.alias("type")).agg(F.count("*").alias("records"))


def _merged_type() -> Column:
    types = F.array_remove(F.collect_set("type"), "VOID")
    numbers = F.size(F.array_except(types, F.array(F.lit(_WHOLE), F.lit(_REAL)))) == 0
    return F.when(F.size(types) == 0, "VOID").when(F.size(types) == 1, F.get(types, F.lit(0))).when(numbers, _REAL).otherwise("STRING")


def schema_drift(types: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fields of :func:`field_types` that are not the same in all partitions: rows ``(field, merged, partitions, holding,
    kinds)``, with the number of partitions, of those that hold the field, and of its types in them."""
    types = types.filter(F.col("field").isNotNull())
    partition = F.struct(*keys)
    merged = types.groupBy(*keys, "field").agg(_merged_type().alias("type"))
    n = merged.select(partition.alias("p")).distinct().agg(F.count("*").alias("partitions"))
    kinds = merged.groupBy("field").agg(
        _merged_type().alias("merged"), F.count("*").alias("holding"), F.count_distinct("type").alias("kinds")
    )
    total = n.first().partitions
    drifted = (F.col("holding") < total) | (F.col("kinds") > 1)
    return kinds.filter(drifted).select("field", "merged", F.lit(total).cast("bigint").alias("partitions"), "holding", "kinds")


def merged_schema(types: DataFrame, max_fields: int = MAX_FIELDS) -> T.StructType:
    """One schema for all partitions: numbers of both kinds are doubles, other mixtures and nested values text.

    As many rows as there are fields reach the driver; more than ``max_fields`` raise.
    """
    merged = types.filter(F.col("field").isNotNull()).groupBy("field").agg(_merged_type().alias("type"))
    found = merged.limit(max_fields + 1).collect()
    if len(found) > max_fields:
        raise ValueError(f"more than {max_fields} fields; read the records as variants")
    kinds = {_WHOLE: T.LongType(), _REAL: T.DoubleType(), "BOOLEAN": T.BooleanType()}
    return T.StructType([T.StructField(r.field, kinds.get(r.type, T.StringType())) for r in sorted(found)])
