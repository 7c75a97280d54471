"""Mapping, type conflicts and empty columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Mapping4 = tuple[str, str, str, str]

# Struct member and Spark type for each kind a variant can hold; numbers with a fixed point keep all their digits.
_MEMBERS = {
    "BIGINT": ("bigint", "bigint"),
    "BOOLEAN": ("boolean", "boolean"),
    "FLOAT": ("float", "float"),
    "DOUBLE": ("double", "double"),
    "STRING": ("string", "string"),
    "DATE": ("date", "date"),
    "TIMESTAMP": ("timestamp", "timestamp"),
    "TIMESTAMP_NTZ": ("timestamp_ntz", "timestamp_ntz"),
    "BINARY": ("binary", "binary"),
    "OBJECT": ("object", "string"),
    "ARRAY": ("array", "string"),
}
_DECIMAL = re.compile(r"DECIMAL\((\d+),\s*(\d+)\)")


def apply_mapping(df: DataFrame, mappings: Iterable[Mapping4]) -> DataFrame:
    """Project, rename and cast by ``(source, source_type, target, target_type)``.

    Columns that are not listed are dropped. A value that does not fit becomes
    null. Sources may be dotted paths into structs.
    """
    columns = []
    for source, source_type, target, target_type in mappings:
        value = F.col(source).try_cast(source_type)
        if target_type != source_type:
            value = value.try_cast(target_type)
        columns.append(value.alias(target))
    return df.select(*columns)


def _kind(value: Column) -> Column:
    """Kind of a variant value; decimals with their precision and scale."""
    schema = F.schema_of_variant(value)
    return F.regexp_extract(schema, r"^(DECIMAL\(.*\)|[A-Z_]+)", 1)


def _field_path(field: str | None) -> str:
    return "$" if field is None else f"$.{field}"


def observed_kinds(df: DataFrame, variant_col: str, field: str | None = None) -> list[str]:
    """Kinds of value found in one field, nulls left out.

    At most one row per kind, precision and scale reaches the driver. Decimals become one kind that
    holds the digits of all.
    """
    value = F.try_variant_get(F.col(variant_col), _field_path(field), "variant")
    found = {r.kind for r in df.select(_kind(value).alias("kind")).distinct().collect() if r.kind} - {"VOID"}
    sizes = [tuple(map(int, m.groups())) for k in found if (m := _DECIMAL.fullmatch(k))]
    kinds = sorted(k for k in found if not _DECIMAL.fullmatch(k))
    if sizes:
        scale = max(s for _, s in sizes)
        kinds.append(f"DECIMAL({max(p - s for p, s in sizes) + scale},{scale})")
    return kinds


def _member(kind: str) -> tuple[str, str]:
    if found := _DECIMAL.fullmatch(kind):
        if int(found[1]) > 38:
            raise ValueError(f"no decimal type holds the digits of all values: {kind}")
        return "decimal", kind.lower()
    if kind not in _MEMBERS:
        raise ValueError(f"no struct member for values of kind {kind}")
    return _MEMBERS[kind]


def resolve_choice(
    df: DataFrame,
    variant_col: str,
    field: str | None = None,
    action: str = "make_struct",
    kinds: Sequence[str] | None = None,
) -> DataFrame:
    """Turn a field seen with several types into a struct with one member per type, the others null.

    The field is ``field`` inside the variant column, or the column itself. Reading a
    variant also converts (number 1 reads as text ``1``), so each member is gated on
    the kind the value really has. Pass ``kinds`` to skip the pass that finds them
    (decimals as ``DECIMAL(p,s)``). A kind that has no member, or that is met but not
    among ``kinds``, raises; no value is lost. A single kind is no conflict and gives a plain column.
    """
    if action != "make_struct":
        raise ValueError(f"unsupported action: {action}")
    kinds = observed_kinds(df, variant_col, field) if kinds is None else list(kinds)
    path = _field_path(field)
    value = F.try_variant_get(F.col(variant_col), path, "variant")
    base = F.regexp_extract("_kind", "^[A-Z_]+", 0)
    columns = []
    for kind in kinds:
        name, dtype = _member(kind)
        typed = F.try_variant_get(F.col(variant_col), path, dtype)
        columns.append(F.when(base == kind.partition("(")[0], typed).alias(name))
    if not columns:
        resolved = F.lit(None).cast("string")
    else:
        resolved = columns[0] if len(columns) == 1 else F.struct(*columns)
    known = F.coalesce(base.isin("VOID", "", *(k.partition("(")[0] for k in kinds)), F.lit(True))
    message = F.concat(F.lit("unexpected kind of value: "), "_kind")
    checked = df.withColumn("_kind", _kind(value)).filter(F.when(known, True).otherwise(F.raise_error(message).cast("boolean")))
    return checked.withColumn(field or variant_col, resolved).drop("_kind")


def drop_null_fields(df: DataFrame, probe_rows: int = 64) -> DataFrame:
    """Drop columns that are null in every row.

    One non-null value proves a column is kept, so a few rows settle most columns.
    Only the columns still open are then counted over the whole input, and column
    pruning keeps that pass to them. A single row reaches the driver. Without any
    row nothing is known and every column stays.
    """
    names = [f"`{c}`" for c in df.columns]
    flags = df.select(*[F.col(n).isNotNull().alias(f"c{i}") for i, n in enumerate(names)]).take(probe_rows)
    undecided = [i for i in range(len(names)) if not any(row[i] for row in flags)]
    empty: set[int] = set()
    if undecided and flags:
        counts = df.agg(*[F.count(F.col(names[i])).alias(f"c{i}") for i in undecided]).first()
        empty = {i for i, n in zip(undecided, counts) if n == 0}
    return df.select(*[F.col(n) for i, n in enumerate(names) if i not in empty])
