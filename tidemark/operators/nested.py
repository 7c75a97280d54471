"""Flattening of nested records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.json_text import one_variant
from tidemark.functions.once import computed_once
from tidemark.session import scratch_dir, session_settings

# More columns than this are better read as rows of paths.
MAX_COLUMNS = 2_000
# Levels of JSON that one pass of flatten_paths opens.
LEVELS_PER_PASS = 4

Reach = Callable[[Callable[[Column], Column]], Column]


def measure_arrays(df: DataFrame) -> dict[str, int]:
    """Largest size of every array in the schema, in one pass with one result row.

    Keys are paths with ``[]`` for "any element", e.g. ``points`` and ``points[]``.
    """
    sizes: dict[str, Column] = {}

    def visit(path: str, dtype: T.DataType, reach: Reach) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                visit(f"{path}.{f.name}", f.dataType, lambda g, n=f.name: reach(lambda c: g(c.getField(n))))
        elif isinstance(dtype, T.ArrayType):
            sizes[path] = F.max(reach(F.size))
            visit(f"{path}[]", dtype.elementType, lambda g: reach(lambda c: F.array_max(F.transform(c, g))))

    for field in df.schema.fields:
        visit(field.name, field.dataType, lambda g, n=field.name: g(F.col(f"`{n}`")))
    if not sizes:
        return {}
    row = df.agg(*[c.alias(f"s{i}") for i, c in enumerate(sizes.values())]).first()
    return {path: max(n or 0, 0) for path, n in zip(sizes, row)}


def measure_keys(df: DataFrame, value: Column, max_keys: int) -> list[str]:
    """Distinct keys of a map column, sorted. Raises beyond ``max_keys``, so that much reaches the driver."""
    found = df.select(F.explode(F.map_keys(value)).alias("k")).select(F.col("k").cast("string")).distinct()
    keys = found.limit(max_keys + 1).collect()
    if len(keys) > max_keys:
        raise ValueError(f"a map has more than {max_keys} keys; flatten_paths gives rows instead of columns")
    return sorted(r.k for r in keys)


def flatten_columns(
    df: DataFrame,
    array_sizes: Mapping[str, int] | None = None,
    map_keys: Mapping[str, Sequence[str]] | None = None,
    max_columns: int = MAX_COLUMNS,
) -> DataFrame:
    """Nested structs, arrays and maps to flat columns named by ``.``-joined path (``k.0``, ``k.l``).

    Without ``array_sizes`` the sizes are measured in one extra pass, and without ``map_keys`` the keys of each
    map in one. Given sizes and keys are checked: a longer array or another key raises, so nothing
    is lost. Data that would need more than ``max_columns`` columns raises too. Maps inside arrays or maps,
    whose keys differ from row to row, are for :func:`flatten_paths`.
    """
    given = array_sizes is not None
    sizes = dict(array_sizes) if given else measure_arrays(df)
    columns: dict[str, Column] = {}
    guards: list[Column] = []

    def guard(wrong: Column, message: str) -> None:
        guards.append(F.when(wrong, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))

    def visit(name: str, path: str, dtype: T.DataType, value: Column, inside: bool = False) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                visit(f"{name}.{f.name}", f"{path}.{f.name}", f.dataType, value.getField(f.name), inside)
        elif isinstance(dtype, T.MapType):
            if inside:
                raise ValueError(f"map {name} lies in an array or a map; flatten_paths gives rows of paths")
            keys = (map_keys or {}).get(path)
            if keys is None:
                keys = measure_keys(df, value, max_columns)
            else:
                others = F.exists(F.map_keys(value), lambda k: ~k.cast("string").isin(*keys))
                guard(others, f"map {name} has a key that is not declared")
            for key in keys:
                wanted = F.lit(key).cast(dtype.keyType)
                visit(f"{name}.{key}", f"{path}.{key}", dtype.valueType, F.try_element_at(value, wanted), True)
        elif isinstance(dtype, T.ArrayType):
            if given:
                if path not in sizes:
                    raise ValueError(f"no size given for array {path}")
                guard(F.size(value) > sizes[path], f"array {name} is longer than the {sizes[path]} elements declared")
            elif inside and path not in sizes:
                raise ValueError(f"array {name} lies in a map; flatten_paths gives rows of paths")
            for i in range(sizes[path]):
                visit(f"{name}.{i}", f"{path}[]", dtype.elementType, F.get(value, i), True)
        elif name in columns:
            raise ValueError(f"two fields flatten to the name {name}")
        else:
            columns[name] = value.alias(name)
            if len(columns) > max_columns:
                raise ValueError(f"more than {max_columns} columns; flatten_paths gives rows instead")

    for field in df.schema.fields:
        visit(field.name, field.name, field.dataType, F.col(f"`{field.name}`"))
    for wrong in guards:
        df = df.filter(wrong)
    return df.select(*columns.values())


def _opened(rows: DataFrame, levels: int) -> DataFrame:
    """Rows ``(_id, _path, _text, _v)`` with ``levels`` more levels of ``_v`` as rows of their own."""
    for _ in range(levels):
        children = rows.sparkSession.tvf.variant_explode_outer(F.col("_v").outer())
        name = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        inner = F.col("pos").isNotNull()
        path = F.when(F.col("_path") == "", name).otherwise(F.concat_ws(".", "_path", name))
        rows = rows.lateralJoin(children).select(
            "_id",
            F.when(inner, path).otherwise(F.col("_path")).alias("_path"),
            "_text",
            F.when(inner, F.col("value")).otherwise(F.col("_v")).alias("_v"),
        )
    return rows


def _paths(rows: DataFrame, id_col: str) -> DataFrame:
    leaf = F.coalesce(F.col("_text"), F.try_variant_get("_v", "$", "string"))
    rows = rows.select("_id", "_path", leaf.alias("_leaf"), "_v")
    empty = F.col("_leaf").isin("[]", "{}") & (F.to_json("_v") == F.col("_leaf"))
    return rows.filter(~F.coalesce(empty, F.lit(False))).select(
        F.col("_id").alias(id_col), F.col("_path").alias("path"), F.col("_leaf").alias("value")
    )


def flatten_paths(df: DataFrame, id_col: str, json_col: str, max_depth: int | None = None) -> DataFrame:
    """Flatten JSON text of unknown shape to rows ``(id, path, value)``.

    Empty lists and objects give no row, null leaves a null value. Text that is not exactly one JSON
    value is kept under a null path. With ``max_depth`` each level is one generator in one stage, and what lies
    below is kept as JSON text. Without it, passes of a few levels go on until nothing is nested: each writes
    what it made to the shared folder, and the next opens only what is still nested. Nothing is shuffled,
    and the plan of a pass does not grow with the data. Of a repeated key the last one counts.
    """
    text = F.col(json_col)
    rows = df.filter(text.isNotNull()).select(F.col(id_col).alias("_id"), text.alias("_text"))
    rows = computed_once(rows, "_v", one_variant(F.col("_text")))
    parsed = F.col("_v").isNotNull()
    rows = rows.select("_id", F.when(parsed, "").alias("_path"), F.when(~parsed, F.col("_text")).alias("_text"), "_v")
    if max_depth is not None:
        return _paths(_opened(rows, max_depth), id_col)
    holds = F.schema_of_variant("_v").rlike("^(ARRAY|OBJECT)<")
    nested = F.coalesce(F.when(holds, ~F.to_json("_v").isin("[]", "{}")), F.lit(False))
    done: DataFrame | None = None
    while True:
        path = scratch_dir(df.sparkSession, "flatten")
        opened = _opened(rows, LEVELS_PER_PASS)
        with session_settings(df.sparkSession, {"spark.sql.variant.allowDuplicateKeys": "true"}):
            opened.withColumn("_nested", nested).write.parquet(path)
        made = df.sparkSession.read.schema(opened.schema.add("_nested", "boolean")).parquet(path)
        part = _paths(made.filter(~F.col("_nested")).drop("_nested"), id_col)
        done = part if done is None else done.union(part)
        rows = made.filter("_nested").drop("_nested")
        if rows.isEmpty():
            return done
