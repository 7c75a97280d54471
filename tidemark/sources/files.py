"""File scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.partitions import TIME_KEYS


def scan_partitioned_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    partition_schema: T.StructType,
    folders: str | None = None,
    corrupt_column: str | None = None,
) -> DataFrame:
    """JSON lines below ``key=value`` folders, with declared data and partition columns.

    Declaring the partition columns keeps padded text such as ``08`` as text.
    ``folders`` is a glob below ``path`` (see :func:`projected_glob`): only
    matching folders are listed, where a plain filter would list them all first.
    """
    fields = list(schema.fields)
    reader = spark.read.option("basePath", path)
    if corrupt_column:
        fields.append(T.StructField(corrupt_column, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    target = f"{path.rstrip('/')}/{folders}" if folders else path
    return reader.schema(T.StructType(fields + list(partition_schema.fields))).json(target)


def projected_glob(values: Mapping[str, Sequence[str] | None]) -> str:
    """Folder glob computed from partition values alone; ``None`` matches any value."""
    parts = []
    for key, wanted in values.items():
        if wanted is None:
            parts.append(f"{key}=*")
        elif len(wanted) == 1:
            parts.append(f"{key}={wanted[0]}")
        else:
            parts.append(f"{key}={{{','.join(wanted)}}}")
    return "/".join(parts)


# Last month of a year, day of a month and hour of a day.
LAST_VALUES = {"month": 12, "day": 31, "hour": 23}
YEARS_AHEAD = 30


def later_folders(at: datetime, keys: Sequence[str] = tuple(TIME_KEYS)) -> str:
    """Glob of the ``key=value`` time folders at or after a time, from year down to any of the keys.

    It names the later years (:data:`YEARS_AHEAD`), then the later months of this one and so on, about a hundred
    patterns in all. A listing that follows it never opens an earlier folder, however many there are.
    """
    wanted, same = [], []
    for level, key in enumerate(keys):
        now, width = getattr(at, key), TIME_KEYS[key][1]
        first = now if level == len(keys) - 1 else now + 1
        last = LAST_VALUES.get(key, now + YEARS_AHEAD)
        below = [f"{k}=*" for k in keys[level + 1 :]]
        wanted += ["/".join([*same, f"{key}={v:0{width}d}", *below]) for v in range(first, last + 1)]
        same.append(f"{key}={now:0{width}d}")
    return "{" + ",".join(wanted) + "}"


def scan_inferred_json(spark: SparkSession, path: str, sampling_ratio: float = 1.0) -> DataFrame:
    """JSON lines without a declared schema.

    Inference is a separate distributed pass. At the default ratio it reads every
    record, so no rare field is missed; a lower ratio trades that for time.
    """
    return spark.read.option("samplingRatio", str(sampling_ratio)).json(path)


# Patterns of comma-separated text. Every repetition is possessive, so that long values need neither time nor stack.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_CLOSED = rf'(?:{_QUOTED}"[^,]*+|(?!")[^,]*+),'
_OPENS = rf'(?:{_CLOSED})*+{_QUOTED}\z'


def csv_values(record: Column) -> Column:
    """Values of one comma-separated record of any number of values, as the usual readers take them.

    A value that starts with a quote goes on to the next single quote, and two quotes in it stand for one. Text
    after the closing quote belongs to the value, a quote inside an unquoted value is text, and a quoted value that
    is never closed takes the rest of the record. Every character but the quotes around values is kept.
    """
    found = F.regexp_extract_all(
        F.concat(F.lit(","), record), F.lit(rf',({_QUOTED}"?+[^,]*+|[^,]*+)'), F.lit(1)
    )
    parts = rf'(?s)\A"({_QUOTED[1:]})"?+(.*+)\z'

    def value(raw: Column) -> Column:
        inside = F.replace(F.regexp_extract(raw, parts, 1), F.lit('""'), F.lit('"'))
        return F.when(raw.startswith('"'), F.concat(inside, F.regexp_extract(raw, parts, 2))).otherwise(raw)

    return F.transform(found, value)


def _running(df: DataFrame, keys: Sequence[str], order: str, opens: str, stays: str) -> DataFrame:
    """Whether each row starts and ends inside a quoted value, once for each way its group may start.

    ``opens`` says whether a row that starts outside ends inside, ``stays`` whether one that starts inside does. A
    row either sets the state whatever it was, turns it round, or leaves it; so the state after a row follows from the
    last one that set it and the number of turns since. Adds ``out_before``, ``out_after``, ``in_before`` and ``in_after``.
    """
    ordered = Window.partitionBy(*keys).orderBy(order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum((F.col(opens) & ~F.col(stays)).cast("int")).over(so_far)
    df = df.withColumn("_turns", turns)
    sets = F.when(F.col(opens) == F.col(stays), F.struct(F.col(opens).alias("to"), F.col("_turns").alias("at")))
    df = df.withColumn("_set", F.last(sets, ignorenulls=True).over(so_far))
    turned = F.pmod(F.col("_turns") - F.coalesce("_set.at", F.lit(0)), F.lit(2)) == 1
    for name, start in (("out", False), ("in", True)):
        df = df.withColumn(f"{name}_after", F.coalesce("_set.to", F.lit(start)) != turned)
    for name, start in (("out", False), ("in", True)):
        df = df.withColumn(f"{name}_before", F.coalesce(F.lag(f"{name}_after").over(ordered), F.lit(start)))
    return df.drop("_turns", "_set")


def _joined_records(lines: DataFrame) -> DataFrame:
    """Records of lines ``(object, block, line, value)``: a quoted value may go on over lines, and over blocks of a file.

    No block knows how it starts, so each is read for both cases. What a whole block does to either case is one small
    row; combined in the order of the file, these rows settle how each block starts. Lines of one record meet by the
    place of its first line; most lines are records of their own and are not moved for that.
    """
    inside = rf'\A{_QUOTED[1:]}(?:\z|"[^,]*+,{_OPENS})'
    opens, stays = F.col("value").rlike(rf"\A{_OPENS}"), F.col("value").rlike(inside)
    lines = _running(lines.withColumns({"_opens": opens, "_stays": stays}), ["object", "block"], "line", "_opens", "_stays")
    lines = lines.drop("_opens", "_stays")

    def start(before: str) -> Column:
        return F.max(F.when(~F.col(before), F.col("line")))

    blocks = lines.groupBy("object", "block").agg(
        F.max_by("out_after", "line").alias("_opens"),
        F.max_by("in_after", "line").alias("_stays"),
        start("out_before").alias("_out_start"),
        start("in_before").alias("_in_start"),
    )
    blocks = _running(blocks, ["object"], "block", "_opens", "_stays")
    # A file starts outside.
    last = F.when(F.col("out_before"), F.col("_in_start")).otherwise(F.col("_out_start"))
    last = F.when(last.isNotNull(), F.struct(F.col("block").alias("block"), last.alias("line")))
    earlier = Window.partitionBy("object").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_last", last).select(
        "object", "block", F.col("out_before").alias("_inside"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    lines = lines.join(blocks, ["object", "block"])
    for side in ("before", "after"):
        known = F.when(F.col("_inside"), F.col(f"in_{side}")).otherwise(F.col(f"out_{side}"))
        lines = lines.withColumn(f"_{side}", known)
    alone = ~F.col("_before") & ~F.col("_after")
    single = lines.filter(alone).select("object", "block", "line", "value")
    so_far = Window.partitionBy("object", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    here = F.when(~F.col("_before"), F.struct("block", "line"))
    spread = lines.filter(~alone).withColumn("_first", F.coalesce(F.last(here, ignorenulls=True).over(so_far), "_carried"))
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    spread = spread.groupBy("object", "_first").agg(F.array_join(parts.getField("value"), "\n").alias("value"))
    return single.unionByName(spread.select("object", "_first.block", "_first.line", "value"))


def _records(lines: DataFrame, multi_line: bool) -> DataFrame:
    """Records ``(object, block, line, value)`` of lines ``(object, block, at, value)``; empty lines are none.

    A line is known by the start of its block and its number there, which any scan of the file gives alike.
    """
    number = F.row_number().over(Window.partitionBy("object", "block").orderBy("at"))
    lines = lines.withColumn("line", number).drop("at")
    return (_joined_records(lines) if multi_line else lines).filter(F.col("value") != "")


def scan_csv_header(
    spark: SparkSession,
    path: str | list[str],
    multi_line: bool = False,
    recursive: bool = False,
    ragged: str | None = None,
) -> DataFrame:
    """Comma-separated text with a header line; every column is a string.

    With ``multi_line`` quoted values may span lines, and each file is one unit of work; without it large
    files are split. A record with fewer values than the header gets nulls for the rest, one with more
    would lose them: name a column ``ragged`` to keep all values of such records there, as an array. Values are then
    those of :func:`scan_headed_files`, large files are split with ``multi_line`` too, and empty values are null.
    Files whose header differs from the first one raise instead of mixing columns; see
    :func:`scan_headed_files` for files with headers of their own.
    """

    def reader() -> DataFrameReader:
        return (
            spark.read.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", multi_line)
            .option("enforceSchema", False)
            .option("recursiveFileLookup", recursive)
        )

    rows = reader().csv(path)
    if ragged is None:
        return rows
    names = rows.columns
    reader_text = spark.read.option("recursiveFileLookup", recursive)
    lines = reader_text.text(path).select(
        F.col("_metadata.file_path").alias("object"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    headed = _headed(_records(lines, multi_line))
    other = ~csv_values(F.col("headers")).eqNullSafe(F.array(*[F.lit(n) for n in names]))
    same = F.when(other, F.raise_error(F.concat(F.lit("another header in "), "object")).cast("boolean")).otherwise(True)
    values = [F.nullif(F.get("fields", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return headed.filter(same).select(*values, F.when(F.size("fields") != len(names), F.col("fields")).alias(ragged))


def _headed(records: DataFrame) -> DataFrame:
    """Rows ``(object, headers, fields)``: the first record of each object is the header of the others."""
    place = F.struct("block", "line")
    first = records.groupBy("object").agg(F.min(place).alias("_first"), F.min_by("value", place).alias("headers"))
    rows = records.join(first, "object").filter(place != F.col("_first"))
    return rows.select("object", "headers", csv_values(F.col("value")).alias("fields"))


def scan_headed_files(
    spark: SparkSession, path: str, multi_line: bool = False, only: DataFrame | None = None
) -> DataFrame:
    """Records of comma-separated files that each have a header of their own: rows ``(object, headers, fields)``.

    All files are read in one scan, however many headers there are; records may have any number of
    values. ``only`` is a table of the wanted files in one column, as paths below ``path``: the semi join with it comes
    before anything else, and no names pass through the driver. ``headers`` is the first record of the file,
    ``fields`` the values of a record (see :func:`csv_values`). With ``multi_line`` quoted values may span lines; line
    ends in them are line feeds. Large files are split either way. A quote that is never closed makes the rest of its
    file one value.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = F.substring_index(name, f"{path.rstrip('/')}/", -1).alias("object")
    order = F.monotonically_increasing_id().alias("at")
    lines = reader.text(path).select(name, F.col("_metadata.file_block_start").alias("block"), order, "value")
    if only is not None:
        lines = lines.join(only.toDF("object"), "object", "left_semi")
    return _headed(_records(lines, multi_line))


def object_listing(spark: SparkSession, path: str) -> DataFrame:
    """Objects below a location as rows ``(path, length, modified)``.

    File contents are not read: the ``content`` column is pruned from the scan. Spark
    still plans tasks by file size, so they are merged into as many as a shuffle has.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "length", F.col("modificationTime").alias("modified")).coalesce(tasks)
