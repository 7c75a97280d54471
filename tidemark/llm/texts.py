"""Helpers for operators that read whole texts in Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import scratch_dir

# A word is a run of anything but a space and U+0009 to U+000D. bytes.split() splits UTF-8 at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 4 << 20


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def blocks(texts: Sequence[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (start, stop) of at most ``limit`` bytes, or of one longer text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or b"")
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow with a function of this library, whose folder is put on the Python path of the workers."""
    environment = df.sparkSession.sparkContext.environment
    folder = str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if folder not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [folder, *paths]))
    return df.mapInArrow(run, schema)


def per_text(
    df: DataFrame, text: str, keep: Sequence[str], fields: T.StructType, start: Callable[[], Callable]
) -> DataFrame:
    """Columns ``keep`` of every row, and the ``fields`` made from its text.

    ``start()`` runs once per task and returns a function from a list of UTF-8 texts
    (None for null) to one array per field. Texts come in blocks of bounded size.
    """
    kept = [F.col(f"`{name}`") for name in keep]
    rows = df.select(*kept, F.col(f"`{text}`").alias("text to read"))
    schema = T.StructType([*rows.schema.fields[:-1], *fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        names = [f.name for f in schema.fields]
        for batch in batches:
            texts = utf8(batch.columns[-1])
            for a, b in blocks(texts):
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in make(texts[a:b])]
                part = [column.slice(a, b - a) for column in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*part, *made], names=names)

    return arrow(rows, run, schema)


def filter_texts(df: DataFrame, text: str, start: Callable[[], Callable]) -> DataFrame:
    """Rows of ``df``, all columns, for whose text the function of ``start()`` says true."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            texts = utf8(batch.columns[at])
            for a, b in blocks(texts):
                yield batch.slice(a, b - a).filter(pa.array(make(texts[a:b]), pa.bool_()))

    return arrow(df, run, df.schema)


# Parquet counts a hundred rows before it looks at their size. With rows of megabytes, a page would be a whole file,
# which its writer, its codec and its reader each hold at once.
LARGE_ROWS = {
    "parquet.page.size.row.check.min": 1,
    "parquet.block.size.row.check.min": 1,
    "parquet.page.size": 1 << 20,
    "parquet.block.size": 8 << 20,
}


def saved(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """The same rows, written once as Parquet below ``spark.checkpoint.dir`` and read again; those with
    ``large_rows`` in row groups and pages of few rows."""
    path = scratch_dir(df.sparkSession, name)
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
