"""Comma-separated text against the standard reader, with files cut into small blocks."""

from __future__ import annotations

import csv
import io
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.sources.files import csv_values


def standard(text):
    return [row for row in csv.reader(io.StringIO(text, newline=None)) if row]


def values(spark, records):
    df = spark.createDataFrame(list(enumerate(records)), "i int, r string")
    return [r.v for r in df.select("i", csv_values(F.col("r")).alias("v")).orderBy("i").collect()]


RECORDS = [
    "a,b,c", ",,", "a", '"a","b"', '1,"two"x,3', '1,2,"p"q', '"a ""b"", c",d', 'ab"c,d', '5" pipe,6"', '"open, to, the end', '"",""',
    '"""",""""""', '"a"b"c",d', '"a" ,b', ' "a",b', '"x""y"z""w,v', '1,"two""', '""a,b', "\t,é,漢", '"',
]


def test_values_as_the_standard_reader_takes_them(spark):
    assert values(spark, RECORDS) == [next(csv.reader([r])) for r in RECORDS]


def test_random_values(spark):
    draw = random.Random(7)
    records = ["".join(draw.choices('",ab é', k=draw.randint(1, 14))) for _ in range(3_000)]
    assert values(spark, records) == [next(csv.reader([r])) for r in records]


def test_long_values_keep_every_character(spark):
    csv.field_size_limit(1 << 30)
    long = ["x" * 10_000_000, 'q""' * 1_000_000, "a,b " * 500_000]
    records = [f'1,"{v}",2' for v in long] + [f'1,"{v}' for v in long] + [f'1,"{v}"tail,2' for v in long] + ["," * 200_000]
    start = time.perf_counter()
    for record in records:
        (got,) = values(spark, [record])
        assert got == next(csv.reader([record]))
    assert time.perf_counter() - start < 60


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of few bytes, so that records and runs of them lie across blocks."""
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


FILES = {
    "plain.csv": "a,b\n1,2\n3,4,5\n6\n",
    "lines.csv": 'id,"te\nxt"\n1,"two\nlines"\n2,"one ""line"""\n\n3,"\n\n"\n4,5" pipe\n5,"x"tail\n6,"many\nmany\n\nmany\nlines, and "" quotes\n' + "filler line\n" * 30 + 'end"after,z\n7,8\n',
    "open.csv": 'a,b\n1,"never\nclosed, 2\n3,4\n\n' + "more\n" * 20 + "last",
    "crlf.csv": 'a,b\r\n1,"x\r\ny"\r\n2,3\r\n',
    "quotes.csv": 'a\n"\n"\n""\n"""\n"""\n" ""\n"" "\nb"b\nb"\n',
    "one.csv": "only header",
    "empty.csv": "",
}


def scanned(spark, path, **options):
    rows = sources.scan_headed_files(spark, str(path), multi_line=True, **options).collect()
    out = {}
    for r in rows:
        out.setdefault(r.object, []).append((r.headers, r.fields))
    return {name: sorted(rows, key=repr) for name, rows in out.items()}


def wanted(files):
    out = {}
    for name, text in files.items():
        rows = standard(text)
        if len(rows) > 1:
            out[name] = sorted((rows[0], row) for row in rows[1:])
    return out


def test_records_over_lines_and_blocks(spark, tmp_path, small_blocks):
    draw = random.Random(3)
    files = dict(FILES)
    for i in range(12):
        lines = ["".join(draw.choices('",a b', weights=[4, 3, 5, 1, 5], k=draw.randint(0, 12))) for _ in range(60)]
        files[f"random{i}.csv"] = "h,i\n" + "\n".join(lines) + "x"
    for name, text in files.items():
        (tmp_path / name).write_text(text, newline="")
    blocks = spark.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    assert blocks > 5 * len(files)
    got = scanned(spark, tmp_path)
    for name, rows in got.items():
        for headers, _ in rows:
            assert next(csv.reader(io.StringIO(headers))) == standard(files[name])[0]
    assert {n: sorted(f for _, f in rows) for n, rows in got.items()} == {
        n: sorted(f for _, f in rows) for n, rows in wanted(files).items()
    }


def test_a_large_file_is_read_in_many_tasks(spark, tmp_path):
    with open(tmp_path / "large.csv", "w") as out:
        out.write("id,text,more\n")
        for i in range(150_000):
            out.write(f'{i},"value ""{i}"",\nsecond line",tail\n' if i % 3 else f"{i},plain value {i},tail\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    try:
        lines = spark.read.text(str(tmp_path))
        assert lines.rdd.getNumPartitions() > 8
        rows = sources.scan_headed_files(spark, str(tmp_path), multi_line=True)
        text = F.when(
            F.col("i") % 3 == 0, F.concat(F.lit("plain value "), "i")
        ).otherwise(F.concat(F.lit('value "'), "i", F.lit('",\nsecond line')))
        want = spark.range(150_000).withColumnRenamed("id", "i").select(F.array(F.col("i").cast("string"), text, F.lit("tail")).alias("fields"))
        assert rows.count() == 150_000 and rows.select("fields").exceptAll(want).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ragged_records_over_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"two\nlines"x\n2\n3,4,"5\n6"\n"never, closed\n')
    got = sources.scan_csv_header(spark, str(tmp_path), multi_line=True, ragged="all").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [("1", "two\nlinesx", None), ("2", None, ["2"]), ("3", "4", ["3", "4", "5\n6"]), ("never, closed", None, ["never, closed"])],
        key=repr,
    )
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="another header|does not conform"):
        sources.scan_csv_header(spark, str(tmp_path), ragged="all").collect()
