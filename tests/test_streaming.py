from __future__ import annotations

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import operators as ops
from tidemark import streaming
from tidemark.streaming import landing

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
TEXT = T.StructType([T.StructField("value", T.StringType())])
LINES = ['{"a":1,"b":"x"}', '{"a":"oops","b":"y"}', "not json", '{"a":2,"c":3}']


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_route_malformed(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate([*LINES, "", None])], "value string, n int")
    good, bad = streaming.route_malformed(df, SCHEMA)
    assert rows(good) == [(0, 1, "x"), (3, 2, None)]
    assert [r[0] for r in rows(bad)] == [1, 2, 4, 5]
    assert bad.columns == ["n", "value"]


def test_each_record_is_parsed_once(spark):
    good, _ = streaming.route_malformed(spark.createDataFrame([("{}",)], "value string"), SCHEMA)
    assert good._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


def land(spark, root, name="ck"):
    lines = streaming.stream_source(spark, f"{root}/in", TEXT, data_format="text", max_files=1)
    streaming.land_stream(
        lines, SCHEMA, f"{root}/curated", f"{root}/raw", f"{root}/failed", f"{root}/{name}", available_now=True
    ).awaitTermination()


def landed(spark, root):
    return {
        "raw": rows(spark.read.text(f"{root}/raw").select("value")),
        "curated": rows(spark.read.parquet(f"{root}/curated").select(*SCHEMA.names)),
        "failed": rows(spark.read.text(f"{root}/failed").select("value")),
    }


def test_land_stream_replays_without_copies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text("\n".join(LINES[:2]) + "\n")
    (tmp_path / "in/2.txt").write_text("\n".join(LINES[2:]) + "\n")
    land(spark, tmp_path)
    first = landed(spark, tmp_path)
    assert first == {
        "raw": sorted((x,) for x in LINES),
        "curated": [(1, "x"), (2, None)],
        "failed": [("not json",), ('{"a":"oops","b":"y"}',)],
    }
    # The last batch was written but its commit is lost: the restarted stream repeats it.
    last = max((tmp_path / "ck/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    land(spark, tmp_path)
    assert landed(spark, tmp_path) == first
    # A new checkpoint counts batches from zero and must not overwrite the old ones.
    (tmp_path / "in/3.txt").write_text('{"a":3,"b":"new"}\n')
    land(spark, tmp_path, "other")
    assert landed(spark, tmp_path)["curated"].count((1, "x")) == 2
    assert (3, "new") in landed(spark, tmp_path)["curated"]


def test_raw_backup_folder_is_arrival_time(spark, tmp_path):
    batch = spark.createDataFrame([("r1",), ("r2",)], "value string")
    arrival = F.lit("2024-02-03 04:05:06").cast("timestamp")
    for _ in range(2):
        landing.stream_raw_backup(batch, str(tmp_path), "s", 7, arrival=arrival)
    folder = tmp_path / "stream_id=s/batch_id=7/year=2024/month=02/day=03/hour=04"
    assert sorted("".join(p.read_text() for p in folder.glob("*.txt")).split()) == ["r1", "r2"]


def test_latest_skips_old_files_but_not_those_of_a_pause(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/old.json").write_text('{"a":1,"b":"old"}\n')
    time.sleep(1.1)

    def run():
        stream = streaming.stream_source(
            spark, f"{tmp_path}/in", SCHEMA, start="latest", marker=f"{tmp_path}/marker"
        )
        streaming.stream_to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True).awaitTermination()
        return rows(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out"))

    assert run() == []
    time.sleep(1.1)
    (tmp_path / "in/new.json").write_text('{"a":2,"b":"new"}\n')
    time.sleep(1.1)
    assert run() == [(2, "new")]
    with pytest.raises(ValueError):
        streaming.stream_source(spark, f"{tmp_path}/in", SCHEMA, start="latest")
    with pytest.raises(ValueError):
        streaming.stream_source(spark, f"{tmp_path}/in", SCHEMA, start="yesterday")


def test_latest_passes_the_history_in_one_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(6):
        (folder / f"{i}.json").write_text(f'{{"a":{i}}}\n')
        os.utime(folder / f"{i}.json", (1_600_000_000, 1_600_000_000))

    def run():
        stream = streaming.stream_source(
            spark, str(folder), SCHEMA, start="latest", max_files=1, marker=f"{tmp_path}/marker"
        )
        query = streaming.stream_to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True)
        query.awaitTermination()
        return len({p["batchId"] for p in query.recentProgress})

    assert run() == 1
    assert spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").count() == 0


def test_stream_with_keys_writes_few_files_per_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(40):
        (tmp_path / f"in/{i}.json").write_text("".join(f'{{"a":{j}}}\n' for j in range(3)))
    stream = streaming.stream_source(spark, f"{tmp_path}/in", SCHEMA).withColumn("k", F.col("a"))
    query = streaming.stream_to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/ck", ["k"], available_now=True)
    query.awaitTermination()
    folders = [f for f in (tmp_path / "out").iterdir() if f.name.startswith("k=")]
    assert len(folders) == 3 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)


def test_batch_size_limit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / f"in/{i}.json").write_text(f'{{"a":{i}}}\n')
    stream = streaming.stream_source(spark, f"{tmp_path}/in", SCHEMA, max_files=1)
    query = streaming.stream_to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4


def metric_files(tmp_path):
    folder = tmp_path / "metrics"
    folder.mkdir()
    lines = [
        f'{{"ts":"2024-01-01T00:{m:02d}:{s:02d}","k":"{"ab"[s % 2]}","v":{m * 10 + s},"p":"{"x" * s}"}}'
        for m in range(12)
        for s in (1, 2, 30)
    ]
    for i in range(0, len(lines), 9):
        (folder / f"{i:03d}.json").write_text("\n".join(lines[i : i + 9]) + "\n")
    return str(folder)


METRIC = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("k", T.StringType()),
        T.StructField("v", T.DoubleType()),
        T.StructField("p", T.StringType()),
    ]
)


@pytest.mark.parametrize(
    "make",
    [
        lambda df, **o: ops.per_minute_sums(df, "ts", ["k"], "p", **o),
        lambda df, **o: ops.period_averages(df, "ts", "v", ["k"], **o),
        lambda df, **o: ops.per_minute_lag(df.withColumn("got", F.col("ts")), "ts", "got", ["k"], **o),
    ],
    ids=["sums", "averages", "lag"],
)
def test_stream_equals_batch(spark, tmp_path, make):
    path = metric_files(tmp_path)
    stream = streaming.stream_source(spark, path, METRIC, max_files=1)
    query = (
        make(stream, watermark="1 minute")
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("metrics_out")
        .option("checkpointLocation", f"{tmp_path}/ck")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batch = make(spark.read.schema(METRIC).json(path))
    assert rows(spark.table("metrics_out")) == rows(batch)


def test_late_rows_do_not_reopen_a_closed_minute(spark, tmp_path):
    folder = tmp_path / "late"
    folder.mkdir()

    def put(name, *stamps):
        (folder / name).write_text("".join(f'{{"ts":"2024-01-01T00:{s}","k":"a","v":1,"p":"x"}}\n' for s in stamps))
        time.sleep(0.05)

    put("1.json", "00:10", "00:20")
    put("2.json", "10:00")
    put("3.json", "11:00")
    put("4.json", "00:30", "20:00")
    put("5.json", "30:00")
    stream = streaming.stream_source(spark, str(folder), METRIC, max_files=1)
    sums = ops.per_minute_sums(stream, "ts", ["k"], "p", watermark="1 minute")
    streaming.stream_to_parquet(sums, f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.filter("minute = '2024-01-01 00:00:00'").select("records").collect()[0][0] == 2
    assert out.count() == out.select("minute").distinct().count()


def test_order_stream(spark, tmp_path):
    stream = streaming.order_stream(spark, rows_per_second=200)
    query = streaming.stream_to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/ck", interval="1 second")
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not sum(p["numInputRows"] for p in query.recentProgress):
            time.sleep(0.3)
    finally:
        query.stop()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.columns == ["order_id", "customer_id", "order_date", "sku", "price"]
    assert out.count() > 0 and out.select("order_id").distinct().count() == out.count()


def test_topic_source_needs_the_connector(spark):
    with pytest.raises(ValueError):
        streaming.topic_source(spark, "host:1", "t", start="middle")
    with pytest.raises(Exception, match="[Kk]afka"):
        streaming.topic_source(spark, "host:1", "t")
