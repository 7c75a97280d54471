"""Streams with state of their own: bounded first start, sized landing, alarms, doubled notices."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import operators as ops
from tidemark import sources, streaming
from tidemark.functions import TIME_KEYS

HOURS = T.StructType([T.StructField(k, T.StringType()) for k in TIME_KEYS])
SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), *HOURS.fields])


def folder(root, at):
    path = root / at.strftime("year=%Y/month=%m/day=%d/hour=%H")
    path.mkdir(parents=True, exist_ok=True)
    return path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# First start


@pytest.mark.parametrize("keys", [tuple(TIME_KEYS), ("year", "month", "day"), ("year",)])
def test_later_folders(spark, tmp_path, keys):
    at = datetime(2024, 2, 29, 13)
    others = [at + timedelta(hours=h) for h in (-9000, -745, -25, -14, -1, 0, 1, 10, 11, 24, 744, 9000, 100_000)]
    for i, other in enumerate(others):
        path = tmp_path / "/".join(f"{k}={other.strftime(f)}" for k, f in zip(keys, ("%Y", "%m", "%d", "%H")))
        path.mkdir(parents=True, exist_ok=True)
        (path / f"{i}.json").write_text(json.dumps({"a": i}) + "\n")
    read = spark.read.option("basePath", str(tmp_path)).json(f"{tmp_path}/{sources.later_folders(at, keys)}")
    part = lambda t: tuple(getattr(t, k) for k in keys)
    assert sorted(r.a for r in read.collect()) == [i for i, t in enumerate(others) if part(t) >= part(at)]


def test_first_start_of_latest_is_bounded_and_lists_no_history(spark, tmp_path):
    now = datetime.now(UTC)
    for days in range(1, 40):
        old = folder(tmp_path / "in", now - timedelta(days=days)) / "old.json"
        old.write_text('{"a":-1}\n')
    hour = folder(tmp_path / "in", now) / "before.json"
    hour.write_text('{"a":-2}\n')
    os.utime(hour, (1_600_000_000, 1_600_000_000))

    def run():
        stream = streaming.stream_source(
            spark, f"{tmp_path}/in", SCHEMA, start="latest", marker=f"{tmp_path}/marker", max_files=2, arrival_keys=tuple(TIME_KEYS)
        )
        query = streaming.stream_to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True)
        query.awaitTermination()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    run()
    for i in range(7):
        (folder(tmp_path / "in", now) / f"{i}.json").write_text(f'{{"a":{i}}}\n')
        os.utime(folder(tmp_path / "in", now) / f"{i}.json", (2_000_000_000, 2_000_000_000))
    assert max(run()) <= 2
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.a for r in out.collect()) == list(range(7))
    assert out.select("hour").distinct().first().hour == now.strftime("%H")
    listed = [line for f in (tmp_path / "ck/sources/0").iterdir() if f.name.isdigit() for line in f.read_text().splitlines()]
    assert "before.json" in " ".join(listed) and not any("old.json" in line for line in listed)


def test_since_needs_folders(spark, tmp_path):
    with pytest.raises(ValueError):
        streaming.stream_source(spark, str(tmp_path), SCHEMA, since=datetime(2024, 1, 1))


# Sized landing


LANDED = T.StructType([T.StructField("v", T.LongType()), T.StructField("pad", T.StringType()), T.StructField("hour", T.StringType())])


@pytest.fixture
def small_files(spark):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    yield
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)


def land(spark, root, checkpoint="ck", **options):
    stream = streaming.stream_source(spark, f"{root}/in", LANDED, data_format="parquet", **options)
    streaming.land_sized(stream, f"{root}/out", f"{root}/{checkpoint}", ["hour"], available_now=True).awaitTermination()


def feed(spark, root, first, n, hour, files=1):
    noise = F.sha2(F.col("id").cast("string"), 512)
    made = spark.range(first, first + n).select(F.col("id").alias("v"), noise.alias("pad"), F.lit(hour).alias("hour"))
    made.repartition(files).write.mode("append").parquet(f"{root}/in")


def test_a_batch_of_one_hour_uses_many_tasks(spark, tmp_path, small_files):
    feed(spark, tmp_path, 0, 20_000, "08", files=16)
    feed(spark, tmp_path, 20_000, 10, "09")
    land(spark, tmp_path)
    hot = list((tmp_path / "out/batches").glob("*/*/hour=08/*.parquet"))
    cold = list((tmp_path / "out/batches").glob("*/*/hour=09/*.parquet"))
    assert len(hot) >= 4 and len(cold) == 1  # a task for 64 KB
    assert max(f.stat().st_size for f in hot) < 4 * min(f.stat().st_size for f in hot)


def test_compaction_replay_and_late_rows(spark, tmp_path):
    def read():
        return streaming.read_landed(spark, f"{tmp_path}/out", LANDED, ["hour"])

    def compact(closed="08"):
        return streaming.compact_landed(spark, f"{tmp_path}/out", LANDED, ["hour"], F.col("hour") <= closed)

    assert read().count() == 0 and compact() == 0
    for i in range(4):
        feed(spark, tmp_path, 100 * i, 100, "08")
        feed(spark, tmp_path, 1000 + 100 * i, 100, "09")
    land(spark, tmp_path, max_files=1)
    want = sorted([*range(400), *range(1000, 1400)])
    assert sorted(r.v for r in read().collect()) == want
    assert compact() == 4 and compact() == 0
    assert len(list((tmp_path / "out/compacted").glob("*/hour=08/*.parquet"))) == 1
    assert sorted(r.v for r in read().collect()) == want
    # A batch that runs again leaves one copy, compacted or not.
    commits = tmp_path / "ck/commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    (commits / str(last)).unlink()
    (commits / f".{last}.crc").unlink(missing_ok=True)
    land(spark, tmp_path, max_files=1)
    assert sorted(r.v for r in read().collect()) == want
    # Late rows of a closed hour are there before and after the next run.
    feed(spark, tmp_path, 5000, 5, "08")
    land(spark, tmp_path, max_files=1)
    want = sorted([*want, *range(5000, 5005)])
    assert sorted(r.v for r in read().collect()) == want
    assert compact() == 1 and sorted(r.v for r in read().collect()) == want
    # A run that ends before its manifest is not seen.
    spark.createDataFrame([(1, "x")], "v long, pad string").write.parquet(f"{tmp_path}/out/compacted/run=broken/hour=08")
    assert sorted(r.v for r in read().collect()) == want
    # Another stream with a checkpoint of its own adds rows, it does not replace batches.
    land(spark, tmp_path, "other")
    assert read().count() == 2 * len(want)


# Alarms


METRIC = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())])
START = datetime(2024, 1, 1)


def metric(spark, root, name, points):
    lines = [json.dumps({"ts": (START + timedelta(minutes=m)).isoformat() + "Z", "k": k, "v": v}) for m, k, v in points]
    (root / "in").mkdir(exist_ok=True)
    (root / f"in/{name}.json").write_text("\n".join(lines) + "\n")
    os.utime(root / f"in/{name}.json", (1_700_000_000 + int(name), 1_700_000_000 + int(name)))


def alarm(spark, root, **options):
    stream = streaming.stream_source(spark, f"{root}/in", METRIC, max_files=1)
    streaming.stream_alarm(
        stream, "ts", "v", f"{root}/out", f"{root}/ck", "10 minutes", ["k"], available_now=True, **options
    ).awaitTermination()
    return streaming.read_alarms(spark, f"{root}/out", stream, "ts", "v", ["k"])


def test_alarm_on_a_stream_equals_batch(spark, tmp_path):
    points = [(m, k, float((m * 7 + len(k) * 13) % 100)) for m in range(0, 300, 2) for k in ("a", "bb") if (m // 20) % 4 or k == "a"]
    for i in range(10):
        metric(spark, tmp_path, str(i), [p for p in points if 30 * i <= p[0] < 30 * i + 30])
    got = alarm(spark, tmp_path)
    closed = F.col("period") + F.expr("INTERVAL 5 MINUTES") <= F.lit(START + timedelta(minutes=288))
    df = spark.read.schema(METRIC).json(f"{tmp_path}/in")
    want = ops.m_of_n_alarm(df, "ts", "v", ["k"]).filter(closed)
    assert rows(got.select(*want.columns)) == rows(want) and want.filter("alarm").count() > 5
    # What a batch keeps of the past is n - 1 rows a key at most.
    kept = spark.read.parquet(f"{tmp_path}/out/last").groupBy("batch_id", "k").count()
    assert kept.agg(F.max("count")).first()[0] == 4


def test_late_rows_do_not_change_a_closed_period(spark, tmp_path):
    metric(spark, tmp_path, "0", [(m, "a", 10.0) for m in range(0, 60)])
    metric(spark, tmp_path, "1", [(61, "a", 99.0), (55, "a", 9e9)])
    metric(spark, tmp_path, "2", [(2, "a", 9e9), (3, "a", 9e9), (62, "a", 99.0)])
    metric(spark, tmp_path, "3", [(4, "a", 9e9), (200, "a", 10.0)])
    got = {(r.period - START).seconds // 60: (r.average, r.alarm) for r in alarm(spark, tmp_path).collect()}
    assert [got[m] for m in range(0, 45, 5)] == [(10.0, False)] * 9
    assert got[55][0] > 1e9 and got[60] == (99.0, True) and 200 not in got


# Notices


def test_doubled_notices_in_two_layouts(spark, tmp_path):
    def record(key):
        return {"s3": {"object": {"key": key}, "bucket": {"name": "b", "arn": "arn:b"}}}

    bare = [json.dumps({"Records": [record(f"k{i}"), record("both")]}) for i in range(5)]
    wrapped = [json.dumps({"Message": b}) for b in bare]
    bodies = [*bare, *wrapped, *bare[:2], json.dumps({"Records": []}), "not json", json.dumps({"Message": "x"})]
    wide = [(START + timedelta(minutes=i), b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(wide, "ts timestamp, body string")
    want = [("both",), *[(f"k{i}",) for i in range(5)]]
    assert rows(ops.distinct_notices(df, "ts").select("key")) == want
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streaming.stream_source(spark, f"{tmp_path}/in", df.schema, data_format="parquet")
    found = ops.distinct_notices(stream, "ts", "1 hour").select("ts", "key")
    streaming.stream_to_parquet(found, f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True).awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("key")) == want
