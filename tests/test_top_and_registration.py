"""Frequent values of a stream; registration of many folders."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import sinks, streaming
from tidemark.functions import TIME_KEYS
from tidemark.sinks import tables

WORDS = T.StructType([T.StructField("w", T.StringType())])


@pytest.mark.parametrize("tracked", [1, 3, 8, 1000])
def test_merged_counts_keep_their_bound(spark, tracked):
    draw = random.Random(tracked)
    parts = [Counter(draw.choices("abcdefghijkl", weights=[60, 40, 25, 9, 8, 7, 6, 5, 4, 3, 2, 1], k=300)) for _ in range(4)]
    true = sum(parts, Counter())
    summary = spark.createDataFrame([], "item string, seen long, lost long")
    for part in parts:
        fresh = spark.createDataFrame([(k, n, 0) for k, n in part.items()], summary.schema)
        both = summary.withColumn("part", F.lit(0)).union(fresh.withColumn("part", F.lit(1)))
        summary = spark.createDataFrame(streaming.merged_counts(both, tracked).collect(), summary.schema)
    rows = summary.collect()
    (lost,) = {r.lost for r in rows}
    seen = {r.item: r.seen for r in rows}
    assert len(seen) == min(tracked, len(true)) and (lost == 0) == (tracked == 1000)
    assert all(seen.get(k, 0) <= n <= seen.get(k, 0) + lost for k, n in true.items())


def test_nothing_to_merge(spark):
    empty = spark.createDataFrame([], "item string, seen long, lost long, part int")
    assert [tuple(r) for r in streaming.merged_counts(empty).collect()] == [(None, None, 0)]


@pytest.mark.parametrize("tracked, exact", [(40, True), (4, False)])
def test_top_of_a_stream(spark, tmp_path, tracked, exact):
    draw, words = random.Random(1), []
    (tmp_path / "in").mkdir()
    for i in range(5):
        part = [*["hot"] * 300, *[f"w{int(draw.expovariate(0.05))}" for _ in range(400)]]
        words += part
        (tmp_path / f"in/{i}.txt").write_text("\n".join(part) + "\n")
    landed = spark.read.schema("w string").text(f"{tmp_path}/in")

    def run():
        stream = streaming.stream_source(spark, f"{tmp_path}/in", WORDS, data_format="text", max_files=1)
        streaming.stream_top(stream, "w", f"{tmp_path}/out", f"{tmp_path}/ck", tracked, available_now=True).awaitTermination()
        return streaming.read_summary(spark, f"{tmp_path}/out", T.StringType())

    summary = run()
    assert summary.count() == tracked  # however many values there are
    want = sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))[:6]
    got = streaming.exact_top(summary, landed, "w", 6)
    assert [tuple(r) for r in got.collect()] == want
    assert ("LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()) == exact
    # What a rerun of the last batch leaves is the same.
    last = max(int(f.name) for f in (tmp_path / "ck/commits").iterdir() if f.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "ck/commits" / name).unlink(missing_ok=True)
    before = sorted(summary.collect())
    assert sorted(run().collect()) == before


def test_many_folders_are_fed_in_parts(spark, tmp_path, monkeypatch):
    start = datetime(2024, 1, 1)

    def add(hours):
        for h in hours:
            path = tmp_path / (start + timedelta(hours=h)).strftime("year=%Y/month=%m/day=%d/hour=%H")
            path.mkdir(parents=True)
            (path / "a.json").write_text(f'{{"a":{h}}}\n')

    monkeypatch.setattr(tables, "PARTITIONS_HELD", 100)
    monkeypatch.setattr(tables, "PARTITIONS_PER_CALL", 30)
    calls = []
    sql = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: (calls.append(text), sql(self, text, *a, **k))[1])
    add(range(700))
    schema = T.StructType([T.StructField("a", T.IntegerType()), *[T.StructField(k, T.StringType()) for k in TIME_KEYS]])

    def register(**options):
        calls.clear()
        return sinks.register_external_table(spark, "tidemark_many", schema, list(TIME_KEYS), str(tmp_path), **options)

    assert register().count() == 700
    added = [c for c in calls if c.startswith("ALTER")]
    assert len(added) >= 24 and max(c.count("PARTITION (") for c in added) == 30
    add(range(700, 710))
    # Later calls list later folders only, and do not ask the catalog for what it has.
    (tmp_path / "year=2023/month=01/day=01/hour=00").mkdir(parents=True)
    (tmp_path / "year=2023/month=01/day=01/hour=00/a.json").write_text('{"a":-1}\n')
    assert register(since=start + timedelta(hours=699)).count() == 710
    assert not any(c.startswith("SHOW PARTITIONS") for c in calls)
    assert sum(c.count("PARTITION (") for c in calls if c.startswith("ALTER")) == 11
    assert register(since=datetime(2050, 1, 1)).count() == 710
    spark.sql("DROP TABLE tidemark_many")
