"""Ledger of tries, schema drift, numbered scripts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark import operators as ops
from tidemark import sinks, streaming


def ledger(spark, path, schema):
    return {r.v: (r.tries, r.state, r.cause) for r in streaming.read_ledger(spark, path, schema).collect()}


def test_tries_are_counted_once_and_end(spark, tmp_path):
    path = str(tmp_path / "ledger")
    fresh = spark.createDataFrame([("ok",), ("later",), ("never",), ("never",), (None,)], "v string")

    def attempt(number):
        bad = F.col("v").isNull() | (F.col("v") == "never") | ((F.col("v") == "later") & F.lit(number < 2))
        return lambda rows: rows.withColumn("cause", F.when(bad, f"round {number}"))

    def run(number, rows=fresh, repairs=None):
        return streaming.try_records(spark, path, rows, attempt(number), number, repairs)

    assert run(1).count() == 4
    first = ledger(spark, path, fresh.schema)
    assert first == {"ok": (1, "done", None), **dict.fromkeys(["later", "never", None], (1, "waiting", "round 1"))}
    # The same round again, and records that come again, change nothing.
    assert run(1).count() == 4 and ledger(spark, path, fresh.schema) == first
    assert sorted(r.v or "" for r in run(2).collect()) == ["", "later", "never"]
    run(2)
    run(3)
    assert run(4).count() == 0
    dead = {"never": (3, "dead", "round 3"), None: (3, "dead", "round 3")}
    assert ledger(spark, path, fresh.schema) == {"ok": (1, "done", None), "later": (2, "done", None), **dead}
    # A repair gives a dead record one more try; an empty batch has nothing else to do.
    broken = streaming.read_ledger(spark, path, fresh.schema).filter("v = 'never'").select("record_id")
    assert run(5, fresh.limit(0), broken.withColumn("v", F.lit("mended"))).count() == 1
    assert ledger(spark, path, fresh.schema)["mended"] == (4, "done", None)
    # A round that runs again after later ones sees what it saw.
    assert run(2).count() == 3


def test_field_types_and_merged_schema(spark):
    rows = [
        ("a", '{"x":1,"y":"s","z":null}'), ("a", '{"x":2.5,"y":"t","z":null}'), ("b", '{"x":1,"y":2,"n":{"k":[1]},"f":true}'),
        ("b", "not json"), ("b", "[1]"), ("b", None), ("c", "{}"), ("c", '{"x":1e3,"x":7}'),
    ]
    types = ops.field_types(spark.createDataFrame(rows, "p string, j string"), "j", ["p"])
    got = {(r.p, r.field, r.type): r.records for r in types.collect()}
    assert got[("a", "x", "BIGINT")] == 1 and got[("a", "x", "DOUBLE")] == 1 and got[("a", "z", "VOID")] == 2
    assert got[("b", "n", "OBJECT")] == 1 and got[("b", None, None)] == 3
    assert ops.merged_schema(types.filter("p <> 'c'")).simpleString() == "struct<f:boolean,n:string,x:double,y:string,z:string>"
    drift = {r.field: (r.merged, r.partitions, r.holding, r.kinds) for r in ops.schema_drift(types.filter("p <> 'c'"), ["p"]).collect()}
    assert drift == {
        "x": ("DOUBLE", 2, 2, 2), "y": ("STRING", 2, 2, 2), "n": ("OBJECT", 2, 1, 1), "f": ("BOOLEAN", 2, 1, 1), "z": ("VOID", 2, 1, 1)
    }
    with pytest.raises(ValueError):
        ops.merged_schema(types, max_fields=2)


def test_scripts_run_once_and_in_order(spark, tmp_path):
    folder = tmp_path / "ddl/sensors"
    folder.mkdir(parents=True)
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.json").write_text('{"a":1}\n')
    (folder / "10_drop.ddl").write_text("DROP TABLE IF EXISTS tidemark_ddl;\n")
    create = "CREATE TABLE tidemark_ddl (a INT) USING json\nLOCATION '${LOCATION}'"
    (folder / "20_create.ddl").write_text(create)
    values = {"sensors": {"LOCATION": str(data)}}

    def run():
        scripts = sinks.read_scripts(spark, str(tmp_path / "ddl"))
        return sinks.run_scripts(spark, scripts, str(tmp_path / "log"), values)

    assert run() == ["sensors/10_drop.ddl", "sensors/20_create.ddl"] and spark.table("tidemark_ddl").count() == 1
    assert run() == []
    (folder / "30_note.ddl").write_text("COMMENT ON TABLE tidemark_ddl IS 'one'")
    assert run() == ["sensors/30_note.ddl"]
    (folder / "30_note.ddl").write_text("COMMENT ON TABLE tidemark_ddl IS '${NOTE}'")
    with pytest.raises(ValueError, match="NOTE"):
        run()
    values["sensors"]["NOTE"] = "two"
    assert run() == ["sensors/30_note.ddl"]
    values["sensors"]["NOTE"] = "three"
    assert run() == ["sensors/30_note.ddl"]
    # A failing script ends the run; the next run starts with it.
    (folder / "40_bad.ddl").write_text("NO SQL")
    (folder / "50_note.ddl").write_text("COMMENT ON TABLE tidemark_ddl IS 'four'")
    with pytest.raises(Exception):
        run()
    (folder / "40_bad.ddl").write_text("COMMENT ON TABLE tidemark_ddl IS 'mended'")
    assert run() == ["sensors/40_bad.ddl", "sensors/50_note.ddl"]
    log = sinks.script_log(spark, str(tmp_path / "log"))
    changes = spark.createDataFrame([("sensors", "2000-01-01"), ("other", "2000-01-01")], "name string, at string")
    stale = ops.stale_partitions(changes.withColumn("at", F.to_timestamp("at")), log, ["name"], "at", "loaded_at")
    assert [r.name for r in stale.collect()] == ["other"]
    spark.sql("DROP TABLE tidemark_ddl")
