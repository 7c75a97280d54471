from __future__ import annotations

import base64
import json

import pytest

from tidemark import operators as ops
from tidemark import plans, sources
from tidemark.operators.detections import OBJECT_NAMES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def notice(*records):
    return json.dumps({"Message": json.dumps({"Records": list(records)})})


def record(**parts):
    bucket = {k: v for k, v in (("name", parts.get("name", "b")), ("arn", parts.get("arn", "arn:b"))) if v != "-"}
    return {"s3": {"object": {"key": parts.get("key", "k")}, "bucket": bucket}}


def test_notices(spark):
    bodies = [
        (1, json.dumps({"Subject": "no message"})),
        (2, notice()),
        (3, notice(record(key="one"), record(key="two"))),
        (4, notice(record(arn="-"))),
        (5, notice(record(key=""))),
        (6, notice(record(key=None))),
    ]
    df = spark.createDataFrame(bodies, "id int, body string")
    kept, rejected = ops.require_fields(ops.unnest_notifications(df), ["key", "bucket", "arn"])
    assert rows(kept) == [(3, "one", "b", "arn:b"), (3, "two", "b", "arn:b"), (5, "", "b", "arn:b")]
    assert [r[0] for r in rows(rejected)] == [1, 2, 4, 6]
    first, _ = ops.require_fields(ops.unnest_notifications(df, first_only=True), ["key", "bucket", "arn"])
    assert [r[1] for r in rows(first)] == ["one", ""]


def test_change_images(spark):
    body = json.dumps(
        {
            "Records": [
                {"dynamodb": {"NewImage": {"id": {"N": "1"}}}},
                {"dynamodb": {"OldImage": {"id": {"N": "2"}}}},
                {"dynamodb": {"NewImage": {"id": {"N": "3"}}, "OldImage": {"id": {"N": "4"}}}},
                {"dynamodb": {}},
            ]
        }
    )
    bad = ["not json", '{"Records":null}', body + " tail", None]
    df = spark.createDataFrame([(body,), ('{"Records":[]}',), *[(b,) for b in bad]], "body string")
    images, unreadable = sources.scan_change_images(df)
    assert images.count() == 4 and {r.body for r in unreadable.collect()} == set(bad)
    split = ops.split_images(images).selectExpr("kind", "image['id']['N'] AS id")
    assert rows(split) == [("new", "1"), ("new", "3"), ("old", "2"), ("old", "4")]


def test_typed_attributes(spark):
    df = spark.createDataFrame(
        [('{  "lat" : { "N" : "3494" },  "lng" : { "N" : "2376" } }',), (None,), ('{"lat":{"N":"x"}}',)], "map string"
    )
    out = sources.decode_typed_attributes(df, "map", ["lat", "lng"]).select("lat", "lng")
    assert [tuple(r) for r in out.collect()] == [(3494.0, 2376.0), (None, None), (None, None)]


def test_csv_quotes_empty_values_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,Street,Town\n1,"Main, Street","say ""hi"""\n2,,"two\nlines"\n')
    df = sources.scan_csv_header(spark, str(tmp_path), multi_line=True)
    assert df.columns == ["ID", "Street", "Town"]
    assert {f.dataType.simpleString() for f in df.schema} == {"string"}
    assert rows(df) == [("1", "Main, Street", 'say "hi"'), ("2", None, "two\nlines")]
    events = ops.row_to_event(df)
    assert rows(events.select("headers", "data")) == [
        ("ID,Street,Town", '1,Main, Street,say "hi"'),
        ("ID,Street,Town", "2,,two\nlines"),
    ]
    assert sorted(len(r.fields) for r in events.collect()) == [3, 3]


def test_csv_is_split_unless_values_span_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"a ""b"", c"\n')
    flat = sources.scan_csv_header(spark, str(tmp_path))
    assert rows(flat) == [("1", 'a "b", c')]
    (tmp_path / "b.csv").write_text('id,v\n1,5" pipe\n2,"two\n\nlines"\n3,6"\n')
    both = sources.scan_csv_header(spark, str(tmp_path), multi_line=True)
    assert rows(both) == [("1", '5" pipe'), ("1", 'a "b", c'), ("2", "two\n\nlines"), ("3", '6"')]


def test_ragged_csv_keeps_all_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n3,4,5\n6\n"7,x",8,"9 ""q""",\n')
    found = sources.scan_csv_header(spark, str(tmp_path), ragged="all").collect()
    assert [(r.a, r.b, r["all"]) for r in found] == [
        ("1", "2", None), ("3", "4", ["3", "4", "5"]), ("6", None, ["6"]), ("7,x", "8", ["7,x", "8", '9 "q"', ""])
    ]


@pytest.mark.parametrize("multi_line", [False, True])
def test_files_with_their_own_headers(spark, tmp_path, multi_line):
    (tmp_path / "a b.csv").write_text("a,b\n1,2\n3,4,5\n")
    (tmp_path / "c+d.csv").write_text('x,y,z\n1,"2,3",\n')
    (tmp_path / "other.csv").write_text("q\n1\n")
    only = spark.createDataFrame([("a b.csv",), ("c+d.csv",), ("gone.csv",)], "name string")
    found = sources.scan_headed_files(spark, str(tmp_path), multi_line, only)
    assert rows(found) == [
        ("a b.csv", "a,b", ["1", "2"]), ("a b.csv", "a,b", ["3", "4", "5"]), ("c+d.csv", "x,y,z", ["1", "2,3", ""])
    ]


def test_csv_files_with_other_headers_are_not_mixed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n")
    (tmp_path / "b.csv").write_text("v,id\ny,2\n")
    with pytest.raises(Exception, match="header"):
        sources.scan_csv_header(spark, str(tmp_path)).collect()


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.15,), (0.1500001,)], "score double")
    assert rows(ops.score_threshold(df)) == [(0.1500001,)]


def test_label_lookup_bounds_and_broadcast(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (79.9,), (80.0,), (None,)], "class double")
    named = ops.label_lookup(df)
    assert len(OBJECT_NAMES) == 80
    assert {(r[0], r[1]) for r in named.collect()} == {
        (-1.0, None),
        (0.0, "person"),
        (79.9, "toothbrush"),
        (80.0, None),
        (None, None),
    }
    assert "BroadcastHashJoin" in named._jdf.queryExecution().executedPlan().toString()


def test_label_lookup_from_a_table_has_no_forced_broadcast(spark):
    labels = spark.createDataFrame([(0, "zero")], "id int, label string")
    named = ops.label_lookup(spark.range(2).selectExpr("id AS class"), "class", labels)
    assert rows(named) == [(0, "zero"), (1, None)]
    assert "ResolvedHint" not in named._jdf.queryExecution().analyzed().toString()


def encoded(prediction):
    inner = base64.b64encode(json.dumps({"prediction": prediction}).encode()).decode()
    outer = {"fragmentMetaData": "f", "frameMetaData": "g", "streamName": "s", "sageMakerOutput": inner}
    return base64.b64encode(json.dumps(outer).encode()).decode()


def test_detections(spark):
    data = [
        (1, encoded([[6.0, 0.9, 0, 0], [6.0, 0.95, 0, 0], [14.0, 0.15, 0, 0], [2, 0.2]])),
        (2, encoded([])),
        (3, encoded([[99, 0.5]])),
        (4, base64.b64encode(b"not json").decode()),
    ]
    records = spark.createDataFrame(data, "id int, payload string")
    decoded = ops.decode_payload(records)
    assert decoded.columns == ["id", "fragment", "frame", "stream_name", "prediction"]
    expected = [(1, 2.0, 0.2), (1, 6.0, 0.95), (3, 99.0, 0.5)]
    by_group = ops.best_score_per_class(ops.explode_predictions(decoded.select("id", "prediction")), ["id"])
    in_record = ops.best_scores_in_record(decoded.select("id", "prediction"))
    assert rows(by_group) == expected and rows(in_record) == expected
    report, unreadable = plans.detections_report(records)
    assert [r.id for r in unreadable.collect()] == [4]
    assert rows(report.select("id", "class_name", "score")) == [(1, "car", 0.2), (1, "train", 0.95), (3, None, 0.5)]
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_ingest_uploads(spark, tmp_path):
    for bucket, key in (("b", "in/one file.csv"), ("b", "two+[2].csv"), ("c", "one file.csv")):
        path = tmp_path / bucket / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"id,file\n1,{bucket}-{key}\n")
    (tmp_path / "b/x.csv").write_text("x,y,z\n1,2,3\n4,5\n6,7,8,9\n")
    first = notice(record(key="in/one file.csv"), record(key="two+[2].csv"), record(key="gone.csv"))
    second, tail = notice(record(key="two+[2].csv"), record(key="x.csv")), notice(record(key="x.csv")) + "{}"
    bodies = [(first,), (second,), ("{}",), (tail,), ("not json",)]
    notices = spark.createDataFrame(bodies, "body string")
    events, rejected = plans.ingest_uploads(spark, notices, str(tmp_path))
    assert rows(events.select("headers", "data")) == [
        ("id,file", "1,b-in/one file.csv"), ("id,file", "1,b-two+[2].csv"),
        ("x,y,z", "1,2,3"), ("x,y,z", "4,5"), ("x,y,z", "6,7,8,9"),
    ]
    # What names no object, or one that is not there, keeps its body.
    assert sorted((r.key or "", r.body) for r in rejected.collect()) == sorted(
        [("gone.csv", first), ("", "{}"), ("", tail), ("", "not json")]
    )
    nothing, _ = plans.ingest_uploads(spark, notices.filter("body = '{}'"), str(tmp_path))
    assert nothing.columns == events.columns and nothing.isEmpty()


def test_broken_payloads_do_not_stop_the_report(spark):
    inner = base64.b64encode(b"\xff\xfe").decode()
    outer = base64.b64encode(json.dumps({"sageMakerOutput": inner}).encode()).decode()
    bad = ["a", "%%%", base64.b64encode(b"\xff\xfe").decode(), outer, "", None]
    nan = base64.b64encode(json.dumps({"sageMakerOutput": base64.b64encode(b'{"prediction":[[1,"NaN"],[1,0.5]]}').decode()}).encode())
    data = [(i, p) for i, p in enumerate(bad)] + [(9, encoded([[2.0, 0.5]])), (10, nan.decode())]
    report, unreadable = plans.detections_report(spark.createDataFrame(data, "id int, payload string"))
    assert rows(report.select("id", "score")) == sorted([(9, 0.5), (10, 0.5)], key=repr)
    assert {(r.id, r.payload) for r in unreadable.collect()} == set(enumerate(bad))


def test_nan_is_not_above_the_threshold(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 0.2), (1, None)], "id int, score double")
    assert rows(ops.score_threshold(df)) == [(1, 0.2)]
