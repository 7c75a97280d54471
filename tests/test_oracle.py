"""Every registered query against plain SQL over the same whole tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from tests.compare import connect, difference
from tidemark.registry import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


# Plan nodes that would not hold at scale: pairs of rows, and rows sent to Python.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in UNWANTED if node in plan]
    assert difference(df, con, ORACLE[name]) is None


@pytest.mark.parametrize(
    "name, columns",
    [
        ("top_sku", "struct<l_partkey:bigint>"),
        ("batch_record_count", "struct<ts:timestamp_ntz>"),
        ("per_minute_sums", "struct<ts:timestamp_ntz,event_type:string,props:string>"),
        ("m_of_n_alarm", "struct<ts:timestamp_ntz,event_type:string,value:double>"),
        ("revenue_by_state", "struct<o_custkey:bigint,o_totalprice:double>"),
        ("partition_gaps", "struct<ts:timestamp_ntz,event_type:string>"),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert f"ReadSchema: {columns}" in plan


@pytest.mark.parametrize(
    "name", ["detections_report", "best_scores_in_record", "flatten_paths", "scan_change_images", "unnest_notifications"]
)
def test_no_shuffle(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SinglePartition" not in plan
