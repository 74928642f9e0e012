"""Plan properties the design relies on, checked on the static plans."""

import re

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("key,pushed", [
    ("custom_predicate", "EqualTo(lang,de)"),
    ("updated_since", "GreaterThanOrEqual(ts,2024-01-20T00:00)"),
    ("bronze_point_read", "EqualTo(nct_id,NCT00000042)"),
    ("filter_status", "In(o_orderstatus, [O,P])"),
])
def test_filters_reach_the_parquet_scan(spark, key, pushed):
    assert pushed in _plan(queries()[key](spark, SF))


@pytest.mark.parametrize("key,schema", [
    ("filter_status", "struct<o_orderkey:bigint,o_orderstatus:string>"),
    ("bronze_count", "struct<event_id:bigint,user_id:bigint>"),
    ("stats_numeric", "struct<o_totalprice:double>"),
])
def test_scans_read_only_needed_columns(spark, key, schema):
    assert f"ReadSchema: {schema}" in _plan(queries()[key](spark, SF))


def test_no_query_pairs_all_rows(spark):
    for key, fn in queries().items():
        plan = _plan(fn(spark, SF))
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), key
