"""Statistics from signed counts equal a recount after any sequence of merges."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from cribra.operators import stats as S
from cribra.operators import tallies as TL
from cribra.sources import keyed as K

SCHEMA = T.StructType([
    T.StructField("k", T.StringType()), T.StructField("day", T.DateType()), T.StructField("status", T.StringType()),
    T.StructField("num", T.LongType()), T.StructField("flag", T.BooleanType()),
    T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("raw", T.StringType())])
FIELDS = (TL.Field("day", "day"), TL.Field("status", "status"), TL.Field("num", "num"), TL.Field("flag", "flag"),
          TL.Field("terms", "terms", "list"), TL.Field("n_terms", "terms", "size"), TL.Field("bytes", "raw", "bytes"))
row = st.tuples(
    st.sampled_from("pqrstu"), st.one_of(st.none(), st.dates(dt.date(2024, 1, 1), dt.date(2024, 1, 4))),
    st.sampled_from(["A", "B", None]), st.one_of(st.none(), st.integers(-2, 3)), st.sampled_from([True, False, None]),
    st.one_of(st.none(), st.lists(st.sampled_from(["t", "u", None]), max_size=3)), st.sampled_from(["", "é", "long", None]))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches=st.lists(st.lists(row, min_size=1, max_size=6), min_size=2, max_size=3), skip=st.booleans())
def test_tallies_equal_a_recount(spark, tmp_path_factory, batches, skip):
    t = K.KeyedTable(str(tmp_path_factory.mktemp("tallies")), SCHEMA, "k", 3)
    for i, rows in enumerate(batches):
        K.merge(spark, t, spark.createDataFrame(rows, SCHEMA))
        if not (skip and i == 0):                  # a refresh may cover several versions
            got = K.refresh_tallies(spark, t, FIELDS)
    now = K.read(spark, t)
    assert _rows(got) == _rows(TL.tally(now, FIELDS))
    assert got.select(TL.row_count(got)).first()[0] == now.count()
    assert _rows(TL.enum_stats(got, "status")) == _rows(S.enum_stats(now, "k", "status"))
    assert _rows(TL.enum_stats(got, "terms")) == _rows(S.enum_stats(now, "k", "terms"))
    text = now.withColumn("day", now["day"].cast("string"))
    assert _rows(TL.date_stats(got, "day")) == _rows(S.date_stats(text, "day"))
    assert _rows(TL.numeric_stats(got, "num")) == _rows(S.numeric_stats(now, "num"))
    assert _rows(TL.boolean_stats(got, ["flag"])) == _rows(S.boolean_stats(now, ["flag"]))


def test_deletes_undo_exactly_and_sizes(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "xx"), ("c", None), ("d", "xx")], "k string, raw string")
    fields = (TL.Field("bytes", "raw", "bytes"),)
    full = TL.tally(rows, fields)
    gone = rows.where("k in ('b', 'c')").selectExpr("k", "raw", "'delete' AS change_type")
    left = TL.add(full, TL.signed(gone, fields))
    assert _rows(left) == _rows(TL.tally(rows.where("k in ('a', 'd')"), fields))
    assert TL.size_stats(full, "bytes").first().asDict() == {
        "docs": 3, "total_bytes": 5, "avg_bytes": 5 / 3, "min_bytes": 1, "max_bytes": 2,
        "p50": 2.0, "p90": 2.0, "p99": 2.0}
    assert TL.add(full, TL.signed(rows.selectExpr("*", "'delete' AS change_type"), fields)).count() == 0
