"""Registry filters, sort and projection, statistics on trial-shaped rows."""

from pyspark.sql import functions as F

from cribra.operators import ordering as O
from cribra.operators import predicates as P
from cribra.operators import stats as ST

LOC = "array<struct<city:string,geoPoint:struct<lat:double,lon:double>>>"


def test_geo_filter_any_location_nested_point(spark):
    df = spark.createDataFrame([
        ("NCT00000001", [("Paris", (48.8566, 2.3522)), ("Lyon", (45.764, 4.8357))]),
        ("NCT00000002", [("Boston", (42.3601, -71.0589))]),
        ("NCT00000003", []),
        ("NCT00000004", None),
    ], f"nct_id string, locations {LOC}")
    near_lyon = P.filter_geo(df, "locations", 45.75, 4.85, 50, "km", "geoPoint.lat", "geoPoint.lon")
    assert [r.nct_id for r in near_lyon.collect()] == ["NCT00000001"]
    miles = P.filter_geo(df, "locations", 40.7128, -74.0060, 200, "mi", "geoPoint.lat", "geoPoint.lon")
    assert [r.nct_id for r in miles.collect()] == ["NCT00000002"]


def test_age_filter_units_and_open_bounds(spark):
    df = spark.createDataFrame([("a", "18 Years", "65 Years"), ("b", "6 Months", "17 Years"),
                                ("c", None, None), ("d", "70 Years", None)],
                               "nct_id string, minimum_age string, maximum_age string")
    got = sorted(r.nct_id for r in P.filter_age(df, "minimum_age", "maximum_age", "16 Years", "20 Years").collect())
    assert got == ["a", "b", "c"]
    kids = sorted(r.nct_id for r in P.filter_age(df, "minimum_age", "maximum_age", None, "1 Year").collect())
    assert kids == ["b", "c"]


def test_status_and_id_filters(spark):
    df = spark.createDataFrame([("NCT00000042", ["NCT00000777"], "RECRUITING"),
                                ("NCT00000043", None, "COMPLETED")],
                               "nct_id string, aliases array<string>, status string")
    assert P.filter_status(df, "status", ["RECRUITING"]).count() == 1
    assert [r.nct_id for r in P.filter_ids(df, "nct_id", "aliases", [" nct42 "]).collect()] == ["NCT00000042"]
    assert [r.nct_id for r in P.filter_ids(df, "nct_id", "aliases", ["NCT777"]).collect()] == ["NCT00000042"]
    want = spark.createDataFrame([("nct0043",), ("garbage",)], "id string")
    assert [r.nct_id for r in P.filter_ids(df, "nct_id", "aliases", want).collect()] == ["NCT00000043"]


def test_partial_date_overlap(spark):
    from cribra.functions.dates import partial_date_hi, partial_date_lo
    df = spark.createDataFrame([("a", "2022"), ("b", "2022-05"), ("c", "2021-12-31"), ("d", None)],
                               "nct_id string, start string")
    df = df.select("nct_id", partial_date_lo("start").alias("lo"), partial_date_hi("start").alias("hi"))
    got = sorted(r.nct_id for r in P.filter_partial_date(df, "lo", "hi", "2022-05-15", "2022-06-01").collect())
    assert got == ["a", "b"]


def test_sort_page_defaults_and_projection(spark):
    import datetime as dt
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 10), ("b", None, 5), ("c", dt.date(2025, 1, 1), 7),
                                ("d", dt.date(2025, 1, 1), 3)], "nct_id string, d date, n int")
    page = O.sort_page(df, [("d", None), ("n", None)], "nct_id", 3).orderBy("position").collect()
    assert [(r.nct_id, r.position) for r in page] == [("d", 1), ("c", 2), ("a", 3)]
    nested = df.select(F.struct(F.struct("nct_id", "n").alias("identificationModule"),
                                F.struct("d").alias("statusModule")).alias("protocolSection"))
    flat = O.project_fields(nested, ["protocolSection.identificationModule"], flatten=True)
    assert flat.columns == ["protocolSection_identificationModule_nct_id",
                            "protocolSection_identificationModule_n"]
    kept = O.project_fields(nested, ["protocolSection.statusModule.d"])
    assert kept.columns == ["d"]


def test_enum_stats_on_list_field_and_string_stats(spark):
    df = spark.createDataFrame([("1", ["PHASE1", "PHASE2"]), ("2", ["PHASE2"]), ("3", []),
                                ("4", None), ("5", ["PHASE2", "PHASE2"])], "nct_id string, phases array<string>")
    rows = ST.enum_stats(df, "nct_id", "phases").orderBy("rank").collect()
    assert [(r.value, r.studies, r.rank) for r in rows] == [("PHASE2", 3, 1), ("PHASE1", 1, 2)]
    assert rows[0].unique_values == 2 and rows[0].missing == 2
    s = spark.createDataFrame([("1", "ab"), ("2", "abcd"), ("3", "wxyz"), ("4", None)], "i string, v string")
    r = ST.string_stats(s, "i", "v").first()
    assert (r.longest_value, r.longest_id, r.longest_chars, r.missing) == ("abcd", "2", 4, 1)


def test_numeric_boolean_list_and_size_stats(spark):
    df = spark.createDataFrame([(1, True, ["a"]), (3, False, ["a", "b"]), (None, None, None)],
                               "x int, b boolean, l array<string>")
    n = ST.numeric_stats(df, "x").first()
    assert (n.min_value, n.max_value, n.avg_value, n.missing) == (1.0, 3.0, 2.0, 1)
    b = ST.boolean_stats(df, ["b"]).first()
    assert (b.true_count, b.false_count, b.missing) == (1, 1, 1)
    sizes = ST.array_sizes(df.withColumn("id", F.lit(1)), "id", "l")
    top = ST.list_size_stats(sizes).orderBy("rank").collect()
    assert (top[0].min_size, top[0].max_size, top[0].unique_sizes) == (0, 2, 3)
    docs = spark.createDataFrame([(f"NCT{i:08d}", i * 10) for i in range(1, 101)], "nct_id string, bytes long")
    sz = {r.size_range: r for r in ST.size_stats(docs, "nct_id").collect()}
    r = next(iter(sz.values()))
    assert r.total_docs == 100 and r.largest_id == "NCT00000100" and r.p50 == 505.0
    assert sz["0-1000"].docs == 99 and sz["1000-10000"].docs == 1


def test_projection_prunes_nested_parquet(spark, tmp):
    import re
    df = spark.createDataFrame([("NCT00000001", "x", "RECRUITING", "2026", 3.5)],
                               "nct_id string, org string, status string, start string, n double")
    nested = df.select(F.struct(
        F.struct("nct_id", "org").alias("identificationModule"),
        F.struct("status", "start").alias("statusModule"),
        F.struct("n").alias("designModule")).alias("protocolSection"))
    nested.write.parquet(f"{tmp}/studies")
    stored = spark.read.parquet(f"{tmp}/studies")
    out = O.project_fields(stored, ["protocolSection.identificationModule",
                                    "protocolSection.statusModule.status"], flatten=True)
    plan = out._jdf.queryExecution().explainString(
        out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    schema = re.search(r"ReadSchema: (.*)", plan).group(1)
    assert "designModule" not in schema and "start" not in schema
    assert "nct_id" in schema and "org" in schema and "status" in schema
    assert out.first()[0] == "NCT00000001"
