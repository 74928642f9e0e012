"""The cell index against the plain distance filter: poles, the date line, odd points."""

import random

from pyspark.sql import functions as F

from cribra.operators import predicates as P

POINTS = "array<struct<lat:double,lon:double>>"


def test_cells_equal_the_distance_filter(spark, tmp):
    rng = random.Random(3)
    studies = [(f"s{i}", [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(rng.randint(1, 3))])
               for i in range(300)]
    edge = [(90.0, 0.0), (-90.0, 50.0), (0.0, 180.0), (0.0, -180.0), (10.0, 179.999), (89.9, -170.0), (95.0, 0.0),
            (0.0, 540.0), (None, 1.0), (-89.99, 179.9), (0.0, -1e-14)]
    studies += [(f"e{i}", [p]) for i, p in enumerate(edge)] + [("none", []), ("null", None), ("s1", [(0.0, 0.0)])]
    df = spark.createDataFrame(studies, f"k string, locations {POINTS}")
    path = f"{tmp}/cells"
    P.write_location_cells(P.location_cells(df, "k", "locations"), path)
    cells = spark.read.parquet(path)
    for lat, lon, km in [(0, 0, 500), (89.5, 10, 200), (-90, 0, 1500), (5, 179.9, 300), (5, -179.9, 2500), (60, 20, 3000),
                         (0, 0, 21_000), (0, 90, 10_500), (45, 0, 0.001), (80, 0, 1_200)]:
        want = {r.k for r in P.filter_geo(df, "locations", lat, lon, km, "km").collect()}
        got = [r.k for r in P.near_by_cells(cells, "k", lat, lon, km, "km").collect()]
        assert set(got) == want and len(got) == len(want), (lat, lon, km)


def test_cells_are_a_filter_of_the_scan(spark, tmp, capsys):
    df = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"), F.array(F.struct(
        (F.col("id") % 170 - 85.0).alias("lat"), (F.col("id") % 350 - 175.0).alias("lon"))).alias("locations"))
    path = f"{tmp}/cells"
    P.write_location_cells(P.location_cells(df, "k", "locations"), path)
    P.near_by_cells(spark.read.parquet(path), "k", 10.0, 20.0, 300.0, "mi").explain()
    plan = capsys.readouterr().out
    assert "EqualTo(cell,-1),And(GreaterThanOr" in plan.split("PushedFilters")[1]
