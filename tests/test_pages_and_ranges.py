"""Pages by token equal the global order; the overlap join equals brute force."""

import datetime as dt
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cribra.operators import intervals as I
from cribra.operators import ordering as O
from cribra.plans.catalog import QUERIES

rows = st.lists(st.tuples(st.one_of(st.none(), st.dates(dt.date(2024, 1, 1), dt.date(2024, 1, 3))),
                          st.one_of(st.none(), st.sampled_from([0.1, 1 / 3, -2.5, 1e300]))), max_size=14)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows, sort=st.sampled_from([[("d", None), ("n", None)], [("n", "desc")], [("n", None), ("d", "asc")], []]))
def test_all_pages_together_equal_the_global_sort(spark, rows, sort):
    df = spark.createDataFrame([(f"id{i:02d}", d, n) for i, (d, n) in enumerate(rows)], "k string, d date, n double")
    got, token = [], None
    for _ in range(10):
        page = O.page_after(df, sort, "k", 4, token).collect()
        got += [r.k for r in page]
        if len(page) < 4:
            break
        token = page[-1].token
    want = [r.k for r in df.orderBy(*[O.sort_key(df, c, d) for c, d in sort], "k").collect()]
    assert got == want


def test_page_walk_and_foreign_tokens(spark):
    df = spark.createDataFrame([(f"id{i:02d}", i % 3) for i in range(11)], "k string, n int")
    walked = O.pages(df, [("n", "desc")], "k", 4, upto=9).orderBy("page", "n", "k").collect()
    assert [r.page for r in walked] == [1] * 4 + [2] * 4 + [3] * 3
    token = O.page_after(df, [("n", "desc")], "k", 4).collect()[-1].token
    with pytest.raises(ValueError, match="order"):
        O.page_after(df, [("n", "asc")], "k", 4, token)
    plan = O.page_after(df, [("n", "desc")], "k", 4, token)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("width,bin_rows", [(1, 5), (7, 3), (1000, 100_000)])
def test_overlap_join_equals_brute_force(spark, width, bin_rows, capsys):
    rng = random.Random(width)

    def some(n):
        out = []
        for i in range(n):
            lo = rng.choice([None, rng.randint(-50, 50)])
            hi = rng.choice([None, (lo or 0) + rng.randint(-3, 30)])
            out.append((i, lo, hi))
        return out + [(n + j, 5, 5) for j in range(20)]         # a hot bin

    a, b = some(40), some(25)
    left = spark.createDataFrame([(*r, 1) for r in a], "i long, lo long, hi long, _x int")
    right = spark.createDataFrame(b, "r long, from long, to long")
    joined = I.overlap_join(left, right, width, bin_rows=bin_rows)

    def meet(x, y):
        first = lambda v: float("-inf") if v is None else v
        last = lambda v: float("inf") if v is None else v
        return (first(x[1]) <= last(x[2]) and first(y[1]) <= last(y[2])
                and first(x[1]) <= last(y[2]) and first(y[1]) <= last(x[2]))

    assert sorted((r.i, r.r) for r in joined.collect()) == sorted((x[0], y[0]) for x in a for y in b if meet(x, y))
    joined.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert I.overlap_join(left.limit(0), right, width).count() == 0


def test_overlap_counts_equal_the_pairs(spark):
    rng = random.Random(5)

    def some(n):
        bounds = [None, -(10 ** 9), *range(-20, 20), 10 ** 9]
        return [(rng.choice([None, i % 30]), rng.choice(bounds), rng.choice(bounds)) for i in range(n)]

    left = spark.createDataFrame(some(300), "i long, lo long, hi long")
    right = spark.createDataFrame(some(200) + [(1, 5, 5)] * 3, "r long, from long, to long")
    got = I.overlap_join(left, right, 10, count="n").collect()
    pairs = I.overlap_join(left, right, 10 ** 8).collect()
    asked = [tuple(r) for r in right.collect()]
    of = Counter((r["r"], r["from"], r["to"]) for r in pairs)
    times = Counter(asked)
    assert (Counter(tuple(r) for r in got)
            == Counter((*r, of[r] // times[r]) for r in asked if of[r]))
    assert I.overlap_join(left.limit(0), right, 10, count="n").count() == 0


@pytest.mark.parametrize("name", ["age_range_matches", "date_range_matches"])
def test_range_counts_grow_with_the_rows_not_the_pairs(spark, tmp_path, name):
    """20,000 rows on each side: hundreds of millions of pairs, of which a join makes each."""
    n = 20_000
    d = str(tmp_path)
    spark.range(n).selectExpr("id AS s_suppkey").write.parquet(f"{d}/supplier.parquet")
    spark.range(n).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "concat('Brand#', id % 5) AS p_brand"
                              ).write.parquet(f"{d}/part.parquet")
    spark.range(n).selectExpr("id AS o_orderkey", "date_add(DATE'1995-01-01', CAST(id % 900 AS INT)) AS o_orderdate",
                              "'4-NOT SPECIFIED' AS o_orderpriority", "'O' AS o_orderstatus",
                              "id AS o_custkey", "CAST(id AS DOUBLE) AS o_totalprice").write.parquet(f"{d}/orders.parquet")
    found = QUERIES[name](spark, d)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_salt" not in plan
    assert found.agg({"studies": "sum"}).first()[0] > 50 * n
