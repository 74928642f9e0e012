"""Every registered query against its DuckDB twin on the smallest driver tables,
plus the driver contract (entry, keys, column names)."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)     # exact: both engines give the same doubles
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def test_contract_shape():
    q, o = queries(), oracle_sql()
    assert len(q) >= 58 and set(o) <= set(q)


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["kind", "criteria", "share"]
    assert df.count() >= 1


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_query_matches_duckdb(spark, duck, key):
    sdf = queries()[key](spark, SF)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = duck.execute(oracle_sql()[key])
    dnames = [d[0] for d in rel.description]
    assert sorted(dnames) == cols
    idx = [dnames.index(c) for c in cols]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert srows == drows


def test_extractor_twin_on_texts_with_headings(spark):
    """The driver's prose has no headings, so check the SQL twin's heading and
    qualifier handling against Spark on trial-like texts."""
    from cribra.operators import rules as R
    from cribra.plans import oracles as O
    texts = ["Key Inclusion Criteria:\n- Adults 18 years\n- ECOG 0-1\nKey Exclusion Criteria:\n- HIV\n* Pregnant",
             "INCLUSION: thyroid nodule. EXCLUSION: recent stroke.",
             "intro line\nMain inclusion:\n1. prior chemotherapy\nAdditional Exclusion Criteria:\n2) hepatitis B\nKey",
             "no headings here\n\n  \nsecond line key\nkey\n", "   "]
    df = spark.createDataFrame([(f"NCT{i:08d}", t) for i, t in enumerate(texts)],
                               "nct_id string, eligibility string")
    s_rows = sorted(tuple(r) for r in R.rule_criteria(df).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE bronze_docs AS SELECT * FROM (VALUES " + ",".join(
        f"('NCT{i:08d}', {O._q(t)})" for i, t in enumerate(texts)) + ") AS t(nct_id, eligibility)")
    d_rows = sorted(tuple(r) for r in con.execute(
        f"WITH {O.RULE_CRITERIA} SELECT nct_id, ordinal, criterion_id, text, kind, is_exclusion "
        "FROM rule_criteria").fetchall())
    assert s_rows == d_rows and len(s_rows) == 13
