"""The pipeline against a plain version of its stages, and the registered queries."""

from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from cribra.llm import quality
from test_text_operators import brute_components, brute_contamination, brute_fingerprint, brute_lines

SF = "/root/testdata/sf0.01"


def test_names_and_order():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination",
                     "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    by_number = {k.split("_")[0] for k in queries()}
    assert {f"op{n}" for n in range(1, 14)} <= by_number and "pipeline" in queries()
    assert {k.split("_")[0] for k in oracle_sql() if k.startswith("op")} == {
        "op1", "op3", "op4", "op6", "op10", "op11", "op12", "op13"}


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = quality.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    x = [quality.statistics((t or "").encode()) for _, t in rows]
    import numpy as np
    rows = [r for r, s in zip(rows, model.score(np.array(x))) if s >= quality.THRESHOLD]
    rows = [(i, t) for i, _, _, t in brute_lines(rows, 10)]
    comp = brute_components([brute_fingerprint(t) for _, t in rows], 4)
    least = defaultdict(lambda: 1 << 60)
    for (i, _), c in zip(rows, comp):
        least[c] = min(least[c], i)
    rows = [r for r, c in zip(rows, comp) if least[c] == r[0]]
    rows = [r for r in rows if not brute_contamination(r[1], items)[3]]
    want = {i: len(t.split()) for i, t in rows if t.split()}
    got = defaultdict(int)
    bins = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.n_words
        bins[r.bin_id] += r.n_words
    assert dict(got) == want and max(bins.values()) <= 2048
    assert 300 < len(want) < 1000


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_and_odd_tables(spark, stage):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    f = corpus_pipeline.STAGES[stage][1]
    empty = spark.createDataFrame([], schema)
    out = f(spark, empty, SF)
    assert out.count() == 0 and (stage == 4 or out.columns == empty.columns)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 100_000, None, None, 1),
         (3, "some words here", "en", None, 2)], schema).selectExpr("*", "1 as n_words", "2 as bin_id", "3 as score")
    out = f(spark, odd, SF)
    assert out.count() <= 100 and (stage == 4 or out.columns == odd.columns)
