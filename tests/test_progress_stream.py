"""Progress as streaming state equals the views over the whole attempt log."""

import os

import pytest
from pyspark.sql import functions as F

from cribra.sources import keyed as K
from cribra.sources import tables as TB
from cribra.sources.tables import Warehouse
from cribra.streaming import progress_stream as PS


def log(spark, wh, batch, minute, rows, signature="s1"):
    """rows: (trial, error); one attempt each."""
    df = spark.createDataFrame([(k, e, i) for i, (k, e) in enumerate(rows)], "nct_id string, error string, seq long")
    TB.write_attempts(df.select(
        "nct_id", F.lit(signature).alias("signature"), F.lit(batch).alias("batch"), "seq",
        F.when(F.col("error").isNull(), F.array()).cast(
            "array<struct<criterion_id:string,text:string,kind:string,is_exclusion:boolean>>").alias("criteria"),
        "error", F.to_timestamp(F.lit(f"2026-08-15 10:{minute:02d}:00")).alias("at")), wh, batch)


def want(spark, wh, signature="s1"):
    attempts = TB.read_attempts(spark, wh).where(F.col("signature") == signature)
    done = {r.nct_id for r in TB.done_view(attempts).collect()}
    failed = {r.nct_id: (r.attempts, r.error, r.last_failed_at) for r in TB.failures_view(attempts).collect()}
    return {k: (k in done, *failed.get(k, (0, None, None))) for k in {r.nct_id for r in attempts.select("nct_id").collect()}}


def got(spark, wh, signature="s1"):
    return {r.nct_id: (r.done, r.attempts, r.error, r.last_failed_at)
            for r in PS.read_progress(spark, wh, signature).collect()}


def test_progress_follows_the_log_across_restarts(spark, tmp, monkeypatch):
    wh = Warehouse(os.path.join(tmp, "wh"), buckets=4)
    TB.ensure_tables(spark, wh)
    log(spark, wh, "b0", 1, [("a", "boom"), ("b", None), ("c", "HTTP 429"), ("d", "x" * 900)])
    log(spark, wh, "b1", 2, [("a", "again"), ("c", "schema")], signature="s2")
    PS.attempts_to_progress(spark, wh).awaitTermination(180)
    assert got(spark, wh) == want(spark, wh) and got(spark, wh, "s2") == want(spark, wh, "s2")
    assert got(spark, wh)["c"][:2] == (False, 0) and len(got(spark, wh)["d"][2]) == 400
    log(spark, wh, "b2", 3, [("a", "second"), ("b", "later"), ("d", None), ("e", None)])
    log(spark, wh, "b3", 4, [("a", None), ("e", "after success")])

    real = K.merge

    def broken(*args, **more):
        real(*args, **more)
        raise RuntimeError("lost in the middle of an epoch")

    monkeypatch.setattr(K, "merge", broken)
    with pytest.raises(Exception, match="middle of an epoch"):
        PS.attempts_to_progress(spark, wh).awaitTermination(180)
    monkeypatch.setattr(K, "merge", real)
    PS.attempts_to_progress(spark, wh).awaitTermination(180)
    assert got(spark, wh) == want(spark, wh)
    log(spark, wh, "b3", 4, [("a", "third"), ("e", "after success")])      # an epoch written again
    log(spark, wh, "b4", 5, [("e", "twice")])
    PS.attempts_to_progress(spark, wh).awaitTermination(180)
    assert got(spark, wh)["e"][:3] == (True, 2, "twice")
    assert got(spark, wh, "s2") == want(spark, wh, "s2")
