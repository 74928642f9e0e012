"""Silver writes, failure counters, progress (fixtures A9-A12, A17)."""

from pyspark.sql import functions as F

from cribra.functions.json_fns import config_signature
from cribra.operators import silver as SV
from cribra.operators.pending import pending_trials
from cribra.schemas import OUTCOME_SCHEMA

SIG = "abcdef0123456789"


def outcomes(spark, rows):
    return spark.createDataFrame(rows, OUTCOME_SCHEMA)


def crit(n):
    return [(f"c-{i}", f"criterion {i}", "condition", i % 2 == 1) for i in range(n)]


def test_outcome_rows_keep_order_and_skip_failures(spark):
    o = outcomes(spark, [("NCT00000001", crit(3), None), ("NCT00000002", None, "HTTP 429")])
    rows = SV.outcomes_to_rows(o, SIG).orderBy("ordinal").collect()
    assert [(r.nct_id, r.ordinal, r.is_exclusion, r.signature) for r in rows] == [
        ("NCT00000001", 0, False, SIG), ("NCT00000001", 1, True, SIG), ("NCT00000001", 2, False, SIG)]


def test_replace_by_key_replaces_trial_and_keeps_other_signatures(spark):
    schema = "nct_id string, signature string, ordinal int, text string"
    target = spark.createDataFrame([("A", SIG, 0, "old0"), ("A", SIG, 1, "old1"),
                                    ("A", "other", 0, "keep"), ("B", SIG, 0, "b")], schema)
    source = spark.createDataFrame([("A", SIG, 0, "new0")], schema)
    got = sorted(tuple(r) for r in SV.replace_by_key(target, source, ["nct_id", "signature"]).collect())
    assert got == [("A", SIG, 0, "new0"), ("A", "other", 0, "keep"), ("B", SIG, 0, "b")]


def test_failures_count_genuine_errors_only(spark):
    # A12: ok 1, 429 on 2, schema error on 3 -> only 3 is recorded
    batch = outcomes(spark, [("NCT00000001", crit(1), None), ("NCT00000002", None, "HTTP 429"),
                             ("NCT00000003", None, "reply:criteria")])
    empty = spark.createDataFrame([], "nct_id string, signature string, error string, attempts int")
    f1 = SV.accumulate_failures(empty, batch, SIG)
    assert [(r.nct_id, r.attempts) for r in f1.collect()] == [("NCT00000003", 1)]
    # a throttled error inside a longer message is still throttling
    again = outcomes(spark, [("NCT00000003", None, "x" * 600),
                             ("NCT00000004", None, "Extraction failed after 6 attempts: HTTP 429")])
    f2 = {r.nct_id: r for r in SV.accumulate_failures(f1, again, SIG).collect()}
    assert set(f2) == {"NCT00000003"} and f2["NCT00000003"].attempts == 2
    assert len(f2["NCT00000003"].error) == 400


def test_clear_failures_on_success(spark):
    f = spark.createDataFrame([("NCT00000001", SIG, "e", 2), ("NCT00000001", "other", "e", 1)],
                              "nct_id string, signature string, error string, attempts int")
    ok = outcomes(spark, [("NCT00000001", [], None)])
    got = [(r.nct_id, r.signature) for r in SV.clear_failures(f, ok, SIG).collect()]
    assert got == [("NCT00000001", "other")]


def test_pending_anti_joins(spark):
    bronze = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "z"), ("D", "   "), ("E", None)],
                                   "nct_id string, eligibility string")
    done = spark.createDataFrame([("A", SIG), ("B", "old")], "nct_id string, signature string")
    fails = spark.createDataFrame([("C", SIG, "e", 3)],
                                  "nct_id string, signature string, error string, attempts int")
    # whitespace-only prose is pending (it gets an ok, empty result without a call)
    assert sorted(r.nct_id for r in pending_trials(bronze, done, fails, SIG).collect()) == ["B", "D"]
    retry = pending_trials(bronze, done, fails, SIG, retry_failed=True)
    assert sorted(r.nct_id for r in retry.collect()) == ["B", "C", "D"]


def test_run_counters_and_stats(spark):
    o = outcomes(spark, [("1", crit(2), None), ("2", None, "HTTP 429"), ("3", None, "bad")])
    c = SV.run_counters(o).first()
    assert (c.succeeded, c.failed, c.rate_limited, c.attempted) == (1, 2, 1, 3)
    silver = SV.outcomes_to_rows(o, SIG)
    fails = spark.createDataFrame([("3", SIG, "bad", 1)],
                                  "nct_id string, signature string, error string, attempts int")
    bronze = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", None)],
                                   "nct_id string, eligibility string")
    st = SV.silver_stats(silver, fails, bronze, SIG).first()
    assert (st.trials, st.criteria, st.failed, st.total) == (1, 2, 1, 3)
    empty = SV.silver_stats(silver.limit(0), fails.limit(0), bronze.limit(0), SIG).first()
    assert (empty.trials, empty.criteria, empty.failed, empty.total) == (0, 0, 0, 0)


def test_progress_percent_total_zero_is_one(spark):
    df = spark.createDataFrame([(3000, 11200), (0, 0)], "d long, t long")
    got = [r.p for r in df.select(SV.progress_percent(F.col("d"), F.col("t")).alias("p")).collect()]
    assert got == [26.8, 0.0]


def test_signature_changes_with_any_input():
    base = {"extractor": "x", "rules": [1]}
    assert config_signature(base) == config_signature(dict(reversed(list(base.items()))))
    assert config_signature(base) != config_signature({**base, "rules": [2]})
    assert len(config_signature(base)) == 16


def test_failures_without_prior_counters(spark):
    batch = outcomes(spark, [("NCT00000003", None, "bad"), ("NCT00000004", None, "HTTP 429")])
    got = [(r.nct_id, r.attempts, r.error) for r in SV.accumulate_failures(None, batch, SIG).collect()]
    assert got == [("NCT00000003", 1, "bad")]


def test_latest_ok_attempt_wins_even_if_empty(spark):
    # Q7: a later ok and empty extraction leaves the trial with no Silver rows
    import datetime as dt

    from cribra.schemas import ATTEMPTS_SCHEMA
    from cribra.sources.tables import failures_view, silver_view
    t0, t1, t2 = (dt.datetime(2026, 8, d) for d in (1, 2, 3))
    log = spark.createDataFrame([
        ("NCT00000001", SIG, "b-0", 0, crit(2), None, t0, "r"),
        ("NCT00000001", SIG, "b-1", 0, [], None, t1, "r"),
        ("NCT00000002", SIG, "b-0", 1, crit(1), None, t0, "r"),
        ("NCT00000002", SIG, "b-1", 1, None, "bad", t1, "r"),
        ("NCT00000002", SIG, "b-2", 1, None, "HTTP 429", t2, "r"),
    ], ATTEMPTS_SCHEMA)
    rows = silver_view(log).collect()
    assert [(r.nct_id, r.ordinal) for r in rows] == [("NCT00000002", 0)]
    f = {r.nct_id: r.attempts for r in failures_view(log).collect()}
    assert f == {"NCT00000002": 1}      # the failure after the success counts; 429 does not
