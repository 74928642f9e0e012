"""Drivers end to end on a temporary warehouse, and the streaming forms."""

import json
import os

import pandas as pd
from conftest import line_extractor, study, write_pages
from pyspark.sql import functions as F

from cribra.plans import runs as R
from cribra.sources import tables as TB
from cribra.sources.tables import Warehouse

SIG = "feedfacecafebeef"


def _pages(root, ids, date="2026-08-14", eligibility="INCLUSION: walks unaided.\nEXCLUSION: asthma attack."):
    per_page = 2
    pages = []
    for i in range(0, len(ids), per_page):
        pages.append({"studies": [study(x, date=date, eligibility=eligibility) for x in ids[i:i + per_page]]})
    return write_pages(root, pages)


def test_backfill_full_then_incremental_and_limited(spark, tmp):
    wh = Warehouse(os.path.join(tmp, "wh"))
    ids = [f"NCT{i:08d}" for i in range(1, 6)]                     # A8: five ids
    p1 = _pages(os.path.join(tmp, "p1"), ids + ["NCT00000002"])    # repeated id on a later page
    r1 = R.run_backfill(spark, wh, p1, run_token="T1", batch_size=2)
    assert (r1.landed, r1.batches, r1.rows_before, r1.rows_after, r1.published) == (6, 3, 0, 5, True)
    runs = TB.read_runs(spark, wh).collect()
    assert [(r.mode, r.complete, str(r.watermark)) for r in runs] == [("full", True, "2026-08-14")]

    # the same pages again: idempotent
    r2 = R.run_backfill(spark, wh, p1, run_token="T2", batch_size=2)
    assert (r2.rows_before, r2.rows_after, r2.added) == (5, 5, 0)

    # incremental: starts from the safe watermark, inclusive
    p2 = _pages(os.path.join(tmp, "p2"), ["NCT00000005", "NCT00000006"], date="2026-08-20")
    r3 = R.run_backfill(spark, wh, p2, run_token="T3", incremental=True)
    assert str(r3.since) == "2026-08-14" and r3.added == 1
    # a limited run does not advance the resume point
    p3 = _pages(os.path.join(tmp, "p3"), ["NCT00000007", "NCT00000008"], date="2026-09-01")
    r4 = R.run_backfill(spark, wh, p3, run_token="T4", incremental=True, limit=1)
    assert r4.published is False and r4.landed == 1
    from cribra.operators.bronze import safe_watermark
    assert str(safe_watermark(TB.read_runs(spark, wh)).first().watermark) == "2026-08-20"
    modes = {r.run_id: r.mode for r in TB.read_runs(spark, wh).collect()}
    assert modes["backfill-T3"] == "incremental" and modes["backfill-T1"] == "full"


def test_interrupted_run_leaves_resume_point(spark, tmp):
    wh = Warehouse(os.path.join(tmp, "wh"))
    p1 = _pages(os.path.join(tmp, "p1"), ["NCT00000001"])
    R.run_backfill(spark, wh, p1, run_token="T1")
    bad = write_pages(os.path.join(tmp, "bad"), ['{"studies": [{"protocolSection": 5}]}'])
    try:
        R.run_backfill(spark, wh, bad, run_token="T2", incremental=True)
    except Exception:  # noqa: BLE001 - the run fails, the ledger must say so
        pass
    runs = {r.run_id: r for r in TB.read_runs(spark, wh).collect()}
    assert runs["backfill-T2"].complete is False and runs["backfill-T2"].finished_at is not None
    from cribra.operators.bronze import safe_watermark
    assert str(safe_watermark(TB.read_runs(spark, wh)).first().watermark) == "2026-08-14"


def test_extraction_run_commits_batches_and_stops_on_throttling(spark, tmp):
    wh = Warehouse(os.path.join(tmp, "wh"))
    ids = [f"NCT{i:08d}" for i in range(1, 9)]
    R.run_backfill(spark, wh, _pages(os.path.join(tmp, "p"), ids), run_token="T1")

    def throttled_after_four(batch: pd.DataFrame) -> pd.DataFrame:
        out = line_extractor(batch)
        late = batch["nct_id"] > "NCT00000004"
        out.loc[late.values, "criteria"] = None
        out.loc[late.values, "error"] = "HTTP 429"
        return out

    res = R.run_extraction(spark, wh, throttled_after_four, SIG, run_token="R1", batch_size=2, workers=2)
    # batches 0, 1 succeed; batch 2 fails entirely under throttling -> stop before batch 3
    assert (res.succeeded, res.failed, res.rate_limited) == (4, 2, 2)
    assert res.criteria == 8 and res.pending == 4
    assert res.throttled_out
    silver = TB.silver_view(TB.read_attempts(spark, wh)).where(F.col("signature") == SIG)
    assert silver.select("nct_id").distinct().count() == 4
    assert TB.failures_view(TB.read_attempts(spark, wh)).count() == 0  # throttling is not counted

    # rerun with a healthy extractor: only the pending four are attempted
    res2 = R.run_extraction(spark, wh, line_extractor, SIG, run_token="R2", batch_size=3)
    assert (res2.succeeded, res2.pending) == (4, 0)
    st = R.status_frame(spark, wh, SIG).first()
    assert (st.bronze_rows, st.trials, st.total, st.criteria, st.percent) == (8, 8, 8, 16, 100.0)

    # a new signature makes everything pending again, old rows count as absent
    st2 = R.status_frame(spark, wh, "0000000000000000").first()
    assert (st2.trials, st2.total) == (0, 8)


def test_failures_reach_max_attempts_then_skip(spark, tmp):
    wh = Warehouse(os.path.join(tmp, "wh"))
    R.run_backfill(spark, wh, _pages(os.path.join(tmp, "p"), ["NCT00000001", "NCT00000002"]),
                   run_token="T1")

    def broken(batch: pd.DataFrame) -> pd.DataFrame:
        out = line_extractor(batch)
        bad = (batch["nct_id"] == "NCT00000002").values
        out.loc[bad, "criteria"] = None
        out.loc[bad, "error"] = "reply:criteria"
        return out

    for k in range(3):
        R.run_extraction(spark, wh, broken, SIG, run_token=f"R{k}")
    f = TB.failures_view(TB.read_attempts(spark, wh)).first()
    assert (f.nct_id, f.attempts) == ("NCT00000002", 3)
    res = R.run_extraction(spark, wh, broken, SIG, run_token="R9")
    assert res.succeeded + res.failed == 0                 # exhausted: skipped
    res = R.run_extraction(spark, wh, broken, SIG, run_token="RA", retry_failed=True)
    assert res.failed == 1


def test_landing_stream_equals_batch_merge(spark, tmp):
    from cribra.sources.landing import write_landing
    from cribra.streaming.landing_stream import landing_to_bronze
    wh = Warehouse(os.path.join(tmp, "wh"))
    landing = os.path.join(tmp, "landing")
    b1 = spark.createDataFrame([("NCT00000001", "2026-08-01", "a"), ("NCT00000002", "2026-08-01", "b")],
                               "nct_id string, last_update_posted string, raw string")
    b2 = spark.createDataFrame([("NCT00000002", "2026-08-10", "b2"), ("NCT00000003", "bad-date", "c")],
                               "nct_id string, last_update_posted string, raw string")
    write_landing(b1, landing, "inc-0000")
    write_landing(b2, landing, "inc-0001")
    q = landing_to_bronze(spark, wh, landing)
    q.awaitTermination(120)
    got = {r.nct_id: (r.raw, r.last_update_posted) for r in TB.read_bronze(spark, wh).collect()}
    assert got["NCT00000002"][0] == "b2" and got["NCT00000003"][1] is None and len(got) == 3
    # nothing new: a second trigger leaves Bronze as it is
    landing_to_bronze(spark, wh, landing).awaitTermination(120)
    assert TB.read_bronze(spark, wh).count() == 3


def test_last_of_two_versions_in_one_file_wins_in_stream_and_batch(spark, tmp):
    from cribra.sources.landing import write_landing_run
    from cribra.streaming.landing_stream import landing_to_bronze
    rows = [("NCT00000001", "2026-08-09", "zz first", "p1", 3, "r-0000"), ("NCT00000001", "2026-08-01", "aa last", "p1", 11, "r-10000")]
    df = spark.createDataFrame(rows, "nct_id string, last_update_posted string, raw string, page_file string, pos long, batch string")
    landing, wh = os.path.join(tmp, "landing"), Warehouse(os.path.join(tmp, "wh"))
    write_landing_run(df.coalesce(1), f"{landing}/run=r-T")
    landing_to_bronze(spark, wh, landing).awaitTermination(120)
    from cribra.operators.bronze import dedupe_latest
    want = dedupe_latest(df, ["nct_id"], ["page_file", "pos"]).first().raw
    assert TB.read_bronze(spark, wh).first().raw == want == "aa last"


def test_landed_studies_stream_into_attempts(spark, tmp):
    import json
    from cribra.sources.landing import write_landing
    from cribra.streaming.pending_stream import landed_to_attempts
    wh = Warehouse(os.path.join(tmp, "wh"))
    landing = os.path.join(tmp, "landing")
    raw = json.dumps(study("NCT00000001", eligibility="INCLUSION: walks unaided.\nEXCLUSION: asthma attack."))
    write_landing(spark.createDataFrame([("NCT00000001", "2026-08-14", raw)],
                                        "nct_id string, last_update_posted string, raw string"),
                  landing, "b-0000")
    landed_to_attempts(spark, wh, landing, line_extractor, SIG).awaitTermination(120)
    silver = TB.silver_view(TB.read_attempts(spark, wh)).collect()
    assert sorted((r.text, r.is_exclusion) for r in silver) == [
        ("EXCLUSION: asthma attack.", False), ("INCLUSION: walks unaided.", False)]


def test_extraction_waves_check_stop_per_wave(spark, tmp):
    wh = Warehouse(os.path.join(tmp, "wh"))
    ids = [f"NCT{i:08d}" for i in range(1, 11)]
    R.run_backfill(spark, wh, _pages(os.path.join(tmp, "p"), ids), run_token="T1")

    def throttled_after_four(batch: pd.DataFrame) -> pd.DataFrame:
        out = line_extractor(batch)
        late = (batch["nct_id"] > "NCT00000004").values
        out.loc[late, "criteria"] = None
        out.loc[late, "error"] = "HTTP 429"
        return out

    res = R.run_extraction(spark, wh, throttled_after_four, SIG, run_token="W", batch_size=2, wave=2)
    # wave 1 = batches 0, 1 (ok); wave 2 = batches 2, 3 (throttled) -> stop before batch 4
    assert (res.succeeded, res.failed, res.rate_limited) == (4, 4, 4)
    res2 = R.run_extraction(spark, wh, None, SIG, run_token="W2", batch_size=4, wave=5)
    assert (res2.succeeded, res2.pending) == (6, 0)


def test_sql_views(spark, tmp):
    wh_root = os.path.join(tmp, "wh")
    pages = _pages(os.path.join(tmp, "p"), ["NCT00000001", "NCT00000002", "NCT00000003"])
    wh = Warehouse(wh_root)
    assert R.run_backfill(spark, wh, pages, run_token="T").landed == 3
    got = R.run_extraction(spark, wh, None, SIG, run_token="E", batch_size=2)
    assert (got.succeeded, got.criteria, got.pending) == (3, 6, 0)
    assert {r.batch for r in TB.read_attempts(spark, wh).select("batch").collect()} == {"silver-E-0000", "silver-E-0001"}
    assert R.status_frame(spark, wh, SIG).first().percent == 100.0
    names = TB.register_views(spark, Warehouse(wh_root))
    assert "silver_criteria" in names
    got = spark.sql("SELECT kind, count(*) AS n FROM silver_criteria GROUP BY kind").collect()
    assert sum(r.n for r in got) == 6
    assert spark.sql("SELECT count(*) AS n FROM bronze_studies").first().n == 3


def test_extraction_limit_counts_written_trials(spark, tmp):
    wh = Warehouse(os.path.join(tmp, "wh"))
    ids = [f"NCT{i:08d}" for i in range(1, 11)]
    R.run_backfill(spark, wh, _pages(os.path.join(tmp, "p"), ids), run_token="T1")

    def odd_fail(batch: pd.DataFrame) -> pd.DataFrame:
        out = line_extractor(batch)
        bad = batch["nct_id"].isin(["NCT00000002", "NCT00000003"]).values
        out.loc[bad, "criteria"] = None
        out.loc[bad, "error"] = "reply:criteria"
        return out

    # limit 4, batches of 3: takes 1-3 (1 ok), then min(3, 4-1)=3 more: 4-6 -> 4 written
    res = R.run_extraction(spark, wh, odd_fail, SIG, run_token="L", limit=4, batch_size=3)
    assert (res.succeeded, res.failed) == (4, 2)
    got = TB.read_attempts(spark, wh).select("nct_id", "batch").collect()
    assert sorted(r.nct_id for r in got) == ids[:6]
    assert sorted({r.batch for r in got}) == ["silver-L-0000", "silver-L-0001"]
    zero = R.run_extraction(spark, wh, odd_fail, SIG, run_token="Z", limit=0)
    assert zero.succeeded + zero.failed == 0


def test_vacuum_keeps_newest_snapshots(spark, tmp):
    wh = Warehouse(os.path.join(tmp, "wh"))
    p = _pages(os.path.join(tmp, "p"), ["NCT00000001"])
    for k in range(3):
        R.run_backfill(spark, wh, p, run_token=f"V{k}")
    before = TB.bronze_versions(spark, wh)
    assert len(before) == 4                                   # empty v0 + one per run
    removed = TB.vacuum_bronze(spark, wh, keep=2)
    assert removed == before[:2] and TB.bronze_versions(spark, wh) == before[2:]
    assert TB.read_bronze(spark, wh).count() == 1


def test_quarantine_run_with_rejects_is_not_complete(spark, tmp):
    wh = Warehouse(os.path.join(tmp, "wh"))
    good = {"studies": [study("NCT00000001")]}
    path = write_pages(os.path.join(tmp, "p"), [good, '{"studies": [{"protocolSection": 5}]}'])
    r = R.run_backfill(spark, wh, path, run_token="Q", on_invalid="quarantine")
    assert (r.landed, r.published) == (1, False)
    from cribra.operators.bronze import safe_watermark
    assert safe_watermark(TB.read_runs(spark, wh)).first().watermark is None


def test_ledger_rows_share_the_start_time(spark, tmp):
    import time as _time

    from cribra.schemas import RUNS_SCHEMA
    wh = Warehouse(os.path.join(tmp, "wh"))
    p = _pages(os.path.join(tmp, "p"), ["NCT00000001"])
    R.run_backfill(spark, wh, p, run_token="S1")
    _time.sleep(0.01)
    raw = spark.read.schema(RUNS_SCHEMA).parquet(wh.runs).where("run_id = 'backfill-S1'").collect()
    assert len(raw) == 2 and raw[0].started_at == raw[1].started_at
    done = [r for r in raw if r.finished_at is not None][0]
    assert done.finished_at >= done.started_at


def test_contract_filters_run_on_typed_bronze_columns(spark, tmp, capsys):
    from cribra.operators import predicates as P
    from cribra.sources.landing import write_landing
    from cribra.streaming.landing_stream import landing_to_bronze
    wh = Warehouse(os.path.join(tmp, "wh"))
    docs = [study("NCT00000001"), study("NCT00000002", status="COMPLETED"), study("NCT00000003", study_type="OBSERVATIONAL")]
    path = write_pages(os.path.join(tmp, "p"), [{"studies": docs}])
    R.run_backfill(spark, wh, path, run_token="T", query=F.lit(True))
    bronze = TB.read_bronze(spark, wh)
    hit = P.filter_status(bronze, "overall_status", ["COMPLETED"]).select("nct_id")
    assert [r.nct_id for r in hit.collect()] == ["NCT00000002"]
    hit.explain()
    plan = capsys.readouterr().out
    assert "EqualTo(overall_status,COMPLETED)" in plan and "raw" not in plan.split("ReadSchema")[1]
    scope = P.scope_filter(bronze, "ancestors", "study_type", "overall_status", statuses=P.RECRUITING)
    assert [r.nct_id for r in scope.collect()] == ["NCT00000001"]
    # a stream that has only the landed document gets the same columns
    wh2, landing = Warehouse(os.path.join(tmp, "wh2")), os.path.join(tmp, "landing")
    write_landing(bronze.select("nct_id", "last_update_posted", "raw"), landing, "b-0000")
    landing_to_bronze(spark, wh2, landing).awaitTermination(120)
    same = [c for c in bronze.columns if c != "ingested_at"]
    assert sorted(map(repr, TB.read_bronze(spark, wh2).select(*same).collect())) == sorted(
        map(repr, bronze.select(*same).collect()))


def test_only_changes_of_bronze_reach_extraction(spark, tmp):
    from cribra.sources import keyed as K
    from cribra.sources.landing import write_landing
    from cribra.streaming.pending_stream import landed_to_attempts

    wh, landing = Warehouse(os.path.join(tmp, "wh")), os.path.join(tmp, "landing")
    docs = {f"NCT{i:08d}": study(f"NCT{i:08d}", eligibility=f"INCLUSION: line {i}") for i in range(1, 5)}

    def land(batch, ids):
        write_landing(spark.createDataFrame([(k, "2026-08-14", json.dumps(docs[k])) for k in ids],
                                            "nct_id string, last_update_posted string, raw string"), landing, batch)
        landed_to_attempts(spark, wh, landing, line_extractor, "sig0").awaitTermination(120)
        return sorted((r.nct_id, r.batch) for r in TB.read_attempts(spark, wh).collect())

    first = land("b-0000", ["NCT00000001", "NCT00000002"])
    assert [k for k, _ in first] == ["NCT00000001", "NCT00000002"]
    again = land("b-0001", ["NCT00000001", "NCT00000002"])          # unchanged: no change rows, no work
    assert again == first
    table = TB.bronze_table(wh)
    assert K.changes(spark, table, 1).count() == 0 and K.versions(spark, table)[-1] == 2
    docs["NCT00000002"] = study("NCT00000002", eligibility="INCLUSION: other prose")
    more = land("b-0002", ["NCT00000002", "NCT00000003"])
    assert [k for k, _ in more] == ["NCT00000001", "NCT00000002", "NCT00000003"]   # done trials are not repeated
    net = TB.bronze_changes(spark, wh, after=1)
    assert sorted((r.nct_id, r.change_type) for r in net.collect()) == [
        ("NCT00000002", "update_postimage"), ("NCT00000002", "update_preimage"), ("NCT00000003", "insert")]
    assert TB.read_study(spark, wh, "NCT00000003").select("eligibility").first()[0] == "INCLUSION: line 3"
    tallies = TB.bronze_tallies(spark, wh)
    assert {(r.field, r.value): r.n for r in tallies.collect()}["overall_status", "RECRUITING"] == 3
