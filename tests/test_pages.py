"""Page scan, study columns, schema validation, dedupe (fixtures A1-A8, A24)."""

import pytest
from conftest import study
from pyspark.sql import functions as F

from cribra.operators import bronze as B
from cribra.sources import pages as PG


def test_pages_in_page_then_list_order(spark, pages_dir):
    path = pages_dir([
        {"studies": [study("NCT00000001"), study("NCT00000002")], "nextPageToken": "TOK"},
        {"studies": [study("NCT00000003")]},
    ])
    rows = PG.read_study_pages(spark, path).orderBy("page_file", "pos").collect()
    ids = [r.study.protocolSection.identificationModule.nctId for r in rows]
    assert ids == ["NCT00000001", "NCT00000002", "NCT00000003"]


def test_study_columns_id_date_raw(spark, pages_dir):
    path = pages_dir([{"studies": [study("NCT00000001"), study("NCT00000002", date=None),
                                   study(None), study("NCT00000004", date="not-a-date")]}])
    # The read check rejects a date that is none; the projection alone makes it NULL.
    with pytest.raises(Exception, match="not a full date"):
        PG.read_study_pages(spark, path).count()
    unchecked = PG.read_page_files(spark, path).select(F.posexplode("page.studies").alias("pos", "study"))
    cols = B.study_columns(unchecked, keep=("pos",)).orderBy("pos").collect()
    assert [c.nct_id for c in cols] == ["NCT00000001", "NCT00000002", None, "NCT00000004"]
    assert str(cols[0].last_update_posted) == "2026-08-14"
    assert cols[1].last_update_posted is None and cols[3].last_update_posted is None
    # nulls are dropped from the re-serialised document, unknown fields never enter it
    assert '"nctId":"NCT00000001"' in cols[0].raw and "null" not in cols[0].raw
    assert cols[0].eligibility == "INCLUSION: walks unaided."


def test_unknown_study_fields_are_ignored(spark, pages_dir):
    doc = study("NCT00000001")
    doc["protocolSection"]["brandNewModule"] = {"x": 1}
    path = pages_dir([{"studies": [doc]}])
    raw = B.study_columns(PG.read_study_pages(spark, path)).first().raw
    assert "brandNewModule" not in raw


@pytest.mark.parametrize("bad", [
    '{"studies": [{"protocolSection": 5}]}',          # A4 wrong type
    '{"unexpected": true}',                            # A24 no studies
    '{"studies": [], "surprise": 1}',                  # paging classes forbid extras
    '{"studies": [',                                   # malformed
])
def test_invalid_page_fails_the_run(spark, pages_dir, bad):
    path = pages_dir([{"studies": [study("NCT00000001")]}, bad])
    with pytest.raises(Exception, match="invalid registry page"):
        PG.read_study_pages(spark, path).count()


def test_unknown_enum_fails_and_quarantine_keeps_good_pages(spark, pages_dir):
    path = pages_dir([{"studies": [study("NCT00000001")]},
                      {"studies": [study("NCT00000002", status="MAYBE")]}])
    with pytest.raises(Exception, match="unknown enum value"):
        PG.read_study_pages(spark, path).count()
    kept = PG.read_study_pages(spark, path, on_invalid="quarantine")
    assert kept.count() == 1
    assert PG.rejected_pages(spark, path).first().problem == "unknown enum value"


def test_missing_ids_are_dropped_and_counted(spark, pages_dir):
    path = pages_dir([{"studies": [study("NCT00000001"), study(None), study(None)]}])
    cols = B.study_columns(PG.read_study_pages(spark, path))
    assert B.drop_missing_ids(cols).count() == 1
    r = B.id_presence_counts(cols).first()
    assert (r.kept_rows, r.skipped_rows) == (1, 2)


def test_dedupe_last_arrival_wins_not_newest_date(spark, pages_dir):
    # A7: stale then fresh in one batch -> the later one; and a later stale one beats an earlier fresh one
    path = pages_dir([{"studies": [study("NCT00000001", date="2026-01-01"),
                                   study("NCT00000001", date="2026-08-14"),
                                   study("NCT00000002", date="2026-08-14"),
                                   study("NCT00000002", date="2026-01-01")]}])
    cols = B.study_columns(PG.read_study_pages(spark, path), keep=("page_file", "pos"))
    got = {r.nct_id: str(r.last_update_posted)
           for r in B.dedupe_latest(cols, ["nct_id"], ["page_file", "pos"]).collect()}
    assert got == {"NCT00000001": "2026-08-14", "NCT00000002": "2026-01-01"}


def test_page_count_uses_total_when_given(spark, pages_dir):
    path = pages_dir([{"studies": [study("NCT00000001")], "totalCount": 11200}])
    assert PG.page_counts(spark, path).first().total_count == 11200


def test_scope_and_updated_since(spark, pages_dir):
    from cribra.operators import predicates as P
    path = pages_dir([{"studies": [
        study("NCT00000001"),
        study("NCT00000002", status="COMPLETED"),
        study("NCT00000003", study_type="OBSERVATIONAL"),
        study("NCT00000004", ancestors=("Heart Diseases",)),
        study("NCT00000005", date="2026-01-01"),
    ]}])
    cols = B.study_columns(PG.read_study_pages(spark, path))
    scoped = P.scope_filter(cols, "ancestors", "study_type", "overall_status")
    assert sorted(r.nct_id for r in scoped.collect()) == ["NCT00000001", "NCT00000005"]
    loose = P.scope_filter(cols, "ancestors", "study_type", "overall_status", statuses=None)
    assert loose.count() == 3
    since = P.updated_since(scoped, "last_update_posted", "2026-08-14")  # inclusive
    assert [r.nct_id for r in since.collect()] == ["NCT00000001"]
    own = P.custom_filter(cols, F.col("overall_status") == "COMPLETED")
    assert [r.nct_id for r in own.collect()] == ["NCT00000002"]


def test_pages_one_per_line(spark, tmp):
    import json
    import os
    os.makedirs(f"{tmp}/lines")
    with open(f"{tmp}/lines/part-0.jsonl", "w") as f:
        for i in range(5):
            f.write(json.dumps({"studies": [study(f"NCT{2 * i + 1:08d}"), study(f"NCT{2 * i + 2:08d}")]}) + "\n")
    rows = PG.read_study_pages(spark, f"{tmp}/lines", page_per_line=True).orderBy("page_file", "pos")
    ids = [r.study.protocolSection.identificationModule.nctId for r in rows.collect()]
    assert ids == [f"NCT{i:08d}" for i in range(1, 11)]


def test_list_and_eligibility_enums_are_checked(spark, pages_dir):
    ok = study("NCT00000001")
    ok["protocolSection"]["designModule"]["phases"] = ["PHASE1", "PHASE2"]
    ok["protocolSection"]["eligibilityModule"].update({"sex": "ALL", "stdAges": ["ADULT"]})
    bad = study("NCT00000002")
    bad["protocolSection"]["designModule"]["phases"] = ["PHASE9"]
    path = pages_dir([{"studies": [ok]}, {"studies": [bad]}])
    assert PG.read_study_pages(spark, path, on_invalid="quarantine").count() == 1
    assert PG.rejected_pages(spark, path).first().problem == "unknown enum value"


def test_page_count_without_total_counts_studies(spark, pages_dir):
    path = pages_dir([{"studies": [study("NCT00000001"), study("NCT00000002")]},
                      {"studies": [study("NCT00000003")]}])
    assert PG.page_counts(spark, path).first().total_count == 3


def test_point_read_and_scope_count(spark, pages_dir):
    from cribra.operators import predicates as P
    path = pages_dir([{"studies": [study("NCT00000001"), study("NCT00000002", status="COMPLETED")]}])
    cols = B.study_columns(PG.read_study_pages(spark, path))
    assert [r.nct_id for r in B.fetch_study(cols, "NCT00000002").collect()] == ["NCT00000002"]
    assert B.fetch_study(cols, "NCT00000009").count() == 0
    scoped = P.scope_filter(cols, "ancestors", "study_type", "overall_status")
    assert P.scope_count(scoped).first().scope_count == 1


def test_full_dates_ids_and_points_are_checked(spark, pages_dir):
    def changed(**modules):
        doc = study("NCT00000001")
        for name, value in modules.items():
            doc["protocolSection"].setdefault(name, {}).update(value)
        return {"studies": [doc]}

    pages = [changed(statusModule={"lastUpdatePostDateStruct": {"date": "garbage", "type": "ACTUAL"}}),
             changed(identificationModule={"nctId": "NCT1"}),
             changed(contactsLocationsModule={"locations": [{"geoPoint": {"lat": 1.5, "lon": 2.0}}, {"geoPoint": {"lat": 1.5}}]}),
             changed(contactsLocationsModule={"locations": [{"geoPoint": {"lat": 1.5, "lon": 2.0}}, {}]})]
    path = pages_dir(pages)
    assert sorted(r.problem for r in PG.rejected_pages(spark, path).collect()) == [
        "not a full date", "point without latitude or longitude", "trial id without 11 characters"]
    assert PG.read_study_pages(spark, path, on_invalid="quarantine").count() == 1


def test_enums_of_a_contract_are_checked_by_path(spark, pages_dir):
    spec = {"components": {"schemas": {
        "Study": {"properties": {"protocolSection": {"$ref": "#/components/schemas/Protocol"}}},
        "Protocol": {"properties": {
            "sponsorCollaboratorsModule": {"properties": {"leadSponsor": {"$ref": "#/components/schemas/Sponsor"},
                                                          "collaborators": {"items": {"$ref": "#/components/schemas/Sponsor"}}}},
            "again": {"$ref": "#/components/schemas/Protocol"}}},
        "Sponsor": {"properties": {"class": {"allOf": [{"$ref": "#/components/schemas/Class"}]}}},
        "Class": {"enum": ["RED", "BLUE"]}}}}
    enums = PG.contract_enums(spec)
    lead, others = (f"protocolSection.sponsorCollaboratorsModule.{x}.class" for x in ("leadSponsor", "collaborators"))
    assert enums == {lead: ("RED", "BLUE"), others: ("RED", "BLUE")}
    docs = []
    for cls in ("RED", "GREEN"):
        doc = study("NCT00000001")
        doc["protocolSection"]["sponsorCollaboratorsModule"] = {
            "leadSponsor": {"name": "x", "class": "BLUE"}, "collaborators": [{"class": "BLUE"}, {"class": cls}]}
        docs.append({"studies": [doc]})
    got = PG.read_page_files(spark, pages_dir(docs), enums={**PG.SCOPE_ENUMS, **enums}).collect()
    assert sorted(str(r.problem) for r in got) == ["None", "unknown enum value"]


def test_page_lines_survive_a_change_of_the_splits(spark, tmp):
    import json as _json

    from cribra.operators.ordering import chunk_index
    pages = [_json.dumps({"studies": [study(f"NCT{p:04d}{k:04d}") for k in range(20)]}) for p in range(120)]
    with open(f"{tmp}/pages.jsonl", "w") as f:
        f.write("\n".join(pages) + "\n")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "64k")
        rows = chunk_index(PG.read_study_pages(spark, tmp, page_per_line=True), ["page_file", "pos"], 500)
        spark.conf.set(size, "8m")
        got = rows.selectExpr("study.protocolSection.identificationModule.nctId as i", "batch_index").collect()
    finally:
        spark.conf.set(size, before)
    assert sorted(r.i for r in got) == [f"NCT{p:04d}{k:04d}" for p in range(120) for k in range(20)]
    assert all(r.batch_index == (int(r.i[3:7]) * 20 + int(r.i[7:])) // 500 for r in got)


def test_long_numbers_keep_all_their_digits(spark):
    from cribra.functions.ids import nct_from_number
    got = spark.createDataFrame([(42,), (10_000_000,), (100_000_000,), (100_000_001,)], "n long").select(
        nct_from_number("n").alias("i")).collect()
    assert [r.i for r in got] == ["NCT00000042", "NCT10000000", "NCT100000000", "NCT100000001"]


def test_one_bad_study_costs_one_row(spark, pages_dir, tmp):
    import os

    from cribra.plans import runs as R
    from cribra.sources import pages as PG
    from cribra.sources import tables as TB
    from cribra.sources.tables import Warehouse
    many = [study(f"NCT{i:08d}") for i in range(1, 1001)]
    many[499] = {"protocolSection": 5}
    many[500] = study("NCT1")
    path = pages_dir([{"studies": many, "nextPageToken": "t"}, {"studies": []}, '{"studies": 7}', "[1]",
                      {"studies": [study("NCT00002000")], "odd": 1}])
    found = PG.single_studies(PG.page_texts(spark, path)).collect()
    bad = sorted((r.page_file[-9:], -1 if r.pos is None else r.pos, r.problem) for r in found if r.problem)
    assert bad == [("0000.json", 499, "malformed page or wrong type"), ("0000.json", 500, "trial id without 11 characters"),
                   ("0002.json", -1, "page has no studies"), ("0003.json", -1, "malformed page or wrong type"),
                   ("0004.json", 0, "unknown page field")]
    kept = PG.read_study_pages(spark, path, "quarantine_study")
    assert kept.count() == 998 and kept.where("study IS NULL").count() == 0
    wh = Warehouse(os.path.join(tmp, "wh"))
    r = R.run_backfill(spark, wh, path, run_token="P", on_invalid="quarantine_study")
    assert (r.landed, r.published) == (998, False) and TB.read_bronze(spark, wh).count() == 998


def test_backfill_takes_the_contract_enums(spark, pages_dir, tmp):
    import os

    import pytest

    from cribra.plans import runs as R
    from cribra.sources.tables import Warehouse
    path = pages_dir([{"studies": [study("NCT00000001")]}])
    wh = Warehouse(os.path.join(tmp, "wh"))
    strict = {"protocolSection.designModule.studyType": ("OBSERVATIONAL",)}
    with pytest.raises(Exception, match="unknown enum value"):
        R.run_backfill(spark, wh, path, run_token="E1", enums=strict)
    r = R.run_backfill(spark, wh, path, run_token="E2", enums=strict, on_invalid="quarantine_study")
    assert (r.landed, r.published) == (0, False)
    assert R.run_backfill(spark, wh, path, run_token="E3").landed == 1
