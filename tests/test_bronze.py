"""Merge, change feed, run ledger, names and strict dates (fixtures A7, A8, A18, A19)."""

import pytest
from pyspark.sql import functions as F

from cribra.functions.dates import partial_date_hi, partial_date_lo, strict_date
from cribra.functions.text import UnsafeNameError, validate_name
from cribra.operators import bronze as B

T_SCHEMA = "nct_id string, last_update_posted date, raw string"
S_SCHEMA = "nct_id string, last_update_posted date, raw string, seq long"


def _t(spark, rows):
    return spark.createDataFrame(rows, T_SCHEMA)


def test_merge_updates_in_place_and_inserts(spark):
    import datetime as dt
    target = _t(spark, [("NCT00000001", dt.date(2026, 1, 1), "a"), ("NCT00000002", dt.date(2026, 1, 1), "b")])
    source = spark.createDataFrame([("NCT00000002", dt.date(2026, 8, 1), "b2", 1),
                                    ("NCT00000002", dt.date(2026, 2, 1), "b3", 2),
                                    ("NCT00000003", None, "c", 3)], S_SCHEMA)
    merged = B.merge_upsert(target, source, ["nct_id"], ["seq"])
    got = {r.nct_id: (r.raw, r.merge_action) for r in merged.collect()}
    # the later arrival of a repeated key wins, even with an older date
    assert got == {"NCT00000001": ("a", "keep"), "NCT00000002": ("b3", "update"),
                   "NCT00000003": ("c", "insert")}
    c = B.merge_counts(merged).first()
    assert (c.rows_before, c.written, c.rows_after, c.added, c.updated) == (2, 2, 3, 1, 1)


def test_merge_is_idempotent(spark):
    import datetime as dt
    target = _t(spark, [("NCT00000001", dt.date(2026, 1, 1), "a")])
    source = spark.createDataFrame([("NCT00000001", dt.date(2026, 8, 1), "a2", 1),
                                    ("NCT00000009", dt.date(2026, 8, 1), "z", 2)], S_SCHEMA)
    once = B.merge_upsert(target, source, ["nct_id"], ["seq"]).drop(B.ACTION_COL)
    twice = B.merge_upsert(once, source, ["nct_id"], ["seq"]).drop(B.ACTION_COL)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_empty_batch_changes_nothing(spark):
    import datetime as dt
    target = _t(spark, [("NCT00000001", dt.date(2026, 1, 1), "a")])
    empty = spark.createDataFrame([], S_SCHEMA)
    merged = B.merge_upsert(target, empty, ["nct_id"], ["seq"])
    assert [(r.nct_id, r.merge_action) for r in merged.collect()] == [("NCT00000001", "keep")]


def test_change_feed_all_kinds(spark):
    before = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "k string, v string")
    after = spark.createDataFrame([("1", "a"), ("2", "B"), ("4", "d")], "k string, v string")
    got = sorted((r.k, r.v, r.change_type) for r in B.change_feed(before, after, ["k"], ["v"]).collect())
    assert got == [("2", "B", "update_postimage"), ("2", "b", "update_preimage"),
                   ("3", "c", "delete"), ("4", "d", "insert")]


def test_safe_watermark_ignores_incomplete_and_limited_runs(spark):
    import datetime as dt
    runs = spark.createDataFrame([
        ("r1", "full", dt.datetime(2026, 8, 1), dt.datetime(2026, 8, 1, 1), 10, dt.date(2026, 7, 30), True),
        ("r2", "incremental", dt.datetime(2026, 8, 2), dt.datetime(2026, 8, 2, 1), 5, None, False),
        ("r3", "incremental", dt.datetime(2026, 8, 3), None, None, None, False),
    ], "run_id string, mode string, started_at timestamp, finished_at timestamp, "
       "studies_written long, watermark date, complete boolean")
    assert str(B.safe_watermark(runs).first().watermark) == "2026-07-30"
    none = B.safe_watermark(runs.where("run_id <> 'r1'")).first().watermark
    assert none is None  # no complete run: the next pass is full


def test_run_ledger_start_and_finish(spark):
    import datetime as dt
    bronze = _t(spark, [("NCT00000001", dt.date(2026, 8, 14), "a"), ("NCT00000002", None, "b")])
    started = B.start_run(spark, "backfill-20260815T000000Z", "full")
    assert started.first().complete is False
    done = B.finish_run(started, bronze, written=2, complete=True).first()
    assert (done.studies_written, str(done.watermark), done.complete) == (2, "2026-08-14", True)
    partial = B.finish_run(started, bronze, written=1, complete=False).first()
    assert partial.watermark is None and partial.complete is False
    ledger = B.ledger_latest(started.unionByName(B.finish_run(started, bronze, 2, True)))
    assert ledger.count() == 1 and ledger.first().complete is True


@pytest.mark.parametrize("name", ["backfill-000", "batch_1", "inc.2026-08-15", "a"])
def test_safe_names(name):
    assert validate_name(name) == name


@pytest.mark.parametrize("name", ["it's", "a/b", "a b", "", "x" * 65])
def test_unsafe_names(name):
    with pytest.raises(UnsafeNameError):
        validate_name(name)


def test_strict_dates_and_partial_dates(spark):
    df = spark.createDataFrame([("2026-08-14",), (None,), ("not-a-date",), ("2026-08",),
                                ("2024-02-30",), ("2022",)], "t string")
    rows = df.select(strict_date("t").alias("d"), partial_date_lo("t").alias("lo"),
                     partial_date_hi("t").alias("hi")).collect()
    assert [str(r.d) if r.d else None for r in rows] == ["2026-08-14", None, None, None, None, None]
    assert (str(rows[3].lo), str(rows[3].hi)) == ("2026-08-01", "2026-08-31")
    assert (str(rows[5].lo), str(rows[5].hi)) == ("2022-01-01", "2022-12-31")


def test_global_index_is_exact_and_chunks_are_runs(spark):
    from cribra.operators.ordering import chunk_index, global_index
    df = spark.range(0, 1003).select(F.format_string("NCT%08d", (F.col("id") * 7919) % 1003).alias("k"))
    idx = global_index(df, ["k"], partitions=5).orderBy("k").collect()
    assert [r.row_index for r in idx] == list(range(1003))
    sizes = chunk_index(df, ["k"], 100).groupBy("batch_index").count().orderBy("batch_index").collect()
    assert [r["count"] for r in sizes] == [100] * 10 + [3]


def test_five_ids_in_batches_of_two(spark):
    # A8: five distinct ids, batches of 2 give 2, 2, 1, named <run>-NNNN
    from cribra.functions.text import numbered
    from cribra.operators.ordering import chunk_index
    df = spark.createDataFrame([(f"NCT0000000{i}",) for i in range(1, 6)], "nct_id string")
    got = chunk_index(df, ["nct_id"], 2).select(
        "nct_id", numbered(F.lit("backfill-T"), F.col("batch_index")).alias("batch"))
    rows = sorted((r.nct_id, r.batch) for r in got.collect())
    assert [b for _, b in rows] == ["backfill-T-0000"] * 2 + ["backfill-T-0001"] * 2 + ["backfill-T-0002"]


def test_checkpoint_folder_comes_from_the_session():
    import pytest as _pytest

    from cribra.session import checkpoint_dir

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

        def set(self, key, value):
            self.value = value

    class Context:
        def __init__(self, master):
            self.master, self.dir = master, None

        def setCheckpointDir(self, d):  # noqa: N802 - Spark's name
            self.dir = d

        def getCheckpointDir(self):  # noqa: N802 - Spark's name
            return self.dir

    class Session:
        def __init__(self, value, master):
            self.conf, self.sparkContext = Conf(value), Context(master)

    cluster = Session("hdfs://shared/ckpt", "yarn")
    assert checkpoint_dir(cluster) == "hdfs://shared/ckpt" == cluster.sparkContext.dir
    with _pytest.raises(ValueError, match="shared"):
        checkpoint_dir(Session(None, "yarn"))          # never a driver-local folder on a cluster
    local = Session(None, "local[4]")
    assert checkpoint_dir(local).startswith("/") and local.sparkContext.dir == local.conf.value


def test_merge_without_order_inserts_a_repeated_key_once(spark):
    target = spark.createDataFrame([], "k string, v string")
    source = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "k string, v string")
    for how in ("keyed", "full_outer"):
        got = B.merge_upsert(target, source, ["k"], strategy=how).collect()
        assert sorted((r.k, r.v) for r in got) == [("a", "2"), ("b", "3")]


def test_both_forms_of_the_id_filter_keep_repeated_ids(spark):
    from cribra.operators.predicates import filter_ids
    df = spark.createDataFrame([("NCT00000001", 1, ["x"]), ("NCT00000001", 2, None), ("NCT00000002", 3, ["NCT00000001"]),
                                (None, 4, ["nct1"]), ("NCT00000003", 5, [])], "nct_id string, n int, alias array<string>")
    ids = spark.createDataFrame([("nct1",), ("zzz",), (None,)], "id string")
    for alias, want in ((None, [1, 2]), ("alias", [1, 2, 3, 4])):
        for wanted in (["nct1", "zzz"], ids):
            assert sorted(r.n for r in filter_ids(df, "nct_id", alias, wanted).collect()) == want
