"""The keyed table: versions, change rows, writers side by side, reads and writes by bucket."""

import os
import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cribra.operators import bronze as B
from cribra.sources import keyed as K

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("a", T.LongType()),
                       T.StructField("b", T.StringType()), T.StructField("at", T.TimestampType())])


def table(tmp_path, buckets=4):
    return K.KeyedTable(str(tmp_path), SCHEMA, "k", buckets, stamp="at")


def frame(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, a long, b string, seq long")


def rows_of(df):
    return sorted((tuple(r) for r in df.select("k", "a", "b").collect()), key=repr)


def changes_as_rows(df):
    return sorted((tuple(r) for r in df.select("k", "a", "b", "change_type").collect()), key=repr)


keys = st.sampled_from("pqrstuvw")
batches = st.lists(st.lists(st.tuples(keys, st.one_of(st.none(), st.integers(0, 2)), st.sampled_from(["x", "y"])),
                            max_size=6), min_size=1, max_size=4)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches=batches, pick=st.data())
def test_versions_and_changes_follow_a_dict(spark, tmp_path_factory, batches, pick):
    t = table(tmp_path_factory.mktemp("keyed"))
    K.create(spark, t)
    states = [{}]
    for rows in batches:
        done = K.merge(spark, t, frame(spark, rows), ["seq"])
        if rows:
            states.append(states[-1] | {k: (a, b) for k, a, b in rows})
        assert done.version == len(states) - 1
    for v, state in enumerate(states):
        assert rows_of(K.read(spark, t, v)) == sorted(((k, *x) for k, x in state.items()), key=repr)
    lo = pick.draw(st.integers(0, len(states) - 1))
    hi = pick.draw(st.integers(lo, len(states) - 1))
    net = K.net_changes(K.changes(spark, t, lo, hi), "k", t.values)
    want = B.change_feed(K.read(spark, t, lo), K.read(spark, t, hi), ["k"], t.values)
    assert changes_as_rows(net) == changes_as_rows(want)


def test_two_writers_lose_nothing(spark, tmp_path):
    t = table(tmp_path, buckets=2)
    K.merge(spark, t, frame(spark, [("base", 0, "x")]), ["seq"])
    failed = []

    def writer(name):
        try:
            for i in range(3):
                K.merge(spark, t, frame(spark, [(f"{name}{i}", i, "x"), ("both", i, name)]), ["seq"])
        except Exception as e:  # noqa: BLE001 - shown by the assertion
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(n,)) for n in ("m", "n")]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed
    got = {r.k for r in K.read(spark, t).collect()}
    assert got == {"base", "both"} | {f"{n}{i}" for n in "mn" for i in range(3)}
    assert K.versions(spark, t) == list(range(8))
    net = K.net_changes(K.changes(spark, t, 0), "k", t.values)
    assert changes_as_rows(net) == changes_as_rows(
        B.change_feed(K.read(spark, t, 0), K.read(spark, t), ["k"], t.values))


def test_a_taken_version_is_not_overwritten(spark, tmp_path):
    t = table(tmp_path)
    K.create(spark, t)
    path = f"{t.commits}/{1:08d}.json"
    assert K._publish(spark, path, "one") and not K._publish(spark, path, "two")
    assert open(path).read() == "one"
    assert [n for n in os.listdir(t.commits) if not n.endswith((".json", ".crc"))] == []


def test_writes_follow_the_batch_and_the_table_is_not_shuffled(spark, tmp_path, monkeypatch):
    t = table(tmp_path, buckets=32)
    K.merge(spark, t, frame(spark, [(f"k{i}", i, "x" * 50) for i in range(3000)]), ["seq"])
    plans, real = [], B.merge_upsert

    def seen(target, source, *args, **more):
        out = real(target, source, *args, **more)
        plans.append(out.where("merge_action = 'keep'")._jdf.queryExecution().optimizedPlan().toString())
        plans.append(out.where("merge_action = 'keep'")._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(B, "merge_upsert", seen)
    done = K.merge(spark, t, frame(spark, [("k7", -1, "new"), ("k8", 8, "x" * 50)]), ["seq"])
    folder = f"{t.root}/data/write={done.write}"
    written = [d for d in os.listdir(folder) if d.startswith("bucket=")]
    assert 1 <= len(written) <= 2
    kept = plans[1].split("Union")[-1]
    assert "BroadcastHashJoin" in kept and "Exchange hashpartitioning" not in kept
    assert sum(w != done.write for w in done.held.values()) >= 30
    net = K.net_changes(K.changes(spark, t, done.version - 1), "k", t.values)
    assert [(r.k, r.change_type) for r in net.orderBy("change_type").collect()] == [
        ("k7", "update_postimage"), ("k7", "update_preimage")]       # k8 landed unchanged


def test_point_read_opens_one_bucket(spark, tmp_path):
    t = table(tmp_path, buckets=8)
    K.merge(spark, t, frame(spark, [(f"k{i}", i, "x") for i in range(500)]), ["seq"])
    one = K.read_key(spark, t, "k77")
    assert [tuple(r) for r in one.select("k", "a").collect()] == [("k77", 77)]
    assert len(one.inputFiles()) == 1 < len(K.read(spark, t).inputFiles())
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,k77)" in plan
    assert K.read_key(spark, t, "nobody").count() == 0


def test_vacuum_keeps_what_newer_versions_refer_to(spark, tmp_path):
    t = table(tmp_path, buckets=4)
    for i in range(4):
        K.merge(spark, t, frame(spark, [(f"k{j}", i * j, "x") for j in range(i, 6)]), ["seq"])
    want = rows_of(K.read(spark, t))
    assert K.vacuum(spark, t, keep=2) == [0, 1, 2]
    assert rows_of(K.read(spark, t)) == want and K.versions(spark, t) == [3, 4]
    with pytest.raises(ValueError):
        K.vacuum(spark, t, keep=0)


def test_null_keys_repeats_and_empty_batches(spark, tmp_path):
    t = table(tmp_path)
    done = K.merge(spark, t, frame(spark, [(None, 1, "x"), ("p", 1, "x"), ("p", 2, None)]), ["seq"])
    assert rows_of(K.read(spark, t)) == [("p", 2, None)]
    again = K.merge(spark, t, frame(spark, []).where(F.lit(False)), ["seq"])
    assert again.version == done.version
    assert K.read(spark, t).where("at IS NULL").count() == 0


def test_counts_come_from_footers(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("day", T.DateType()),
                           T.StructField("text", T.StringType())])
    t = K.KeyedTable(str(tmp_path), schema, "k", 4)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert K.footer_stats(spark, t, "day").first()["rows"] == 0
    rows = spark.range(300).selectExpr("concat('k', id) AS k", "date_add(date'2024-01-01', cast(id % 40 AS int)) AS day",
                                       "repeat('x', 50) AS text")
    K.merge(spark, t, rows)
    K.merge(spark, t, rows.where("k = 'k3'").withColumn("day", F.lit("2030-05-05").cast("date")))
    got = K.footer_stats(spark, t, "day")
    assert [str(x) for x in got.first()] == ["300", "2030-05-05"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MAX(day)]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
