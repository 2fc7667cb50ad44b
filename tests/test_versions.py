"""Tables of base and delta folders: replays, merges, any order of batches, and how much is read."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from chatterlens.operators import ingest as ing
from chatterlens.sources.versions import EPOCH, VersionedTable, newest
from chatterlens.streaming import streams as st

MESSAGES = "id string, content string, timestamp long"


def test_readers_open_few_folders(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k string, v int", newest(["k"], EPOCH), max_deltas=4)
    for epoch in range(50):
        table.write(spark.createDataFrame([(f"k{epoch % 7}", epoch), ("every", epoch)], "k string, v int").coalesce(1), epoch)
        assert len(table.folders()) <= 5
    assert {r.k: r.v for r in table.read().collect()} == {"every": 49, **{f"k{e % 7}": e for e in range(50)}}
    assert sum(len(os.listdir(tmp_path / "t" / part)) for part in ("base", "delta")) <= 12
    # Epochs in the base and live ones may be played again.
    table.write(spark.createDataFrame([("every", -1)], "k string, v int"), 3)
    table.write(spark.createDataFrame([("every", 49), ("k0", 49)], "k string, v int"), 49)
    assert {r.k: r.v for r in table.read().collect()}["every"] == 49


def test_unfinished_deltas_do_not_count(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k string, v int", newest(["k"], EPOCH))
    assert table.read().count() == 0
    table.write(spark.createDataFrame([("a", 1)], "k string, v int"), 0)
    table.write(spark.createDataFrame([("a", 2)], "k string, v int"), 1)
    os.remove(tmp_path / "t" / "delta" / "main-1" / "_SUCCESS")
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)]


def test_users_in_any_order_of_batches(spark, tmp_path):
    schema = "id string, platform string, username string, display_name string, metadata string, place int"
    batches = [[("a", "p", "one", None, None, 1), ("b", "p", "x", None, None, 4)], [("a", "p", "three", None, None, 3)], [("a", "p", "two", "D", None, 2), ("b", "p", "y", None, None, 4)]]
    results = set()
    for i, order in enumerate(itertools.permutations(range(3))):
        store = ing.user_store(spark, str(tmp_path / f"u{i}"), max_deltas=2)
        for epoch, which in enumerate(order):
            ing.save_users(store, spark.createDataFrame(batches[which], schema), 100, "place", epoch)
        results.add(tuple(sorted((r.id, r.username, r.first_seen, r.last_seen) for r in store.read().collect())))
    assert results == {(("a", "three", 100, 100), ("b", "y", 100, 100))}


def test_activity_equals_the_rollup_for_any_split(spark, tmp_path):
    rows = [(f"m{i}", f"u{i % 5}", "discord", 1000 + i * 37 % 91) for i in range(60)]
    messages = spark.createDataFrame(rows, "id string, author_id string, platform string, timestamp long")
    whole = sorted(map(tuple, ing.user_activity_rollup(messages, "author_id").select("id", "platform", "username", "message_count", "first_seen", "last_seen").collect()))
    for batches in (1, 4, 9):
        target = str(tmp_path / str(batches))
        add = st.add_activity(target, max_deltas=3)
        for epoch in range(batches):
            for _ in range(1 + (epoch == batches // 2)):
                add(messages.filter(F.pmod(F.hash("id"), F.lit(batches)) == epoch), epoch)
        assert sorted(map(tuple, st.stored_activity(spark, target).collect())) == whole


def test_batches_read_their_own_buckets(spark, tmp_path):
    target = str(tmp_path / "t")
    write = st.append_new(target, buckets=16)
    write(spark.createDataFrame([(f"a{i}", "x", 1_700_000_000 + i) for i in range(200)], MESSAGES), 0)
    ledger = st.known_ids(spark, target, 16)
    one = ledger.versions(F.col("bucket").isin([3]))
    assert len(one.inputFiles()) >= 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    files = one.select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("bucket=3" in r.f for r in files)


def test_a_batch_that_failed_half_way_is_not_doubled(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    first = spark.createDataFrame([("a", "x", 1_700_000_000), ("n", "x", None)], MESSAGES)
    write = st.append_new(target)
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            write(first, 0)
    write(first, 0)
    write(first, 0)
    write(first.unionByName(spark.createDataFrame([("b", "x", 5)], MESSAGES)), 1)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == ["a", "b", "n"]
    # A target from before there was a ledger is taken in.
    old = str(tmp_path / "old")
    first.withColumn("day", F.to_date(F.timestamp_seconds("timestamp"))).write.partitionBy("day").parquet(old)
    st.append_new(old)(first.unionByName(spark.createDataFrame([("b", "x", 5)], MESSAGES)), 0)
    assert sorted(r.id for r in spark.read.parquet(old).collect()) == ["a", "b", "n"]
