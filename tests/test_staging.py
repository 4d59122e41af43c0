"""Children in keyed state: promotion, replacement, expiry, and what a batch reads."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.streaming import staging

CHILD = "asset string, n int, slot int, at timestamp, v string"
PARENT = "asset string, at timestamp"


def at(s):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)


@pytest.fixture()
def store(spark):
    before = spark.conf.get(staging.STATE_STORE[0])
    spark.conf.set(*staging.STATE_STORE)
    yield
    spark.conf.set(staging.STATE_STORE[0], before)


def run(spark, path, batches, most=None):
    """The rows that come out in each batch; batches: lists of (children, parents)."""
    query, got = None, []
    for n, (children, parents) in enumerate(batches):
        spark.createDataFrame([(a, k, s, at(s), v) for a, k, s, v in children], CHILD).coalesce(1).write.mode("append").parquet(f"{path}/c/{n}")
        spark.createDataFrame([(a, at(s)) for a, s in parents], PARENT).coalesce(1).write.mode("append").parquet(f"{path}/p/{n}")
        c = spark.readStream.schema(CHILD).parquet(f"{path}/c/*")
        p = spark.readStream.schema(PARENT).parquet(f"{path}/p/*")
        rows = staging.stage_children(p, c, ["asset"], ["n"], ["slot"], "at", most)
        seen = []
        query = rows.writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.select("asset", "n", "v", "outcome").collect()))).outputMode("append").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()  # noqa: B023
        assert query.awaitTermination(120)
        got.append((sorted(seen), query.lastProgress))
    return got


def test_early_children_are_promoted_and_replaced(spark, tmp_path, store):
    got = run(spark, tmp_path, [([("A", 1, 5, "first"), ("A", 1, 3, "older"), ("A", 2, 4, "x"), ("B", 1, 4, "waits")], [("C", 1)]), ([("A", 1, 9, "later"), ("C", 7, 9, "at once")], []), ([], [("A", 10)]), ([("A", 3, 11, "now")], [])])
    assert [rows for rows, _ in got] == [[], [("C", 7, "at once", "promoted")], [("A", 1, "later", "promoted"), ("A", 2, "x", "promoted")], [("A", 3, "now", "promoted")]]


def test_children_expire_by_event_time(spark, tmp_path, store):
    got = run(spark, tmp_path, [([("A", 1, 0, "old"), ("A", 2, 50, "young")], []), ([("Z", 1, 80, "tick")], []), ([], [("A", 81)]), ([("Z", 2, 200, "tock")], [])], datetime.timedelta(seconds=60))
    rows = [r for rows, _ in got for r in rows]
    assert ("A", 1, "old", "expired") in rows and ("A", 2, "young", "promoted") in rows and ("A", 1, "old", "promoted") not in rows
    assert ("Z", 1, "tick", "expired") in rows


def test_what_a_batch_reads_does_not_grow_with_what_waits(spark, tmp_path, store):
    many = [(f"a{i}", 1, 1, "w") for i in range(3000)]
    got = run(spark, tmp_path, [(many, []), ([("b", 1, 2, "x")], [("b", 2)])])
    assert got[1][0] == [("b", 1, "x", "promoted")]
    progress = got[1][1]
    assert progress["numInputRows"] <= 2 and sum(s["numRowsUpdated"] for s in progress["stateOperators"]) <= 4
