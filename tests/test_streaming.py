"""Streams against the same work in one batch: replays, late rows, early children, chains."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import hashes
from tallyforge.operators import fold
from tallyforge.sources.tables import stream_events
from tallyforge.streaming import fold as streams
from tallyforge.streaming.store import Store


def files(spark, path, parts, schema):
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/p{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


EVENT = "k int, slot long, tx_index int, event_ordinal int, tx_signature string, v string"


def event(k, slot, v):
    return (k, slot, 0, 0, f"s{slot}", v)


def last(rows):
    order = F.struct("slot", "tx_index", "event_ordinal", "tx_signature")
    return fold.project(rows, ["k"], order, last={c: F.col(c) for c in ("slot", "tx_index", "event_ordinal", "tx_signature", "v")})


def test_fold_stream_with_replay_and_late_events(spark, tmp_path):
    parts = [[event(1, 1, "a"), event(2, 2, "b")], [event(1, 5, "c")], [event(1, 3, "late"), event(3, 9, "d")]]
    events = files(spark, f"{tmp_path}/in", parts, EVENT)
    store = Store(spark, f"file://{tmp_path}/store", ["k"], EVENT, 4)
    policies = {c: "guarded" for c in ("slot", "tx_index", "event_ordinal", "tx_signature", "v")}
    order = F.struct("slot", "tx_index", "event_ordinal", "tx_signature")
    run = lambda check: streams.fold_stream(events, store, f"{tmp_path}/{check}", last, policies, order).awaitTermination(120)
    assert run("c1")
    want = {1: "c", 2: "b", 3: "d"}
    assert {r["k"]: r["v"] for r in store.read().collect()} == want
    # a batch of the same stream again: skipped
    assert not store.apply(last(spark.createDataFrame([event(1, 99, "x")], EVENT)), f"{tmp_path}/c1", 2, lambda old, new: new)
    assert {r["k"]: r["v"] for r in store.read().collect()} == want
    # all of it again from a new checkpoint: the same table
    assert run("c2")
    assert {r["k"]: r["v"] for r in store.read().collect()} == want and store.read().count() == 3


def test_untouched_buckets_stay(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", ["k"], "k int, v string", 16)
    rows = spark.createDataFrame([(i, "a") for i in range(50)], "k int, v string")
    over = lambda old, new: fold.merge(old, new, ["k"], {"v": "overwrite"})
    assert store.apply(rows, "s", 0, over)
    before = store._manifest()[1]
    assert store.apply(rows.where("k = 7").withColumn("v", F.lit("b")), "s", 1, over)
    after = store._manifest()[1]
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r["v"] for r in store.read().where("k = 7").collect()} == {"b"} and store.read().count() == 50
    assert store.apply(store.read().where("k = 7"), "s", 2, lambda old, new: old.where("k <> 7")) and store.read().count() == 49


def test_staging_promotes_and_expires(spark, tmp_path):
    children = files(spark, f"{tmp_path}/in", [[event(1, 10, "a"), event(2, 11, "b"), event(4, 10, "old")], [event(3, 5000, "c")]], EVENT)
    table, staged = (Store(spark, f"file://{tmp_path}/{n}", ["k"], EVENT, 4) for n in ("table", "staged"))
    known = [[1], [1, 2, 3]]
    seen = []

    def parents():
        now = known[min(len(seen), 1)]
        return spark.createDataFrame([(k,) for k in now], "k int")

    policies = {c: "overwrite" for c in ("slot", "tx_index", "event_ordinal", "tx_signature", "v")}
    apply = staged.apply
    staged.apply = lambda *a: (apply(*a), seen.append(1))[0]  # what follows sees all parents
    assert streams.fold_with_staging(children, table, staged, parents, ["k"], f"{tmp_path}/c", policies, max_age_ms=400_000).awaitTermination(120)
    assert {r["k"]: r["v"] for r in table.read().collect()} == {1: "a", 2: "b", 3: "c"}
    assert staged.read().count() == 0


def test_cursor_never_goes_back(spark, tmp_path):
    events = files(spark, f"{tmp_path}/in", [[event(1, 7, "a")], [event(1, 3, "b")], [event(1, 7, "c")]], EVENT)
    cursors = Store(spark, f"file://{tmp_path}/store", ["name"], "name string, slot long, tx_index long, tx_signature string", 1)
    assert streams.advance_cursors(events, cursors, "main", f"{tmp_path}/c").awaitTermination(120)
    assert [tuple(r) for r in cursors.read().collect()] == [("main", 7, 0, "s7")]


def test_backfill_then_tail(spark, tmp_path):
    events = files(spark, f"{tmp_path}/in", [[event(1, 1, "a")], [event(2, 2, "b")]], EVENT)
    store = Store(spark, f"file://{tmp_path}/store", ["k"], EVENT, 2)
    policies = {c: "overwrite" for c in ("slot", "tx_index", "event_ordinal", "tx_signature", "v")}
    start = lambda rows, trigger: streams.fold_stream(rows, store, f"{tmp_path}/c", last, policies, trigger=trigger)
    query = streams.backfill_then_tail(events, start, 120)
    assert store.read().count() == 2
    spark.createDataFrame([event(3, 3, "c")], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/p9")
    query.processAllAvailable()
    query.stop()
    assert store.read().count() == 3


def test_refreshed_statistics(spark, tmp_path):
    schema = "asset int, score int"
    events = files(spark, f"{tmp_path}/in", [[(1, 50), (2, 10)], [(1, 70)]], schema)
    store = Store(spark, f"file://{tmp_path}/store", ["asset"], "asset int, n long", 4)
    rollup = lambda df: df.groupBy("asset").agg(F.count("*").alias("n"))
    assert streams.refresh_rollup(events, store, f"{tmp_path}/c", ["asset"], rollup, lambda: spark.read.parquet(f"{tmp_path}/in/*")).awaitTermination(120)
    assert {tuple(r) for r in store.read().collect()} == {(1, 2), (2, 1)}


def test_events_up_to_a_slot(spark, tmp_path):
    rows = [("A", "{}", "s", n, None, 0, 0) for n in range(6)]
    from tallyforge.sources.tables import EVENTS, read_events

    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/e")
    assert read_events(spark, f"{tmp_path}/e").count() == 6
    query = stream_events(spark, f"{tmp_path}/e", stop_slot=3).writeStream.format("memory").queryName("upto").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and spark.table("upto").count() == 4


@pytest.mark.parametrize("chain", ["feedback", "revoke"])
def test_running_chains(spark, tmp_path, chain):
    leaf = lambda a, n: bytes([a, n] * 16)
    parts = [[("a", 0, leaf(1, 0)), ("b", 0, leaf(2, 0)), ("a", 1, leaf(1, 1))], [("a", 1, leaf(1, 1)), ("a", 2, leaf(1, 2))]]
    events = files(spark, f"{tmp_path}/in", parts, "agent string, position long, leaf binary")
    query = streams.extend_chains(events, "agent", chain).writeStream.format("memory").queryName(f"chains_{chain}").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r["agent"], r["position"]): bytes(r["digest"]) for r in spark.table(f"chains_{chain}").collect()}
    for a, code, n in (("a", 1, 3), ("b", 2, 1)):
        digest = bytes(32)
        for k in range(n):
            digest = hashes.keccak_batch([digest + hashes.LINK_DOMAIN[chain].encode() + leaf(code, k)])[0]
            assert got[a, k] == digest
    assert len(got) == 4


def test_late_positions_are_given_out(spark, tmp_path):
    leaf = lambda n: bytes([7, n] * 16)
    parts = [[("a", 0, leaf(0)), ("a", 4, leaf(4))], [("a", 2, leaf(2)), ("a", 4, leaf(4)), ("a", 5, leaf(5))], [("a", 2, leaf(2)), ("a", 1, leaf(1))]]
    events = files(spark, f"{tmp_path}/in", parts, "agent string, position long, leaf binary")
    query = streams.extend_chains(events, "agent", "feedback").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted((r["position"], r["late"], r["digest"] is None) for r in spark.table("late").collect())
    assert got == [(0, False, False), (1, True, True), (2, True, True), (4, False, False), (5, False, False)]
