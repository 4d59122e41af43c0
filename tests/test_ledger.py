"""All tables from one stream: crashes between tables, transactions that cannot be read, gaps, totals."""

import json

import pytest
from pyspark.sql import functions as F
from test_fold import at, compare, log, raw, replay, rows_of

from tallyforge.operators import ranges, rollups
from tallyforge.sources import tables
from tallyforge.streaming import ledger


def stream(spark, path, batches):
    for n, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(f"{path}/{n:03d}")
    return spark.readStream.schema(tables.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


class Crash(Exception):
    pass


def test_a_crash_after_each_table_heals(spark, tmp_path, monkeypatch):
    """The batch fails after one table, then after two, and so on, and each time comes again; the tables end as by a replay."""
    story = log(5, 120)
    want = replay(story)
    first, second = raw(spark, story[:70]), raw(spark, story[70:])
    book = ledger.Ledger(spark, f"file://{tmp_path}/book", buckets=2)
    assert ledger._batch(book, first, "s", 0) and not ledger._batch(book, first, "s", 0)
    before = {name: rows_of(book.read(name), name) for name in ("agents", "feedbacks")}
    put = ledger.Ledger._put
    names = list(ledger.SCHEMAS)
    for k in (1, 4, 9, len(names)):
        left = [k]

        def failing(self, name, *rest, left=left):
            if not left[0]:
                raise Crash
            left[0] -= 1
            return put(self, name, *rest)

        monkeypatch.setattr(ledger.Ledger, "_put", failing)
        if k < len(names):
            with pytest.raises(Crash):
                ledger._batch(book, second, "s", 1)
            assert {name: rows_of(book.read(name), name) for name in before} == before
        else:
            assert ledger._batch(book, second, "s", 1)
    compare({name: book.read(name) for name in want}, want)
    totals = {r["asset"]: (r["feedback_count"], r["raw_avg_score"]) for r in rollups.from_totals(book.read("feedback_totals")).collect()}
    assert totals == {a: (r["feedback_count"], r["raw_avg_score"]) for a, r in want["agents"].items() if a in totals}
    assert all(r["feedback_count"] == 0 for a, r in want["agents"].items() if a not in totals)
    used = {f.rsplit("/", 1)[0] for which in (-1, -2) for t in book._commit(which)["tables"].values() for f in t["folders"].values()}
    assert {"/".join(f.rsplit("/", 2)[1:]) for f, _ in book._list("*/*")} == used  # nothing of the failed attempts stays


def test_gaps_and_unread_transactions_hold_the_ledger_back(spark, tmp_path):
    new = lambda a, slot, s, **more: ("AgentRegistered", dict(asset=a, collection="C", owner="o", agentUri="") | more, slot, 0, 0, s)
    fetched = lambda a, b: (ledger.FETCHED, {"from": a, "to": b}, a, 0, 0, f"f{a}")
    broken = ("UriUpdated", {"asset": "B"}, 4, 1, 1, "t4")
    batches = [
        [new("A", 1, "t1"), fetched(0, 3)],
        [new("B", 4, "t4"), broken, fetched(4, 9)],  # one event of t4 cannot be read
        [new("C", 15, "t15"), fetched(14, 20)],  # 10 to 13 are missing
        [new("D", 12, "t12"), fetched(10, 13)],
        [new("B", 4, "t4"), ("UriUpdated", {"asset": "B", "newUri": "u", "updatedBy": "o"}, 4, 1, 1, "t4")],
    ]
    book = ledger.Ledger(spark, f"file://{tmp_path}/book", buckets=1)
    seen = []
    for n, batch in enumerate(batches):
        ledger._batch(book, raw(spark, batch), "s", n)
        seen.append((book.complete(), sorted(r["asset"] for r in book.read("agents").collect())))
    assert seen == [(3, ["A"]), (3, ["A"]), (3, ["A", "C"]), (3, ["A", "C", "D"]), (20, ["A", "B", "C", "D"])]
    entry = book.read("event_log").collect()
    assert [(r["tx_signature"], r["slot"], r["event_type"], r["processed"]) for r in entry] == [("t4", 4, "UriUpdated", True)] and "missing" in entry[0]["error"]
    assert [tuple(r) for r in book.read("fetched").collect()] == [(0, 20)]


def test_the_stream_equals_the_replay_and_buckets_grow(spark, tmp_path):
    story = log(6, 90)
    book = ledger.Ledger(spark, f"file://{tmp_path}/book", buckets=1, largest=1)
    query = ledger.fold_ledger(stream(spark, f"{tmp_path}/in", [raw(spark, story[:40]), raw(spark, story[40:65]), raw(spark, story[65:])]), book, f"{tmp_path}/c")
    assert query.awaitTermination(600) is True
    want = replay(story)
    compare({name: book.read(name) for name in want}, want)
    assert book._commit()["tables"]["feedbacks"]["buckets"] > 1 and len(book._list("commit-*.json")) == 2


def test_islands_gaps_and_ends(spark):
    rows = [("a", 5, 9), ("a", 1, 3), ("a", 4, 4), ("a", 12, 11), ("a", 20, 22), ("a", 21, 30), ("a", 31, 31), ("b", 7, 7), ("b", None, 3), ("a", 1, 3)]
    frame = spark.createDataFrame(rows, "source string, from_slot long, to_slot long")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(ranges.islands(frame, ["source"])) == [("a", 1, 9), ("a", 20, 31), ("b", 7, 7)]
    assert got(ranges.gaps(frame, ["source"])) == [("a", 10, 19)]
    assert got(ranges.first_end(frame, ["source"])) == [("a", 9), ("b", 7)]
    assert got(ranges.first_end(frame.where("false"))) == []


def test_totals_by_signed_steps(spark):
    schema = "asset string, client_address string, score int, is_revoked boolean, status string"
    old = spark.createDataFrame([("a", "1", 10, False, "PENDING"), ("a", "2", 20, False, "PENDING"), ("b", "1", None, False, "PENDING")], schema)
    new = spark.createDataFrame([("a", "1", 10, True, "PENDING"), ("a", "2", 20, False, "FINALIZED"), ("b", "1", None, False, "ORPHANED"), ("c", "1", 7, False, "PENDING")], schema)
    totals = spark.createDataFrame([("a", 2, 2, 30), ("b", 1, 0, 0)], rollups.TOTALS)
    got = {r["asset"]: tuple(r)[1:] for r in rollups.add_totals(totals, rollups.total_steps(old, new)).collect()}
    assert got == {"a": (1, 1, 20), "b": (0, 0, 0), "c": (1, 1, 7)}
    assert rollups.total_steps(new, new).isEmpty()
    assert {r["asset"]: r["raw_avg_score"] for r in rollups.from_totals(totals.unionByName(spark.createDataFrame([("d", 3, 2, 5)], rollups.TOTALS))).collect()} == {"a": 15, "b": 0, "d": 3}
