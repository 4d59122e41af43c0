"""All entity tables folded from one stream of events, a batch at a time, with one commit for all of them.

Each table lies in buckets of its key's hash. A batch writes new folders for the
buckets that it touches of each table, and last of all one small commit file
that names every table's folders, the batch's number, and how far the ledger is
complete. Until that file has its name a reader, and the batch when it comes
again after a crash, sees the tables as they were before all of it. Folders that
neither of the last two commits names are removed. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import events, projections, ranges, rollups
from ..sources.shared import checkpoint, scope
from .fold import CATCH_UP

#: Tables beside those of the fold: transactions that couldn't be read, totals of feedback, slots that were fetched.
MORE = {
    "event_log": "tx_signature string, slot long, tx_index int, event_type string, error string, processed boolean",
    "feedback_totals": rollups.TOTALS,
    "fetched": "from_slot long, to_slot long",
}
KEYS = projections.KEYS | {"event_log": ["tx_signature"], "feedback_totals": ["asset"], "fetched": ["from_slot"]}
SCHEMAS = projections.TABLES | MORE
#: A raw event of this name says that the slots from `from` to `to` were fetched whole.
FETCHED = "SlotsFetched"


class Ledger:
    """The tables below `path`, a folder that driver and executors share. A table whose largest bucket exceeds `largest` bytes gets twice as many in the next batch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 4, largest: int = 256 << 20):
        self.spark, self.path, self.buckets, self.largest = spark, path.rstrip("/"), buckets, largest

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _list(self, pattern: str) -> list[tuple[str, int]]:
        store, path = self._at(pattern)
        return sorted((s.getPath().toString(), s.getLen()) for s in store.globStatus(path) or [])

    def _commit(self, which: int = -1) -> dict:
        """The last commit (-1) or the one before it (-2)."""
        found = self._list("commit-*.json")
        if len(found) < -which:
            return {"version": -1, "streams": {}, "complete": None, "tables": {}}
        return json.loads(self.spark.read.text(found[which][0], wholetext=True).first()[0])

    def _rows(self, name: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = state["tables"].get(name, {}).get("folders", {})
        wanted = [f"{self.path}/{f}" for b, f in folders.items() if buckets is None or int(b) in buckets]
        if not wanted:
            return self.spark.createDataFrame([], SCHEMAS[name]).where(F.lit(False))
        return self.spark.read.schema(SCHEMAS[name]).parquet(*wanted)

    def read(self, name: str) -> DataFrame:
        """A table as the last commit left it."""
        return self._rows(name, self._commit())

    def complete(self) -> int | None:
        """The last slot up to which, from the first one fetched, every slot was fetched and every transaction folded; null before any."""
        return self._commit()["complete"]

    def apply(self, made: dict[str, tuple[DataFrame, DataFrame]], state: dict, stream: str, number: int, complete: Callable[[dict[str, DataFrame]], int | None]) -> None:
        """Puts the rows of each table in place of those whose keys are gone, and commits."""
        after = state | {"version": state["version"] + 1, "streams": state["streams"] | {stream: number}, "tables": {}}
        for name, (rows, gone) in made.items():
            after["tables"][name] = self._put(name, rows, gone, state["tables"].get(name, {"buckets": self.buckets, "folders": {}, "want": self.buckets}))
        after["complete"] = complete({name: self._rows(name, after) for name in MORE})
        store, last = self._at(f"commit-{after['version']:09d}.json")
        _, new = self._at(f".commit-{uuid.uuid4().hex}")
        out = store.create(new, True)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        if not store.rename(new, last):
            raise RuntimeError(f"another writer has committed {last}")
        self._sweep({f.rsplit("/", 1)[0] for c in (after, state) for t in c["tables"].values() for f in t["folders"].values()})

    def _put(self, name: str, rows: DataFrame, gone: DataFrame, table: dict) -> dict:
        rows, gone = checkpoint(rows), checkpoint(gone.distinct())
        count, folders = table["want"], table["folders"]
        bucket = F.pmod(F.xxhash64(*KEYS[name]), F.lit(count)).cast("int")
        touched = {r[0] for part in (rows, gone) for r in part.select(bucket).distinct().collect()}  # numbers of buckets
        if count != table["buckets"]:
            touched = set(range(count))
            old = self._rows(name, {"tables": {name: table}})
            folders = {}
        else:
            old = self._rows(name, {"tables": {name: table}}, list(touched))
        if not touched:
            return table
        folder = f"{name}/{uuid.uuid4().hex}"
        fresh = projections.over(old, rows, gone, KEYS[name]).withColumn("_bucket", bucket)
        fresh.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        sizes: dict[int, int] = {}
        for file, size in self._list(f"{folder}/_bucket=*/*.parquet"):
            b = int(file.rsplit("/", 2)[1].split("=")[1])
            sizes[b] = sizes.get(b, 0) + size
        kept = {b: f for b, f in folders.items() if int(b) not in touched}
        return {"buckets": count, "want": 2 * count if max(sizes.values(), default=0) > self.largest else count, "folders": kept | {str(b): f"{folder}/_bucket={b}" for b in sizes}}

    def _sweep(self, used: set[str]) -> None:
        for folder, _ in self._list("*/*"):
            if "/".join(folder.rsplit("/", 2)[1:]) not in used:
                store, path = self._at("/".join(folder.rsplit("/", 2)[1:]))
                store.delete(path, True)
        for file, _ in self._list("commit-*.json")[:-2]:
            store, path = self._at(file.rsplit("/", 1)[1])
            store.delete(path, True)


def _batch(ledger: Ledger, batch: DataFrame, stream: str, number: int) -> bool:
    """Folds a batch of raw events into all tables; False if it is in already."""
    state = ledger._commit()
    if number <= state["streams"].get(stream, -1):
        return False
    with scope(ledger.spark):
        batch = checkpoint(batch)
        read = events.wide(batch)
        # a transaction with an event that cannot be read is set aside whole, until it comes again and can be
        reason = F.lit("a needed field is missing or cannot be read")
        bad = read.where(~F.col("ok")).groupBy("tx_signature").agg(F.min("slot").alias("slot"), F.min("tx_index").alias("tx_index"), F.min("name").alias("event_type"))
        bad = checkpoint(bad.select("*", reason.alias("error"), F.lit(False).alias("processed")))
        good = batch.join(bad.select("tx_signature"), "tx_signature", "left_anti")
        stored = {name: ledger._rows(name, state) for name in SCHEMAS}
        made, _ = projections.changes(good, stored)
        healed = stored["event_log"].where("NOT processed").join(good.select("tx_signature").distinct(), "tx_signature", "left_semi").withColumn("processed", F.lit(True))
        log = bad.unionByName(healed)
        made["event_log"] = (log, log.select("tx_signature"))
        rows, keys = made["feedbacks"]
        before = stored["feedbacks"].join(keys, projections.FEEDBACK_KEY, "left_semi")
        totals = rollups.add_totals(stored["feedback_totals"], rollups.total_steps(before, rows))
        made["feedback_totals"] = (totals, totals.select("asset"))
        told = F.from_json("data", "`from` long, `to` long")
        new = batch.where(F.col("name") == FETCHED).select(told.alias("t")).select(F.col("t.from").alias("from_slot"), F.col("t.to").alias("to_slot")).dropna()
        made["fetched"] = (ranges.islands(stored["fetched"].unionByName(new)), stored["fetched"].select("from_slot"))
        ledger.apply(made, state, stream, number, _complete)
    return True


def _complete(tables: dict[str, DataFrame]) -> int | None:
    """The end of the first unbroken range of slots, or the slot before the first transaction that is set aside."""
    end = ranges.first_end(tables["fetched"]).first()
    stop = tables["event_log"].where("NOT processed").agg(F.min("slot")).first()[0]
    if end is None:
        return None
    return end["end"] if stop is None else min(end["end"], stop - 1)


def fold_ledger(raw: DataFrame, ledger: Ledger, checkpoint_path: str, trigger: dict = CATCH_UP) -> StreamingQuery:
    """Folds a stream of raw events (sources.tables.EVENTS) into all tables of a ledger; the checkpoint's path names the stream.

    Batches come in the order of the ledger, one file or more at a time. A
    transaction that holds an event which cannot be read goes into event_log and
    folds nothing; when it is delivered again whole it folds, and is processed.
    Events of FETCHED say what was fetched. complete() stays below the first gap
    and below the first such transaction, whatever comes later.
    """

    def one(batch: DataFrame, number: int) -> None:
        _batch(ledger, batch, checkpoint_path, number)

    return raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint_path).trigger(**trigger).start()
