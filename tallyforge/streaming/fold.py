"""Streams of events folded into stored tables, idempotent whatever is delivered again."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import hashes, scalar
from ..operators.fold import batch_cursor, expire, merge, stage
from .store import Store

#: How a stream runs: all that is there and then an end, or on and on.
CATCH_UP, TAIL = {"availableNow": True}, {"processingTime": "500 milliseconds"}


def _run(events: DataFrame, checkpoint: str, one: Callable[[DataFrame, int], None], trigger: dict) -> StreamingQuery:
    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def fold_stream(events: DataFrame, store: Store, checkpoint: str, project: Callable[[DataFrame], DataFrame], policies: dict[str, str], order: Column | None = None, trigger: dict = CATCH_UP) -> StreamingQuery:
    """Folds a stream into a stored table: each batch's projection is merged into the buckets that it touches.

    The checkpoint's path names the stream in the store. A batch that comes again
    is skipped; a new checkpoint on an old table folds what it reads again, which
    changes nothing if the policies are idempotent. With `order` a late event
    doesn't undo a later one (policy `guarded`).
    """

    def one(batch: DataFrame, number: int) -> None:
        store.apply(project(batch), checkpoint, number, lambda old, new: merge(old, new, store.keys, policies, order))

    return _run(events, checkpoint, one, trigger)


def fold_with_staging(children: DataFrame, table: Store, staged: Store, parents: Callable[[], DataFrame], on: list[str], checkpoint: str, policies: dict[str, str], max_age_ms: int | None = None, slot: str = "slot", trigger: dict = CATCH_UP) -> StreamingQuery:
    """Children with a parent go to the table, early ones wait in `staged`; each batch also promotes those whose parent has come since.

    With max_age_ms staged rows go when they are that much older, in slots, than
    the batch's newest. parents() is read anew for each batch. Rows are keyed by
    the stores' keys; a row that comes again overwrites itself.
    """
    whole = {c: "overwrite" for c in table.spark.createDataFrame([], table.schema).columns if c not in table.keys}

    def one(batch: DataFrame, number: int) -> None:
        there, early = stage(batch, parents(), on)
        waiting = staged.read()
        come, _ = stage(waiting, parents(), on)
        last = lambda df: df.groupBy(*table.keys).agg(*[F.max_by(c, scalar.guard(slot=slot)).alias(c) for c in whole])
        table.apply(last(there.unionByName(come.select(*there.columns))), checkpoint, number, lambda old, new: merge(old, new, table.keys, policies))
        newest = batch.agg(F.max(slot).alias("n")).first()["n"]  # one row

        def rest(old: DataFrame, new: DataFrame) -> DataFrame:
            kept = stage(merge(old, last(new), staged.keys, whole), parents(), on)[1]
            return expire(kept, newest, max_age_ms, slot) if max_age_ms is not None and newest is not None else kept

        # rows that were promoted lie in buckets that the batch need not touch: they are given to it too
        staged.apply(early.unionByName(waiting.select(*early.columns)), checkpoint, number, rest)

    return _run(children, checkpoint, one, trigger)


def advance_cursors(events: DataFrame, cursors: Store, name: str, checkpoint: str, trigger: dict = CATCH_UP) -> StreamingQuery:
    """Keeps the highest place of the events seen under a name (cursors: name, slot, tx_index, tx_signature); it never goes back."""
    place = F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")).alias(c) for c in ("slot", "tx_index")], F.coalesce("tx_signature", F.lit("")).alias("tx_signature"))

    def one(batch: DataFrame, number: int) -> None:
        new = batch_cursor(batch, place).where("cursor IS NOT NULL").select(F.lit(name).alias("name"), "cursor.*")
        cursors.apply(new, checkpoint, number, lambda old, rows: merge(old, rows, ["name"], {c: "guarded" for c in ("slot", "tx_index", "tx_signature")}, place))

    return _run(events, checkpoint, one, trigger)


def backfill_then_tail(events: DataFrame, start: Callable[[DataFrame, dict], StreamingQuery], timeout: int | None = None) -> StreamingQuery:
    """Catches up with all that is there, in batches, and only then goes on live, from the same checkpoint; start(events, trigger) begins a query."""
    first = start(events, CATCH_UP)
    if not first.awaitTermination(timeout) and timeout is not None:
        first.stop()
        raise TimeoutError("the backfill isn't done")
    return start(events, TAIL)


def refresh_rollup(events: DataFrame, store: Store, checkpoint: str, keys: list[str], rollup: Callable[[DataFrame], DataFrame], source: Callable[[], DataFrame], trigger: dict = CATCH_UP) -> StreamingQuery:
    """Counts the statistics of the keys that a batch touches again, from source(); others stay as they are."""

    def one(batch: DataFrame, number: int) -> None:
        touched = batch.select(*keys).distinct()
        fresh = rollup(source().join(touched, keys, "left_semi"))
        store.apply(fresh, checkpoint, number, lambda old, new: merge(old, new, store.keys, {c: "overwrite" for c in old.columns if c not in store.keys}))

    return _run(events, checkpoint, one, trigger)


def extend_chains(events: DataFrame, by: str, chain: str, position: str = "position") -> DataFrame:
    """by, position, digest, late of each event as it comes: state is each chain's last digest and position, and the positions that it passed over.

    Events (by, position, leaf) of a chain come in order of position from batch
    to batch; within one they are sorted. One at a position that the chain passed
    over comes too late to be hashed into what follows: it is given out without
    a digest and as late, and the chain must be verified anew from there. One at
    a position that was there before is a repeated delivery and gives no row.
    """
    domain = hashes.LINK_DOMAIN[chain].encode()
    kind = dict(events.dtypes)[by]

    def step(key, pieces, state):
        digest, last, gaps = state.get if state.exists else (bytes(32), -1, "[]")
        open_ = json.loads(gaps)  # ranges of positions, ends included
        rows = pd.concat(list(pieces)).sort_values(position)
        out = []
        for at, leaf in zip(rows[position].tolist(), rows["leaf"], strict=True):
            if at > last:
                if last >= 0 and at > last + 1:
                    open_.append([last + 1, at - 1])
                digest, last = hashes.keccak_one(bytes(digest) + domain + bytes(leaf)), at
                out.append((key[0], at, digest, False))
                continue
            gap = next((g for g in open_ if g[0] <= at <= g[1]), None)
            if gap is not None:
                open_.remove(gap)
                open_ += [g for g in ([gap[0], at - 1], [at + 1, gap[1]]) if g[0] <= g[1]]
                out.append((key[0], at, None, True))
        state.update((digest, last, json.dumps(open_)))
        yield pd.DataFrame(out, columns=[by, position, "digest", "late"])

    return events.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, {position} long, digest binary, late boolean", "digest binary, last long, gaps string", "append", "NoTimeout")
