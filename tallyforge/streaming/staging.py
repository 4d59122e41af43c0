"""Early children that wait for their parent in keyed state: what a batch reads doesn't depend on how many wait."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs, as a setting of the session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: What tells parents from children in the union of both; a name that doesn't begin with an underscore, as rows lose such ones.
KIND = "staging_kind"


class Waiting(StatefulProcessor):
    """Of each parent: whether it is there, and the children that wait, by their own key, the last one of each. A timer lets those go that waited too long."""

    def __init__(self, columns: list[str], keys: list[str], order: list[str], at: str, most: datetime.timedelta | None, child: T.StructType):
        self.columns, self.keys, self.order, self.at, self.most, self.child = columns, keys, order, at, most, child

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "known boolean")
        name = T.StructType([self.child[k] for k in self.keys])
        self.waiting = handle.getMapState("waiting", name, self.child)

    def _rows(self, rows: list[tuple], outcome: str) -> pd.DataFrame:
        return pd.DataFrame([(*r, outcome) for r in rows], columns=[*self.columns, "outcome"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        came = self.known.exists()
        last: dict[tuple, tuple] = {}
        for piece in rows:
            came = came or bool((piece[KIND] == "parent").any())
            children = piece[piece[KIND] == "child"]
            for r in children[self.columns].itertuples(index=False, name=None):
                r = tuple(None if x is pd.NaT or (isinstance(x, float) and x != x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r)
                k = tuple(r[self.columns.index(c)] for c in self.keys)
                place = lambda x: tuple((x[self.columns.index(c)] is not None, x[self.columns.index(c)]) for c in self.order)
                if k not in last or place(r) >= place(last[k]):
                    last[k] = r
        if came:
            if not self.known.exists():
                self.known.update((True,))
                held = {tuple(k): tuple(v) for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
                last = held | last
                self.waiting.clear()
                if self.most is not None:
                    for timer in list(self.handle.listTimers()):
                        self.handle.deleteTimer(timer)
            if last:
                yield self._rows(list(last.values()), "promoted")
            return
        for k, r in last.items():
            self.waiting.updateValue(k, r)
            if self.most is not None and r[self.columns.index(self.at)] is not None:
                self.handle.registerTimer(int((r[self.columns.index(self.at)].replace(tzinfo=datetime.timezone.utc) + self.most).timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        old = []
        for k, r in list(self.waiting.iterator()):
            at = r[self.columns.index(self.at)]
            if at is not None and (at.replace(tzinfo=datetime.timezone.utc) + self.most).timestamp() * 1000 <= now:
                old.append(tuple(r))
                self.waiting.removeKey(tuple(k))
        if old:
            yield self._rows(old, "expired")

    def close(self) -> None:
        pass


def stage_children(parents: DataFrame, children: DataFrame, on: list[str], keys: list[str], order: list[str], at: str, most: datetime.timedelta | None = None, delay: str = "0 seconds") -> DataFrame:
    """The children of a stream, each with `outcome`: promoted once its parent has come (at once if it is there), or expired.

    parents (columns on) and children (on, keys, order, at and others) are
    streams. A child that waits is replaced by a later one, in `order`, of the
    same keys; a repeated delivery of a promoted one is promoted again, which an
    upsert by its keys doesn't mind. With `most` a child that is so much older
    than the newest event, by `at` and the watermark's delay, expires; a parent
    that comes after that doesn't find it. State is kept for each parent apart,
    and a batch reads that of the parents it names. Children without a parent
    key have none. The session needs STATE_STORE.
    """
    child = children.schema
    columns = child.names
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in child if f.name not in on]
    told = parents.select(*on, *[c for c, f in zip(none, [f for f in child if f.name not in on], strict=True) if f.name != at], *([F.col(at)] if at in parents.columns else [F.lit(None).cast("timestamp").alias(at)]), F.lit("parent").alias(KIND))
    both = children.withColumn(KIND, F.lit("child")).unionByName(told.select(*columns, KIND)).dropna(subset=on)
    processor = Waiting(columns, keys, order, at, most, child)
    output = T.StructType([*child.fields, T.StructField("outcome", T.StringType())])
    timed = both.withWatermark(at, delay) if most is not None else both
    return timed.groupBy(*on).transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime" if most is not None else "None")
