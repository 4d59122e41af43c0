"""Shared pieces: Arrow text access, vectorised word hashing, draws of rows; and the shared folder's functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..sources.shared import checkpoint, drop, fresh_folder, remove, scope, shared_dir  # noqa: F401

#: Bytes of text that one vectorised step holds at a time; a longer text makes a step of its own.
STEP_BYTES = 1 << 21
#: Characters that separate words, as in [\x20\x09-\x0D].
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def crc_mod(column: str, k: int):
    """crc32 of the id as text, modulo k; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % k, F.lit(0)).cast("int")


def crc32_sql(column: str) -> str:
    """crc32 of a column as text in DuckDB's SQL, bit by bit; for ASCII."""
    bits = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))"
    codes = f"list_transform(string_split({column}::VARCHAR, ''), lambda s: unicode(s)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: {bits}), 4294967295::BIGINT)"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that df has no column of, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame, seed: int) -> Column:
    """A 64-bit hash of all columns of a row, nulls told apart from what is beside them; maps, which have none, as their entries in order."""
    plain = lambda f: F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`")
    return F.xxhash64(F.lit(seed), *[x for f in df.schema.fields for x in (plain(f), F.col(f"`{f.name}`").isNull())])


def draw(docs: DataFrame, by: str, most: int, labels: DataFrame | None = None) -> list[Row]:
    """doc_id, text, `by` of at most `most` distinct documents of each value of `by`, a column of docs or of labels (doc_id, by): those with the lowest hashes of id and text.

    Hashes are uniform, so a class of n labels finds its documents below a share
    of 2 * most / n of all hashes; where repeated or missing ones leave too few,
    the share grows. No task reads a whole class, and texts aren't shuffled: the
    few drawn are broadcast to them. Nulls in any of the three columns aren't
    drawn. What comes to the driver is bounded in rows for each class, not in
    bytes: whole texts.
    """
    keys = ["_one", "_two"]
    spark = docs.sparkSession
    own = [] if labels is not None else [by]
    labels = (docs if labels is None else labels).select("doc_id", by).dropna()
    hashed = docs.select("doc_id", "text", *own).dropna().withColumns({"_one": F.xxhash64("doc_id", "text"), "_two": F.xxhash64(F.lit(1), "text", "doc_id")})
    share = {r[by]: min(1.0, 2 * most / r["count"]) for r in labels.groupBy(by).count().collect()}
    if not share:
        return []
    kind = labels.select(by).schema.add("_share", "double")
    low = lambda s: F.col("_one") / float(1 << 63) < 2 * s - 1
    while True:
        cut = F.broadcast(spark.createDataFrame(list(share.items()), kind))
        near = hashed.where(low(F.lit(max(share.values())))).select("doc_id", *own, *keys)
        near = near if own else near.join(labels, "doc_id")
        few = checkpoint(near.join(cut, by).where(low(F.col("_share"))).select(by, *keys).dropDuplicates())
        got = {r[by]: r["count"] for r in few.groupBy(by).count().collect()}
        short = [c for c, s in share.items() if s < 1 and got.get(c, 0) < most]
        if not short:
            break
        share.update({c: min(1.0, 16 * share[c]) for c in short})
    picked = few.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*keys))).where(F.col("_k") <= most).select(by, *keys)
    picked = spark.createDataFrame(picked.collect(), picked.schema)
    drawn = hashed.join(F.broadcast(picked), [*own, *keys]).dropDuplicates([by, *keys])
    return sorted(drawn.select("doc_id", "text", by).collect(), key=lambda r: (r["doc_id"], r["text"], r[by]))


def slices(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of batch whose texts hold at most `most` bytes together, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one array, and the offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    got = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return got, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], np.uint64))[0])


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, STEP_BYTES + 1024)
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry than rows); `between` marks the bytes that aren't part of one."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    full = ~between[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = full.copy()
    begins[1:] &= ~full[:-1] | edge[1:-1]
    stops = full.copy()
    stops[:-1] &= ~full[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z as a-z if lower), and each row's first word."""
    starts, ends, first = word_spans(data, offsets, between)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), first
