"""Hash chains: verification in parallel, heads, checkpoints, replay pages, gaps, comparison with an authority.

A chain's rows have a position, a leaf (32 bytes) and, mostly, a stored digest
(32 bytes). A digest hashes the one before, the chain's domain and the leaf, so
a stored digest can be checked against the stored one before it: no row waits
for another but where stored digests are missing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashes
from ..functions.scalar import guard
from .fold import merge

#: What a chain starts from: 32 zero bytes.
GENESIS = bytes(32)
#: Positions that one window goes over.
CHUNK = 100_000
#: Fixed value: events between checkpoints.
INTERVAL = 1000


@dataclass(frozen=True)
class Hash:
    """A hash as a function of columns, and of lists of byte strings."""

    column: Callable[[Column], Column]
    batch: Callable[[list[bytes]], list[bytes]]


KECCAK = Hash(hashes.keccak256, hashes.keccak_batch)
SHA256 = Hash(lambda m: F.unhex(F.sha2(m, 256)), lambda ms: [hashlib.sha256(m).digest() for m in ms])


def leaves(rows: DataFrame, chain: str) -> DataFrame:
    """rows with `leaf`, the hash of asset, client_address (32 bytes each), feedback_index, seal_hash, slot and, of responses, responder and response_hash."""
    more = (F.col("responder"), F.col("response_hash")) if chain == "response" else ()
    data = hashes.leaf(chain, F.col("asset"), F.col("client_address"), F.col("feedback_index"), F.col("seal_hash"), F.col("slot"), *more)
    return rows.withColumn("leaf", hashes.keccak256(data))


def digests(rows: DataFrame, by: list[str], position: str, chain: str = "feedback", ties: list[Column] | None = None, seeds: DataFrame | None = None, hash: Hash = KECCAK, checkpoints: DataFrame | None = None) -> DataFrame:
    """rows with `number` (from 1 on in its chain), `computed` (the digest that follows from the stored ones before) and `bad`.

    Order is by position, then by `ties` (canonical, nulls lowest, if not given,
    where the columns exist). A long chain is cut into ranges of CHUNK positions;
    each begins with what the ranges before it end with, from one row a range. A
    row whose predecessor has no stored digest is folded from the last stored
    one on, in step with all other such runs of its task, with one digest a run
    held. `seeds` (by, count, digest) says where chains begin that aren't
    verified from their start. `checkpoints` (by, count, digest) stand for the
    stored digests that rows lack: a chain without any is cut at them into pieces
    that are folded apart, and held against each one. Null leaves make null
    digests.
    """
    rows = _linked(rows, by, position, ties, seeds, checkpoints)
    alone = F.col("_step") == 1
    given = F.col("_given").isNotNull()
    direct = rows.where(alone & given).withColumn("computed", hash.column(hashes.link(chain, F.col("_before"), F.col("leaf"))))
    runs = rows.where(~alone | ~given).repartition(*by, "_run").sortWithinPartitions(*by, "_run", "_step")
    got = direct.unionByName(runs.mapInArrow(_folded(by, chain, hash.batch), rows.withColumn("computed", F.lit(None).cast("binary")).schema))
    bad = given & ~F.col("_given").eqNullSafe(F.col("computed"))
    return got.withColumn("bad", bad).drop("_step", "_run", "_before", "_given")


def pieces(rows: DataFrame, by: list[str], position: str, **options) -> int:
    """How many pieces digests() folds apart, each of which may be another task's."""
    made = {"ties": None, "seeds": None, "checkpoints": None} | options
    return _linked(rows, by, position, **made).select(*by, "_run").distinct().count()


def _linked(rows: DataFrame, by: list[str], position: str, ties: list[Column] | None, seeds: DataFrame | None, checkpoints: DataFrame | None) -> DataFrame:
    """rows with number, _given (the digest stored for them), _before (the one given last before them), _run (its number), _step (how far behind it)."""
    order = [F.col(position), *(ties if ties is not None else [guard()] if {"slot", "tx_index", "event_ordinal", "tx_signature"} <= set(rows.columns) else [])]
    if seeds is not None:
        rows = rows.join(seeds.select(*by, F.col("count").alias("_seed_n"), F.col("digest").alias("_seed")), by, "left")
    else:
        rows = rows.withColumns({"_seed_n": F.lit(None).cast("long"), "_seed": F.lit(None).cast("binary")})
    rows = rows.withColumn("_chunk", F.floor(F.col(position) / CHUNK))
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
    rows = rows.withColumn("_k", F.row_number().over(inside).cast("long"))
    n = F.coalesce("_seed_n", F.lit(0).cast("long"))
    across = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    if checkpoints is None:
        rows = rows.withColumn("_given", F.col("digest"))
    else:
        sizes = rows.groupBy(*by, "_chunk").agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n")
        marks = checkpoints.groupBy(*by, F.col("count").alias("_c")).agg(F.min("digest").alias("_mark"))
        rows = rows.join(sizes, [*by, "_chunk"]).withColumn("_c", n + F.col("_o") + F.col("_k")).join(marks, [*by, "_c"], "left").withColumn("_given", F.coalesce("digest", "_mark")).drop("_o", "_c", "_mark")
    stored = F.when(F.col("_given").isNotNull(), F.struct(F.col("_k").alias("k"), F.col("_given").alias("d")))
    rows = rows.withColumn("_last", F.last(stored, ignorenulls=True).over(Window.partitionBy(*by, "_chunk").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)))
    ends = rows.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"), F.max_by(stored, F.when(F.col("_given").isNotNull(), F.col("_k"))).alias("_end"))
    ends = ends.withColumn("_offset", F.coalesce(F.sum("_n").over(across), F.lit(0)))
    ended = F.when(F.col("_end").isNotNull(), F.struct((F.col("_offset") + F.col("_end.k")).alias("k"), F.col("_end.d").alias("d")))
    ends = ends.withColumn("_from", F.last(ended, ignorenulls=True).over(across)).select(*by, "_chunk", "_offset", "_from")
    rows = rows.join(ends, [*by, "_chunk"])
    start = F.coalesce(F.col("_last.k") + F.col("_offset"), F.col("_from.k"), F.lit(0).cast("long"))
    rows = rows.withColumns({"_step": F.col("_offset") + F.col("_k") - start, "_run": start, "number": n + F.col("_offset") + F.col("_k")})
    rows = rows.withColumn("_before", F.coalesce("_last.d", "_from.d", "_seed", F.lit(GENESIS)))
    return rows.drop("_chunk", "_k", "_last", "_offset", "_from", "_seed", "_seed_n")


def _folded(by: list[str], chain: str, batch_hash: Callable):
    domain = hashes.LINK_DOMAIN[chain].encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come run by run, each in order of its steps: of the task one digest is held."""
        held: tuple[tuple, bytes | None] | None = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*by, "_run")), strict=True))
            step, before, leaf = (batch.column(c).to_pylist() for c in ("_step", "_before", "leaf"))
            out: list[bytes | None] = []
            for key, k, b, x in zip(keys, step, before, leaf, strict=True):
                from_ = b if k == 1 else held[1] if held is not None and held[0] == key else None
                digest = batch_hash([bytes(from_) + domain + bytes(x)])[0] if from_ is not None and x is not None else None
                out.append(digest)
                held = key, digest
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "computed"])

    return run


def verify_chain(rows: DataFrame, by: list[str], position: str, chain: str = "feedback", **options) -> DataFrame:
    """by, events (rows, those before a seed included), valid, first_mismatch (number of the first bad row, null if none), digest (of the last row; null if the chain isn't valid).

    What follows a bad row isn't hashed on from a digest that is known to be
    wrong, so a broken chain has no final digest here; digests() has those that
    the stored ones imply. Staged rows belong to a chain: union them first.
    """
    found = digests(rows, by, position, chain, **options)
    got = found.groupBy(*by).agg(F.max("number").alias("events"), F.min(F.when(F.col("bad"), F.col("number"))).alias("first_mismatch"), F.max_by("computed", "number").alias("digest"))
    valid = F.col("first_mismatch").isNull()
    return got.withColumns({"valid": valid, "digest": F.when(valid, F.col("digest"))})


def verify_incremental(rows: DataFrame, checkpoints: DataFrame, by: list[str], position: str, chain: str = "feedback", target: int | None = None, first: int = 1, **options) -> DataFrame:
    """verify_chain() from each chain's latest checkpoint (by, count, digest) up to `target` on; `first` is the position of the first event (feedback counts from 0)."""
    seeds = latest_checkpoints(checkpoints if target is None else checkpoints.where(F.col("count") <= target), by)
    todo = rows.join(seeds.select(*by, F.col("count").alias("_done")), by, "left").where(F.col(position) - first + 1 > F.coalesce("_done", F.lit(0))).drop("_done")
    return verify_chain(todo, by, position, chain, seeds=seeds, **options)


def checkpoints(digests: DataFrame, by: list[str], interval: int = INTERVAL, *more: str) -> DataFrame:
    """by, count, digest and further columns of every row whose number is a multiple of interval."""
    return digests.where(F.col("number") % interval == 0).select(*by, F.col("number").alias("count"), F.col("computed").alias("digest"), *more)


def latest_checkpoints(checkpoints: DataFrame, by: list[str]) -> DataFrame:
    """The one of the highest count of each chain."""
    return checkpoints.groupBy(*by).agg(F.max("count").alias("count"), F.max_by("digest", "count").alias("digest"))


def store_checkpoints(stored: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """The checkpoints with new ones put in; a count that is there already takes the new digest."""
    return merge(stored, new.select(*by, "count", "digest"), [*by, "count"], {"digest": "overwrite"})


def heads(rows: DataFrame, by: list[str], position: str, digest: str | Column = "digest", chain: str = "feedback", canonical: bool = False) -> DataFrame:
    """by, count, digest of each chain: feedback counts from 0, so its count is the highest position and one; of others it is the highest.

    The digest is the last one stored: last by position, or, with canonical, in
    the order of the ledger, nulls lowest.
    """
    d = F.col(digest) if isinstance(digest, str) else digest
    last = F.struct(guard(), F.col(position)) if canonical else F.col(position)
    count = F.max(position) + (1 if chain == "feedback" else 0)
    return rows.groupBy(*by).agg(count.cast("long").alias("count"), F.max_by(d, F.when(d.isNotNull(), last)).alias("digest"))


def replay_page(rows: DataFrame, by: list[str], position: str, start: int = 0, stop: int | None = None, first: int = INTERVAL) -> DataFrame:
    """The first `first` rows of each chain with positions in [start, stop), with has_more and next_from (the position after the page's last row).

    Without a stop the range ends at start + first + 1, so that positions with
    gaps may end a page early.
    """
    first = max(1, min(first, INTERVAL))
    inside = rows.where((F.col(position) >= start) & (F.col(position) < (start + first + 1 if stop is None else stop)))
    w = Window.partitionBy(*by).orderBy(position)
    page = inside.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first + 1)
    whole = Window.partitionBy(*by)
    page = page.withColumns({"has_more": F.max("_n").over(whole) > first, "next_from": F.max(F.when(F.col("_n") <= first, F.col(position))).over(whole) + 1})
    return page.where(F.col("_n") <= first).drop("_n")


def latest_signature(heads: DataFrame, by: list[str]) -> DataFrame:
    """The signature of the newest of an agent's heads (rows of by, slot, tx_signature) by slot; ties to the higher signature."""
    return heads.groupBy(*by).agg(F.max_by("tx_signature", F.struct(F.coalesce("slot", F.lit(-1)), "tx_signature")).alias("tx_signature"))


def digest_cache(cache: DataFrame, authority: DataFrame, key: str = "asset") -> DataFrame:
    """The cache with an authority's counts and digests put in, whole rows by agent."""
    columns = [c for c in cache.columns if c != key]
    return merge(cache, authority.select(key, *columns), [key], {c: "overwrite" for c in columns})


def gaps(rows: DataFrame, by: list[str], position: str) -> DataFrame:
    """The places after which positions are missing, and how many."""
    after = F.lead(position).over(Window.partitionBy(*by).orderBy(position))
    return rows.withColumn("missing", after - F.col(position) - 1).where("missing > 0").select(*by, position, "missing")


def compare_heads(ours: DataFrame, authority: DataFrame, by: list[str]) -> DataFrame:
    """The verdict on each of our heads (count, digest) against the authority's (auth_count, auth_digest)."""
    d, n, ad, an = (F.col(c) for c in ("digest", "count", "auth_digest", "auth_count"))
    verdict = (
        F.when(an.isNull(), "keep").when(d.isNull() & (an == 0), "ok").when(d.isNull(), "keep").when(n < an, "behind").when(n > an, "exceeds").when(d == ad, "ok").otherwise("mismatch")
    )
    return ours.join(authority, by, "left").withColumn("verdict", verdict)
