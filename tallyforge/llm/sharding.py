"""Consistent placement of documents on shards by a permutation-filled lookup table.

Each shard walks its own permutation of the slots of a prime-sized table (an
offset and a skip that hash its name), and the shards take turns claiming their
next free slot, until none is free. A document's key hashes to a slot. Shares
differ by less than one slot a turn, and adding or removing a shard moves few
other slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_hash, unused

#: The table's size: prime, and over 100 slots for each of hundreds of shards.
SLOTS = 65_537
SHARDS = 64


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The shard (its place in `shards`) of every slot. slots must be prime and no fewer than the shards."""
    if not shards or len(set(shards)) != len(shards) or slots < len(shards):
        raise ValueError("shards must be distinct, at least one, at most as many as slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not prime")
    seeds = [hashlib.sha256(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(h[:8], "big") % slots for h in seeds]
    skip = [int.from_bytes(h[8:16], "big") % (slots - 1) + 1 for h in seeds]
    turn = [0] * len(shards)
    table = [-1] * slots
    free = slots
    while free:
        for k in range(len(shards)):
            while True:
                at = (offset[k] + turn[k] * skip[k]) % slots
                turn[k] += 1
                if table[at] < 0:
                    break
            table[at] = k
            free -= 1
            if not free:
                break
    return np.array(table, np.int32)


def place(docs: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """docs with columns slot and shard (columns of these names are replaced).

    The slot is xxhash64 of `key` modulo the table's size. Equal keys share a
    shard; rows with a null key are dealt out by a hash of all their columns, so
    only equal ones share one for certain. The table has `slots` rows whatever
    the input, so it is broadcast, and the documents aren't shuffled.
    """
    spark = docs.sparkSession
    table = lookup_table(shards, slots)
    rows = spark.createDataFrame([(s, shards[k]) for s, k in enumerate(table.tolist())], "slot int, shard string")
    docs = docs.drop("slot", "shard")
    hashed = F.when(F.col(key).isNull(), row_hash(docs, 2)).otherwise(F.xxhash64(key))
    keyed = docs.withColumn("slot", F.pmod(hashed, F.lit(slots)).cast("int"))
    return keyed.join(F.broadcast(rows), "slot")


def write_shards(docs: DataFrame, path: str, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS, files: int = 8) -> None:
    """Writes the placed documents in one folder for each shard; `files` tasks share a shard, by a hash of the whole row."""
    placed = place(docs, shards, key, slots)
    (part,) = unused(placed, "part")
    placed.withColumn(part, F.pmod(row_hash(docs, 3), F.lit(files))).repartition("shard", part).drop(part).write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = [f"shard-{k:03d}" for k in range(SHARDS)]
    return place(docs, names).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "slot", "shard")


QUERIES = {"op4_sharding": op4_sharding}
SQL: dict[str, str] = {}
