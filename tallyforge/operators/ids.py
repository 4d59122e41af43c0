"""Gapless sequential ids, within scopes and over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpoint


def _numbered(rows: DataFrame, scope: list[str], order: list[Column], held: Column, new: Column, number: str, most: str) -> DataFrame:
    """rows with the number of each new row within its scope, from 1 in order, and the highest id (`held`) of its scope, 0 without one.

    Rows are sorted in ranges of scope and order, so that a large scope lies in
    several of them. A range's rows are numbered apart. The scopes that go over
    more than one range, of which each range has two at most, are summed up over
    their ranges; those few sums are broadcast.
    """
    ranged = checkpoint(rows.withColumns({"_held": held, "_new": new}).repartitionByRange(*scope, *order).withColumn("_p", F.spark_partition_id()))
    parts = ranged.groupBy("_p", *scope).agg(F.count_if("_new").alias("_n"), F.max("_held").alias("_m"))
    whole = Window.partitionBy(*scope)
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    over = parts.select("_p", *scope, F.sum("_n").over(before).alias("_before"), F.max("_m").over(whole).alias("_most"), F.count("*").over(whole).alias("_parts"))
    over = over.where("_parts > 1").select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_scope_{c}") for c in scope], "_before", "_most")
    same = F.col("_p") == F.col("_q")
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"_scope_{c}"))
    near = Window.partitionBy("_p", *scope)
    placed = ranged.withColumns({"_k": F.row_number().over(Window.partitionBy("_p", *scope, "_new").orderBy(*order)), "_own": F.max("_held").over(near)})
    got = placed.join(F.broadcast(over), same, "left")
    got = got.withColumns({number: F.when(F.col("_new"), F.col("_k") + F.coalesce("_before", F.lit(0))), most: F.coalesce("_most", "_own", F.lit(0))})
    return got.drop("_held", "_new", "_p", "_q", "_k", "_own", "_before", "_most", *[f"_scope_{c}" for c in scope])


def assign_ids(rows: DataFrame, scope: list[str], order: list[Column], column: str, eligible: Column | None = None) -> DataFrame:
    """Rows that lack an id get the scope's largest id and their rank among those; ids that exist stay. No task holds a whole scope."""
    new = F.col(column).isNull() & (F.coalesce(eligible, F.lit(True)) if eligible is not None else F.lit(True))
    got = _numbered(rows, scope, order, F.col(column), new, "_number", "_top")
    return got.withColumn(column, F.coalesce(F.col("_top") + F.col("_number"), F.col(column))).select(*rows.columns)


def number_globally(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """rows numbered from 1 in order: ranges are sorted apart, and a running sum over their sizes gives each one's offset."""
    ranged = checkpoint(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_o"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_k", rank).join(F.broadcast(offsets), "_p").withColumn(column, F.col("_o") + F.col("_k")).drop("_p", "_k", "_o")


def assign_global_ids(rows: DataFrame, order: list[str], column: str, eligible: Column | None = None) -> DataFrame:
    """Rows that lack an id and are eligible get the highest id there is and their number in order; ids that exist stay. Without the column all rows are new."""
    if column not in rows.columns:
        rows = rows.withColumn(column, F.lit(None).cast("long"))
    new = F.col(column).isNull() & (F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True))
    most = rows.agg(F.coalesce(F.max(column), F.lit(0)).alias("_most"))
    numbered = number_globally(rows.where(new).drop(column), order, "_number").crossJoin(F.broadcast(most))  # one row
    return rows.where(~new).unionByName(numbered.withColumn(column, F.col("_most") + F.col("_number")).select(*rows.columns))


def repair_ids(rows: DataFrame, order: list[str], column: str, key: str) -> DataFrame:
    """key and the id that a full numbering in order gives, of the rows whose id differs from it."""
    right = number_globally(rows, order, "_right")
    return right.where(~F.col(column).eqNullSafe(F.col("_right"))).select(key, F.col("_right").alias(column))


def audit_gapless(rows: DataFrame, scope: list[str], column: str, needed: Column | None = None) -> DataFrame:
    """Scopes whose ids, of all rows that hold one, aren't 1 to n; and with `needed`, scopes with rows that should hold one and don't (`missing`).

    Ids are whole numbers. Different ones (`kinds`) are counted exactly by masks
    of 64 neighbours, so that no row is kept for each id.
    """
    held = F.col(column).isNotNull()
    missing = F.count_if(needed & ~held) if needed is not None else F.lit(0).cast("long")
    bit = F.pmod(F.col(column), F.lit(64)).cast("int")
    # the rows without an id go with the first mask
    blocks = rows.withColumn("_block", F.coalesce(F.col(column) - F.pmod(F.col(column), F.lit(64)), F.lit(0))).groupBy(*scope, "_block")
    part = blocks.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_mask"), missing.alias("missing"))
    a = part.groupBy(*scope).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.coalesce(F.sum(F.bit_count("_mask")), F.lit(0)).cast("long").alias("kinds"), F.sum("missing").alias("missing"))
    found = a.where("(n > 0 AND (lo <> 1 OR hi <> n OR kinds <> n)) OR missing > 0")
    return found if needed is not None else found.drop("missing")


def counters(rows: DataFrame, scope: list[str], column: str, name: str | None = None) -> DataFrame:
    """The next id of each scope; with a name, as scope texts `name:a:b`."""
    found = rows.groupBy(*scope).agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_value"))
    return found if name is None else found.select(F.concat_ws(":", F.lit(name), *[F.col(c).cast("string") for c in scope]).alias("scope"), "next_value")
