"""Ranges of slots: what is covered without a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, from_slot, to_slot of the maximal runs of slots that ranges (by, from_slot, to_slot; ends included) cover.

    Ranges may overlap, touch, repeat or come in any order; one that ends before
    it begins, or lacks an end, covers nothing. Without `by` all ranges are sorted
    in one task: a row for each fetch, of which few are left after each merge.
    """
    by = by or []
    whole = ranges.where("to_slot >= from_slot").select(*by, "from_slot", "to_slot")
    order = Window.partitionBy(*by).orderBy("from_slot", "to_slot")
    before = F.max("to_slot").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("from_slot") > before + 1), 1).otherwise(0)
    named = whole.withColumn("_new", starts).withColumn("_island", F.sum("_new").over(order))
    return named.groupBy(*by, "_island").agg(F.min("from_slot").alias("from_slot"), F.max("to_slot").alias("to_slot")).drop("_island")


def first_end(ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, end: the last slot of the first island, up to which nothing is missing; no row without ranges."""
    found = islands(ranges, by)
    keys = by or []
    got = found.groupBy(*keys).agg(F.min_by("to_slot", "from_slot").alias("end"))
    return got.where(F.col("end").isNotNull())


def gaps(ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, from_slot, to_slot of what is missing between islands."""
    order = Window.partitionBy(*(by or [])).orderBy("from_slot")
    after = islands(ranges, by).withColumn("_next", F.lead("from_slot").over(order))
    return after.where("_next IS NOT NULL").select(*(by or []), (F.col("to_slot") + 1).alias("from_slot"), (F.col("_next") - 1).alias("to_slot"))
