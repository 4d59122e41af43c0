"""Aggregates over agents, feedback and statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import active


def feedback_rollup(feedbacks: DataFrame, by: list[str]) -> DataFrame:
    """Count of feedback that isn't revoked, whatever its status, and the rounded average score (0 if none)."""
    live = ~F.col("is_revoked")
    return feedbacks.groupBy(*by).agg(F.count_if(live).alias("feedback_count"), F.coalesce(F.round(F.avg(F.when(live, F.col("score")))), F.lit(0)).cast("long").alias("raw_avg_score"))


#: Totals from which counts and averages follow without reading the feedback again.
TOTALS = "asset string, feedback_count long, scored long, score_sum long"


def total_steps(before: DataFrame, after: DataFrame) -> DataFrame:
    """asset, and the signed changes of its totals, from the old and the new rows of the feedback that changed: what was inserted, revoked, orphaned or recovered."""
    live = (~F.col("is_revoked") & active()).cast("long")
    scored = F.when(F.col("score").isNotNull(), live).otherwise(0)
    part = lambda df, sign: df.select("asset", (sign * live).alias("n"), (sign * scored).alias("scored"), (sign * scored * F.coalesce("score", F.lit(0))).alias("total"))
    steps = part(before, -1).unionByName(part(after, 1)).groupBy("asset").agg(F.sum("n").alias("n"), F.sum("scored").alias("scored"), F.sum("total").alias("total"))
    return steps.where("n <> 0 OR scored <> 0 OR total <> 0")


def add_totals(totals: DataFrame, steps: DataFrame) -> DataFrame:
    """The TOTALS of the assets that steps change."""
    zero = F.lit(0).cast("long")
    old = totals.withColumnsRenamed({"scored": "_scored"})
    rows = steps.join(old, "asset", "left")
    return rows.select("asset", (F.coalesce("feedback_count", zero) + F.col("n")).alias("feedback_count"), (F.coalesce("_scored", zero) + F.col("scored")).alias("scored"), (F.coalesce("score_sum", zero) + F.col("total")).alias("score_sum"))


def from_totals(totals: DataFrame) -> DataFrame:
    """asset, feedback_count, raw_avg_score (0 without scores) of TOTALS."""
    mean = F.when(F.col("scored") > 0, F.round(F.col("score_sum") / F.col("scored"))).otherwise(0)
    return totals.select("asset", "feedback_count", mean.cast("long").alias("raw_avg_score"))


def reputation(agents: DataFrame, feedbacks: DataFrame, key: str = "asset") -> DataFrame:
    """agents with score count, rounded average, positive and negative counts; null average without scores."""
    good = feedbacks.where(active() & ~F.col("is_revoked") & F.col("score").isNotNull())
    stats = good.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("score")).cast("long").alias("avg_score"), F.count_if(F.col("score") >= 50).alias("positive"), F.count_if(F.col("score") < 50).alias("negative"))
    joined = agents.join(stats, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "positive", "negative")})


def leaderboard(agents: DataFrame, first: int, least_tier: int = 2, collection: str | None = None, include_orphaned: bool = False) -> DataFrame:
    """The agents of a tier and up, by sort_key and then asset: of one collection if it is given, and without orphaned ones, where agents have a status."""
    rows = agents.where(F.col("trust_tier") >= least_tier)
    if collection is not None:
        rows = rows.where(F.col("collection") == collection)
    if "status" in agents.columns and not include_orphaned:
        rows = rows.where(F.coalesce(active(), F.lit(True)))
    return rows.orderBy(F.desc("sort_key"), "asset").limit(first)


def leaderboard_reputation(agents: DataFrame, feedbacks: DataFrame, first: int, least_tier: int = 2, **which) -> DataFrame:
    """The reputation of the first agents of the leaderboard, 1000 at most: their keys are broadcast to the feedback, of which nothing else is summed up."""
    board = leaderboard(agents, min(first, 1000), least_tier, **which)
    return reputation(board, feedbacks.join(F.broadcast(board.select("asset")), "asset", "left_semi"))


def totals(**counts: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """One row: each table's aggregates, one pass a table."""
    parts = [df.agg(*[c.alias(f"{name}_{k}") for k, c in aggs.items()]) for name, (df, aggs) in counts.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each


def status_counts(**tables: DataFrame) -> DataFrame:
    """A row for each table with its numbers of pending, finalized and orphaned rows."""
    one = lambda name, df: df.agg(F.lit(name).alias("model"), *[F.count_if(F.col("status") == s.upper()).alias(s) for s in ("pending", "finalized", "orphaned")])
    return reduce(DataFrame.unionByName, [one(k, v) for k, v in tables.items()])


def distinct_tags(feedbacks: DataFrame, columns: list[str], first: int) -> DataFrame:
    """Distinct tags of several columns, in order."""
    tags = feedbacks.select(F.explode(F.array(*columns)).alias("tag")).where("tag IS NOT NULL AND tag <> ''")
    return tags.distinct().orderBy("tag").limit(first)


def collection_stats(collections: DataFrame, agents: DataFrame, feedbacks: DataFrame) -> DataFrame:
    """Agents, feedback and average score of each collection, aggregated before the joins so that no row fans out."""
    a = agents.groupBy("collection").agg(F.count("*").alias("agent_count"))
    f = feedbacks.join(agents.select("asset", "collection"), "asset").groupBy("collection").agg(F.count("*").alias("total_feedbacks"), F.round(F.avg("score")).cast("long").alias("avg_score"))
    return collections.join(a, "collection", "left").join(f, "collection", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("agent_count", "total_feedbacks")})


def pivot_keys(rows: DataFrame, by: str, key: str, value: Column, keys: list[str]) -> DataFrame:
    """One row for each `by` and a column for each key, by one aggregate instead of a join a key."""
    return rows.groupBy(by).agg(*[F.max(F.when(F.col(key) == k, value)).alias(k) for k in keys])
