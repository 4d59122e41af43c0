"""Statistics of agents and collections: joins on aggregates, so that no row fans out before it is counted."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import active
from .rollups import status_counts

KEY = ["asset", "client_address", "feedback_index"]


def _zero(*columns: str) -> dict[str, Column]:
    return {c: F.coalesce(c, F.lit(0).cast("long")) for c in columns}


def with_digest_counts(agents: DataFrame, cache: DataFrame) -> DataFrame:
    """agents with total_feedback, response and revocation counts: the cached ones, else their own feedback count, else 0."""
    kept = cache.select("asset", F.col("feedback_count").alias("_f"), F.col("response_count").alias("_r"), F.col("revoke_count").alias("_v"))
    zero = F.lit(0).cast("long")
    rows = agents.join(kept, "asset", "left")
    return rows.withColumns({"total_feedback": F.coalesce("_f", "feedback_count", zero), "total_responses": F.coalesce("_r", zero), "total_revocations": F.coalesce("_v", zero)}).drop("_f", "_r", "_v")


def feedback_stats(feedbacks: DataFrame, by: list[str]) -> DataFrame:
    """Scores that count (not orphaned, not revoked, not null): number, rounded average, positive from 50 on, negative."""
    good = feedbacks.where(active() & ~F.col("is_revoked") & F.col("score").isNotNull())
    return good.groupBy(*by).agg(
        F.count("*").alias("scores"), F.round(F.avg("score")).cast("long").alias("avg_score"), F.count_if(F.col("score") >= 50).alias("positive"), F.count_if(F.col("score") < 50).alias("negative")
    )


def with_stats(agents: DataFrame, feedbacks: DataFrame, validations: DataFrame) -> DataFrame:
    """The reputation of agents: scores, average, positive, negative and validations.

    An agent of whom no feedback row is known has its stored count and average
    (null if the count is 0), as its feedback may be elsewhere.
    """
    seen = feedbacks.groupBy("asset").agg(F.lit(True).alias("_seen"))
    checked = validations.where(active("chain_status")).groupBy("asset").agg(F.count("*").alias("validation_count"))
    rows = agents.join(feedback_stats(feedbacks, ["asset"]), "asset", "left").join(seen, "asset", "left").join(checked, "asset", "left")
    stored = F.when(F.col("_seen").isNull(), F.col("feedback_count"))
    count = F.coalesce("scores", stored, F.lit(0)).cast("long")
    mean = F.when(count > 0, F.coalesce("avg_score", F.when(F.col("_seen").isNull(), F.col("raw_avg_score"))))
    return rows.withColumns({"avg_score": mean.cast("long"), "scores": count, **_zero("positive", "negative", "validation_count")}).drop("_seen")


def pointer_agents(pointers: DataFrame, agents: DataFrame) -> DataFrame:
    """Pointers with the agents that hold them: equal col, and creator equal to the agent's creator, else owner."""
    mine = agents.where(active()).select(F.col("canonical_col").alias("col"), F.coalesce("creator", "owner").alias("creator"), "asset", "created_at")
    return pointers.join(mine, ["col", "creator"])


def collection_agents(pointers: DataFrame, agents: DataFrame, feedbacks: DataFrame, validations: DataFrame, collection_id: int, limit: int = 100, offset: int = 0) -> DataFrame:
    """The agents of one collection with their reputation, newest first."""
    held = pointer_agents(pointers.where(F.col("collection_id") == collection_id), agents).select("asset")
    mine = agents.join(held, "asset", "left_semi")
    scored = with_stats(mine, feedbacks.join(held, "asset", "left_semi"), validations.join(held, "asset", "left_semi"))
    return scored.orderBy(F.desc_nulls_last("created_at"), F.desc("asset")).offset(offset).limit(limit)


def collection_stats(collections: DataFrame, agents: DataFrame, feedbacks: DataFrame, collection: str | None = None, include_orphaned: bool = False, by_agents: bool = False, first: int = 50) -> DataFrame:
    """collection, collection_type, agent_count, total_feedbacks, avg_score: the newest `first`, or those of most agents, or one by name.

    A collection that is named but not registered is of type USER.
    """
    keep = lambda df: df if include_orphaned else df.where(active())
    a, f, c = keep(agents), keep(feedbacks), collections
    if collection is not None:
        a = a.where(F.col("collection") == collection)
        named = collections.sparkSession.range(1).select(F.lit(collection).alias("collection"))
        c = named.join(collections, "collection", "left").withColumn("collection_type", F.coalesce("collection_type", F.lit("USER")))
    counts = a.groupBy("collection").agg(F.count("*").alias("agent_count"))
    scores = f.join(a.select("asset", "collection"), "asset").groupBy("collection").agg(F.count("*").alias("total_feedbacks"), F.round(F.avg("score")).cast("long").alias("avg_score"))
    rows = c.join(counts, "collection", "left").join(scores, "collection", "left").withColumns(_zero("agent_count", "total_feedbacks"))
    order = [F.desc("agent_count"), F.col("collection")] if by_agents else [F.desc_nulls_last("created_at"), F.col("collection")]
    return rows.select("collection", "collection_type", "agent_count", "total_feedbacks", "avg_score", "created_at").orderBy(*order).limit(first)


def global_stats(agents: DataFrame, pointers: DataFrame, feedbacks: DataFrame, include_orphaned: bool = False) -> DataFrame:
    """One row of totals: agents, collections, feedbacks, agents of tiers 4 and 3, rounded average quality of agents with feedback."""
    keep = lambda df: df if include_orphaned else df.where(active())
    tier = lambda n: F.count_if(F.col("trust_tier") == n)
    quality = F.round(F.avg(F.when(F.col("feedback_count") > 0, F.col("quality_score")))).cast("long")
    parts = [
        keep(agents).agg(F.count("*").alias("total_agents"), tier(4).alias("tier4"), tier(3).alias("tier3"), quality.alias("avg_quality")),
        pointers.agg(F.count("*").alias("total_collections")),
        keep(feedbacks).agg(F.count("*").alias("total_feedbacks")),
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each


def verification_stats(tables: dict[str, DataFrame], staged: dict[str, DataFrame] | None = None) -> DataFrame:
    """model, pending, finalized, orphaned of each table, staged rows counted with the orphaned."""
    counts = status_counts(**tables)
    if not staged:
        return counts
    waiting = reduce(DataFrame.unionByName, [df.agg(F.lit(m).alias("model"), F.count("*").alias("_n")) for m, df in staged.items()])
    rows = counts.join(F.broadcast(waiting), "model", "left")  # a row a model
    return rows.withColumn("orphaned", F.col("orphaned") + F.coalesce("_n", F.lit(0))).drop("_n")


def readiness(tables: dict[str, DataFrame], staged: dict[str, DataFrame], cursor_slot: Column, head_slot: Column, most_behind: int = 150) -> DataFrame:
    """One row: rows, pending and orphaned of all tables, staged rows, and whether the cursor is more than most_behind slots behind."""
    models = verification_stats(tables)
    total = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")) for df in tables.values()]).agg(F.sum("n").alias("total"))
    waiting = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")) for df in staged.values()]).agg(F.sum("n").alias("staged"))
    summed = models.agg(F.sum("pending").alias("pending"), F.sum("orphaned").alias("orphaned"))
    return summed.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(waiting)).withColumn("backlog", head_slot - cursor_slot > most_behind)  # one row each


def agent_stats(assets: DataFrame, feedbacks: DataFrame) -> DataFrame:
    """Of each requested asset the count, average value and last time of feedback that is neither revoked nor orphaned; without any 0 and nulls.

    Values are texts of whole numbers with decimals of their own; the average is in double.
    """
    good = feedbacks.where(active() & ~F.col("is_revoked"))
    value = F.col("value").cast("double") / F.pow(F.lit(10.0), F.col("value_decimals"))
    stats = good.join(assets.select("asset"), "asset", "left_semi").groupBy("asset").agg(F.count("*").alias("n"), F.avg(value).alias("avg_value"), F.max("created_at").alias("last_at"))
    return assets.select("asset").distinct().join(stats, "asset", "left").withColumns(_zero("n"))


def feedback_counts(assets: DataFrame, feedbacks: DataFrame) -> DataFrame:
    """Of each requested asset the number of feedback that is neither revoked nor orphaned."""
    good = feedbacks.where(active() & ~F.col("is_revoked")).join(assets.select("asset"), "asset", "left_semi")
    return assets.select("asset").distinct().join(good.groupBy("asset").agg(F.count("*").alias("n")), "asset", "left").withColumns(_zero("n"))


def last_activity(assets: DataFrame, feedbacks: DataFrame) -> DataFrame:
    """Of each requested asset the time of its last feedback that isn't orphaned, revoked or not."""
    last = feedbacks.where(active()).join(assets.select("asset"), "asset", "left_semi").groupBy("asset").agg(F.max("created_at").alias("last_activity"))
    return assets.select("asset").distinct().join(last, "asset", "left")


def registered_docs(metadata: DataFrame, agents: DataFrame) -> DataFrame:
    """The rows of metadata that documents gave, of agents that aren't orphaned."""
    return metadata.where(F.startswith("key", F.lit("_uri:"))).join(agents.where(active()).select("asset"), "asset", "left_semi")


def latest_registration(metadata: DataFrame, agents: DataFrame, first: int = 100) -> DataFrame:
    """The time of the newest document row of each agent, newest first."""
    return registered_docs(metadata, agents).groupBy("asset").agg(F.max("updated_at").alias("updated_at")).orderBy(F.desc("updated_at"), "asset").limit(first)


def tiers(agents: DataFrame) -> DataFrame:
    return agents.groupBy("trust_tier").agg(F.count("*").alias("n"))


def with_parent(children: DataFrame, feedbacks: DataFrame) -> DataFrame:
    """children with parent_status and parent_hash of their feedback; null without one."""
    return children.join(feedbacks.select(*KEY, F.col("status").alias("parent_status"), F.col("seal_hash").alias("parent_hash")), KEY, "left")


def with_revoked_at(feedbacks: DataFrame, revocations: DataFrame) -> DataFrame:
    """Feedback with the time of its last revocation, if it is revoked."""
    gone = revocations.groupBy(*KEY).agg(F.max("created_at").alias("_at"))
    return feedbacks.join(gone, KEY, "left").withColumn("revoked_at", F.when(F.col("is_revoked"), F.col("_at"))).drop("_at")


def with_seed(rows: DataFrame, most: DataFrame, column: str = "seed") -> DataFrame:
    """rows and the one value of `most` (a table of one row and column), 0 if it is null."""
    return rows.crossJoin(F.broadcast(most.select(F.coalesce(F.col(most.columns[0]), F.lit(0)).alias(column))))  # one row


def first_seen(rows: DataFrame, keys: list[str], order: Column, first: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    """Of each key the given columns of its first row, those of its last, and the number of rows, in one aggregate."""
    return rows.groupBy(*keys).agg(*[F.min_by(c, order).alias(f"first_{c}") for c in first], *[F.max_by(c, order).alias(f"last_{c}") for c in last], F.count("*").alias("n"))


def distinct_on(rows: DataFrame, keys: list[Column], order: list[Column], after: Column | None = None, first: int | None = None) -> DataFrame:
    """The first row of each key in order; from after a key on, and only so many, in order of keys."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    rows = rows if after is None else rows.where(after)
    n = F.row_number().over(Window.partitionBy(*named).orderBy(*order))
    got = rows.withColumns(named).withColumn("_n", n).where("_n = 1")
    return (got if first is None else got.orderBy(*named).limit(first)).drop(*named, "_n")


def multi_get(asked: DataFrame, table: DataFrame, on: list[str], most_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of table for each asked key, and `found`; a key without a row is kept with nulls. Few keys go to the table by broadcast."""
    keys = asked.select(*on).distinct()
    few = keys.limit(most_broadcast + 1).count() <= most_broadcast
    hits = table.join(F.broadcast(keys) if few else keys, on, "left_semi")
    return keys.join(hits.withColumn("found", F.lit(True)), on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_staged(live: DataFrame, staged: DataFrame) -> DataFrame:
    """Live and staged rows of a chain, told apart by `staged`; columns that one side lacks are null."""
    return live.withColumn("staged", F.lit(False)).unionByName(staged.withColumn("staged", F.lit(True)), allowMissingColumns=True)
