"""Folding ordered events into tables: keyed projections, merges, staging of early children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("overwrite", "keep", "coalesce", "or", "greatest", "guarded")


def project(events: DataFrame, keys: list[str], order: Column, last: dict[str, Column] | None = None, first: dict[str, Column] | None = None) -> DataFrame:
    """A row for each key with values of its last and first event in `order` (a comparable, unique struct), by partial aggregates."""
    aggs = [F.max_by(v, order).alias(k) for k, v in (last or {}).items()] + [F.min_by(v, order).alias(k) for k, v in (first or {}).items()]
    return events.groupBy(*keys).agg(*aggs)


def last_non_null(value: Column, order: Column) -> Column:
    """The last value that isn't null."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def merge(target: DataFrame, batch: DataFrame, keys: list[str], policies: dict[str, str], order: Column | None = None) -> DataFrame:
    """target upserted by batch (one row a key on either side), each column by its policy.

    Keys compare as values, so that a null key meets a null key. `guarded` takes
    the batch's column where the batch's `order` (a comparable struct of columns
    that both sides have) is no lower than the target's: a late row changes
    nothing.
    """
    sides = {"t": target, "b": batch}
    if order is not None:
        sides = {k: df.withColumn("_order", order) for k, df in sides.items()}
    t, b = (df.withColumn("_there", F.lit(True)).alias(k) for k, df in sides.items())
    there = lambda side: F.col(f"{side}._there").isNotNull()
    newer = there("b") & (~there("t") | (F.col("b._order") >= F.col("t._order"))) if order is not None else F.lit(None)
    how = {
        "overwrite": lambda c: F.when(there("b"), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")),
        "keep": lambda c: F.when(there("t"), F.col(f"t.{c}")).otherwise(F.col(f"b.{c}")),
        "coalesce": lambda c: F.coalesce(f"b.{c}", f"t.{c}"),
        "or": lambda c: F.coalesce(f"b.{c}", F.lit(False)) | F.coalesce(f"t.{c}", F.lit(False)),
        "greatest": lambda c: F.greatest(f"t.{c}", f"b.{c}"),
        "guarded": lambda c: F.when(newer, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")),
    }
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = t.join(b, on, "full")
    return joined.select(*[F.when(there("t"), F.col(f"t.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys], *[how[p](c).alias(c) for c, p in policies.items()])


def metadata_state(ops: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Set and delete operations (op, value, immutable) folded: after an immutable set nothing but a delete counts, and a delete begins anew."""
    deleted = ops.where("op = 'delete'").groupBy(*keys).agg(F.max(order).alias("cut"))
    live = ops.where("op = 'set'").join(deleted, keys, "left").where(F.col("cut").isNull() | (order > F.col("cut")))
    fixed = live.groupBy(*keys).agg(F.min(F.when(F.col("immutable"), order)).alias("stop"))
    good = live.join(fixed, keys).where(F.col("stop").isNull() | (order <= F.col("stop")))
    return good.groupBy(*keys).agg(F.max_by("value", order).alias("value"), F.bool_or("immutable").alias("immutable"))


def stage(children: DataFrame, parents: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(children with a parent, children to stage)."""
    keys = parents.select(*on).distinct()
    return children.join(keys, on, "left_semi"), children.join(keys, on, "left_anti")


def stage_last(children: DataFrame, parents: DataFrame, on: list[str], keys: list[str], order: Column) -> tuple[DataFrame, DataFrame]:
    """(children with a parent, the last row of each key of those to stage)."""
    there, early = stage(children, parents, on)
    columns = [c for c in children.columns if c not in keys]
    return there, project(early, keys, order, last={c: F.col(c) for c in columns}).select(*children.columns)


def promotion_order(*ties: str, slot="slot", tx="tx_index", ordinal="event_ordinal") -> Column:
    """The order in which staged rows are promoted: a missing slot first, a missing index or ordinal last."""
    far = (1 << 31) - 1
    parts = [F.coalesce(F.col(c).cast("long"), F.lit(d).cast("long")).alias(c) for c, d in ((slot, 0), (tx, far), (ordinal, far))]
    return F.struct(*parts, *[F.coalesce(F.col(t).cast("string"), F.lit("")).alias(t) for t in ties])


def promote(staged: DataFrame, parents: DataFrame, on: list[str], keys: list[str] | None = None, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(staged children whose parent has come, those that go on waiting); with keys, of each key the last one in order, as the others are overwritten at once."""
    come, wait = stage(staged, parents, on)
    if keys is not None:
        columns = [c for c in staged.columns if c not in keys]
        come = project(come, keys, order if order is not None else promotion_order(), last={c: F.col(c) for c in columns}).select(*staged.columns)
    return come, wait


def cascade(staged_feedbacks: DataFrame, staged_responses: DataFrame, revocations: DataFrame, feedbacks: DataFrame, agents: DataFrame) -> dict[str, DataFrame]:
    """What follows when agents come: their feedback is promoted, then the responses to it, then revocations of it are pending again.

    feedbacks and responses (promoted), staged_feedbacks and staged_responses
    (still waiting), revocations (all, with their status). Rows name their agent
    in asset, their feedback in asset, client_address, feedback_index.
    """
    key = ["asset", "client_address", "feedback_index"]
    new, waiting = promote(staged_feedbacks, agents, ["asset"], key, promotion_order("created_at", "id"))
    parents = feedbacks.select(*key).unionByName(new.select(*key)).distinct()
    answers, early = promote(staged_responses, parents, key, [*key, "responder", "tx_signature"], promotion_order("tx_signature", "id"))
    return {"feedbacks": new, "staged_feedbacks": waiting, "responses": answers, "staged_responses": early, "revocations": reconcile_revocations(revocations, parents)}


def reconcile_revocations(revocations: DataFrame, feedbacks: DataFrame) -> DataFrame:
    """Orphaned revocations whose feedback is there are pending; the feedback isn't marked as revoked by that."""
    key = ["asset", "client_address", "feedback_index"]
    rows = revocations.join(feedbacks.select(*key).distinct().withColumn("_p", F.lit(True)), key, "left")
    return rows.withColumn("status", F.when((F.col("status") == "ORPHANED") & F.col("_p"), "PENDING").otherwise(F.col("status"))).drop("_p")


def migrate_orphans(responses: DataFrame, feedbacks: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses that stay, staged with the orphaned ones that have no id and no feedback added)."""
    key = ["asset", "client_address", "feedback_index"]
    old = (F.col("status") == "ORPHANED") & F.col("response_id").isNull()
    lost = F.coalesce(old, F.lit(False)) & F.col("_p").isNull()
    rows = responses.join(feedbacks.select(*key).distinct().withColumn("_p", F.lit(True)), key, "left")
    moved = rows.where(lost).drop("_p")
    fresh = moved.select(*[c for c in staged.columns if c in moved.columns]).join(staged.select(*key, "responder", "tx_signature"), [*key, "responder", "tx_signature"], "left_anti")
    return rows.where(~lost).drop("_p"), staged.unionByName(fresh, allowMissingColumns=True)


def expire(staged: DataFrame, last_slot: int, max_age_ms: int, slot: str = "slot") -> DataFrame:
    return staged.where(F.col(slot) >= last_slot - -(-max_age_ms // 400))


def advance_cursor(current: Column, incoming: Column) -> Column:
    """The higher of two cursors (guard structs)."""
    return F.greatest(current, incoming)


def batch_cursor(batch: DataFrame, order: Column) -> DataFrame:
    """One row, `cursor`: the highest place of a batch; null if it is empty."""
    return batch.agg(F.max(order).alias("cursor"))


def dead_letters(typed: DataFrame, reason: str = "a needed field is missing or cannot be read") -> tuple[DataFrame, DataFrame]:
    """(rows that could be read, the others with a reason); rows of typed() with `ok`."""
    good = F.coalesce("ok", F.lit(False))
    return typed.where(good).drop("ok"), typed.where(~good).drop("ok").withColumn("reason", F.lit(reason))


def open_cursor(batch: DataFrame, dead: DataFrame, order: Column, tx: str = "tx_signature") -> DataFrame:
    """The cursor of a batch that holds dead letters: the highest place below their first transaction; rows of a transaction that failed don't count."""
    stop = dead.agg(F.min(order).alias("_stop"))  # one row
    rows = batch.join(dead.select(tx).distinct(), tx, "left_anti").crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (order < F.col("_stop")))
    return batch_cursor(rows, order)
