"""The status machine: pending, finalized, orphaned, against a snapshot of what exists and of chain heads.

`existence` tables hold a key and `exists`, null where nothing is known;
`verdicts` hold asset and verdict, as chain.compare_heads() gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ids import assign_global_ids
from .stats import KEY, with_parent


def _due(status: str, cutoff: int | None, slot: str) -> Column:
    return (F.col(status) == "PENDING") & (F.lit(True) if cutoff is None else F.col(slot) <= cutoff)


def _known(rows: DataFrame, existence: DataFrame, key: str) -> DataFrame:
    return rows.join(existence.select(key, F.col("exists").alias("_there")), key, "left")


def verify_existence(rows: DataFrame, authority: DataFrame, key: str, cutoff: int | None = None, status: str = "status", slot: str = "slot", verified_slot: int | None = None) -> DataFrame:
    """rows with their new status: pending ones up to the cutoff are finalized if they exist, orphaned if not, and stay if nothing is known.

    With verified_slot, rows that are decided now bear it in that column. A
    table without slots (the registries) takes no cutoff.
    """
    due = _due(status, cutoff, slot)
    there = _known(rows, authority, key)
    new = F.when(due & F.col("_there"), "FINALIZED").when(due & ~F.col("_there"), "ORPHANED").otherwise(F.col(status))
    if verified_slot is not None:
        old = F.col("verified_slot") if "verified_slot" in rows.columns else F.lit(None).cast("long")
        there = there.withColumn("verified_slot", F.when(due & F.col("_there").isNotNull(), F.lit(verified_slot).cast("long")).otherwise(old))
    return there.withColumn(status, new).drop("_there")


def verify_agents(agents: DataFrame, authority: DataFrame, cutoff: int, slot: int, order: list[str]) -> DataFrame:
    """verify_existence() of agents; those that aren't orphaned and have no agent_id get the next ones in order."""
    return assign_global_ids(verify_existence(agents, authority, "asset", cutoff, verified_slot=slot), order, "agent_id", F.col("status") != "ORPHANED")


def finalize_uri_metadata(metadata: DataFrame, agents: DataFrame) -> DataFrame:
    """Pending rows that documents gave are finalized, verified at the time of the agent's update, else of its creation, else at the epoch."""
    times = agents.select("asset", F.coalesce("updated_at", "created_at").alias("_at"))
    due = (F.col("status") == "PENDING") & F.startswith("key", F.lit("_uri:"))
    rows = metadata.join(times, "asset", "left")
    at = F.coalesce("_at", F.timestamp_seconds(F.lit(0)))
    return rows.withColumns({"verified_at": F.when(due, at).otherwise(F.col("verified_at")), "status": F.when(due, "FINALIZED").otherwise(F.col("status"))}).drop("_at")


def verify_feedbacks(feedbacks: DataFrame, existence: DataFrame, verdicts: DataFrame, cutoff: int | None = None, slot: str = "slot") -> DataFrame:
    """Pending feedback up to the cutoff: orphaned without its agent, finalized if its chain is ok, else it stays."""
    due = _due("status", cutoff, slot)
    rows = _known(feedbacks, existence, "asset").join(verdicts.select("asset", "verdict"), "asset", "left")
    new = F.when(due & ~F.col("_there"), "ORPHANED").when(due & F.col("_there") & (F.col("verdict") == "ok"), "FINALIZED").otherwise(F.col("status"))
    return rows.withColumn("status", new).drop("_there", "verdict")


def verify_children(rows: DataFrame, feedbacks: DataFrame, existence: DataFrame, verdicts: DataFrame, cutoff: int | None = None, slot: str = "slot") -> DataFrame:
    """Pending responses or revocations: orphaned without a feedback or with an orphaned one, else as feedback, by the verdicts on their own chain.

    `hash_differs` says whether a seal hash isn't the feedback's: that is counted, but decides nothing.
    """
    there = with_parent(rows, feedbacks)
    lost = F.coalesce(F.col("parent_status") == "ORPHANED", F.lit(True))
    due = _due("status", cutoff, slot)
    differs = F.col("seal_hash").isNotNull() & F.col("parent_hash").isNotNull() & (F.col("seal_hash") != F.col("parent_hash"))
    there = there.withColumns({"hash_differs": differs, "status": F.when(due & lost, "ORPHANED").otherwise(F.col("status"))}).drop("parent_status", "parent_hash")
    return verify_feedbacks(there, existence, verdicts, cutoff, slot)


def recover_orphans(rows: DataFrame, existence: DataFrame, key: str, feedbacks: DataFrame | None = None) -> DataFrame:
    """Orphaned rows that exist, or whose agent does, are pending again; with feedbacks, only those whose feedback is there and isn't orphaned."""
    there = _known(rows, existence, key)
    again = (F.col("status") == "ORPHANED") & F.col("_there")
    if feedbacks is not None:
        there = there.join(feedbacks.where("status <> 'ORPHANED'").select(*KEY).distinct().withColumn("_parent", F.lit(True)), KEY, "left")
        again = again & F.col("_parent").isNotNull()
    return there.withColumn("status", F.when(again, "PENDING").otherwise(F.col("status"))).drop("_there", "_parent")


def cycle(feedbacks: DataFrame, responses: DataFrame, revocations: DataFrame, existence: DataFrame, verdicts: dict[str, DataFrame], cutoff: int | None = None) -> dict[str, DataFrame]:
    """One round: feedback, then its children, then what was orphaned too early, parents first, and those again."""
    f = verify_feedbacks(feedbacks, existence, verdicts["feedback"], cutoff)
    f = verify_feedbacks(recover_orphans(f, existence, "asset"), existence, verdicts["feedback"], cutoff)
    got = {"feedbacks": f}
    for name, rows, chain in (("responses", responses, "response"), ("revocations", revocations, "revoke")):
        rows = verify_children(rows, f, existence, verdicts[chain], cutoff)
        rows = recover_orphans(rows.drop("hash_differs"), existence, "asset", f)
        got[name] = verify_children(rows, f, existence, verdicts[chain], cutoff)
    return got


def backfill_seal_hash(responses: DataFrame, events: DataFrame) -> DataFrame:
    """Responses without a seal hash take that of the event at their place (tx_signature, event_ordinal), if it is a response's."""
    w = Window.partitionBy("tx_signature", "event_ordinal").orderBy(F.desc("seal_hash"))
    known = events.where("name = 'ResponseAppended' AND seal_hash IS NOT NULL").select("tx_signature", "event_ordinal", F.col("seal_hash").alias("_hash"), F.row_number().over(w).alias("_n")).where("_n = 1").drop("_n")
    return responses.join(known, ["tx_signature", "event_ordinal"], "left").withColumn("seal_hash", F.coalesce("seal_hash", "_hash")).drop("_hash")


def cycle_stats(before: DataFrame, after: DataFrame, keys: list[str], mismatches: DataFrame | None = None) -> DataFrame:
    """One row: rows verified, orphaned, recovered and skipped (pending before and after) in a cycle, and chains with a mismatch."""
    rows = before.select(*keys, F.col("status").alias("_b")).join(after.select(*keys, F.col("status").alias("_a")), keys)
    to = lambda a, b: F.count_if((F.col("_b") == a) & (F.col("_a") == b))
    found = rows.agg(
        F.count_if((F.col("_b") != "FINALIZED") & (F.col("_a") == "FINALIZED")).alias("verified"), F.count_if((F.col("_b") != "ORPHANED") & (F.col("_a") == "ORPHANED")).alias("orphaned"),
        F.count_if((F.col("_b") == "ORPHANED") & (F.col("_a") != "ORPHANED")).alias("recovered"), to("PENDING", "PENDING").alias("skipped"),
    )
    if mismatches is None:
        return found
    return found.crossJoin(F.broadcast(mismatches.agg(F.count_if(F.col("verdict").isin("mismatch", "exceeds")).alias("mismatches"))))  # one row each


def existence(attempts: DataFrame, key: str) -> DataFrame:
    """One verdict from several attempts: any success, else any confirmed absence, else unknown."""
    return attempts.groupBy(key).agg(F.bool_or("exists").alias("exists"))


def cutoff(current_slot: int, margin: int = 32) -> int:
    return max(0, current_slot - margin)
