"""Finalisation lines of transaction logs matched with feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import base58

#: Fixed value: the text that begins a finalisation.
MARK = "PP_FINALIZE|v=1|"
KEY = ["tx_signature", "asset", "client_address", "feedback_index", "hash"]


def finalisations(frames: DataFrame, program: str) -> DataFrame:
    """The finalisations that the program's log lines state (events.attribute_frames()), readable or not.

    After MARK come fields `k=v` with | between them: session, client, asset,
    seal and context_ref as 32 bytes in hex, feedback_index and context as
    digits; of a repeated key the last counts. asset and client_address are
    given in base58. `readable` is false if a field is missing or malformed.
    """
    fields = F.split(F.substring_index("line", MARK, -1), r"\|")
    rows = frames.where((F.col("program") == program) & F.contains("line", F.lit(MARK)))
    rows = rows.withColumn("_p", F.transform(fields, lambda p: F.split(p, "=", 2)))
    value = lambda k: F.try_element_at(F.try_element_at(F.filter("_p", lambda p: p[0] == k), F.lit(-1)), F.lit(2))
    hex32 = lambda k: F.when(value(k).rlike("^(0x)?[0-9a-fA-F]{64}$"), F.lower(F.regexp_replace(value(k), "^0x", "")))
    digits = lambda k: F.when(value(k).rlike("^[0-9]+$"), value(k))
    rows = rows.select(
        "tx_signature", "position", base58(F.unhex(hex32("asset"))).alias("asset"), base58(F.unhex(hex32("client"))).alias("client_address"),
        digits("feedback_index").try_cast("long").alias("feedback_index"), hex32("seal").alias("hash"),
        (hex32("session").isNotNull() & hex32("context_ref").isNotNull() & digits("context").isNotNull()).alias("_rest"),
    )
    good = F.col("_rest")
    for c in KEY[1:]:
        good = good & F.col(c).isNotNull()
    return rows.withColumn("readable", good).drop("_rest")


def match(stated: DataFrame, feedbacks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proofs: finalisations with their feedback, errors: unreadable ones and those without a feedback). None is left out."""
    there = feedbacks.select(*KEY).distinct()
    proofs = stated.where("readable").join(there, KEY, "left_semi")
    lone = stated.where("readable").join(there, KEY, "left_anti").withColumn("reason", F.lit("unmatched"))
    return proofs, lone.unionByName(stated.where("NOT readable").withColumn("reason", F.lit("unreadable")))


def flag(feedbacks: DataFrame, proofs: DataFrame) -> DataFrame:
    """feedbacks with `proved`, whether a proof has the same five keys."""
    there = proofs.select(*KEY, F.lit(True).alias("_p")).distinct()
    return feedbacks.drop("proved").join(there, KEY, "left").withColumn("proved", F.coalesce("_p", F.lit(False))).drop("_p")


def backfill(feedbacks: DataFrame, proofs: DataFrame, after_slot: int, after_signature: str, limit: int, retry: DataFrame | None = None, most: int = 5) -> DataFrame:
    """Transactions with unproved feedback after the cursor, oldest first; and, whatever the cursor, those of `retry` (tx_signature, attempts) tried fewer than `most` times."""
    bare = feedbacks.join(proofs.select(*KEY).distinct(), KEY, "left_anti").groupBy("slot", "tx_signature").agg(F.count("*").alias("unproved"))
    wanted = (F.col("slot") > after_slot) | ((F.col("slot") == after_slot) & (F.col("tx_signature") > after_signature))
    if retry is not None:
        due = retry.groupBy("tx_signature").agg(F.max("attempts").alias("_n")).where(F.col("_n") < most)
        bare = bare.join(due, "tx_signature", "left")
        wanted = wanted | F.col("_n").isNotNull()
    return bare.where(wanted).orderBy("slot", "tx_signature").limit(limit).select("slot", "tx_signature", "unproved")


def retries(retry: DataFrame, tried: DataFrame, proofs: DataFrame) -> DataFrame:
    """The retry list after a round: transactions that were tried and have no proof, each with one attempt more."""
    done = proofs.select("tx_signature").distinct()
    again = tried.select("tx_signature").distinct().join(done, "tx_signature", "left_anti").withColumn("attempts", F.lit(1))
    return retry.join(done, "tx_signature", "left_anti").unionByName(again).groupBy("tx_signature").agg(F.sum("attempts").cast("int").alias("attempts"))
