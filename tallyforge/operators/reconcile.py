"""Two copies of a table, and keys that are missing on one side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The keys that differ and how: missing on the left, extra there, or changed."""
    a, b = left.select(*keys, F.lit(1).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in columns]), right.select(*keys, F.lit(1).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    same = reduce(lambda x, y: x & y, [F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")) for c in columns], F.lit(True))
    change = F.when(F.col("_l").isNull(), "missing").when(F.col("_r").isNull(), "extra").when(~same, "changed")
    return a.join(b, keys, "full").withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")


def with_flag(rows: DataFrame, known: DataFrame, on: list[str], flag: str) -> DataFrame:
    """rows with whether their key is known."""
    return rows.join(known.select(*on).distinct().withColumn(flag, F.lit(True)), on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


#: What tells each kind of action apart, and what it is looked up by.
ACTIONS = {"agent": ["asset"], "feedback": ["asset", "client", "feedback_index", "seal_hash"], "response": ["asset", "client", "feedback_index", "responder", "seal_hash"], "revoke": ["asset", "client", "feedback_index", "seal_hash"]}


def expected_actions(log: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(actions by kind, responses whose client can't be told) of a log with line, phase, asset, wallet, client, feedback_index, seal_hash, tx_signature.

    Lines that lack a field of their kind don't count. The wallet is the client
    of a feedback and a revocation, the responder of a response. A response's
    client is that of the n-th payload (phase response_payload) before it of the
    same responder, asset, index and hash, if it is the n-th response of those;
    else the client of the only feedback of that asset, index and hash.
    """
    need = lambda *cs: reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in cs])
    common = ["asset", "feedback_index", "seal_hash"]
    of = lambda phase: log.where(F.col("phase") == phase)
    plain = lambda phase: of(phase).where(need(*common, "wallet", "tx_signature")).select("asset", F.col("wallet").alias("client"), "feedback_index", "seal_hash", "tx_signature")
    feedback, revoke = plain("feedback"), plain("revoke")
    key = ["wallet", *common]
    n = F.row_number().over(Window.partitionBy(*key).orderBy("line"))
    payloads = of("response_payload").where(need(*key, "client")).select(*key, F.col("client").alias("_payload"), F.col("line").alias("_at"), n.alias("_n"))
    answers = of("response").where(need(*key, "tx_signature")).select(*key, "tx_signature", "line", n.alias("_n"))
    only = feedback.groupBy(*common).agg(F.min("client").alias("_lo"), F.max("client").alias("_hi"))
    rows = answers.join(payloads, [*key, "_n"], "left").join(only, common, "left")
    client = F.coalesce(F.when(F.col("_at") < F.col("line"), F.col("_payload")), F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")))
    rows = rows.withColumn("client", client).select("asset", "client", "feedback_index", F.col("wallet").alias("responder"), "seal_hash", "tx_signature")
    agents = of("agent").where(need("asset", "tx_signature")).select("asset", "tx_signature")
    return {"agent": agents, "feedback": feedback, "response": rows.where("client IS NOT NULL"), "revoke": revoke}, rows.where("client IS NULL").select("tx_signature")


def integrity(actions: dict[str, DataFrame], tables: dict[str, DataFrame]) -> DataFrame:
    """kind, expected, indexed, missing, mismatched: expected actions by key against the tables' rows and their signatures.

    Of actions with one key the one with the highest signature is expected.
    """
    found = []
    for kind, keys in ACTIONS.items():
        want = actions[kind].groupBy(*keys).agg(F.max("tx_signature").alias("_want"))
        have = tables[kind].groupBy(*keys).agg(F.max("tx_signature").alias("_have"), F.lit(True).alias("_there"))
        rows = want.join(have, keys, "left")
        there = F.col("_there").isNotNull()
        found.append(rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("expected"), F.count_if(there).alias("indexed"), F.count_if(~there).alias("missing"), F.count_if(there & ~F.col("_want").eqNullSafe(F.col("_have"))).alias("mismatched")))
    return reduce(DataFrame.unionByName, found)


def coherent(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row: numbers of missing, extra and changed keys, and whether there are none."""
    n = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    got = compare(left, right, keys, columns).agg(n("missing"), n("extra"), n("changed"))
    return got.withColumn("ok", F.col("missing") + F.col("extra") + F.col("changed") == 0)
