"""Event decoding, projections, proofs and hashes on small inputs."""

import json

from pyspark.sql import functions as F

from tallyforge.functions import hashes
from tallyforge.operators import events, projections, proofs

RAW = "name string, data string, tx_signature string, slot long, tx_index int, event_ordinal int"


def raw(spark, *rows):
    return spark.createDataFrame([(n, json.dumps(d) if d is not None else None, f"s{slot}", slot, 0, k) for k, (n, slot, d) in enumerate(rows)], RAW)


def test_typed_reads_fields_and_marks_dead_letters(spark):
    rows = raw(
        spark,
        ("AgentRegistered", 1, {"asset": "a", "collection": "c", "owner": "o", "agentUri": ""}),
        ("AgentRegistered", 2, {"asset": "b", "collection": "c", "atomEnabled": False}),
        ("AgentRegistered", 3, None),
        ("MetadataDeleted", 4, {"asset": "a", "key": "k"}),
    )
    got = [tuple(r) for r in events.typed(rows, "AgentRegistered").orderBy("slot").select("asset", "owner", "atom_enabled", "ok").collect()]
    assert got == [("a", "o", True, True), ("b", None, False, False), (None, None, True, False)]
    hashed = raw(spark, ("ValidationRequested", 1, {"asset": "a", "validatorAddress": "v", "nonce": 2**64 - 1, "requestHash": "ab" * 32, "requester": "r"}), ("ValidationRequested", 2, {"asset": "a", "validatorAddress": "v", "nonce": -1, "requestHash": "ab", "requester": "r"}))
    got = events.typed(hashed, "ValidationRequested").orderBy("slot").select("nonce", F.length("request_hash").alias("n"), "ok").collect()
    assert [(r[0] and int(r[0]), r[1], r[2]) for r in got] == [(2**64 - 1, 32, True), (None, None, False)]


def test_frames_follow_the_innermost_program(spark):
    logs = ["out", "Program A invoke [1]", "Program log: 1", "Program B invoke [2]", "Program data: x", "Program B failed: no", "Program log: 2", "Program Z success", "Program A success", "after"]
    frames = events.attribute_frames(spark.createDataFrame([("t", logs), ("e", []), ("n", None)], "tx_signature string, logs array<string>"))
    got = [r["program"] for r in frames.orderBy("position").collect()]
    assert got == [None, "A", "A", "B", "B", "B", "A", "Z", "A", None]
    nothing = spark.createDataFrame([], "tx_signature string")
    assert [r[0] for r in events.unparsed(frames, nothing, "B").collect()] == ["t"]
    assert events.unparsed(frames, nothing, "A").count() == 0


def test_tx_index_keeps_zero_and_marks_unknown_order(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "slot long, tx_signature string")
    blocks = spark.createDataFrame([(1, ["a"])], "slot long, signatures array<string>")
    got = {r["tx_signature"]: (r["tx_index"], r["unresolved"]) for r in events.with_tx_index(rows, blocks).collect()}
    assert got == {"a": (0, False), "b": (None, True), "c": (None, False)}


def test_lock_hints_go_by_place_and_own_values_win(spark):
    rows = spark.createDataFrame([("t", "p", 0, None), ("t", "p", 4, False), ("t", "p", 5, None), ("t", "q", 1, None)], "tx_signature string, kind string, event_ordinal int, lock boolean")
    hints = spark.createDataFrame([("t", "p", 0, True), ("t", "p", 1, True), ("t", "q", 2, None)], "tx_signature string, kind string, position int, lock boolean")
    got = {(r["kind"], r["event_ordinal"]): r["lock"] for r in events.with_lock_hints(rows, hints).collect()}
    assert got == {("p", 0): True, ("p", 4): False, ("p", 5): None, ("q", 1): None}


def test_agents_keep_first_and_take_last(spark):
    rows = raw(
        spark,
        ("UriUpdated", 0, {"asset": "a", "newUri": "early", "updatedBy": "u"}),
        ("AgentRegistered", 1, {"asset": "a", "collection": "c1", "owner": "o1", "agentUri": "u1"}),
        ("AtomEnabled", 2, {"asset": "a", "enabledBy": "o1"}),
        ("WalletUpdated", 3, {"asset": "a", "newWallet": "w", "updatedBy": "o1"}),
        ("AgentRegistered", 4, {"asset": "a", "collection": "c2", "owner": "o2", "atomEnabled": False, "agentUri": "u2"}),
        ("WalletResetOnOwnerSync", 5, {"asset": "a", "newWallet": projections.NO_WALLET, "ownerAfterSync": "o3"}),
        ("UriUpdated", 6, {"asset": "a", "newUri": "", "updatedBy": "u"}),
        ("ParentAssetSet", 7, {"asset": "a", "parentAsset": "p", "parentCreator": "pc", "setBy": "u", "lock": True}),
        ("ParentAssetSet", 8, {"asset": "a", "parentAsset": "p2", "parentCreator": "pc", "setBy": "u"}),
        ("UriUpdated", 9, {"asset": "x", "newUri": "no such agent", "updatedBy": "u"}),
    )
    t = lambda k: events.typed(rows, k).where("ok")
    got = projections.agents(*(t(k) for k in ("AgentRegistered", "AgentOwnerSynced", "AtomEnabled", "UriUpdated", "WalletUpdated", "WalletResetOnOwnerSync", "ParentAssetSet"))).collect()
    assert len(got) == 1
    a = got[0]
    assert (a.owner, a.creator, a.collection, a.slot, a.uri, a.wallet, a.atom_enabled, a.parent_asset, a.parent_locked) == ("o3", "o1", "c1", 1, None, None, False, "p2", True)


def test_pointers_recount_after_moves(spark):
    agents = spark.createDataFrame([("a", None, "o"), ("b", "o", "x")], "asset string, creator string, owner string")
    moves = spark.createDataFrame([("a", "p", True, 1), ("b", "p", None, 2), ("a", "q", None, 3), ("z", "q", None, 4)], "asset string, col string, lock boolean, slot long")
    moves = moves.selectExpr("*", "0 AS tx_index", "0 AS event_ordinal", "'s' AS tx_signature")
    held, table = projections.pointers(agents, moves)
    assert {r.asset: (r.canonical_col, r.col_locked) for r in held.collect()} == {"a": ("q", True), "b": ("p", None)}
    assert {(r["col"], r["first_seen_slot"], r["last_seen_slot"], r["asset_count"]) for r in table.collect()} == {("p", 1, 2, 1), ("q", 3, 3, 1)}


def test_validations_may_answer_first(spark):
    common = "asset string, validator_address string, nonce long, slot long, tx_index int, event_ordinal int, tx_signature string"
    asked = spark.createDataFrame([("a", "v", 1, 1, 0, 0, "s", "u", "h", "r")], f"{common}, request_uri string, request_hash string, requester string")
    told = spark.createDataFrame([("a", "v", 2, 1, 0, 0, "s", 7, "u", "h", None)], f"{common}, response int, response_uri string, response_hash string, tag string")
    assert {(r.nonce, r.status, r.requester, r.response) for r in projections.validations(asked, told).collect()} == {(1, "PENDING", "r", None), (2, "RESPONDED", None, 7)}


def test_proofs_and_errors(spark):
    a, c, h = b"a" * 32, b"c" * 32, "ab" * 32
    line = lambda index, more="": f"Program log: PP_FINALIZE|v=1|session={h}|client={c.hex()}|asset={a.hex()}|feedback_index={index}|seal={h.upper()}|context=1|context_ref={h}{more}"
    logs = ["Program P invoke [1]", line(3), line(9), line("x"), line(3, "|asset=00"), "Program log: PP_FINALIZE|v=1|", "Program P success", line(4)]
    frames = events.attribute_frames(spark.createDataFrame([("t", logs)], "tx_signature string, logs array<string>"))
    asset, client = hashes.base58_batch([a, c])
    fed = spark.createDataFrame([("t", asset, client, 3, h, 5), ("u", asset, client, 4, h, 6)], "tx_signature string, asset string, client_address string, feedback_index long, hash string, slot long")
    good, bad = proofs.match(proofs.finalisations(frames, "P"), fed)
    assert [r.feedback_index for r in good.collect()] == [3]
    assert sorted(r.reason for r in bad.collect()) == ["unmatched", "unreadable", "unreadable", "unreadable"]
    assert {r.tx_signature: r.proved for r in proofs.flag(fed, good).collect()} == {"t": True, "u": False}
    assert [r.tx_signature for r in proofs.backfill(fed, good, 5, "t", 10).collect()] == ["u"]
    none = good.where("false")
    retry = proofs.retries(spark.createDataFrame([("t", 3)], "tx_signature string, attempts int"), fed, none)
    assert {r.tx_signature: r.attempts for r in retry.collect()} == {"t": 4, "u": 1}
    assert [r.tx_signature for r in proofs.backfill(fed, none, 6, "u", 10, retry).collect()] == ["t", "u"]
    assert [r.tx_signature for r in proofs.backfill(fed, none, 6, "u", 10, proofs.retries(retry, fed, none)).collect()] == ["u"]
    assert proofs.retries(retry, fed, good).collect() == [("u", 2)]


def test_keccak_base58_and_leaf(spark):
    known = {b"": "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470", b"abc": "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"}
    assert [d.hex() for d in hashes.keccak_batch(list(known))] == list(known.values())
    long = [b"x" * n for n in (135, 136, 137, 400)]
    assert hashes.keccak_batch(long) == [hashes.keccak_batch([m])[0] for m in long]
    rows = spark.createDataFrame([(b"\0\0hello",), (b"",), (None,), (b"\xff" * 32,)], "b binary")
    got = rows.select("b", hashes.base58("b").alias("t")).select("b", "t", hashes.from_base58("t").alias("back"), hashes.keccak256("b").alias("k")).collect()
    assert all(r.b == r.back for r in got) and got[0].t.startswith("11") and got[2].k is None
    one = rows.limit(1).select(hashes.leaf("feedback", F.lit(b"a" * 32), F.lit(b"c" * 32), F.lit(258), F.lit(None).cast("binary"), F.lit(1)).alias("x"), hashes.u64_le(F.lit(-1)).alias("m")).first()
    assert one.x == b"8004_LEAF_V1____" + b"a" * 32 + b"c" * 32 + (258).to_bytes(8, "little") + bytes(32) + (1).to_bytes(8, "little")
    assert one.m == b"\xff" * 8


def test_failed_transactions_go(spark):
    tx = spark.createDataFrame([("a", None), ("b", "err")], "tx_signature string, err string")
    assert [r["tx_signature"] for r in events.succeeded(tx).collect()] == ["a"]


def test_a_condition_on_fields_does_not_parse_again(spark):
    frame = raw(spark, ("UriUpdated", 0, {"asset": "a", "newUri": "u", "updatedBy": "x"}))
    plan = events.typed(frame.repartition(2), "UriUpdated").where("ok AND asset = 'a'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
