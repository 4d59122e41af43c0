"""Semantics of the entity operators that the tables alone don't show."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import hashes, scalar
from tallyforge.operators import chain, entities, fold, ids, lifecycle, paging, projections, reconcile, stats
from tallyforge.sources import tables

H = "ab" * 32


def raw(spark, events):
    """Events (name, fields, slot): the place follows from their number."""
    rows = [(n, json.dumps(f), f"s{i}", s, None, 0, 0) for i, (n, f, s) in enumerate(events)]
    return spark.createDataFrame(rows, tables.EVENTS)


def feedback(asset, client, index, score=50, **more):
    return dict(asset=asset, clientAddress=client, feedbackIndex=index, value="5", valueDecimals=0, score=score, sealHash=H, atomEnabled=False, newTrustTier=1, newQualityScore=2, newConfidence=3, newRiskScore=4, newDiversityRatio=5, newFeedbackDigest=H, newFeedbackCount=1, tag1="t", tag2="", endpoint="", feedbackUri="", feedbackFileHash=H, isUniqueClient=True, hadImpact=False, slot=1) | more


def revoke(asset, client, index, **more):
    return dict(asset=asset, clientAddress=client, feedbackIndex=index, sealHash=H, slot=1, originalScore=1, atomEnabled=False, hadImpact=False, newTrustTier=1, newQualityScore=2, newConfidence=3, newRevokeDigest=H, newRevokeCount=1) | more


def answer(asset, client, index, responder):
    return dict(asset=asset, client=client, feedbackIndex=index, responder=responder, responseHash=H, sealHash=H, newResponseDigest=H, newResponseCount=1, responseUri="u", slot=1)


EVENTS = [
    ("AgentRegistered", dict(asset="A", collection="C", owner="o1", agentUri="u1"), 1),
    ("RegistryInitialized", dict(collection="C", authority="x"), 1),
    ("AgentOwnerSynced", dict(asset="A", oldOwner="o1", newOwner="o2"), 2),
    ("UriUpdated", dict(asset="A", newUri="", updatedBy="o2"), 3),
    ("WalletUpdated", dict(asset="A", newWallet="1" * 32, updatedBy="o2"), 4),
    ("NewFeedback", feedback("A", "c", 0, 80), 5),
    ("NewFeedback", feedback("B", "c", 0), 5),
    ("ResponseAppended", answer("A", "c", 0, "r"), 6),
    ("ResponseAppended", answer("B", "c", 0, "r"), 6),
    ("MetadataSet", dict(asset="A", key="k", value="v\0w", immutable=True), 6),
    ("MetadataSet", dict(asset="A", key="_uri:name", value="no", immutable=False), 6),
    ("ValidationRequested", dict(asset="A", validatorAddress="w", nonce=1, requestHash=H, requester="q"), 7),
    ("NewFeedback", dict(asset="A"), 7),
]
LATER = [
    ("AgentRegistered", dict(asset="B", collection="C", owner="p", agentUri="u2"), 8),
    ("AgentRegistered", dict(asset="A", collection="D", owner="o3", agentUri="u3"), 8),
    ("NewFeedback", feedback("B", "c", 1, 20), 9),
    ("NewFeedback", feedback("A", "c", 1, 60, atomEnabled=True, newTrustTier=4), 9),
    ("FeedbackRevoked", revoke("A", "c", 0), 10),
    ("FeedbackRevoked", revoke("A", "c", 77), 10),
    ("MetadataSet", dict(asset="A", key="k", value="later", immutable=False), 11),
    ("ValidationResponded", dict(asset="A", validatorAddress="w", nonce=1, response=9, responseHash=H), 11),
]


def test_dispatcher(spark):
    got, dead = projections.fold(raw(spark, EVENTS))
    one = lambda name: [r.asDict() for r in got[name].collect()]
    (a,) = one("agents")
    assert (a["owner"], a["creator"], a["collection"], a["uri"], a["wallet"], a["slot"], a["atom_enabled"]) == ("o2", "o1", "C", None, None, 1, True)
    assert (a["feedback_count"], a["raw_avg_score"]) == (1, 80)
    assert [r["asset"] for r in one("feedbacks")] == ["A"] and [r["asset"] for r in one("orphan_feedbacks")] == ["B"]
    assert [r["asset"] for r in one("responses")] == ["A"] and [r["asset"] for r in one("orphan_responses")] == ["B"]
    (m,) = one("metadata")
    assert m["value"] == "vw" and m["immutable"] and m["id"] == "A:" + hashlib.sha256(b"k").hexdigest()[:32]
    assert one("validations")[0]["status"] == "PENDING" and one("collections")[0]["authority"] == "x"
    assert [r["name"] for r in dead.collect()] == ["NewFeedback"]


def test_dispatcher_on_a_snapshot(spark):
    whole = projections.fold(raw(spark, EVENTS + LATER))[0]
    kept = {k: tables.checkpoint(v) for k, v in projections.fold(raw(spark, EVENTS))[0].items()}
    later = raw(spark, EVENTS + LATER).where("slot >= 8")
    got = {k: tables.checkpoint(v) for k, v in projections.fold(later, kept)[0].items()}
    again = projections.fold(later, got)[0]
    a = {r["asset"]: r for r in got["agents"].collect()}
    assert (a["A"]["owner"], a["A"]["creator"], a["A"]["collection"], a["A"]["uri"], a["A"]["trust_tier"]) == ("o3", "o1", "C", "u3", 4)
    f = {(r["asset"], int(r["feedback_index"])): r["is_revoked"] for r in got["feedbacks"].collect()}
    assert f == {("A", 0): True, ("A", 1): False, ("B", 0): False, ("B", 1): False}
    assert got["orphan_feedbacks"].isEmpty() and got["orphan_responses"].isEmpty()
    assert {int(r["feedback_index"]): r["status"] for r in got["revocations"].collect()} == {0: "PENDING", 77: "ORPHANED"}
    assert [r["value"] for r in got["metadata"].collect()] == ["vw"] and got["validations"].first()["status"] == "RESPONDED"
    for name in ("agents", "feedbacks", "revocations", "responses", "metadata", "validations", "collections"):
        columns = sorted(set(got[name].columns) & set(whole[name].columns))
        rows = lambda df: sorted(map(str, df.select(*columns).collect()))  # noqa: E731, B023
        assert rows(got[name]) == rows(again[name]), name
        if name != "agents":
            assert rows(got[name]) == rows(whole[name]), name


def test_merge_of_null_keys_and_late_rows(spark):
    old = spark.createDataFrame([(None, 5, "a"), (1, 5, "b")], "k int, slot int, v string")
    new = spark.createDataFrame([(None, 6, "c"), (1, 4, "late"), (2, 1, "d")], "k int, slot int, v string")
    got = fold.merge(old, new, ["k"], {"slot": "guarded", "v": "guarded"}, F.struct("slot"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(None, 6, "c"), (1, 5, "b"), (2, 1, "d")]))
    assert fold.merge(got, new, ["k"], {"slot": "guarded", "v": "guarded"}, F.struct("slot")).count() == 3


def test_dead_letters_block_the_cursor(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "b", True), (2, "b", False), (3, "c", True)], "slot int, tx_signature string, ok boolean")
    good, dead = fold.dead_letters(rows)
    assert good.count() == 3 and [r["reason"] for r in dead.collect()] == ["a needed field is missing or cannot be read"]
    assert fold.open_cursor(good, dead, F.struct("slot", "tx_signature")).first()["cursor"]["slot"] == 1
    assert fold.open_cursor(good, dead.where("false"), F.struct("slot", "tx_signature")).first()["cursor"]["slot"] == 3


@pytest.mark.parametrize("down", [True, False])
def test_pages_make_up_the_list(spark, down):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 1, 2, 3]), "a" if i % 3 else None) for i in range(40)]
    table = spark.createDataFrame(rows, "id int, score int, tag string")
    keys = [("score", not down), ("tag", True), ("id", True)]
    whole = [tuple(r) for r in paging.keyset_page(table, keys, 1000).select("score", "tag", "id").collect()]
    walked, cursor = [], None
    while True:
        page = [tuple(r) for r in paging.keyset_page(table, keys, 7, cursor).select("score", "tag", "id").collect()]
        if not page:
            break
        walked += page
        cursor = list(page[-1])
    assert walked == whole and len(whole) == 40


def test_filters(spark):
    with pytest.raises(ValueError):
        entities.condition("response", responseId_gt=3)
    with pytest.raises(ValueError):
        entities.condition("revocation", revocationId=3)
    with pytest.raises(ValueError):
        entities.list_rows(spark.range(1), "agent", "trustTier", cursor=(1, "a"))
    assert entities.parse_list('a,"b,c", d ,"e\\"f"') == ["a", "b,c", "d", 'e"f']
    for bad in ("a,,b", '"a', 'a"b"', "a,"):
        with pytest.raises(ValueError):
            entities.parse_list(bad)
    rows = spark.createDataFrame([(f"v{i}",) for i in range(300)] + [(None,)], "owner string").withColumn("status", F.lit("PENDING"))
    assert entities.where(rows, "agent", owner_in=[f"v{i}" for i in range(300)]).count() == 250
    assert entities.where(rows, "agent", owner_in=[]).count() == 301
    assert rows.where(entities.parse_filter("owner", "in.(v1,v2)")).count() == 2 and rows.where(entities.parse_filter("owner", "gte.v98")).count() == 2
    assert rows.where(entities.parse_filter("owner", "v5")).count() == 1
    assert entities.clamp(None, None) == (100, 0) and entities.clamp(999, 9999) == (250, 5000) and entities.clamp(-1, -1) == (0, 0)
    assert entities.lookup(rows, F.col("owner") == "v3").count() == 1 and entities.lookup(rows, F.col("owner") == "none").count() == 0
    with pytest.raises(Exception, match="ambiguous"):
        entities.lookup(rows, F.col("owner").isin("v3", "v4")).collect()
    v = spark.createDataFrame([(None, "ok"), (3, "ok")], "response int, chain_status string")
    assert [entities.where(v, "validation", status=s).count() for s in ("PENDING", "COMPLETED", "EXPIRED")] == [1, 1, 0]


def test_chains_with_keccak(spark, monkeypatch):
    monkeypatch.setattr(chain, "CHUNK", 4)
    rnd, rows, want = random.Random(5), [], {}
    for agent in "abc":
        digest = bytes(32)
        for n in range(1, 14):
            leaf = bytes(rnd.randrange(256) for _ in range(32))
            digest = hashes.keccak_batch([digest + hashes.LINK_DOMAIN["response"].encode() + leaf])[0]
            rows.append((agent, n, leaf, None if rnd.random() < 0.4 else digest))
        want[agent] = digest
    schema = "agent string, n int, leaf binary, digest binary"
    good = spark.createDataFrame(rows, schema)
    got = {r["agent"]: r for r in chain.verify_chain(good, ["agent"], "n", "response").collect()}
    assert all(r["valid"] and r["events"] == 13 and bytes(r["digest"]) == want[a] for a, r in got.items()) and len(got) == 3
    # a changed leaf shows at the next stored digest, however far it is
    k = next(i for i, r in enumerate(rows) if r[3] is None and 0 < i < 11)
    bad = [(a, n, bytes(32) if i == k else leaf, d) for i, (a, n, leaf, d) in enumerate(rows)]
    first = next(r[1] for r in rows[k + 1 :] if r[3] is not None)
    got = {r["agent"]: r for r in chain.verify_chain(spark.createDataFrame(bad, schema), ["agent"], "n", "response").collect()}
    assert got["a"]["first_mismatch"] == first and got["a"]["digest"] is None and got["b"]["valid"]
    # from checkpoints on
    points = chain.checkpoints(chain.digests(good, ["agent"], "n", "response"), ["agent"], 5)
    stored = chain.store_checkpoints(points.where("count = 5"), points, ["agent"])
    assert stored.count() == 6
    got = {r["agent"]: r for r in chain.verify_incremental(good, stored, ["agent"], "n", "response").collect()}
    assert all(r["valid"] and r["events"] == 13 and bytes(r["digest"]) == want[a] for a, r in got.items())
    got = chain.verify_incremental(good.where("n > 5"), stored, ["agent"], "n", "response", target=7).collect()
    assert all(r["events"] == 13 and bytes(r["digest"]) == want[r["agent"]] for r in got)


def test_leaves_and_heads(spark):
    key = [bytes([i]) * 32 for i in range(4)]
    rows = spark.createDataFrame([(key[0], key[1], 7, None, 9, key[2], key[3])], "asset binary, client_address binary, feedback_index long, seal_hash binary, slot long, responder binary, response_hash binary")
    u64 = lambda n: n.to_bytes(8, "little")
    for name in ("feedback", "response", "revoke"):
        middle = key[2] + key[3] if name == "response" else b""
        data = hashes.LEAF_DOMAIN[name].encode() + key[0] + key[1] + u64(7) + middle + bytes(32) + u64(9)
        assert bytes(chain.leaves(rows, name).first()["leaf"]) == hashes.keccak_batch([data])[0]
    heads = spark.createDataFrame([("a", 4, 1, 0, 0, "x", b"1"), ("a", 9, 3, 0, 0, "y", None), ("a", 8, 2, 0, 0, "z", b"2")], "agent string, n int, slot int, tx_index int, event_ordinal int, tx_signature string, digest binary")
    for canonical in (True, False):
        r = chain.heads(heads, ["agent"], "n", chain="feedback", canonical=canonical).first()
        assert (r["count"], bytes(r["digest"])) == (10, b"2")
    page = chain.replay_page(heads, ["agent"], "n", 0, None, 2).collect()
    assert [(r["n"], r["has_more"], r["next_from"]) for r in page] == []
    page = chain.replay_page(heads, ["agent"], "n", 4, 10, 2).orderBy("n").collect()
    assert [(r["n"], r["has_more"], r["next_from"]) for r in page] == [(4, True, 9), (8, True, 9)]


def test_cycle_runs_parents_first(spark):
    f = spark.createDataFrame([("A", "c", 0, "PENDING", "h"), ("B", "c", 0, "PENDING", "h"), ("C", "c", 0, "ORPHANED", "h"), ("D", "c", 0, "PENDING", "h")], "asset string, client_address string, feedback_index int, status string, seal_hash string").withColumn("slot", F.lit(1))
    exists = spark.createDataFrame([("A", True), ("B", False), ("C", True), ("D", None)], "asset string, exists boolean")
    verdicts = {k: spark.createDataFrame([(a, "ok") for a in "ABCD"], "asset string, verdict string") for k in ("feedback", "response", "revoke")}
    children = f.withColumn("status", F.when(F.col("asset") == "C", "ORPHANED").otherwise("PENDING")).withColumn("seal_hash", F.lit("x"))
    got = lifecycle.cycle(f, children, children, exists, verdicts, 10)
    want = {"A": "FINALIZED", "B": "ORPHANED", "C": "FINALIZED", "D": "PENDING"}
    for name, rows in got.items():
        assert {r["asset"]: r["status"] for r in rows.collect()} == want, name
    late = lifecycle.verify_feedbacks(f.withColumn("slot", F.lit(11)), exists, verdicts["feedback"], 10)
    assert {r["status"] for r in late.where("asset = 'A'").collect()} == {"PENDING"}
    tries = spark.createDataFrame([("a", None), ("a", False), ("b", None), ("c", False), ("c", True)], "id string, exists boolean")
    assert {r["id"]: r["exists"] for r in lifecycle.existence(tries, "id").collect()} == {"a": False, "b": None, "c": True}
    assert lifecycle.cutoff(10) == 0 and lifecycle.cutoff(100) == 68


def test_ids_that_exist_stay(spark):
    rows = spark.createDataFrame([(1, 5, "ok"), (2, None, "ok"), (3, None, "ORPHANED"), (4, None, "ok")], "k int, id long, status string")
    got = {r["k"]: r["id"] for r in ids.assign_global_ids(rows, ["k"], "id", F.col("status") != "ORPHANED").collect()}
    assert got == {1: 5, 2: 6, 3: None, 4: 7}
    again = {r["k"]: r["id"] for r in ids.assign_global_ids(spark.createDataFrame(list(got.items()), "k int, id long"), ["k"], "id", F.lit(False)).collect()}
    assert again == got


def test_values(spark):
    row = spark.createDataFrame([("ipfs://x", "ar://y", "https://z", "Qmz", 0, 100, 1_700_000_000_000)], "a string, b string, c string, d string, bt long, slot long, now long")
    got = row.select(
        *[scalar.uri_type(F.col(c)).alias(c) for c in "abcd"], F.unix_millis(scalar.block_time(F.col("bt"), F.col("slot"), F.col("now"))).alias("t"),
        F.unix_millis(scalar.block_time(F.col("now"), F.col("slot"), F.col("now"))).alias("ahead"), scalar.key_hash(F.lit("k")).alias("h"),
        scalar.hashes_equal(F.lit(None).cast("binary"), F.unhex(F.lit("00" * 32))).alias("e"), scalar.pointer_variants(F.lit("c1:b" + "a" * 20)).alias("p"),
        *[F.unix_seconds(scalar.timestamp_literal(F.lit(t))).alias(f"t{i}") for i, t in enumerate(("1700000000000", "1700000000", "2023-11-14T22:13:20Z"))],
        scalar.decompose_id(F.lit("sol:a:b"), "x", "y").alias("i"), scalar.decompose_id(F.lit("a"), "x", "y").alias("j"), scalar.cluster_id(F.lit("mainnet")).alias("cl"),
        scalar.response_status(F.lit("FINALIZED")).alias("rs"), scalar.request_status(F.lit(None)).alias("rq"), scalar.digest_text(F.lit("\\xAB")).alias("dg"),
    ).first()
    assert [got[c] for c in "abcd"] == ["IPFS", "ARWEAVE", "HTTP", "IPFS"]
    assert got["t"] == 1_584_316_800_000 + 40_000 and got["ahead"] == 1_700_000_300_000
    assert got["h"] == hashlib.sha256(b"k").hexdigest()[:32] and got["e"] and got["p"] == ["b" + "a" * 20, "c1:b" + "a" * 20]
    assert got["t0"] == got["t1"] == got["t2"] == 1_700_000_000
    assert (got["i"]["x"], got["i"]["y"], got["j"], got["cl"], got["rs"], got["rq"], got["dg"]) == ("a", "b", None, 101, "FINALIZED", "PENDING", "ab")
    page = row.select(paging.encode_cursor("a", "bt").alias("cursor")).select(paging.decode_cursor(F.col("cursor"), "a string, bt long").alias("x")).first()["x"]
    assert (page["a"], page["bt"]) == ("ipfs://x", 0)


def test_base58_and_lookup_hash():
    assert hashes.base58_batch([bytes(32), b"hello world", b"", None]) == ["1" * 32, "StV1DL6CwTryKyV", "", None]
    assert hashes.from_base58_batch(["StV1DL6CwTryKyV", "0", "", None]) == [b"hello world", None, b"", None]
    rnd = random.Random(1)
    values = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(40))) for _ in range(200)]
    assert hashes.from_base58_batch(hashes.base58_batch(values)) == values
    one = hashes.lookup_hash(values)
    assert [int(hashes.lookup_hash([v])[0]) for v in values] == one.tolist() and len(set(one.tolist())) > 190


def by_the_book(key):
    """The published lookup hash of a byte string, a byte at a time, with the start value and the blocks of the database that uses it."""
    m = 0xFFFFFFFF
    turn = lambda x, k: ((x << k) | (x >> (32 - k))) & m
    a = b = c = (0x9E3779B9 + len(key) + 3923095) & m
    word = lambda part: int.from_bytes(part.ljust(4, b"\0"), "little")
    rest = key
    while len(rest) >= 12:
        a, b, c = (a + word(rest[:4])) & m, (b + word(rest[4:8])) & m, (c + word(rest[8:12])) & m
        for k in (4, 6, 8, 16, 19, 4):
            a = ((a - c) & m) ^ turn(c, k)
            c = (c + b) & m
            a, b, c = b, c, a
        rest = rest[12:]
    # the first byte of c is for the length
    a, b, c = (a + word(rest[:4])) & m, (b + word(rest[4:8])) & m, (c + (word(rest[8:]) << 8)) & m
    for k in (14, 11, 25, 16, 4, 14, 24):
        c = ((c ^ b) - turn(b, k)) & m
        a, b, c = b, c, a
    return b


def test_lookup_hash_by_the_book():
    rnd = random.Random(6)
    values = [b"", b"a", b"Hello, world", "Größe".encode(), *(bytes(rnd.randrange(256) for _ in range(n)) for n in range(60))]
    signed = lambda x: x - (1 << 32) if x >> 31 else x
    got = [int(x) for x in hashes.lookup_hash(values)]
    assert [g - (1 << 32) if g >> 31 else g for g in got] == [signed(by_the_book(v)) for v in values]


def test_action_log(spark, tmp_path):
    lines = [
        dict(line=1, phase="feedback", asset="A", wallet="c1", feedback_index="0", seal_hash="h", tx_signature="f1"),
        dict(line=2, phase="response_payload", asset="A", wallet="r", client="c9", feedback_index="0", seal_hash="h"),
        dict(line=3, phase="response", asset="A", wallet="r", feedback_index="0", seal_hash="h", tx_signature="a1"),
        dict(line=4, phase="response", asset="A", wallet="r", feedback_index="0", seal_hash="h", tx_signature="a2"),
        dict(line=5, phase="response", asset="B", wallet="r", feedback_index="0", seal_hash="h", tx_signature="a3"),
        dict(line=6, phase="agent", asset="A", tx_signature="g"),
    ]
    (tmp_path / "log.jsonl").write_text("\n".join([*map(json.dumps, lines), "not json"]))
    log = tables.read_actions(spark, f"{tmp_path}/log.jsonl", "line long, phase string, asset string, wallet string, client string, feedback_index string, seal_hash string, tx_signature string")
    assert tuple(tables.action_counts(log).first()) == (7, 6, 1)
    actions, lost = reconcile.expected_actions(log.where("malformed IS NULL"))
    assert {(r["tx_signature"], r["client"]) for r in actions["response"].collect()} == {("a1", "c9"), ("a2", "c1")}
    assert [r["tx_signature"] for r in lost.collect()] == ["a3"]
    have = {"agent": actions["agent"], "feedback": actions["feedback"].withColumn("tx_signature", F.lit("other")), "response": actions["response"].where("tx_signature = 'a1'"), "revoke": actions["revoke"]}
    got = {r["kind"]: tuple(r)[1:] for r in reconcile.integrity(actions, have).collect()}
    assert got == {"agent": (1, 1, 0, 0), "feedback": (1, 1, 0, 1), "response": (2, 1, 1, 0), "revoke": (0, 0, 0, 0)}
    windows = tables.snapshot_windows({"a": (spark.range(10).toDF("slot"), "slot")}, 2, 4)
    assert windows["a"].count() == 3


def test_staging_keeps_the_last(spark):
    rows = spark.createDataFrame([("A", 1, 5, "x"), ("A", 1, 6, "y"), ("B", 1, 2, "z")], "asset string, n int, slot int, v string")
    parents = spark.createDataFrame([("B",)], "asset string")
    there, early = fold.stage_last(rows, parents, ["asset"], ["asset", "n"], F.struct("slot"))
    assert [r["v"] for r in there.collect()] == ["z"] and [r["v"] for r in early.collect()] == ["y"]
    staged = rows.withColumns({"tx_index": F.when(F.col("v") == "x", 0), "event_ordinal": F.lit(0), "slot": F.lit(None).cast("int")})
    come, wait = fold.promote(staged, spark.createDataFrame([("A",)], "asset string"), ["asset"], ["asset", "n"])
    assert [r["v"] for r in come.collect()] == ["y"] and [r["v"] for r in wait.collect()] == ["z"]  # a missing index comes last
    assert fold.expire(rows, 100, 400 * 95).count() == 2
    assert stats.with_stats(spark.createDataFrame([("Z", 4, 70)], "asset string, feedback_count int, raw_avg_score int"), spark.createDataFrame([], "asset string, status string, is_revoked boolean, score int"), spark.createDataFrame([], "asset string, chain_status string")).first()["avg_score"] == 70
