"""The fold of all kinds of events against a replay of one event after another, whole and in batches."""

import datetime
import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalar
from tallyforge.operators import events, projections
from tallyforge.sources import schemas, tables

Z = datetime.timezone.utc
REPUTATION = ["TrustTier", "QualityScore", "Confidence", "RiskScore", "DiversityRatio"]


def at(slot):
    return datetime.datetime(2026, 1, 1, tzinfo=Z) + datetime.timedelta(seconds=slot)


def log(seed, n):
    """Events of all kinds about few keys, so that everything happens: early children, repeats, moves, late registrations, orphaned revocations."""
    r = random.Random(seed)
    digest = lambda: hashlib.sha256(str(r.random()).encode()).hexdigest()
    asset, client = lambda: r.choice("ABCDEF"), lambda: r.choice("cd")
    lock = lambda: r.choice([{}, {}, {"lock": True}, {"lock": False}])
    said = lambda names: {f"new{k}": r.randrange(5 if k == "TrustTier" else 100) for k in names}
    make = {
        "AgentRegistered": lambda: dict(asset=r.choice("ABCDE"), collection=r.choice("XY"), owner=r.choice("pqr"), agentUri=r.choice(["", "u1", "u2"]), **r.choice([{}, {"atomEnabled": False}])),
        "AgentOwnerSynced": lambda: dict(asset=asset(), oldOwner="p", newOwner=r.choice("pqr")),
        "AtomEnabled": lambda: dict(asset=asset(), enabledBy="p"),
        "UriUpdated": lambda: dict(asset=asset(), newUri=r.choice(["", "v1", "v2"]), updatedBy="p"),
        "WalletUpdated": lambda: dict(asset=asset(), newWallet=r.choice(["w", projections.NO_WALLET]), updatedBy="p"),
        "WalletResetOnOwnerSync": lambda: dict(asset=asset(), newWallet=r.choice(["w2", projections.NO_WALLET]), ownerAfterSync=r.choice("pqr")),
        "MetadataSet": lambda: dict(asset=asset(), key=r.choice(["k", "l", "_uri:name"]), value=f"v{r.randrange(99)}", immutable=r.random() < 0.3),
        "MetadataDeleted": lambda: dict(asset=asset(), key=r.choice("kl")),
        "RegistryInitialized": lambda: dict(collection=r.choice("XYZ"), authority=r.choice("st")),
        "CollectionPointerSet": lambda: dict(asset=asset(), setBy=r.choice("pq"), col=r.choice(["c1:m", "c1:n"]), **lock()),
        "ParentAssetSet": lambda: dict(asset=asset(), parentAsset=asset(), parentCreator="p", setBy="p", **lock()),
        "NewFeedback": lambda: dict(asset=asset(), clientAddress=client(), feedbackIndex=r.randrange(3), value=str(r.randrange(-9, 9)), valueDecimals=0, sealHash=digest(), atomEnabled=r.random() < 0.6, newFeedbackDigest=digest(), newFeedbackCount=1, tag1=r.choice(["", "t"]), **r.choice([{}, {"score": r.randrange(101)}]), **said(REPUTATION)),
        "FeedbackRevoked": lambda: dict(asset=asset(), clientAddress=client(), feedbackIndex=r.randrange(3), sealHash=digest(), originalScore=3, atomEnabled=r.random() < 0.7, hadImpact=r.random() < 0.7, newRevokeDigest=digest(), newRevokeCount=1, **said(REPUTATION[:3])),
        "ResponseAppended": lambda: dict(asset=asset(), client=client(), feedbackIndex=r.randrange(3), responder=r.choice("xy"), responseHash=digest(), sealHash=digest(), newResponseDigest=digest(), newResponseCount=r.randrange(9), responseUri=r.choice(["", "z"])),
        "ValidationRequested": lambda: dict(asset=asset(), validatorAddress="v", nonce=r.randrange(3), requestUri=r.choice(["", "a"]), requestHash=digest(), requester=r.choice("mn")),
        "ValidationResponded": lambda: dict(asset=asset(), validatorAddress="v", nonce=r.randrange(3), response=r.randrange(99), responseHash=digest(), tag=r.choice(["", "g"])),
    }
    often = ["NewFeedback", "FeedbackRevoked", "ResponseAppended", "CollectionPointerSet"] * 4 + ["AgentRegistered", "MetadataSet"] + list(make)
    out = []
    for k in range(n):
        kind = r.choice(often)
        while kind == "AgentRegistered" and k < n // 4:  # many children come first
            kind = r.choice(often)
        out.append((kind, make[kind](), k // 3, r.choice([None, k % 3]) if k % 3 == 0 else k % 3, k % 3, f"s{k:04d}"))
    # the ledger's order: slot, index (null first), ordinal, signature
    return sorted(out, key=lambda e: (e[2], -1 if e[3] is None else e[3], e[4], e[5]))


def replay(log):
    """One event after the other, tables as dictionaries."""
    T = {k: {} for k in projections.TABLES}
    agents, feedbacks, revocations = T["agents"], T["feedbacks"], T["revocations"]
    blank = lambda x: x or None
    wallet = lambda w: None if w == projections.NO_WALLET else w

    def count(a, when):
        live = [f for k, f in feedbacks.items() if k[0] == a and not f["is_revoked"]]
        scores = [f["score"] for f in live if f["score"] is not None]
        agents[a].update(feedback_count=len(live), raw_avg_score=int(sum(scores) / len(scores) + 0.5) if scores else 0, updated_at=when)

    def take(key, row):
        if key in feedbacks:
            feedbacks[key].update({c: row[c] for c in ("feedback_hash", "running_digest")})
        else:
            feedbacks[key] = {c: row[c] for c in row if not c.startswith("new_") and c != "atom_enabled"} | dict(is_revoked=False, revoked_at=None, revoked_slot=None, status="PENDING")
        if row["atom_enabled"]:
            agents[key[0]].update({c: row[f"new_{c}"] for c in projections.REPUTATION})
        count(key[0], row["created_at"])
        for k in [k for k in T["orphan_responses"] if k[:3] == key]:
            T["responses"][k] = T["orphan_responses"].pop(k) | {"status": "PENDING"}
        if key in revocations and revocations[key]["status"] == "ORPHANED":
            revocations[key]["status"] = "PENDING"

    for kind, d, slot, tx, ordinal, signature in log:
        when, place = at(slot), dict(slot=slot, tx_index=tx, event_ordinal=ordinal, tx_signature=signature)
        a = d.get("asset")
        mine = agents.get(a)
        key = (a, d.get("clientAddress", d.get("client")), d.get("feedbackIndex"))
        if kind == "AgentRegistered":
            T["collections"].setdefault(d["collection"], dict(registry_type="BASE", authority=None, created_at=when, created_slot=slot, status="PENDING"))
            now = dict(owner=d["owner"], uri=blank(d["agentUri"]), atom_enabled=d.get("atomEnabled", True), tx_index=tx, event_ordinal=ordinal, updated_at=when)
            if mine:
                mine.update(now)
            else:
                agents[a] = now | dict(creator=d["owner"], collection=d["collection"], slot=slot, tx_signature=signature, created_at=when, wallet=None, parent_asset=None, parent_creator=None, parent_locked=False, canonical_col="", col_locked=False, feedback_count=0, raw_avg_score=0, status="PENDING", **dict.fromkeys(projections.REPUTATION))
            far = 2**31 - 1
            waiting = sorted((k for k in T["orphan_feedbacks"] if k[0] == a), key=lambda k: [far if T["orphan_feedbacks"][k][c] is None else T["orphan_feedbacks"][k][c] for c in ("slot", "tx_index", "event_ordinal")])
            for k in waiting:
                take(k, T["orphan_feedbacks"].pop(k))
        elif kind == "RegistryInitialized":
            row = T["collections"].setdefault(d["collection"], dict(created_at=when, created_slot=slot, status="PENDING"))
            row.update(registry_type="BASE", authority=d["authority"])
        elif kind == "MetadataSet":
            old = T["metadata"].get((a, d["key"]))
            if not d["key"].startswith("_uri:") and not (old and old["immutable"]):
                h = hashlib.sha256(d["key"].encode()).hexdigest()[:32]
                T["metadata"][a, d["key"]] = place | dict(id=f"{a}:{h}", key_hash=h, value=d["value"], immutable=d["immutable"], updated_at=when, status="PENDING")
        elif kind == "MetadataDeleted":
            T["metadata"].pop((a, d["key"]), None)
        elif kind == "NewFeedback":
            row = place | dict(value=d["value"], value_decimals=0, score=d.get("score"), tag1=blank(d["tag1"]), tag2=None, endpoint=None, feedback_uri=None, feedback_hash=bytes.fromhex(d["sealHash"]), running_digest=bytes.fromhex(d["newFeedbackDigest"]), created_at=when, atom_enabled=d["atomEnabled"], **{f"new_{c}": d[f"new{n}"] for c, n in zip(projections.REPUTATION, REPUTATION)})
            if mine:
                take(key, row)
            else:
                T["orphan_feedbacks"][key] = row
        elif kind == "FeedbackRevoked":
            there = key in feedbacks
            revocations[key] = place | dict(feedback_hash=bytes.fromhex(d["sealHash"]), original_score=3, atom_enabled=d["atomEnabled"], had_impact=d["hadImpact"], revoke_count=1, running_digest=bytes.fromhex(d["newRevokeDigest"]), created_at=when, status="PENDING" if there else "ORPHANED")
            if there:
                feedbacks[key].update(is_revoked=True, revoked_at=when, revoked_slot=slot)
                count(a, when)
                if d["atomEnabled"] and d["hadImpact"]:
                    mine.update({c: d[f"new{n}"] for c, n in zip(projections.REPUTATION[:3], REPUTATION)})
        elif kind == "ResponseAppended":
            row = {k: v for k, v in place.items() if k != "tx_signature"} | dict(response_uri=blank(d["responseUri"]), response_hash=bytes.fromhex(d["responseHash"]), seal_hash=bytes.fromhex(d["sealHash"]), response_count=d["newResponseCount"], running_digest=bytes.fromhex(d["newResponseDigest"]), created_at=when)
            if key in feedbacks:
                T["responses"][*key, d["responder"], signature] = row | {"status": "PENDING"}
            else:
                T["orphan_responses"][*key, d["responder"], signature] = row
        elif kind.startswith("Validation"):
            k = (a, "v", d["nonce"])
            row = T["validations"].setdefault(k, dict.fromkeys(["requester", "request_uri", "request_hash", "response", "response_uri", "response_hash", "tag", "updated_at"]) | dict(status="PENDING", created_at=when, chain_status="PENDING"))
            row.update(place)
            if kind == "ValidationRequested":
                row.update(requester=d["requester"], request_uri=blank(d["requestUri"]), request_hash=bytes.fromhex(d["requestHash"]))
            else:
                row.update(response=d["response"], response_uri=None, response_hash=bytes.fromhex(d["responseHash"]), tag=blank(d["tag"]), status="RESPONDED", updated_at=when)
        elif mine:
            mine["updated_at"] = when
            if kind == "AgentOwnerSynced":
                mine["owner"] = d["newOwner"]
            elif kind == "AtomEnabled":
                mine["atom_enabled"] = True
            elif kind == "UriUpdated":
                mine["uri"] = blank(d["newUri"])
            elif kind == "WalletUpdated":
                mine["wallet"] = wallet(d["newWallet"])
            elif kind == "WalletResetOnOwnerSync":
                mine.update(owner=d["ownerAfterSync"], wallet=wallet(d["newWallet"]))
            elif kind == "ParentAssetSet":
                mine.update(parent_asset=d["parentAsset"], parent_creator="p", parent_locked=d.get("lock", mine["parent_locked"]))
            elif kind == "CollectionPointerSet":
                mine.update(canonical_col=d["col"], col_locked=d.get("lock", mine["col_locked"]))
                p = T["collection_pointers"].setdefault((d["col"], mine["creator"]), dict(first_seen_asset=a, first_seen_at=when, first_seen_slot=slot, first_seen_tx_signature=signature))
                p.update(last_seen_at=when, last_seen_slot=slot, last_seen_tx_index=tx, last_seen_tx_signature=signature)
    for (col, creator), p in T["collection_pointers"].items():
        p["asset_count"] = sum(x["canonical_col"] == col and x["creator"] == creator for x in agents.values())
    return T


def raw(spark, log):
    return spark.createDataFrame([(k, json.dumps(d), s, slot, at(slot), tx, o) for k, d, slot, tx, o, s in log], tables.EVENTS)


def rows_of(table, name):
    key = projections.KEYS[name]
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else int(v) if type(v).__name__ == "Decimal" else v.astimezone(Z) if isinstance(v, datetime.datetime) else v
    found = {}
    for r in table.collect():
        row = {c: plain(v) for c, v in r.asDict().items()}
        k = tuple(row.pop(c) for c in key)
        assert k not in found, (name, k)
        found[k[0] if len(k) == 1 else k] = row
    return found


def compare(got, want):
    for name in projections.TABLES:
        mine = rows_of(got[name], name)
        assert mine.keys() == want[name].keys(), name
        for k, row in mine.items():
            differ = {c: (v, want[name][k][c]) for c, v in row.items() if v != want[name][k][c]}
            assert not differ, (name, k, differ)


def fold_in(spark, log, cuts):
    kept = None
    for a, b in zip([0, *cuts], [*cuts, len(log)]):
        batch = raw(spark, log[a:b])
        kept = {k: tables.checkpoint(v) for k, v in projections.fold(batch, kept)[0].items()}
    return kept, batch


@pytest.mark.parametrize("seed, cuts", [(1, []), (1, [60, 61, 150]), (2, [100])])
def test_fold_equals_the_replay(spark, seed, cuts):
    events_ = log(seed, 240)
    kept, batch = fold_in(spark, events_, cuts)
    want = replay(events_)
    assert all(want[k] for k in ("agents", "feedbacks", "orphan_feedbacks", "responses", "orphan_responses", "collection_pointers"))
    assert {r["status"] for r in want["revocations"].values()} == {"PENDING", "ORPHANED"}
    compare(kept, want)
    if len(cuts) == 1:  # a batch that comes again changes nothing
        compare(projections.fold(batch, kept)[0], want)


def test_fold_of_nothing_and_what_it_reads(spark, tmp_path):
    got, dead = projections.fold(raw(spark, log(1, 3)).where("false"))
    assert all(v.isEmpty() and v.columns == projections.columns_of(k) for k, v in got.items()) and dead.isEmpty()
    raw(spark, log(1, 50)).write.parquet(f"{tmp_path}/events")
    got, dead = projections.fold(tables.read_events(spark, f"{tmp_path}/events"))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    # changes of agents, moves and feedback are written before, as are responses and sets of metadata; the others read their family once
    assert {k: scans(v) for k, v in got.items() if scans(v)} == {"collections": 1, "validations": 1}


def test_moves_of_pointers_count_down(spark):
    told = [("AgentRegistered", dict(asset=a, collection="C", owner="o", agentUri=""), 1, 0, k, f"r{k}") for k, a in enumerate("AB")]
    move = lambda a, col, slot: ("CollectionPointerSet", dict(asset=a, setBy="z", col=col), slot, 0, 0, f"m{slot}")
    kept, _ = fold_in(spark, told + [move("A", "p", 2), move("B", "p", 3), move("A", "q", 4)], [4])
    assert {r["col"]: (r["asset_count"], r["first_seen_slot"], r["last_seen_slot"]) for r in kept["collection_pointers"].collect()} == {"p": (1, 2, 3), "q": (1, 4, 4)}
    # an agent without a creator takes who set its pointer first
    none = kept["agents"].withColumns({"creator": F.lit(None).cast("string"), "canonical_col": F.lit("")})
    got = projections.fold(raw(spark, [move("A", "s", 9)]), {"agents": none})[0]
    assert got["agents"].where("asset = 'A'").first()["creator"] == "z"
    assert [(r["col"], r["creator"], r["asset_count"]) for r in got["collection_pointers"].collect()] == [("s", "z", 1)]


def test_entities_have_their_schemas(spark):
    got = projections.fold(raw(spark, log(3, 60)))[0]
    for name, rows in projections.entities(got).items():
        want = spark.createDataFrame([], schemas.SCHEMAS[name]).dtypes
        assert rows.dtypes == want, name
    a = projections.entities(got)["agents"].first()
    assert a["agent_uri"] == got["agents"].where(F.col("asset") == a["asset"]).first()["uri"] and a["block_slot"] is not None


def test_wide_marks_dead_letters(spark):
    rows = [("NewFeedback", {"asset": "A"}), ("AgentRegistered", {"asset": "A", "collection": "c", "owner": "o"}), ("Unknown", {"asset": "A"}), ("MetadataSet", {"asset": "A", "key": "k", "value": "7 of them", "immutable": False})]
    frame = spark.createDataFrame([(k, json.dumps(d), f"s{i}", 1, 0, i) for i, (k, d) in enumerate(rows)] + [("UriUpdated", None, "n", 1, 0, 9), ("UriUpdated", "no json", "m", 1, 0, 9)], "name string, data string, tx_signature string, slot long, tx_index int, event_ordinal int")
    got = {(r["name"], r["tx_signature"]): r for r in events.wide(frame).collect()}
    assert {k[1]: r["ok"] for k, r in got.items()} == {"s0": False, "s1": True, "s3": True, "n": False, "m": False}
    assert got["AgentRegistered", "s1"]["atom_enabled"] is True and got["MetadataSet", "s3"]["value"] == "7 of them" and got["NewFeedback", "s0"]["atom_enabled"] is None


def test_events_are_parsed_once(spark):
    """No table's plan holds the parser: each condition on a parsed column would parse the event again."""
    frame = spark.createDataFrame([(kind, json.dumps(data), slot, tx, ordinal, signature, at(slot)) for kind, data, slot, tx, ordinal, signature in log(1, 30)], "name string, data string, slot long, tx_index int, event_ordinal int, tx_signature string, block_time timestamp")
    made, dead = projections.changes(frame, {name: projections.stored_table(frame, name, None) for name in projections.TABLES})
    for rows in (*[part for parts in made.values() for part in parts], dead):
        assert "from_json" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_steps_of_the_fold_leave_no_shuffles(spark):
    """What a step shuffled is deleted when its result is written, and the digests of a feedback are kept once."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.rsplit("/", 1)[-1] for f in disk.getAllFiles().mkString(" ").split(" ") if "/shuffle_" in f}
    frame = raw(spark, log(1, 240))
    stored = {name: projections.stored_table(frame, name, None) for name in projections.TABLES}
    before = shuffles()
    made, _ = projections.changes(frame, stored)
    for _ in range(50):  # deletion isn't waited for
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    fed = projections.feedback_changes(tables.checkpoint(events.wide(frame)).where("ok"), made["agents"][0].withColumn("_born", scalar.guard()), stored)
    assert fed.where("base IS NOT NULL AND hashes.feedback_hash = base.feedback_hash AND hashes.running_digest = base.running_digest").isEmpty()
    assert not fed.where("base IS NOT NULL").isEmpty()
