"""Events of all kinds folded into the entity tables.

events.wide() makes one row of each event, with typed columns. A table is made
of the events of its key family (an asset; a feedback's triple; a response's
key; an asset and a metadata key; a validation's key) by one aggregate over
them, and only then meets the stored table, so that a hot key is summed up
before any join and the raw events are read once a family. What follows from an
agent's registration in mid-batch, from staged rows and from revocations that
come before their feedback is decided by comparing places in the ledger order,
not by replaying.

Events are told apart by slot, transaction index, ordinal and signature; a
repeated delivery of a batch changes nothing, and batches in the order of the
ledger give what one batch of all gives. Empty inputs give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashes, scalar
from ..sources import schemas
from ..sources.shared import checkpoint, drop, written
from . import events
from .fold import metadata_state, project
from .rollups import feedback_rollup

#: Fixed value: the wallet that stands for none.
NO_WALLET = "1" * 32

_PLACE = "slot long, tx_index int, event_ordinal int, tx_signature string"
_HELD = f"running_digest binary, {_PLACE}, created_at timestamp"
FEEDBACK_KEY = ["asset", "client_address", "feedback_index"]
RESPONSE_KEY = [*FEEDBACK_KEY, "responder", "tx_signature"]
VALIDATION_KEY = ["asset", "validator_address", "nonce"]
_TRIPLE = "asset string, client_address string, feedback_index decimal(20,0)"
_FEEDBACK = f"value string, value_decimals int, score int, tag1 string, tag2 string, endpoint string, feedback_uri string, feedback_hash binary, {_HELD}"
_RESPONSE = "response_uri string, response_hash binary, seal_hash binary, response_count decimal(20,0), running_digest binary, slot long, tx_index int, event_ordinal int, created_at timestamp"
REPUTATION = ["trust_tier", "quality_score", "confidence", "risk_score", "diversity_ratio"]
#: The tables that fold() makes and takes as a snapshot.
TABLES = {
    "agents": f"asset string, owner string, creator string, collection string, {_PLACE}, created_at timestamp, updated_at timestamp, uri string, wallet string, atom_enabled boolean, parent_asset string, parent_creator string, parent_locked boolean, canonical_col string, col_locked boolean, {', '.join(f'{c} int' for c in REPUTATION)}, feedback_count long, raw_avg_score long, status string",
    "collections": "collection string, registry_type string, authority string, created_slot long, created_at timestamp, status string",
    "collection_pointers": "col string, creator string, first_seen_asset string, first_seen_at timestamp, first_seen_slot long, first_seen_tx_signature string, last_seen_at timestamp, last_seen_slot long, last_seen_tx_index int, last_seen_tx_signature string, asset_count long",
    "feedbacks": f"{_TRIPLE}, {_FEEDBACK}, is_revoked boolean, revoked_slot long, revoked_at timestamp, status string",
    "orphan_feedbacks": f"{_TRIPLE}, {_FEEDBACK}, atom_enabled boolean, {', '.join(f'new_{c} int' for c in REPUTATION)}",
    "revocations": f"{_TRIPLE}, feedback_hash binary, original_score int, atom_enabled boolean, had_impact boolean, revoke_count decimal(20,0), {_HELD}, status string",
    "responses": f"{_TRIPLE}, responder string, tx_signature string, {_RESPONSE}, status string",
    "orphan_responses": f"{_TRIPLE}, responder string, tx_signature string, {_RESPONSE}",
    "validations": f"asset string, validator_address string, nonce decimal(20,0), requester string, request_uri string, request_hash binary, response int, response_uri string, response_hash binary, tag string, status string, {_PLACE}, created_at timestamp, updated_at timestamp, chain_status string",
    "metadata": f"id string, asset string, key string, key_hash string, value string, immutable boolean, {_PLACE}, updated_at timestamp, status string",
}


def columns_of(name: str) -> list[str]:
    return [c.split(" ")[0] for c in TABLES[name].split(", ")]


_PLAIN = [c for c in columns_of("orphan_feedbacks") if c not in FEEDBACK_KEY]


def _is(*names: str) -> Column:
    return F.col("name").isin(*names)


def _last(value: Column | str, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("o")))


def _at(when: Column) -> Column:
    return F.max(F.when(when, F.col("o")))


def _lowest() -> Column:
    return F.struct(*[F.lit(-2).cast("long").alias(c) for c in ("slot", "tx_index", "event_ordinal")], F.lit("").alias("tx_signature"))


def _kept(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows of a stored table with each of its columns but the keys behind `s_`, and `s_there`."""
    return rows.select(*keys, *[F.col(c).alias(f"s_{c}") for c in columns_of(name) if c not in keys], F.lit(True).alias("s_there"))


#: Kinds of events that set an agent's columns.
NEW = "AgentRegistered"
OF_ASSETS = [NEW, "AgentOwnerSynced", "AtomEnabled", "UriUpdated", "WalletUpdated", "WalletResetOnOwnerSync", "ParentAssetSet", "CollectionPointerSet"]


def asset_changes(rows: DataFrame) -> DataFrame:
    """A row for each asset that events name: the last value of each column with the place of its event (o_...), and what the first registration said."""
    new = _is(NEW)
    wallet = F.nullif("new_wallet", F.lit(NO_WALLET))
    groups = {  # column: the kinds that set it, its value
        "owner": (_is(NEW, "AgentOwnerSynced", "WalletResetOnOwnerSync"), F.coalesce("new_owner", "owner_after_sync", "owner")),
        "uri": (_is(NEW, "UriUpdated"), scalar.blank_to_null(F.coalesce("new_uri", "agent_uri"))),
        "atom_enabled": (_is(NEW, "AtomEnabled"), F.when(new, F.col("atom_enabled")).otherwise(F.lit(True))),
        "wallet": (_is("WalletUpdated", "WalletResetOnOwnerSync"), wallet),
        "parent": (_is("ParentAssetSet"), F.struct("parent_asset", "parent_creator")),
        "parent_locked": (_is("ParentAssetSet") & F.col("lock").isNotNull(), F.col("lock")),
        "canonical_col": (_is("CollectionPointerSet"), F.col("col")),
        "col_locked": (_is("CollectionPointerSet") & F.col("lock").isNotNull(), F.col("lock")),
    }
    aggs = [a for c, (when, value) in groups.items() for a in (_last(value, when).alias(c), _at(when).alias(f"o_{c}"))]
    first = F.struct("owner", "collection", "slot", "tx_signature", F.col("at").alias("created_at"))
    aggs += [F.min_by(first, F.when(new, F.col("o"))).alias("first"), F.min(F.when(new, F.col("o"))).alias("born")]
    aggs += [_last(F.struct("tx_index", "event_ordinal"), new).alias("place"), F.min_by("set_by", F.when(_is("CollectionPointerSet"), F.col("o"))).alias("set_by")]
    return rows.where(_is(*OF_ASSETS)).groupBy("asset").agg(*aggs, F.max("o").alias("o_any"), F.max_by("at", "o").alias("updated_at"))


def _agents(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """The agents: stored ones and those registered, with what their events changed from the registration on. Also _born, its place in the ledger, and _o, the last event's."""
    rows = changes.join(_kept(stored, ["asset"], "agents"), "asset", "full").where("born IS NOT NULL OR s_there")
    born = F.when(F.col("s_there"), scalar.guard("s_slot", "s_tx_index", "s_event_ordinal", "s_tx_signature")).otherwise(F.col("born"))
    live = lambda c: F.coalesce(F.col(f"o_{c}") >= born, F.lit(False))
    now = lambda c, value=None: F.when(live(c), F.col(c) if value is None else value)
    was = lambda c: F.col(f"s_{c}")
    first = lambda c: F.when(F.col("s_there"), was(c)).otherwise(F.col(f"first.{c}"))
    again = F.col("born").isNotNull()
    made = {c: F.when(live(c), F.col(c)).otherwise(was(c)) for c in ("owner", "uri", "atom_enabled", "wallet")}
    made |= {c: F.when(live("parent"), F.col(f"parent.{c}")).otherwise(was(c)) for c in ("parent_asset", "parent_creator")}
    made |= {c: F.coalesce(now(c), was(c), F.lit(False)) for c in ("parent_locked", "col_locked")}
    made |= {c: first(c) for c in ("collection", "slot", "tx_signature", "created_at")}
    made |= {c: F.when(again, F.col(f"place.{c}")).otherwise(was(c)) for c in ("tx_index", "event_ordinal")}
    made["canonical_col"] = F.coalesce(now("canonical_col"), was("canonical_col"), F.lit(""))
    made["creator"] = F.coalesce(was("creator"), "first.owner", now("canonical_col", F.col("set_by")))
    made["updated_at"] = F.coalesce(F.when(F.col("o_any").isNotNull(), F.col("updated_at")), was("updated_at"))
    made |= {c: was(c) for c in REPUTATION}
    made |= {c: F.coalesce(was(c), F.lit(0).cast("long")) for c in ("feedback_count", "raw_avg_score")}
    made["status"] = F.coalesce(was("status"), F.lit("PENDING"))
    return rows.select("asset", *[made[c].alias(c) for c in columns_of("agents")[1:]], born.alias("_born"), F.col("o_any").alias("_o"))


def collections(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """A row for each collection that events initialise or register in: its last authority, its first event's time. Stored ones keep all but the authority."""
    told = _is("RegistryInitialized")
    new = rows.where(_is("RegistryInitialized", NEW)).groupBy("collection").agg(_last("authority", told).alias("authority"), F.max(told).alias("told"), F.min_by("slot", "o").alias("created_slot"), F.min_by("at", "o").alias("created_at"))
    both = new.join(_kept(stored, ["collection"], "collections"), "collection", "left")
    old = lambda c, fresh: F.when(F.col("s_there"), F.col(f"s_{c}")).otherwise(fresh).alias(c)
    authority = F.when(F.col("told"), F.col("authority")).otherwise(F.col("s_authority")).alias("authority")
    kind = F.when(F.coalesce("told", F.lit(False)), "BASE").otherwise(F.coalesce("s_registry_type", F.lit("BASE"))).alias("registry_type")
    return both.select("collection", kind, authority, old("created_slot", F.col("created_slot")), old("created_at", F.col("created_at")), old("status", F.lit("PENDING")))


def pointer_changes(moves: DataFrame) -> DataFrame:
    """col, creator, first and last sight of each pointer that moves name (asset, col, creator, slot, tx_index, tx_signature, at, o); the last one by slot, index and signature."""
    late = F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")).alias(c) for c in ("slot", "tx_index")], F.coalesce("tx_signature", F.lit("")).alias("tx_signature"), "o")
    first = F.struct("asset", "at", "slot", "tx_signature")
    last = F.struct("at", "slot", "tx_index", "tx_signature")
    seen = moves.where("col <> ''").groupBy("col", "creator").agg(F.min_by(first, "o").alias("f"), F.max_by(last, late).alias("l"))
    return seen.select("col", "creator", *[F.col(f"f.{c}").alias(f"first_seen_{c}") for c in ("asset", "at", "slot", "tx_signature")], *[F.col(f"l.{c}").alias(f"last_seen_{c}") for c in ("at", "slot", "tx_index", "tx_signature")])


def pointer_steps(moves: DataFrame) -> DataFrame:
    """col, creator, step of each move (asset, was, creator_was, col, creator): -1 for the pointer that is left, +1 for the one that is taken; none if it is the same or blank."""
    moved = moves.where(~(F.col("was").eqNullSafe(F.col("col")) & F.col("creator_was").eqNullSafe(F.col("creator"))))
    steps = F.array(F.struct(F.col("was").alias("col"), F.col("creator_was").alias("creator"), F.lit(-1).alias("step")), F.struct("col", "creator", F.lit(1).alias("step")))
    return moved.select(F.explode(steps).alias("x")).select("x.*").where("col <> '' AND creator IS NOT NULL")


def _pointers(rows: DataFrame, agents: DataFrame, stored_agents: DataFrame, stored: DataFrame) -> DataFrame:
    """The pointers that moves name: stored rows with later sights and signed changes of their counts, and new ones. Moves of assets that aren't registered by then don't count."""
    held = agents.select("asset", "creator", F.col("_born").alias("born"), F.col("canonical_col").alias("held"))
    moves = checkpoint(rows.where(_is("CollectionPointerSet")).join(held, "asset").where("o >= born").select("asset", "col", "creator", "held", "slot", "tx_index", "tx_signature", "at", "o"), free=True)
    seen = pointer_changes(moves)
    now = moves.groupBy("asset").agg(F.first("creator").alias("creator"), F.first("held").alias("col"))
    before = stored_agents.select("asset", F.col("canonical_col").alias("was"), F.coalesce("creator", "owner").alias("creator_was"))
    steps = pointer_steps(now.join(before, "asset", "left")).groupBy("col", "creator").agg(F.sum("step").alias("step"))
    key = ["col", "creator"]
    both = seen.join(steps, key, "full").join(_kept(stored, key, "collection_pointers"), key, "left").where("first_seen_slot IS NOT NULL OR s_there")
    place = lambda p: F.struct(*[F.coalesce(F.col(f"{p}last_seen_{c}").cast("long"), F.lit(-1).cast("long")).alias(c) for c in ("slot", "tx_index")], F.coalesce(f"{p}last_seen_tx_signature", F.lit("")).alias("s"))
    newer = F.col("last_seen_slot").isNotNull() & (F.col("s_there").isNull() | (place("") >= place("s_")))
    first = [F.when(F.col("s_there"), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in columns_of("collection_pointers") if c.startswith("first")]
    last = [F.when(newer, F.col(c)).otherwise(F.col(f"s_{c}")).alias(c) for c in columns_of("collection_pointers") if c.startswith("last")]
    return both.select(*key, *first, *last, F.greatest(F.lit(0).cast("long"), F.coalesce("s_asset_count", F.lit(0).cast("long")) + F.coalesce("step", F.lit(0).cast("long"))).alias("asset_count"))


def _feedback_events(rows: DataFrame, staged: DataFrame) -> DataFrame:
    """asset, client_address, feedback_index, o, f (feedback) or r (revocation), at; staged rows count as events once more."""
    told, gone = _is("NewFeedback"), _is("FeedbackRevoked")
    blank = {c: scalar.blank_to_null(F.col(c)).alias(c) for c in ("tag1", "tag2", "endpoint")}
    names = {"value": F.col("value_big").alias("value"), "feedback_hash": F.col("seal_hash").alias("feedback_hash"), "running_digest": F.col("new_feedback_digest").alias("running_digest"), "created_at": F.col("at").alias("created_at"), **blank}
    f = F.struct(*[names.get(c, F.col(c)) for c in _PLAIN])
    names |= {"running_digest": F.col("new_revoke_digest").alias("running_digest")}
    more = ["atom_enabled", "had_impact", *[f"new_{c}" for c in REPUTATION[:3]]]
    columns = [c for c in columns_of("revocations") if c not in (*FEEDBACK_KEY, "status", *more)]
    names |= {"revoke_count": F.col("new_revoke_count").alias("revoke_count")}
    r = F.struct(*[names.get(c, F.col(c)) for c in columns], *more)
    own = rows.where(told | gone).select(*FEEDBACK_KEY, "o", F.when(told, f).alias("f"), F.when(gone, r).alias("r"))
    again = staged.select(*FEEDBACK_KEY, scalar.guard().alias("o"), F.struct(*_PLAIN).alias("f"))
    return own.unionByName(again, allowMissingColumns=True)


def _promotion(row: str) -> Column:
    """The order in which a new agent's staged feedback is taken in: a missing slot first, a missing index or ordinal last; then the time and the id."""
    far = (1 << 31) - 1
    parts = [F.coalesce(F.col(f"{row}{c}").cast("long"), F.lit(d).cast("long")).alias(c) for c, d in (("slot", 0), ("tx_index", far), ("event_ordinal", far))]
    return F.struct(*parts, F.col(f"{row}created_at").alias("created_at"), scalar.compose_id(*[F.col(k) for k in FEEDBACK_KEY]).alias("id"))


def feedback_changes(rows: DataFrame, agents: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """A row for each feedback key that events or staged rows name, with the stored feedback (s_...) and revocation (t) of that key.

    born: its agent is registered. base: the feedback's columns
    (of the last event before the agent's registration, else of the first after).
    hashes: of the last event, where they aren't the base's. fed, hit: what the last event of its kind says of
    the agent's reputation. r: the last revocation; applied: it came when the
    feedback was there, and not before the stored one.
    """
    lives = agents.select("asset", F.col("_born").alias("born"))
    o, born = F.col("o"), F.col("born")
    says = [f"new_{c}" for c in REPUTATION]
    told = F.col("f").isNotNull()
    post = told & born.isNotNull() & (o >= born)
    hit = F.col("r.atom_enabled") & F.col("r.had_impact")
    joined = _feedback_events(rows, stored["orphan_feedbacks"]).join(lives, "asset", "left")
    by = joined.groupBy(*FEEDBACK_KEY).agg(
        F.first("born").alias("born"),
        F.max_by("f", F.when(told & ~F.coalesce(post, F.lit(False)), o)).alias("early"), F.min_by("f", F.when(post, o)).alias("late"),
        _last(F.struct("f.feedback_hash", "f.running_digest"), post).alias("hashes"), _at(post).alias("o_told"), F.max_by("f.created_at", F.when(post, o)).alias("told_at"), F.min(F.when(post, o)).alias("o_late"),
        _last(F.struct(*[f"f.{c}" for c in says]), post & F.col("f.atom_enabled")).alias("fed"), _at(post & F.col("f.atom_enabled")).alias("o_fed"),
        F.max_by("r", F.when(F.col("r").isNotNull(), o)).alias("r"), _at(F.col("r").isNotNull()).alias("o_r"), _last(F.struct(*[f"r.{c}" for c in says[:3]]), hit).alias("hit"), _at(hit).alias("o_hit"),
    )
    s = _kept(stored["feedbacks"], FEEDBACK_KEY, "feedbacks").withColumn("o_s", scalar.guard("s_slot", "s_tx_index", "s_event_ordinal", "s_tx_signature"))
    t = stored["revocations"].select(*FEEDBACK_KEY, F.struct(*[c for c in columns_of("revocations") if c not in FEEDBACK_KEY]).alias("t"), scalar.guard().alias("o_t"))
    both = by.join(s, FEEDBACK_KEY, "left").join(t, FEEDBACK_KEY, "left")
    lives = F.col("born").isNotNull()
    promoted = lives & F.col("s_there").isNull() & F.col("early").isNotNull()
    # the place from which on the feedback is there
    there = F.when(F.col("s_there"), F.greatest("o_s", F.coalesce("born", "o_s"))).when(promoted, F.col("born")).otherwise(F.when(lives, F.col("o_late")))
    fits = lambda c: F.coalesce((F.col(c) > F.col("there")) & (F.col("o_t").isNull() | (F.col(c) >= F.col("o_t"))), F.lit(False))
    both = both.withColumns({"promoted": promoted, "there": there, "known": F.coalesce("s_there", lives & F.coalesce("early", "late").isNotNull())})
    base = F.coalesce("early", "late")
    # no digest is kept twice: only what the table takes from somewhere else
    same = F.col("s_there").isNull() & F.col("hashes").eqNullSafe(F.struct(base["feedback_hash"].alias("feedback_hash"), base["running_digest"].alias("running_digest")))
    early = F.when(F.col("early").isNotNull(), F.struct(*[f"early.{c}" for c in ("atom_enabled", *says, "slot", "tx_index", "event_ordinal", "created_at")]))
    return both.withColumns({"base": base, "early": early, "hashes": F.when(~same, F.col("hashes")), "applied": fits("o_r"), "hits": fits("o_hit"), "born": F.col("born").isNotNull()}).drop("late", "o_late", "there", "o_s")


def _feedbacks(changes: DataFrame) -> DataFrame:
    c = changes.where("known")
    one = {k: F.when(F.col("s_there"), F.col(f"s_{k}")).otherwise(F.col(f"base.{k}")) for k in columns_of("feedbacks") if k in _PLAIN}
    one |= {k: F.coalesce(F.when(F.col("hashes").isNotNull(), F.col(f"hashes.{k}")), one[k]) for k in ("feedback_hash", "running_digest")}
    one["is_revoked"] = F.col("applied") | F.coalesce("s_is_revoked", F.lit(False))
    one |= {k: F.when(F.col("applied"), F.col(f"r.{v}")).otherwise(F.col(f"s_{k}")) for k, v in (("revoked_slot", "slot"), ("revoked_at", "created_at"))}
    one["status"] = F.coalesce("s_status", F.lit("PENDING"))
    return c.select(*FEEDBACK_KEY, *[one[k].alias(k) for k in columns_of("feedbacks") if k not in FEEDBACK_KEY])


def _revocations(changes: DataFrame) -> DataFrame:
    """The last revocation of each key, PENDING if its feedback is there, else ORPHANED; a stored one stays unless the incoming one's place is no lower."""
    takes = F.col("o_r").isNotNull() & (F.col("o_t").isNull() | (F.col("o_r") >= F.col("o_t")))
    columns = [c for c in columns_of("revocations") if c not in (*FEEDBACK_KEY, "status")]
    fresh = F.when(F.col("known"), "PENDING").otherwise("ORPHANED")
    old = F.when((F.col("t.status") == "ORPHANED") & F.col("known"), "PENDING").otherwise(F.col("t.status"))
    # a delivery of the stored event itself leaves what was decided of it since
    status = F.when(F.col("takes") & (F.col("o_t").isNull() | (F.col("o_r") > F.col("o_t"))), fresh).otherwise(old)
    rows = changes.withColumn("takes", takes).where("o_r IS NOT NULL OR o_t IS NOT NULL")
    rows = rows.select(*FEEDBACK_KEY, *[F.when(F.col("takes"), F.col(f"r.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns], status.alias("status"))
    return rows.select(*columns_of("revocations"))


def _effects(agents: DataFrame, changes: DataFrame, feedbacks: DataFrame) -> DataFrame:
    """The agents that events or feedback changed: their feedback counted again, and the reputation that the last event says."""
    three, two = REPUTATION[:3], REPUTATION[3:]
    fed, hit = F.col("o_fed"), F.when(F.col("hits"), F.col("o_hit"))
    later = F.coalesce(hit > fed, hit.isNotNull())
    said = F.struct(*[F.when(later, F.col(f"hit.new_{c}")).otherwise(F.col(f"fed.new_{c}")).alias(c) for c in three])
    entering = F.col("promoted") & F.col("early.atom_enabled") & F.col("early").isNotNull()
    last = F.greatest(F.col("o_told"), F.when(F.col("applied"), F.col("o_r")))
    last_at = F.when(F.col("applied") & F.coalesce(F.col("o_r") > F.col("o_told"), F.lit(True)), F.col("r.created_at")).otherwise(F.col("told_at"))
    by = changes.where("born").groupBy("asset").agg(
        F.max_by(said, F.greatest(fed, hit)).alias("said"), F.max(F.greatest(fed, hit)).isNotNull().alias("has_said"),
        F.max_by(F.struct(*[F.col(f"fed.new_{c}").alias(c) for c in two]), fed).alias("more"), F.max(fed).isNotNull().alias("has_more"),
        F.max_by(F.struct(*[F.coalesce(F.col(f"early.new_{c}"), F.lit(0)).alias(c) for c in REPUTATION]), F.when(entering, _promotion("early."))).alias("entered"), F.max(entering).alias("has_entered"),
        F.max(last).alias("o_last"), F.max_by(last_at, last).alias("last_at"),
    )
    touched = checkpoint(by.withColumn("touched", F.lit(True)), free=True)
    mine = feedbacks.join(touched.select("asset"), "asset", "left_semi")
    counts = feedback_rollup(mine, ["asset"]).withColumnsRenamed({"feedback_count": "n", "raw_avg_score": "avg"})
    # feedback that was there before its agent is taken in at the registration, which then is as old as the last of it
    entered = mine.join(agents.select("asset", "_born"), "asset").where(scalar.guard() < F.col("_born")).groupBy("asset").agg(F.max_by("created_at", _promotion("")).alias("entered_at"))
    rows = agents.join(touched, "asset", "left").where("_o IS NOT NULL OR touched").join(counts, "asset", "left").join(entered, "asset", "left")
    made = {c: F.when(F.col("has_said"), F.col(f"said.{c}")).when(F.col("has_entered"), F.col(f"entered.{c}")).otherwise(F.col(c)) for c in three}
    made |= {c: F.when(F.col("has_more"), F.col(f"more.{c}")).when(F.col("has_entered"), F.col(f"entered.{c}")).otherwise(F.col(c)) for c in two}
    made |= {"feedback_count": F.coalesce("n", "feedback_count"), "raw_avg_score": F.coalesce("avg", "raw_avg_score")}
    after = F.col("o_last").isNotNull() & F.coalesce(F.col("o_last") > F.greatest("_o", "_born"), F.lit(True))
    made["updated_at"] = F.when(after, F.col("last_at")).when((F.col("_o") == F.col("_born")) & F.col("entered_at").isNotNull(), F.col("entered_at")).otherwise(F.col("updated_at"))
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in columns_of("agents")])


def _responses(rows: DataFrame, feedbacks: DataFrame, stored: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses with their feedback, those to stage) of the keys that events or staged rows name: the last event of each; PENDING if it is new, and a stored one keeps its status and time."""
    names = {"running_digest": F.col("new_response_digest"), "response_count": F.col("new_response_count"), "created_at": F.col("at"), "response_uri": scalar.blank_to_null(F.col("response_uri"))}
    columns = [c for c in columns_of("orphan_responses") if c not in RESPONSE_KEY]
    own = rows.where(_is("ResponseAppended")).select("asset", F.col("client").alias("client_address"), "feedback_index", "responder", "tx_signature", "o", F.struct(*[names.get(c, F.col(c)).alias(c) for c in columns]).alias("x"))
    again = staged.select(*RESPONSE_KEY, scalar.guard().alias("o"), F.struct(*columns).alias("x"))
    one = checkpoint(own.unionByName(again).groupBy(*RESPONSE_KEY).agg(F.max_by("x", "o").alias("x")).select(*RESPONSE_KEY, "x.*"), free=True)
    last = checkpoint(one.join(feedbacks.select(*FEEDBACK_KEY, F.lit(True).alias("there")), FEEDBACK_KEY, "left"), free=True)
    drop(one)
    old = stored.select(*RESPONSE_KEY, F.col("status").alias("s_status"), F.col("created_at").alias("s_at"), F.lit(True).alias("s_there"))
    come = last.where("there").join(old, RESPONSE_KEY, "left")
    come = come.withColumns({"status": F.when(F.col("s_there"), F.col("s_status")).otherwise("PENDING"), "created_at": F.when(F.col("s_there"), F.col("s_at")).otherwise(F.col("created_at"))})
    return come.select(*columns_of("responses")), last.where("there IS NULL").select(*columns_of("orphan_responses"))


def _validations(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests and responses by (asset, validator, nonce), each column from the last event that has it; a response may come without a request, and one that came stays."""
    asked, told = _is("ValidationRequested"), _is("ValidationResponded")
    blank = lambda c: scalar.blank_to_null(F.col(c)).alias(c)
    ask = F.struct("requester", blank("request_uri"), "request_hash")
    tell = F.struct("response", blank("response_uri"), "response_hash", blank("tag"), F.col("at").alias("updated_at"))
    place = F.struct("slot", "tx_index", "event_ordinal", "tx_signature")
    new = rows.where(asked | told).groupBy(*VALIDATION_KEY).agg(_last(ask, asked).alias("a"), _last(tell, told).alias("t"), F.max_by(place, "o").alias("p"), F.min_by("at", "o").alias("created_at"))
    s = _kept(stored, VALIDATION_KEY, "validations")
    both = new.join(s, VALIDATION_KEY, "left")
    of = lambda part, c: F.when(F.col(part).isNotNull(), F.col(f"{part}.{c}")).otherwise(F.col(f"s_{c}"))
    made = {c: of("a", c) for c in ("requester", "request_uri", "request_hash")} | {c: of("t", c) for c in ("response", "response_uri", "response_hash", "tag", "updated_at")} | {c: F.col(f"p.{c}") for c in ("slot", "tx_index", "event_ordinal", "tx_signature")}
    made |= {"status": F.when(F.col("t").isNotNull(), "RESPONDED").otherwise(F.coalesce("s_status", F.lit("PENDING"))), "created_at": F.coalesce("s_created_at", "created_at"), "chain_status": F.coalesce("s_chain_status", F.lit("PENDING"))}
    return both.select(*VALIDATION_KEY, *[made[c].alias(c) for c in columns_of("validations") if c not in VALIDATION_KEY])


def _metadata(rows: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what sets and deletions leave of the keys that they name, those keys). Keys of documents (`_uri:`) aren't set by events; zero characters go; the id is the asset and the key's hash."""
    key = ["asset", "key"]
    plain = ["slot", "tx_index", "event_ordinal", "tx_signature"]
    value = lambda text, at: F.struct(text.alias("value"), *plain, at.alias("updated_at"), F.lit(None).cast("string").alias("status"))
    sets = rows.where(_is("MetadataSet") & ~F.startswith("key", F.lit("_uri:"))).select(*key, F.lit("set").alias("op"), value(scalar.strip_nul(F.col("value")), F.col("at")).alias("value"), "immutable", "o")
    gone = rows.where(_is("MetadataDeleted")).select(*key, F.lit("delete").alias("op"), "o")
    ops = checkpoint(sets.unionByName(gone, allowMissingColumns=True), free=True)
    names = ops.select(*key).distinct()
    old = stored.join(names, key, "left_semi").select(*key, F.lit("set").alias("op"), F.struct("value", *plain, "updated_at", "status").alias("value"), "immutable", _lowest().alias("o"))
    state = metadata_state(ops.unionByName(old), key, F.col("o"))
    hashed = scalar.key_hash(F.col("key"))
    made = {"id": F.concat_ws(":", "asset", hashed), "key_hash": hashed, "status": F.coalesce("value.status", F.lit("PENDING"))} | {c: F.col(f"value.{c}") for c in ("value", *plain, "updated_at")}
    return state.select(*[made.get(c, F.col(c)).alias(c) for c in columns_of("metadata")]), names


def stored_table(raw: DataFrame, name: str, given: DataFrame | None) -> DataFrame:
    """A snapshot's table with the columns of TABLES, null where it lacks one; empty without one."""
    if given is None:
        return raw.sparkSession.createDataFrame([], TABLES[name]).where(F.lit(False))  # which the optimiser leaves out
    kinds = dict(part.split(" ") for part in TABLES[name].split(", "))
    return given.select(*[(F.col(c) if c in given.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


#: The columns that name a row of each table.
KEYS = {
    "agents": ["asset"], "collections": ["collection"], "collection_pointers": ["col", "creator"], "feedbacks": FEEDBACK_KEY, "orphan_feedbacks": FEEDBACK_KEY, "revocations": FEEDBACK_KEY,
    "responses": RESPONSE_KEY, "orphan_responses": RESPONSE_KEY, "validations": VALIDATION_KEY, "metadata": ["asset", "key"],
}


def changes(raw: DataFrame, stored: dict[str, DataFrame]) -> tuple[dict[str, tuple[DataFrame, DataFrame]], DataFrame]:
    """({table: (new rows, keys that the table's rows of go before)}, dead letters): what raw events of all kinds change in the TABLES, given whole.

    Staged rows count again; once their agent or feedback is there they go. The
    parsed events, the touched agents and the touched feedback keys are written
    to the shared folder, so that no raw event is parsed twice: a condition on
    parsed columns would be pushed below the parser and parse once a column. The
    shuffles of each step are deleted with its end, before the next one's.
    Events are dealt out by their place first, so that few files are no bound.
    """
    read = written(events.wide(raw.repartition("slot", "tx_index", "event_ordinal", "tx_signature")), "events")
    rows = read.where("ok")
    moved = checkpoint(asset_changes(rows), free=True)
    agents = _agents(moved, stored["agents"])
    made = {"collections": collections(rows, stored["collections"]), "collection_pointers": _pointers(rows, agents, stored["agents"], stored["collection_pointers"])}
    fed = checkpoint(feedback_changes(rows, agents, stored), free=True)
    made["feedbacks"] = _feedbacks(fed)
    made["orphan_feedbacks"] = fed.where("NOT known AND base IS NOT NULL").select(*FEEDBACK_KEY, "base.*").select(*columns_of("orphan_feedbacks"))
    made["revocations"] = _revocations(fed)
    feedbacks = over(stored["feedbacks"], made["feedbacks"], made["feedbacks"], FEEDBACK_KEY)
    made["responses"], made["orphan_responses"] = _responses(rows, feedbacks, stored["responses"], stored["orphan_responses"])
    made["validations"] = _validations(rows, stored["validations"])
    made["metadata"], names = _metadata(rows, stored["metadata"])
    made["agents"] = _effects(agents, fed, feedbacks)
    # all that was staged is among the rows that were decided again
    gone = {"metadata": names, "orphan_feedbacks": stored["orphan_feedbacks"], "orphan_responses": stored["orphan_responses"]}
    dead = read.where(~F.col("ok")).select("name", "slot", "tx_index", "event_ordinal", "tx_signature", F.lit("a needed field is missing or cannot be read").alias("reason"))
    return {name: (made[name], gone.get(name, made[name]).select(*KEYS[name])) for name in TABLES}, dead


def over(stored: DataFrame, rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows, and the stored ones whose keys aren't gone."""
    return stored.join(gone.select(*keys), keys, "left_anti").select(*rows.columns).unionByName(rows)


def fold(raw: DataFrame, snapshot: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, dead letters): raw events of all kinds folded into the TABLES, on top of a snapshot of them."""
    kept = {name: stored_table(raw, name, (snapshot or {}).get(name)) for name in TABLES}
    made, dead = changes(raw, kept)
    whole = ("orphan_feedbacks", "orphan_responses")  # of which nothing stored stays undecided
    return {name: rows if name in whole else over(kept[name], rows, gone, KEYS[name]) for name, (rows, gone) in made.items()}, dead


#: Tables that other ones stand for in sources.schemas, and columns that have other names there.
_ENTITY = {"responses": "feedback_responses"}
_RENAMED = {"agents": {"uri": "agent_uri", "wallet": "agent_wallet", "slot": "block_slot"}, **{k: {"slot": "block_slot"} for k in ("metadata", "feedbacks", "orphan_feedbacks", "responses", "orphan_responses", "validations")}}


def entities(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of fold() as the rows of sources.schemas: ids are composed of the keys, numbers that are given later are null, an agent's sort key follows from its reputation."""
    out = {}
    for name, rows in tables.items():
        rows = rows.withColumnsRenamed(_RENAMED.get(name, {}))
        key = {"responses": RESPONSE_KEY, "orphan_responses": RESPONSE_KEY, "validations": VALIDATION_KEY}.get(name, FEEDBACK_KEY)
        if "id" not in rows.columns and set(key) <= set(rows.columns):
            rows = rows.withColumn("id", scalar.compose_id(*[F.col(k) for k in key]))
        if name == "agents":
            zero = [F.coalesce(c, F.lit(0)) for c in REPUTATION[:3]]
            rows = rows.withColumn("sort_key", scalar.sort_key(*zero, hashes.tie_breaker(F.col("asset"))))
        made = _ENTITY.get(name, name)
        out[made] = schemas.as_entity(rows, made)
    return out


def _named(kind: str, rows: DataFrame) -> DataFrame:
    at = F.col("block_time") if "block_time" in rows.columns else F.lit(None).cast("timestamp")
    return rows.withColumns({"name": F.lit(kind), "o": scalar.guard(), "at": at})


def agents(registered: DataFrame, owners: DataFrame, atoms: DataFrame, uris: DataFrame, wallets: DataFrame, resets: DataFrame, parents: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """A row for each registered asset, of frames of one kind each as events.typed() reads them.

    A repeated registration overwrites owner, uri, atom_enabled and its place in
    the block and keeps creator, collection, slot, signature and created_at of
    the first; updated_at is the time of the last event. Later events count
    from the first registration on; a blank uri is null, and so is the wallet
    that stands for none. A snapshot stands for all events before these.
    """
    parts = [_named(k, df) for k, df in zip(OF_ASSETS, (registered, owners, atoms, uris, wallets, resets, parents), strict=False)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("col", "set_by") if c not in rows.columns})
    return _agents(asset_changes(rows), stored_table(registered, "agents", snapshot)).drop("_born", "_o")


def pointers(agents: DataFrame, pointer_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asset, canonical_col, col_locked) of each known agent with a pointer, and the pointers with first and last sight and their assets.

    A pointer is (col, creator), the creator being the agent's, else who set it
    first, else the agent's owner. Events of unknown agents count for neither.
    """
    by = F.col("set_by") if "set_by" in pointer_events.columns else F.lit(None).cast("string")
    rows = _named("CollectionPointerSet", pointer_events.withColumn("set_by", by)).join(agents.select("asset", "creator", "owner"), "asset")
    held = rows.groupBy("asset").agg(F.max_by("col", "o").alias("canonical_col"), F.max_by("lock", F.when(F.col("lock").isNotNull(), F.col("o"))).alias("col_locked"), F.coalesce(F.first("creator"), F.min_by("set_by", "o"), F.first("owner")).alias("creator"))
    seen = pointer_changes(rows.drop("creator").join(held.select("asset", "creator"), "asset"))
    none = F.lit(None).cast("string")
    counts = pointer_steps(held.select("asset", none.alias("was"), none.alias("creator_was"), F.col("canonical_col").alias("col"), "creator")).groupBy("col", "creator").agg(F.sum("step").alias("asset_count"))
    table = seen.join(counts, ["col", "creator"], "left").withColumn("asset_count", F.coalesce("asset_count", F.lit(0).cast("long")))
    return held.drop("creator"), table.select("col", "creator", "first_seen_slot", "last_seen_slot", "asset_count")


def feedback_effects(agents: DataFrame, feedbacks: DataFrame, new: DataFrame, revoked: DataFrame) -> DataFrame:
    """agents with feedback_count and raw_avg_score counted again, and the reputation fields of the events of agents that have them enabled; revocations of feedback that isn't there change nothing."""
    there = feedbacks.select(*[c for c in FEEDBACK_KEY if c in revoked.columns]).distinct()
    counts = feedback_rollup(feedbacks, ["asset"])
    fields = reputation_fields(new, revoked.join(there, there.columns, "left_semi"))
    made = [c for c in (*counts.columns, *fields.columns) if c != "asset"]
    old = [c for c in made if c in agents.columns]
    rows = agents.withColumnsRenamed({c: f"_{c}" for c in old}).join(counts, "asset", "left").join(fields, "asset", "left")
    for c in made:
        default = F.lit(0).cast("long") if c in ("feedback_count", "raw_avg_score") else F.lit(None)
        rows = rows.withColumn(c, F.coalesce(c, f"_{c}" if c in old else default, default))
    return rows.drop(*[f"_{c}" for c in old])


def reputation_fields(new: DataFrame, revoked: DataFrame) -> DataFrame:
    """Tier, quality and confidence of each asset by its last event that changes them; risk and diversity only by its last feedback."""
    three = [f"new_{c}" for c in REPUTATION[:3]]
    two = [f"new_{c}" for c in REPUTATION[3:]]
    a = new.where("atom_enabled").select("asset", scalar.guard().alias("o"), F.lit(True).alias("fed"), *three, *two)
    b = revoked.where("atom_enabled AND had_impact").select("asset", scalar.guard().alias("o"), F.lit(False).alias("fed"), *three)
    rows = a.unionByName(b, allowMissingColumns=True)
    fed = F.when(F.col("fed"), F.col("o"))
    return rows.groupBy("asset").agg(*[F.max_by(c, "o").alias(c[4:]) for c in three], *[F.max_by(c, fed).alias(c[4:]) for c in two])


def validations(requested: DataFrame, responded: DataFrame) -> DataFrame:
    """Requests and responses merged by (asset, validator, nonce); a response may come without a request."""
    asked = project(requested, VALIDATION_KEY, scalar.guard(), last={c: F.col(c) for c in ("request_uri", "request_hash", "requester")})
    told = project(responded, VALIDATION_KEY, scalar.guard(), last={c: F.col(c) for c in ("response", "response_uri", "response_hash", "tag")}).withColumn("_told", F.lit(True))
    return asked.join(told, VALIDATION_KEY, "full").withColumn("status", F.when(F.col("_told"), "RESPONDED").otherwise("PENDING")).drop("_told")
