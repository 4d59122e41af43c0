"""The columns of the entity tables, and what their rows must fulfil."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = "tx_index int, event_ordinal int, tx_signature string"
_STATE = "status string, verified_at timestamp"
#: Numbers of up to 64 bits without sign are decimals; a feedback's value has up to 39 digits and is text.
_KEY = "asset string, client_address string, feedback_index decimal(20,0)"
_RATED = "value string, value_decimals int, score int, tag1 string, tag2 string, endpoint string, feedback_uri string, feedback_hash binary, running_digest binary"

SCHEMAS = {
    "collections": f"collection string, registry_type string, authority string, created_at timestamp, {_STATE}",
    "collection_pointers": "collection_id long, col string, creator string, first_seen_asset string, first_seen_at timestamp, first_seen_slot long, first_seen_tx_signature string, last_seen_at timestamp, last_seen_slot long, last_seen_tx_index int, last_seen_tx_signature string, asset_count long, version string, name string, symbol string, description string, image string, banner_image string, social_website string, social_x string, social_discord string, metadata_status string, metadata_hash string, metadata_bytes long, metadata_updated_at timestamp",
    "agents": f"asset string, agent_id long, owner string, creator string, agent_uri string, agent_wallet string, collection string, canonical_col string, col_locked boolean, parent_asset string, parent_creator string, parent_locked boolean, nft_name string, atom_enabled boolean, trust_tier int, quality_score int, confidence int, risk_score int, diversity_ratio int, feedback_count int, raw_avg_score int, sort_key long, block_slot long, {_PLACE}, created_at timestamp, updated_at timestamp, {_STATE}, verified_slot long",
    "metadata": f"id string, asset string, key string, key_hash string, value binary, immutable boolean, block_slot long, {_PLACE}, created_at timestamp, updated_at timestamp, {_STATE}",
    "feedbacks": f"id string, feedback_id long, {_KEY}, {_RATED}, is_revoked boolean, revoked_at timestamp, block_slot long, {_PLACE}, created_at timestamp, {_STATE}",
    "orphan_feedbacks": f"id string, {_KEY}, {_RATED}, atom_enabled boolean, new_trust_tier int, new_quality_score int, new_confidence int, new_risk_score int, new_diversity_ratio int, block_slot long, {_PLACE}, created_at timestamp",
    "feedback_responses": f"id string, response_id long, {_KEY}, responder string, response_uri string, response_hash binary, seal_hash binary, running_digest binary, response_count decimal(20,0), block_slot long, {_PLACE}, created_at timestamp, {_STATE}",
    "orphan_responses": f"id string, {_KEY}, responder string, response_uri string, response_hash binary, seal_hash binary, running_digest binary, response_count decimal(20,0), block_slot long, {_PLACE}, created_at timestamp",
    "revocations": f"id string, revocation_id long, {_KEY}, feedback_hash binary, slot long, original_score int, atom_enabled boolean, had_impact boolean, running_digest binary, revoke_count decimal(20,0), {_PLACE}, created_at timestamp, {_STATE}",
    "validations": f"id string, asset string, validator_address string, nonce decimal(20,0), requester string, request_uri string, request_hash binary, response int, response_uri string, response_hash binary, tag string, status string, block_slot long, {_PLACE}, created_at timestamp, updated_at timestamp, chain_status string, chain_verified_at timestamp",
    "agent_digest_cache": "asset string, feedback_digest binary, feedback_count long, response_digest binary, response_count long, revoke_digest binary, revoke_count long, last_verified_slot long, last_verified_at timestamp, needs_gap_fill boolean",
    "id_counters": "scope string, next_value long",
    "indexer_state": "id string, last_signature string, last_slot long, last_tx_index int, source string, updated_at timestamp",
    "proof_feedbacks": f"id string, {_KEY}, tx_signature string, session string, context_type string, context_ref_hash binary, created_at timestamp",
    "hash_chain_checkpoints": "agent string, chain string, count long, digest binary, created_at timestamp",
    "event_log": "id string, event_type string, data string, tx_signature string, slot long, processed boolean, error string, created_at timestamp",
}

_STATUS = ("status", lambda c: c.isin("PENDING", "FINALIZED", "ORPHANED"))
_HELD = lambda column: ("status", lambda c: (c == "ORPHANED") | F.col(column).isNotNull())
#: table: rule: a column and what must hold of it; a null value breaks no rule.
RULES: dict[str, dict[str, tuple]] = {
    "collections": {"registry_type": ("registry_type", lambda c: c.isin("BASE", "USER")), "status": _STATUS},
    "collection_pointers": {"collection_id": ("collection_id", lambda c: c >= 1), "asset_count": ("asset_count", lambda c: c >= 0)},
    "agents": {
        "trust_tier": ("trust_tier", lambda c: c.between(0, 4)), "quality_score": ("quality_score", lambda c: c.between(0, 10_000)), "confidence": ("confidence", lambda c: c.between(0, 10_000)),
        "risk_score": ("risk_score", lambda c: c.between(0, 100)), "diversity_ratio": ("diversity_ratio", lambda c: c.between(0, 255)), "raw_avg_score": ("raw_avg_score", lambda c: c.between(0, 100)),
        "status": _STATUS, "agent_id": _HELD("agent_id"),
    },
    "feedbacks": {"value_decimals": ("value_decimals", lambda c: c.between(0, 18)), "score": ("score", lambda c: c.between(0, 100)), "status": _STATUS, "feedback_id": _HELD("feedback_id")},
    "feedback_responses": {"status": _STATUS, "response_id": _HELD("response_id")},
    "revocations": {"status": _STATUS, "revocation_id": _HELD("revocation_id")},
    "validations": {"status": ("status", lambda c: c.isin("PENDING", "RESPONDED")), "chain_status": ("chain_status", _STATUS[1]), "response": ("response", lambda c: c.between(0, 100))},
    "id_counters": {"next_value": ("next_value", lambda c: c >= 1)},
}


def load_entity(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An entity table with its fixed columns, without reading a footer to infer them."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def as_entity(rows: DataFrame, name: str) -> DataFrame:
    """rows with the columns and types of an entity table; columns that they lack are null."""
    kinds = [part.split(" ") for part in SCHEMAS[name].split(", ")]
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds])


def conditions(name: str, columns: list[str]) -> dict[str, Column]:
    """Each rule of a table whose column is there, as a condition that also holds of null."""
    return {rule: F.coalesce(test(F.col(c)), F.lit(True)) for rule, (c, test) in RULES[name].items() if c in columns}


def violations(rows: DataFrame, name: str) -> DataFrame:
    """One row: for each rule the number of rows that break it, in one pass."""
    return rows.agg(*[F.count_if(~holds).alias(rule) for rule, holds in conditions(name, rows.columns).items()])
