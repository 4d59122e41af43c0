"""The fold of all kinds of events over the given tables, and its SQL.

Stand-ins: a customer registers an agent (every 31st doesn't), an order is
feedback to it and, by its number, one of the agent's other events too; every
seventh order is revoked, before or after it came; the first lines of an order
are responses; nations are initialised. Slots are numbers of orders, so that
many children come before their parent. The whole rows of the tables are
compared, as texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import projections
from ..sources.tables import load

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: name of the event: table, condition, slot, index of the transaction, fields; expressions that Spark and the SQL share.
STORY = {
    "AgentRegistered": ("customer", "c_custkey % 31 <> 0", "c_custkey * 7919 % 20011", 0, {"asset": "concat('a', c_custkey)", "collection": "concat('n', c_nationkey)", "owner": "concat('o', c_custkey % 97)", "agentUri": "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END", "atomEnabled": "c_custkey % 3 = 0"}),
    "RegistryInitialized": ("nation", "n_nationkey % 2 = 0", "n_nationkey * 1000", 0, {"collection": "concat('n', n_nationkey)", "authority": "n_name"}),
    "NewFeedback": ("orders", "TRUE", "o_orderkey", 1, {"asset": "concat('a', o_custkey)", "clientAddress": "concat('k', o_orderkey % 29)", "feedbackIndex": "o_orderkey", "value": "CAST(o_orderkey % 1000 AS VARCHAR(9))", "valueDecimals": "o_orderkey % 3", "score": "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 101 END", "sealHash": "sha256(concat('s', o_orderkey))", "atomEnabled": "o_orderkey % 4 <> 0", "newTrustTier": "o_orderkey % 5", "newQualityScore": "o_orderkey % 991", "newConfidence": "o_orderkey % 983", "newRiskScore": "o_orderkey % 101", "newDiversityRatio": "o_orderkey % 97", "newFeedbackDigest": "sha256(concat('d', o_orderkey))", "newFeedbackCount": "1", "tag1": "o_orderpriority", "tag2": "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END"}),
    "FeedbackRevoked": ("orders", "o_orderkey % 7 = 0", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 5000 ELSE greatest(0, o_orderkey - 5000) END", 2, {"asset": "concat('a', o_custkey)", "clientAddress": "CASE WHEN o_orderkey % 5 = 0 THEN 'nobody' ELSE concat('k', o_orderkey % 29) END", "feedbackIndex": "o_orderkey", "sealHash": "sha256(concat('r', o_orderkey))", "originalScore": "1", "atomEnabled": "o_orderkey % 3 <> 0", "hadImpact": "o_orderkey % 4 <> 1", "newTrustTier": "o_orderkey % 4", "newQualityScore": "o_orderkey % 503", "newConfidence": "o_orderkey % 499", "newRevokeDigest": "sha256(concat('e', o_orderkey))", "newRevokeCount": "1"}),
    "AgentOwnerSynced": ("orders", "o_orderkey % 13 = 0", "o_orderkey", 3, {"asset": "concat('a', o_custkey)", "oldOwner": "''", "newOwner": "concat('p', o_orderkey % 89)"}),
    "WalletUpdated": ("orders", "o_orderkey % 17 = 0", "o_orderkey", 4, {"asset": "concat('a', o_custkey)", "newWallet": f"CASE WHEN o_orderkey % 2 = 0 THEN '{projections.NO_WALLET}' ELSE concat('w', o_orderkey) END", "updatedBy": "''"}),
    "WalletResetOnOwnerSync": ("orders", "o_orderkey % 19 = 0", "o_orderkey", 5, {"asset": "concat('a', o_custkey)", "newWallet": f"CASE WHEN o_orderkey % 2 = 0 THEN '{projections.NO_WALLET}' ELSE concat('v', o_orderkey) END", "ownerAfterSync": "concat('q', o_orderkey % 83)"}),
    "AtomEnabled": ("orders", "o_orderkey % 23 = 0", "o_orderkey", 6, {"asset": "concat('a', o_custkey)", "enabledBy": "''"}),
    "UriUpdated": ("orders", "o_orderkey % 11 = 0", "o_orderkey", 7, {"asset": "concat('a', o_custkey)", "newUri": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END", "updatedBy": "''"}),
    "ParentAssetSet": ("orders", "o_orderkey % 29 = 0", "o_orderkey", 8, {"asset": "concat('a', o_custkey)", "parentAsset": "concat('a', o_custkey + 1)", "parentCreator": "concat('o', o_orderkey % 7)", "setBy": "''", "lock": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 3 = 1 END"}),
    "CollectionPointerSet": ("orders", "o_orderkey % 3 = 0", "o_orderkey", 9, {"asset": "concat('a', o_custkey)", "setBy": "'z'", "col": "o_orderpriority", "lock": "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 4 = 1 END"}),
    "ResponseAppended": ("lineitem JOIN orders ON l_orderkey = o_orderkey", "l_linenumber <= 2", "greatest(0, l_orderkey + 3000 - l_linenumber * 1999)", 10, {"asset": "concat('a', o_custkey)", "client": "concat('k', o_orderkey % 29)", "feedbackIndex": "CASE WHEN l_linenumber = 2 AND l_orderkey % 9 = 0 THEN 0 ELSE o_orderkey END", "responder": "concat('r', l_suppkey)", "responseHash": "sha256(concat('h', l_orderkey))", "sealHash": "sha256(concat('s', l_orderkey))", "newResponseDigest": "sha256(concat('g', l_orderkey))", "newResponseCount": "l_linenumber", "responseUri": "CASE WHEN l_linenumber = 1 THEN '' ELSE l_returnflag END"}),
}
_SIGNATURE = {"customer": "concat('c', c_custkey)", "nation": "concat('n', n_nationkey)", "orders": "concat('{}-', o_orderkey)"}
_LINE = "concat('l', l_orderkey, '-', l_linenumber, '-', l_suppkey, l_returnflag)"


def story(spark, d: str) -> DataFrame:
    """The raw events."""
    parts = []
    for name, (source, condition, slot, index, fields) in STORY.items():
        first, _, rest = source.partition(" JOIN ")
        rows = load(spark, d, first)
        if rest:
            other, on = rest.split(" ON ")
            rows = rows.join(load(spark, d, other), F.expr(on))
        hashed = lambda e: F.expr(e.replace("sha256(", "sha2(").replace("))", "), 256)") if e.startswith("sha256") else e)
        data = F.to_json(F.struct(*[hashed(e).alias(k) for k, e in fields.items()]))
        signature = F.expr(_SIGNATURE[source].format(index) if source in _SIGNATURE else _LINE)
        at = F.timestamp_seconds(F.expr(slot).cast("long"))
        parts.append(rows.where(condition).select(F.lit(name).alias("name"), data.alias("data"), signature.alias("tx_signature"), F.expr(slot).cast("long").alias("slot"), at.alias("block_time"), F.lit(index).alias("tx_index"), F.lit(0).alias("event_ordinal")))
    return reduce(DataFrame.unionByName, parts)


def _events_sql() -> str:
    """A common table expression for each kind: its fields, slot, o (slot and index as one number) and signature."""
    out = []
    for name, (source, condition, slot, index, fields) in STORY.items():
        signature = _SIGNATURE[source].format(index) if source in _SIGNATURE else _LINE
        columns = ", ".join(f'{e} AS "{k}"' for k, e in fields.items())
        out.append(f"{name} AS (SELECT DISTINCT {columns}, ({slot})::BIGINT AS slot, ({slot})::BIGINT * 100 + {index} AS o, {signature} AS tx FROM {source} WHERE {condition})")
    return ", ".join(out)


#: The columns of each table that are compared, and how the SQL calls them.
SHOWN = {
    "agents": "asset, owner, creator, collection, slot, tx_signature, tx_index, created_at, updated_at, uri, wallet, atom_enabled, parent_asset, parent_creator, parent_locked, canonical_col, col_locked, trust_tier, quality_score, confidence, risk_score, diversity_ratio, feedback_count, raw_avg_score, status",
    "collections": "collection, registry_type, authority, created_slot, created_at, status",
    "collection_pointers": "col, creator, first_seen_asset, first_seen_at, first_seen_slot, first_seen_tx_signature, last_seen_at, last_seen_slot, last_seen_tx_index, last_seen_tx_signature, asset_count",
    "feedbacks": "asset, client_address, feedback_index, value, value_decimals, score, tag1, tag2, feedback_hash, running_digest, slot, tx_signature, created_at, is_revoked, revoked_slot, revoked_at, status",
    "orphan_feedbacks": "asset, client_address, feedback_index, score, atom_enabled, new_trust_tier, slot, created_at",
    "revocations": "asset, client_address, feedback_index, feedback_hash, original_score, atom_enabled, had_impact, revoke_count, running_digest, slot, tx_index, tx_signature, created_at, status",
    "responses": "asset, client_address, feedback_index, responder, tx_signature, response_uri, response_hash, seal_hash, response_count, running_digest, slot, created_at, status",
    "orphan_responses": "asset, client_address, feedback_index, responder, tx_signature, response_count, slot",
}


def _shown(name: str, rows: DataFrame) -> DataFrame:
    kinds = dict(rows.dtypes)
    one = lambda c: F.lower(F.hex(c)) if kinds[c] == "binary" else scalar.to_unix(F.col(c)).cast("string") if kinds[c] == "timestamp" else F.col(c).cast("string")
    return rows.select(F.lit(name).alias("entity"), F.concat_ws("|", *[F.coalesce(one(c), F.lit("~")) for c in SHOWN[name].split(", ")]).alias("content"))


def _sql() -> str:
    text = lambda name: f"SELECT '{name}' AS entity, concat_ws('|', {', '.join(f'''coalesce(({c})::VARCHAR, '~')''' for c in SHOWN[name].split(', '))}) AS content FROM {name}"
    last = lambda kind, value, o="x.o": f"arg_max({value}, {o}) FILTER ({kind})"
    return f"""
WITH {_events_sql()},
born AS (SELECT asset, slot AS born, o AS bo FROM AgentRegistered),
moves AS (SELECT 'owner' AS k, asset, "newOwner" AS v, o, NULL::BOOLEAN AS b FROM AgentOwnerSynced UNION ALL SELECT 'owner', asset, "ownerAfterSync", o, NULL FROM WalletResetOnOwnerSync
    UNION ALL SELECT 'wallet', asset, "newWallet", o, NULL FROM WalletUpdated UNION ALL SELECT 'wallet', asset, "newWallet", o, NULL FROM WalletResetOnOwnerSync UNION ALL SELECT 'atom', asset, '', o, NULL FROM AtomEnabled
    UNION ALL SELECT 'uri', asset, "newUri", o, NULL FROM UriUpdated UNION ALL SELECT 'parent', asset, "parentAsset", o, lock FROM ParentAssetSet UNION ALL SELECT 'by', asset, "parentCreator", o, NULL FROM ParentAssetSet
    UNION ALL SELECT 'col', asset, col, o, lock FROM CollectionPointerSet),
x AS (SELECT moves.* FROM moves JOIN born USING (asset) WHERE o > bo),
f AS (SELECT n.*, bo, born FROM NewFeedback n LEFT JOIN born USING (asset)),
r AS (SELECT r.*, f.o IS NOT NULL AND f.bo IS NOT NULL AS known, r.o > greatest(f.o, f.bo) AS applied FROM FeedbackRevoked r LEFT JOIN f ON f.asset = r.asset AND f."clientAddress" = r."clientAddress" AND f."feedbackIndex" = r."feedbackIndex"),
said AS (SELECT asset, "newTrustTier" AS t, "newQualityScore" AS q, "newConfidence" AS c, "newRiskScore" AS i, "newDiversityRatio" AS v, TRUE AS fed, greatest(o, bo)::HUGEINT * 10000000000 + o AS w FROM f WHERE "atomEnabled" AND bo IS NOT NULL
    UNION ALL SELECT asset, "newTrustTier", "newQualityScore", "newConfidence", NULL, NULL, FALSE, o::HUGEINT * 10000000000 + o FROM r WHERE applied AND "atomEnabled" AND "hadImpact"),
rep AS (SELECT asset, arg_max(t, w) AS t, arg_max(q, w) AS q, arg_max(c, w) AS c, arg_max(i, w) FILTER (fed) AS i, arg_max(v, w) FILTER (fed) AS v FROM said GROUP BY 1),
feedbacks AS (SELECT f.asset, f."clientAddress" AS client_address, f."feedbackIndex" AS feedback_index, f.value, f."valueDecimals" AS value_decimals, f.score, f.tag1, nullif(f.tag2, '') AS tag2, f."sealHash" AS feedback_hash, f."newFeedbackDigest" AS running_digest, f.slot, f.tx AS tx_signature, f.slot AS created_at,
    coalesce(r.applied, FALSE) AS is_revoked, CASE WHEN r.applied THEN r.slot END AS revoked_slot, CASE WHEN r.applied THEN r.slot END AS revoked_at, 'PENDING' AS status, f.o
    FROM f LEFT JOIN r ON f.asset = r.asset AND f."clientAddress" = r."clientAddress" AND f."feedbackIndex" = r."feedbackIndex" WHERE f.bo IS NOT NULL),
counts AS (SELECT asset, count(*) FILTER (NOT is_revoked) AS n, coalesce(round(avg(score) FILTER (NOT is_revoked)), 0)::BIGINT AS a FROM feedbacks GROUP BY 1),
late AS (SELECT asset, max(o) AS o FROM (SELECT asset, o FROM x UNION ALL SELECT asset, o FROM f WHERE o > bo UNION ALL SELECT asset, o FROM r WHERE applied) GROUP BY 1),
early AS (SELECT asset, max(slot) AS at FROM f WHERE o < bo GROUP BY 1),
xs AS (SELECT asset, {last("k = 'owner'", "v")} AS owner, {last("k = 'wallet'", "v")} AS wallet, {last("k = 'uri'", "v")} AS uri, max(o) FILTER (k = 'uri') AS uri_o, bool_or(k = 'atom') AS atom, {last("k = 'parent'", "v")} AS parent, {last("k = 'by'", "v")} AS parent_by,
    {last("k = 'parent' AND b IS NOT NULL", "b")} AS parent_lock, {last("k = 'col'", "v")} AS col, {last("k = 'col' AND b IS NOT NULL", "b")} AS col_lock FROM x GROUP BY 1),
agents AS (SELECT g.asset, coalesce(xs.owner, g.owner) AS owner, g.owner AS creator, g.collection, g.slot, g.tx AS tx_signature, 0 AS tx_index, g.slot AS created_at, coalesce(late.o // 100, early.at, g.slot) AS updated_at,
    nullif(CASE WHEN uri_o IS NOT NULL THEN xs.uri ELSE g."agentUri" END, '') AS uri, nullif(xs.wallet, '{projections.NO_WALLET}') AS wallet, g."atomEnabled" OR coalesce(xs.atom, FALSE) AS atom_enabled, xs.parent AS parent_asset, xs.parent_by AS parent_creator, coalesce(parent_lock, FALSE) AS parent_locked,
    coalesce(xs.col, '') AS canonical_col, coalesce(col_lock, FALSE) AS col_locked, rep.t AS trust_tier, rep.q AS quality_score, rep.c AS confidence, rep.i AS risk_score, rep.v AS diversity_ratio, coalesce(counts.n, 0) AS feedback_count, coalesce(counts.a, 0) AS raw_avg_score, 'PENDING' AS status
    FROM AgentRegistered g LEFT JOIN xs USING (asset) LEFT JOIN rep USING (asset) LEFT JOIN counts USING (asset) LEFT JOIN late USING (asset) LEFT JOIN early USING (asset)),
collections AS (SELECT collection, 'BASE' AS registry_type, max(authority) AS authority, arg_min(slot, o * 1000 + k) AS created_slot, arg_min(slot, o * 1000 + k) AS created_at, 'PENDING' AS status FROM (SELECT collection, NULL AS authority, slot, o, 0 AS k FROM AgentRegistered UNION ALL SELECT collection, authority, slot, o, 1 FROM RegistryInitialized) GROUP BY 1),
p AS (SELECT c.*, agents.creator FROM CollectionPointerSet c JOIN born USING (asset) JOIN agents USING (asset) WHERE o > bo),
held AS (SELECT canonical_col AS col, creator, count(*) AS n FROM agents GROUP BY ALL),
collection_pointers AS (SELECT col, creator, arg_min(asset, o) AS first_seen_asset, min(slot) AS first_seen_at, min(slot) AS first_seen_slot, arg_min(tx, o) AS first_seen_tx_signature, max(slot) AS last_seen_at, max(slot) AS last_seen_slot, 9 AS last_seen_tx_index, arg_max(tx, o) AS last_seen_tx_signature, coalesce(max(held.n), 0) AS asset_count
    FROM p LEFT JOIN held USING (col, creator) GROUP BY 1, 2),
orphan_feedbacks AS (SELECT asset, "clientAddress" AS client_address, "feedbackIndex" AS feedback_index, score, "atomEnabled" AS atom_enabled, "newTrustTier" AS new_trust_tier, slot, slot AS created_at FROM f WHERE bo IS NULL),
revocations AS (SELECT asset, "clientAddress" AS client_address, "feedbackIndex" AS feedback_index, "sealHash" AS feedback_hash, 1 AS original_score, "atomEnabled" AS atom_enabled, "hadImpact" AS had_impact, 1 AS revoke_count, "newRevokeDigest" AS running_digest, slot, 2 AS tx_index, tx AS tx_signature, slot AS created_at, CASE WHEN known THEN 'PENDING' ELSE 'ORPHANED' END AS status FROM r),
answers AS (SELECT s.asset, client AS client_address, s."feedbackIndex" AS feedback_index, responder, s.tx AS tx_signature, nullif("responseUri", '') AS response_uri, "responseHash" AS response_hash, s."sealHash" AS seal_hash, "newResponseCount" AS response_count, "newResponseDigest" AS running_digest, s.slot, s.slot AS created_at, 'PENDING' AS status, k.asset IS NOT NULL AS there
    FROM ResponseAppended s LEFT JOIN feedbacks k ON k.asset = s.asset AND k.client_address = s.client AND k.feedback_index = s."feedbackIndex"),
responses AS (SELECT * FROM answers WHERE there), orphan_responses AS (SELECT * FROM answers WHERE NOT there)
{' UNION ALL '.join(text(name) for name in SHOWN)}"""


def fold_tables(spark, d: str) -> DataFrame:
    """All rows of the tables that the fold of the story makes, each as one text."""
    tables, _ = projections.fold(story(spark, d))
    return reduce(DataFrame.unionByName, [_shown(name, tables[name]) for name in SHOWN])


QUERIES["fold_tables"] = fold_tables
SQL["fold_tables"] = _sql()
