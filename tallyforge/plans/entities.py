"""Queries of the entity tables: filters, lists, statistics, ids, chains, statuses, documents; and their SQL.

Stand-ins, each a list of expressions that Spark and the SQL share: a customer
is an agent, an order its feedback, a lineitem a response to it (and, for the
first of an order, a validation), every seventh order a revocation, an event a
row of metadata and of a hash chain, a nation a collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashes, scalar
from ..operators import chain, documents, entities, fold, ids, lifecycle, paging, projections, reconcile, rollups, stats, tree
from ..sources import schemas
from ..sources.tables import load

_COL = "'bafyaaaaaaaaaaaaaaaaaaaaa', substr('abcdefghijklmnopqrstuvwxyz', {} + 1, 1)"
_KEY = ["concat('a', o_custkey) AS asset", "concat('k', o_orderkey % 29) AS client_address", "o_orderkey AS feedback_index"]
_STATE = "CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'FINALIZED' ELSE 'ORPHANED' END"
TABLES = {
    "ag": ("customer", [
        "concat('a', c_custkey) AS asset", "CASE WHEN c_custkey % 9 <> 0 THEN c_custkey END AS agent_id", "concat('o', c_custkey % 97) AS owner",
        "CASE WHEN c_custkey % 3 = 0 THEN concat('o', c_custkey % 53) END AS creator", "concat('n', c_nationkey) AS collection",
        f"concat(CASE WHEN c_custkey % 2 = 0 THEN 'c1:' ELSE '' END, {_COL.format('c_nationkey')}) AS canonical_col",
        "CASE WHEN c_custkey >= 7 THEN concat('a', c_custkey % 7 + 1) END AS parent_asset", "c_custkey % 4 = 0 AS atom_enabled", "CAST(c_custkey % 5 AS INT) AS trust_tier",
        "c_custkey * 37 % 10001 AS quality_score", "c_custkey * 37 % 10001 * 1000 + c_custkey % 1000 AS sort_key", "c_custkey % 13 AS feedback_count", "c_custkey % 101 AS raw_avg_score", "c_custkey % 13 AS total_feedback",
        "CASE WHEN c_custkey % 17 = 0 THEN 'ORPHANED' WHEN c_custkey % 3 = 0 THEN 'PENDING' ELSE 'FINALIZED' END AS status", "c_custkey * 7919 % 100003 AS slot", "c_custkey * 7919 % 1009 AS created_at",
        "CAST(c_custkey % 11 AS INT) AS tx_index", "CAST(0 AS INT) AS event_ordinal", "c_name AS nft_name",
    ]),
    "fb": ("orders", [
        *_KEY, "CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey END AS feedback_id", "concat('f', o_orderkey) AS id", "CAST(o_orderkey % 1000 AS STRING) AS value", "CAST(o_orderkey % 3 AS INT) AS value_decimals",
        "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 101 END AS score", "o_orderpriority AS tag1", "o_orderstatus AS tag2", "o_orderpriority AS endpoint", "o_orderkey % 7 = 0 AS is_revoked", f"{_STATE} AS status",
        "o_orderkey * 31 % 100003 AS block_slot", "concat('h', o_orderkey % 1000) AS seal_hash", "o_orderdate AS created_at",
    ]),
    "rs": ("lineitem JOIN orders ON l_orderkey = o_orderkey", [
        "CASE WHEN l_linenumber = 6 THEN 'zz' ELSE concat('a', o_custkey) END AS asset", *_KEY[1:], "concat('r', l_suppkey) AS responder", "concat('t', l_orderkey, '-', l_linenumber) AS tx_signature",
        "CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_linenumber AS BIGINT) END AS response_id", "concat('q', l_orderkey, '-', l_linenumber) AS id", "CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS block_slot",
        "l_partkey % 100 AS response_count", "CAST(l_linenumber AS INT) AS tx_index", "CAST(0 AS INT) AS event_ordinal",
        "CASE WHEN l_returnflag = 'R' THEN 'ORPHANED' WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'FINALIZED' END AS status",
        "CASE WHEN l_suppkey % 4 = 0 THEN concat('h', o_orderkey % 1000) WHEN l_suppkey % 4 = 1 THEN 'hx' END AS seal_hash", "l_shipdate AS created_at", "l_orderkey * 31 % 100003 AS slot",
    ]),
    "rv": ("orders WHERE o_orderkey % 7 = 0", [
        *_KEY, "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS revocation_id", "concat('v', o_orderkey) AS id", "o_orderkey % 50 AS revoke_count", "o_orderkey * 13 % 100003 AS slot", "CAST(o_orderkey % 4 AS INT) AS tx_index",
        "CAST(0 AS INT) AS event_ordinal", "concat('x', o_orderkey) AS tx_signature", f"{_STATE} AS status", "concat('h', o_orderkey % 900) AS seal_hash", "o_orderdate AS created_at",
    ]),
    "vl": ("lineitem WHERE l_linenumber = 1", [
        "concat('a', l_partkey % 500 + 1) AS asset", "concat('w', l_suppkey) AS validator_address", "CASE WHEN l_quantity > 25 THEN l_suppkey % 101 END AS response", "concat('d', l_orderkey) AS id",
        "CASE WHEN l_returnflag = 'R' THEN 'ORPHANED' ELSE 'PENDING' END AS chain_status", "l_shipdate AS created_at",
    ]),
    "md": ("events", [
        "concat('a', user_id) AS asset", "CASE WHEN event_id % 4 = 0 THEN '_uri:name' WHEN event_id % 4 = 1 THEN '_uri:_status' ELSE event_type END AS key", "concat(event_type, event_id) AS value",
        "CASE WHEN event_id % 3 = 0 THEN 'FINALIZED' ELSE 'PENDING' END AS status", "event_id AS updated_at",
    ]),
    "cp": ("nation", [
        f"concat({_COL.format('n_nationkey')}) AS col", "concat('o', n_nationkey * 3) AS creator", "n_nationkey AS collection_id", "n_nationkey * 17 % 11 AS first_seen_at", "n_nationkey * 5 % 23 AS first_seen_slot",
        "concat('a', n_nationkey) AS first_seen_asset", "concat('n', n_nationkey) AS collection", "'BASE' AS collection_type", "n_nationkey % 7 AS created_at",
    ]),
}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark, d: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    source, _, condition = source.partition(" WHERE ")
    if " JOIN " in source:
        rows = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    else:
        rows = load(spark, d, source)
    return (rows.where(condition) if condition else rows).selectExpr(*columns)


def query(sql: str):
    """Registers a query; its SQL may name the stand-ins it uses."""
    used = [n for n in TABLES if f" {n}" in sql.replace("\n", " ").replace("(", " ").replace(",", " ,")]
    ctes = ", ".join(f"{n} AS (SELECT {', '.join(TABLES[n][1])} FROM {TABLES[n][0]})" for n in used)

    def add(f):
        QUERIES[f.__name__] = f
        start = next((w for w in ("WITH RECURSIVE ", "WITH ") if sql.startswith(w)), "")
        SQL[f.__name__] = f"{start}{ctes}, {sql[len(start) :]}" if start else f"WITH {ctes} {sql}"
        return f

    return add


# filters and lists


@query("SELECT asset, agent_id FROM ag WHERE status <> 'ORPHANED' AND owner IN ('o1', 'o2', 'o3', 'o50') AND trust_tier >= 2 AND total_feedback > 3 AND atom_enabled = FALSE")
def filter_agents(spark, d):
    return entities.where(table(spark, d, "ag"), "agent", owner_in=["o1", "o2", "o3", "o50"], trustTier_gte=2, totalFeedback_gt=3, atomEnabled=False, unknown=7, owner=None).select("asset", "agent_id")


@query("SELECT id FROM fb WHERE status <> 'ORPHANED' AND feedback_id >= 100 AND feedback_id < 9000 AND tag1 = '1-URGENT' AND NOT is_revoked")
def filter_feedbacks(spark, d):
    return entities.where(table(spark, d, "fb"), "feedback", feedbackId_gte=100, feedbackId_lt=9000, tag1="1-URGENT", isRevoked=False).select("id")


@query("SELECT id FROM rs WHERE status <> 'ORPHANED' AND response_id > 2 AND EXISTS (SELECT 1 FROM fb WHERE fb.asset = rs.asset AND fb.client_address = rs.client_address AND fb.feedback_index = rs.feedback_index AND fb.feedback_id = 5)")
def filter_responses(spark, d):
    return entities.where(table(spark, d, "rs"), "response", table(spark, d, "fb"), feedback="5", responseId_gt=2).select("id")


@query("SELECT id FROM rv WHERE status <> 'ORPHANED' AND asset = 'a7' AND revocation_id <= 1000000")
def filter_revocations(spark, d):
    return entities.where(table(spark, d, "rv"), "revocation", agent="a7", revocationId_lte=1_000_000).select("id")


@query("SELECT id FROM vl WHERE chain_status <> 'ORPHANED' AND response IS NULL AND validator_address <> ''")
def filter_validations(spark, d):
    return entities.where(table(spark, d, "vl"), "validation", status="PENDING").select("id")


@query("SELECT asset, key, count(*) AS n FROM md WHERE status <> 'ORPHANED' AND NOT starts_with(key, '_uri:') AND key <> '' GROUP BY 1, 2")
def filter_metadata(spark, d):
    return entities.user_metadata(entities.where(table(spark, d, "md"), "metadata")).groupBy("asset", "key").agg(F.count("*").alias("n"))


@query("SELECT asset, canonical_col FROM ag WHERE canonical_col NOT IN ('bafyaaaaaaaaaaaaaaaaaaaaab', 'c1:bafyaaaaaaaaaaaaaaaaaaaaab', 'c,d') AND owner <> 'o5'")
def filter_texts(spark, d):
    column = "canonical_col"
    return table(spark, d, "ag").where(entities.parse_filter(column, 'not.in.(bafyaaaaaaaaaaaaaaaaaaaaab,"c,d")', pointer=True) & entities.parse_filter("owner", "neq.o5")).select("asset", column)


@query("SELECT id, status FROM fb WHERE (tag1 = '1-URGENT' OR tag2 = 'P') AND status <> 'FINALIZED'")
def filter_any_tag(spark, d):
    return table(spark, d, "fb").where(entities.any_tag(("tag1", "1-URGENT"), ("tag2", "P")) & entities.by_status("FINALIZED", negate=True)).select("id", "status")


@query("SELECT rs.id FROM rs LEFT JOIN fb ON fb.asset = rs.asset AND fb.client_address = rs.client_address AND fb.feedback_index = rs.feedback_index WHERE coalesce(rs.block_slot, fb.block_slot) BETWEEN 50 AND 20000")
def slot_or_parent(spark, d):
    return entities.at_slot(table(spark, d, "rs"), table(spark, d, "fb"), 50, 20_000).select("id")


@query("SELECT asset, quality_score FROM ag WHERE status <> 'ORPHANED' ORDER BY quality_score DESC, asset DESC LIMIT 50 OFFSET 20")
def list_agents(spark, d):
    return entities.list_rows(table(spark, d, "ag"), "agent", "qualityScore", first=50, skip=20).select("asset", "quality_score")


@query("SELECT asset, created_at FROM ag WHERE status <> 'ORPHANED' AND (created_at < 800 OR (created_at = 800 AND asset < 'a5')) ORDER BY created_at DESC, asset DESC LIMIT 100")
def list_agents_after(spark, d):
    return entities.list_rows(table(spark, d, "ag"), "agent", cursor=(800, "a5")).select("asset", "created_at")


@query("SELECT id FROM fb WHERE status <> 'ORPHANED' ORDER BY created_at DESC, asset, client_address, feedback_index, feedback_id NULLS LAST, id LIMIT 250")
def list_feedbacks(spark, d):
    return entities.list_rows(table(spark, d, "fb"), "feedback", first=10_000).select("id")


@query("SELECT id FROM rs WHERE status <> 'ORPHANED' ORDER BY response_count DESC, response_id DESC NULLS LAST, id DESC LIMIT 100")
def list_responses(spark, d):
    return entities.list_rows(table(spark, d, "rs"), "response", "responseCount").select("id")


@query("SELECT id FROM rv WHERE status <> 'ORPHANED' ORDER BY created_at, revocation_id NULLS LAST, id LIMIT 100")
def list_revocations(spark, d):
    return entities.list_rows(table(spark, d, "rv"), "revocation", descending=False).select("id")


@query("SELECT asset, key, max(value) AS value FROM md WHERE key <> '_uri:name' AND status <> 'ORPHANED' GROUP BY 1, 2 ORDER BY asset, key LIMIT 250 OFFSET 7")
def list_metadata(spark, d):
    rows = table(spark, d, "md").where("status <> 'ORPHANED'").groupBy("asset", "key").agg(F.max("value").alias("value"), F.lit("PENDING").alias("status"))
    return entities.list_rows(rows.where("key <> '_uri:name'"), "metadata", descending=False, first=250, skip=7).select("asset", "key", "value")


@query("SELECT asset, sort_key FROM ag WHERE trust_tier >= 2 AND collection = 'n3' AND status <> 'ORPHANED' ORDER BY sort_key DESC, asset LIMIT 20")
def leaderboard_of_collection(spark, d):
    return rollups.leaderboard(table(spark, d, "ag"), 20, collection="n3").select("asset", "sort_key")


@query("SELECT asset, sort_key FROM ag WHERE trust_tier >= 3 ORDER BY sort_key DESC, asset LIMIT 100")
def leaderboard_with_orphans(spark, d):
    return rollups.leaderboard(table(spark, d, "ag"), 100, 3, include_orphaned=True).select("asset", "sort_key")


@query("SELECT col, creator FROM cp WHERE collection_id >= 3 AND first_seen_slot <= 20 ORDER BY first_seen_at DESC, col, creator LIMIT 15")
def list_collections(spark, d):
    return entities.list_collections(table(spark, d, "cp"), first=15, ids=(3, None), slots=(None, 20)).select("col", "creator")


@query("SELECT asset FROM ag WHERE status <> 'ORPHANED' AND canonical_col IN ('bafyaaaaaaaaaaaaaaaaaaaaac', 'c1:bafyaaaaaaaaaaaaaaaaaaaaac') ORDER BY created_at DESC, asset DESC LIMIT 100")
def collection_assets(spark, d):
    return entities.collection_assets(table(spark, d, "ag"), "bafyaaaaaaaaaaaaaaaaaaaaac").select("asset")


@query("SELECT count(*) AS n FROM ag WHERE status <> 'ORPHANED' AND canonical_col IN ('bafyaaaaaaaaaaaaaaaaaaaaac', 'c1:bafyaaaaaaaaaaaaaaaaaaaaac') AND coalesce(creator, owner) = 'o3'")
def collection_asset_count(spark, d):
    return entities.collection_asset_count(table(spark, d, "ag"), "c1:bafyaaaaaaaaaaaaaaaaaaaaac", "o3")


@query("SELECT asset FROM ag WHERE parent_asset = 'a3' AND status <> 'ORPHANED' ORDER BY created_at DESC, asset DESC LIMIT 40 OFFSET 5")
def agent_children(spark, d):
    return entities.children(table(spark, d, "ag"), "a3", 40, 5).select("asset")


@query("""WITH RECURSIVE n AS (SELECT asset AS node, CASE WHEN feedback_count <> 3 THEN parent_asset END AS parent FROM ag WHERE status <> 'ORPHANED'), t AS (SELECT node, 0 AS depth, [node] AS path FROM n WHERE node = 'a3' UNION ALL SELECT n.node, depth + 1, list_append(path, n.node) FROM t JOIN n ON n.parent = t.node WHERE depth < 3 AND NOT list_contains(path, n.node))
SELECT node, depth, array_to_string(path, '/') AS path FROM t WHERE depth > 0""")
def agent_subtree(spark, d):
    agents = table(spark, d, "ag").withColumn("parent_asset", F.when(F.col("feedback_count") != 3, F.col("parent_asset")))
    return tree.subtree(agents, "a3", 3, include_root=False).withColumn("path", F.concat_ws("/", "path"))


@query("SELECT asset, sort_key FROM ag WHERE status <> 'ORPHANED' AND trust_tier >= 1 AND sort_key < 9000000 AND collection = 'n3' ORDER BY sort_key DESC, asset LIMIT 30")
def get_leaderboard(spark, d):
    return entities.get_leaderboard(table(spark, d, "ag"), "n3", 1, 30, 9_000_000).select("asset", "sort_key")


@query("SELECT id, block_slot FROM rs ORDER BY block_slot DESC NULLS LAST, asset, client_address, feedback_index, responder, tx_index, event_ordinal, tx_signature LIMIT 200")
def list_by_slot(spark, d):
    return entities.list_by_slot(table(spark, d, "rs"), "response", "block_slot", descending=True, first=200).select("id", "block_slot")


@query("SELECT asset, id, score FROM fb WHERE score < 90 OR score IS NULL OR (score = 90 AND feedback_index > 500) ORDER BY score DESC NULLS LAST, feedback_index LIMIT 1000")
def keyset_page(spark, d):
    return paging.keyset_page(table(spark, d, "fb"), [("score", False), ("feedback_index", True)], 1000, [90, 500]).select("asset", "id", "score")


@query("SELECT asset, client_address, feedback_index, id, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY asset, client_address, feedback_index ORDER BY response_id NULLS LAST, created_at, id) AS rn FROM rs) WHERE rn BETWEEN 2 AND 3")
def page_of_responses(spark, d):
    key = ["asset", "client_address", "feedback_index"]
    return paging.page_per_group(table(spark, d, "rs"), key, [F.asc_nulls_last("response_id"), F.col("created_at"), F.col("id")], 2, 1).select(*key, "id", "rn")


@query("SELECT asset, id, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY created_at DESC, id DESC) AS rn FROM vl) WHERE rn <= 2")
def page_of_validations(spark, d):
    return paging.page_per_group(table(spark, d, "vl"), ["asset"], [F.desc("created_at"), F.desc("id")], 2).select("asset", "id", "rn")


# joins and statistics


@query("SELECT asset, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 19 END, feedback_count, 0)::BIGINT AS total_feedback, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 END, 0)::BIGINT AS total_responses FROM ag JOIN customer ON asset = concat('a', c_custkey)")
def digest_counts(spark, d):
    cache = load(spark, d, "customer").where("c_custkey % 2 = 0").selectExpr("concat('a', c_custkey) AS asset", "c_custkey % 19 AS feedback_count", "c_custkey % 7 AS response_count", "c_custkey % 3 AS revoke_count")
    return stats.with_digest_counts(table(spark, d, "ag").drop("total_feedback"), cache).select("asset", "total_feedback", "total_responses")


_STATS = """s AS (SELECT asset, count(*) AS n, round(avg(score))::BIGINT AS a, count(*) FILTER (score >= 50) AS p, count(*) FILTER (score < 50) AS g FROM fb WHERE status <> 'ORPHANED' AND NOT is_revoked AND score IS NOT NULL GROUP BY 1),
k AS (SELECT DISTINCT asset FROM fb), w AS (SELECT asset, count(*) AS v FROM vl WHERE chain_status <> 'ORPHANED' GROUP BY 1),
st AS (SELECT ag.*, coalesce(s.n, CASE WHEN k.asset IS NULL THEN feedback_count END, 0)::BIGINT AS scores, coalesce(s.a, CASE WHEN k.asset IS NULL THEN raw_avg_score END)::BIGINT AS a, coalesce(p, 0)::BIGINT AS positive, coalesce(g, 0)::BIGINT AS negative, coalesce(v, 0)::BIGINT AS validation_count
FROM ag LEFT JOIN s ON s.asset = ag.asset LEFT JOIN k ON k.asset = ag.asset LEFT JOIN w ON w.asset = ag.asset)"""


@query(f"WITH {_STATS} SELECT asset, scores, CASE WHEN scores > 0 THEN a END AS avg_score, positive, negative, validation_count FROM st")
def agents_with_stats(spark, d):
    return stats.with_stats(*(table(spark, d, n) for n in ("ag", "fb", "vl"))).select("asset", "scores", "avg_score", "positive", "negative", "validation_count")


@query("SELECT cp.collection_id, ag.asset FROM cp JOIN ag ON ag.canonical_col = cp.col AND coalesce(ag.creator, ag.owner) = cp.creator WHERE ag.status <> 'ORPHANED'")
def pointer_agents(spark, d):
    return stats.pointer_agents(table(spark, d, "cp"), table(spark, d, "ag")).select("collection_id", "asset")


@query(f"WITH {_STATS} SELECT st.asset, scores, CASE WHEN scores > 0 THEN a END AS avg_score FROM st JOIN cp ON st.canonical_col = cp.col AND coalesce(st.creator, st.owner) = cp.creator WHERE st.status <> 'ORPHANED' AND collection_id = 4 ORDER BY st.created_at DESC, st.asset DESC LIMIT 100")
def collection_agents(spark, d):
    return stats.collection_agents(*(table(spark, d, n) for n in ("cp", "ag", "fb", "vl")), 4).select("asset", "scores", "avg_score")


@query("""WITH x AS (SELECT collection, count(*) AS n FROM ag WHERE status <> 'ORPHANED' GROUP BY 1), y AS (SELECT ag.collection, count(*) AS n, round(avg(score))::BIGINT AS s FROM fb JOIN ag ON ag.asset = fb.asset WHERE fb.status <> 'ORPHANED' AND ag.status <> 'ORPHANED' GROUP BY 1)
SELECT cp.collection, collection_type, coalesce(x.n, 0)::BIGINT AS agent_count, coalesce(y.n, 0)::BIGINT AS total_feedbacks, y.s AS avg_score FROM cp LEFT JOIN x ON x.collection = cp.collection LEFT JOIN y ON y.collection = cp.collection ORDER BY agent_count DESC, cp.collection LIMIT 10""")
def collections_by_agents(spark, d):
    return stats.collection_stats(*(table(spark, d, n) for n in ("cp", "ag", "fb")), by_agents=True, first=10).drop("created_at")


@query("SELECT (SELECT count(*) FROM ag WHERE status <> 'ORPHANED') AS total_agents, (SELECT count(*) FROM ag WHERE status <> 'ORPHANED' AND trust_tier = 4) AS tier4, (SELECT count(*) FROM ag WHERE status <> 'ORPHANED' AND trust_tier = 3) AS tier3, (SELECT round(avg(quality_score))::BIGINT FROM ag WHERE status <> 'ORPHANED' AND feedback_count > 0) AS avg_quality, (SELECT count(*) FROM cp) AS total_collections, (SELECT count(*) FROM fb WHERE status <> 'ORPHANED') AS total_feedbacks")
def global_totals(spark, d):
    return stats.global_stats(table(spark, d, "ag"), table(spark, d, "cp"), table(spark, d, "fb"))


@query("SELECT 'feedbacks' AS model, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'FINALIZED') AS finalized, count(*) FILTER (status = 'ORPHANED') AS orphaned FROM fb UNION ALL SELECT 'responses', count(*) FILTER (status = 'PENDING'), count(*) FILTER (status = 'FINALIZED'), count(*) FILTER (status = 'ORPHANED') + count(*) FILTER (asset = 'zz') FROM rs UNION ALL SELECT 'agents', count(*) FILTER (status = 'PENDING'), count(*) FILTER (status = 'FINALIZED'), count(*) FILTER (status = 'ORPHANED') FROM ag")
def verification_models(spark, d):
    rs = table(spark, d, "rs")
    return stats.verification_stats({"feedbacks": table(spark, d, "fb"), "responses": rs, "agents": table(spark, d, "ag")}, {"responses": rs.where("asset = 'zz'")})


@query("SELECT sum(p)::BIGINT AS pending, sum(o)::BIGINT AS orphaned, sum(n)::BIGINT AS total, (SELECT count(*) FROM rs WHERE asset = 'zz') AS staged, TRUE AS backlog FROM (SELECT count(*) FILTER (status = 'PENDING') AS p, count(*) FILTER (status = 'ORPHANED') AS o, count(*) AS n FROM fb UNION ALL SELECT count(*) FILTER (status = 'PENDING'), count(*) FILTER (status = 'ORPHANED'), count(*) FROM ag)")
def readiness(spark, d):
    return stats.readiness({"feedbacks": table(spark, d, "fb"), "agents": table(spark, d, "ag")}, {"responses": table(spark, d, "rs").where("asset = 'zz'")}, F.lit(10), F.lit(1000))


@query("SELECT ag.asset, count(fb.id) AS n, round(avg(value::DOUBLE / 10 ** value_decimals), 6) AS avg_value, epoch(max(fb.created_at))::BIGINT AS last_at FROM ag LEFT JOIN fb ON fb.asset = ag.asset AND fb.status <> 'ORPHANED' AND NOT is_revoked GROUP BY 1")
def agent_stats(spark, d):
    got = stats.agent_stats(table(spark, d, "ag"), table(spark, d, "fb"))
    return got.select("asset", "n", F.round("avg_value", 6).alias("avg_value"), scalar.to_unix(F.col("last_at").cast("timestamp")).alias("last_at"))


@query("SELECT ag.asset, count(fb.id) AS n FROM ag LEFT JOIN fb ON fb.asset = ag.asset AND fb.status <> 'ORPHANED' AND NOT is_revoked GROUP BY 1")
def feedback_counts(spark, d):
    return stats.feedback_counts(table(spark, d, "ag"), table(spark, d, "fb"))


@query("SELECT ag.asset, epoch(max(fb.created_at))::BIGINT AS last_activity FROM ag LEFT JOIN fb ON fb.asset = ag.asset AND fb.status <> 'ORPHANED' GROUP BY 1")
def last_activity(spark, d):
    return stats.last_activity(table(spark, d, "ag"), table(spark, d, "fb")).select("asset", scalar.to_unix(F.col("last_activity").cast("timestamp")).alias("last_activity"))


@query("SELECT md.asset, max(md.updated_at) AS updated_at FROM md JOIN ag ON ag.asset = md.asset AND ag.status <> 'ORPHANED' WHERE starts_with(md.key, '_uri:') GROUP BY 1 ORDER BY updated_at DESC, md.asset LIMIT 100")
def latest_registration(spark, d):
    return stats.latest_registration(table(spark, d, "md"), table(spark, d, "ag"))


@query("SELECT trust_tier, count(*) AS n FROM ag GROUP BY 1")
def agent_tiers(spark, d):
    return stats.tiers(table(spark, d, "ag"))


@query("SELECT rs.id, fb.status AS parent_status, fb.seal_hash AS parent_hash FROM rs LEFT JOIN fb ON fb.asset = rs.asset AND fb.client_address = rs.client_address AND fb.feedback_index = rs.feedback_index")
def responses_with_parent(spark, d):
    return stats.with_parent(table(spark, d, "rs"), table(spark, d, "fb")).select("id", "parent_status", "parent_hash")


@query("SELECT fb.id, CASE WHEN is_revoked THEN epoch(rv.created_at)::BIGINT END AS revoked_at FROM fb LEFT JOIN rv ON rv.feedback_index = fb.feedback_index")
def revoked_at(spark, d):
    return stats.with_revoked_at(table(spark, d, "fb"), table(spark, d, "rv")).select("id", scalar.to_unix(F.col("revoked_at").cast("timestamp")).alias("revoked_at"))


@query("SELECT canonical_col, arg_min(asset, (slot, asset)) AS first_asset, arg_max(owner, (slot, asset)) AS last_owner, count(*) AS n FROM ag GROUP BY 1")
def first_seen(spark, d):
    return stats.first_seen(table(spark, d, "ag"), ["canonical_col"], F.struct("slot", "asset"), ["asset"], ["owner"])


@query("SELECT slot, id FROM (SELECT *, row_number() OVER (PARTITION BY slot, tx_index ORDER BY id) AS n FROM rs WHERE slot > 300) WHERE n = 1 ORDER BY slot, tx_index LIMIT 400")
def distinct_on(spark, d):
    return stats.distinct_on(table(spark, d, "rs"), [F.col("slot"), F.coalesce("tx_index", F.lit(-1))], [F.col("id")], F.col("slot") > 300, 400).select("slot", "id")


@query("SELECT DISTINCT rs.asset, fb.asset IS NOT NULL AS found, fb.n FROM rs LEFT JOIN (SELECT asset, count(*) AS n FROM fb WHERE score > 50 GROUP BY 1) fb ON fb.asset = rs.asset")
def multi_get_rows(spark, d):
    return stats.multi_get(table(spark, d, "rs"), table(spark, d, "fb").where("score > 50").groupBy("asset").agg(F.count("*").alias("n")), ["asset"])


@query("SELECT staged, count(*) AS n, count(tag1) AS tags FROM (SELECT FALSE AS staged, tag1 FROM fb WHERE status <> 'ORPHANED' UNION ALL SELECT TRUE, NULL FROM fb WHERE status = 'ORPHANED') GROUP BY 1")
def live_and_staged(spark, d):
    fb = table(spark, d, "fb")
    return stats.with_staged(fb.where("status <> 'ORPHANED'"), fb.where("status = 'ORPHANED'").drop("tag1")).groupBy("staged").agg(F.count("*").alias("n"), F.count("tag1").alias("tags"))


@query("SELECT id, feedback_index + (SELECT coalesce(max(agent_id), 0) FROM ag) AS seeded FROM fb")
def seeded(spark, d):
    return stats.with_seed(table(spark, d, "fb"), table(spark, d, "ag").agg(F.max("agent_id"))).select("id", (F.col("feedback_index") + F.col("seed")).alias("seeded"))


# ids


@query("""WITH m AS (SELECT max(agent_id) AS most FROM ag), n AS (SELECT asset, row_number() OVER (ORDER BY slot, tx_index, asset) AS k FROM ag WHERE agent_id IS NULL AND status <> 'ORPHANED')
SELECT ag.asset, coalesce(agent_id, most + k) AS agent_id FROM ag LEFT JOIN n ON n.asset = ag.asset CROSS JOIN m""")
def agent_ids(spark, d):
    return ids.assign_global_ids(table(spark, d, "ag"), ["slot", "tx_index", "asset"], "agent_id", F.col("status") != "ORPHANED").select("asset", "agent_id")


@query("SELECT asset, r AS agent_id FROM (SELECT asset, agent_id, row_number() OVER (ORDER BY slot, tx_index, asset) AS r FROM ag) WHERE agent_id IS DISTINCT FROM r")
def repaired_ids(spark, d):
    return ids.repair_ids(table(spark, d, "ag"), ["slot", "tx_index", "asset"], "agent_id", "asset").withColumn("agent_id", F.col("agent_id").cast("long"))


@query("SELECT id, CASE WHEN status <> 'ORPHANED' AND response_id IS NULL THEN coalesce(max(response_id) OVER w, 0) + row_number() OVER (PARTITION BY asset, client_address, feedback_index, response_id IS NULL AND status <> 'ORPHANED' ORDER BY slot, tx_index, tx_signature) ELSE response_id END AS response_id FROM rs WINDOW w AS (PARTITION BY asset, client_address, feedback_index)")
def response_ids(spark, d):
    order = [F.col(c) for c in ("slot", "tx_index", "tx_signature")]
    return ids.assign_ids(table(spark, d, "rs"), ["asset", "client_address", "feedback_index"], order, "response_id", scalar.active()).select("id", "response_id")


@query("SELECT concat('revocations:', asset) AS scope, coalesce(max(revocation_id), 0) + 1 AS next_value FROM rv GROUP BY asset")
def id_counters(spark, d):
    return ids.counters(table(spark, d, "rv"), ["asset"], "revocation_id", "revocations")


@query("SELECT asset, client_address, feedback_index, missing FROM (SELECT asset, client_address, feedback_index, count(response_id) AS n, min(response_id) AS lo, max(response_id) AS hi, count(DISTINCT response_id) AS k, count(*) FILTER (response_id IS NULL AND status <> 'ORPHANED') AS missing FROM rs GROUP BY 1, 2, 3) WHERE missing > 0 OR (n > 0 AND (lo <> 1 OR hi <> n OR k <> n))")
def audit_responses(spark, d):
    key = ["asset", "client_address", "feedback_index"]
    return ids.audit_gapless(table(spark, d, "rs"), key, "response_id", scalar.active()).select(*key, "missing")


@query("SELECT id, CASE WHEN status <> 'ORPHANED' AND revocation_id IS NULL THEN coalesce(max(revocation_id) OVER (PARTITION BY asset), 0) + row_number() OVER (PARTITION BY asset, revocation_id IS NULL AND status <> 'ORPHANED' ORDER BY slot, tx_index, tx_signature, id) ELSE revocation_id END AS revocation_id FROM rv")
def revocation_ids(spark, d):
    order = [F.col(c) for c in ("slot", "tx_index", "tx_signature", "id")]
    return ids.assign_ids(table(spark, d, "rv"), ["asset"], order, "revocation_id", scalar.active()).select("id", "revocation_id")


@query("SELECT col, creator, row_number() OVER (ORDER BY first_seen_at, first_seen_slot, col, creator) AS number FROM cp")
def pointer_ids(spark, d):
    return ids.assign_global_ids(table(spark, d, "cp"), ["first_seen_at", "first_seen_slot", "col", "creator"], "number").select("col", "creator", F.col("number").cast("long").alias("number"))


@query("SELECT count(*) FILTER (trust_tier > 4) AS trust_tier, count(*) FILTER (quality_score > 10000) AS quality_score, count(*) FILTER (raw_avg_score > 100) AS raw_avg_score, 0::BIGINT AS status, count(*) FILTER (status <> 'ORPHANED' AND agent_id IS NULL) AS agent_id FROM ag")
def agent_violations(spark, d):
    return schemas.violations(table(spark, d, "ag"), "agents")


# orphans and statuses


@query("SELECT rv.id, CASE WHEN rv.status = 'ORPHANED' AND fb.id IS NOT NULL THEN 'PENDING' ELSE rv.status END AS status FROM rv LEFT JOIN fb ON fb.feedback_index = rv.feedback_index AND fb.score > 40")
def reconcile_revocations(spark, d):
    return fold.reconcile_revocations(table(spark, d, "rv"), table(spark, d, "fb").where("score > 40")).select("id", "status")


@query("SELECT (SELECT count(*) FROM rs WHERE NOT (status = 'ORPHANED' AND response_id IS NULL AND asset = 'zz')) AS kept, (SELECT count(*) FROM rs WHERE status = 'ORPHANED' AND response_id IS NULL AND asset = 'zz') AS staged")
def migrate_orphans(spark, d):
    rs = table(spark, d, "rs")
    kept, staged = fold.migrate_orphans(rs, table(spark, d, "fb"), rs.where("false"))
    return kept.agg(F.count("*").alias("kept")).crossJoin(F.broadcast(staged.agg(F.count("*").alias("staged"))))  # one row each


@query("""WITH o AS (SELECT fb.asset, fb.client_address, fb.feedback_index, fb.asset IN (SELECT asset FROM ag WHERE trust_tier > 2) AS there FROM fb WHERE score IS NOT NULL),
p AS (SELECT rs.* FROM rs JOIN o ON o.there AND o.asset = rs.asset AND o.feedback_index = rs.feedback_index)
SELECT (SELECT count(*) FROM o WHERE there) AS feedbacks, (SELECT count(*) FROM o WHERE NOT there) AS staged_feedbacks, (SELECT count(DISTINCT (asset, client_address, feedback_index, responder, tx_signature)) FROM p) AS responses, (SELECT count(*) FROM rs) - (SELECT count(*) FROM p) AS staged_responses""")
def cascade(spark, d):
    staged = table(spark, d, "fb").where("score IS NOT NULL").withColumns({"slot": F.col("block_slot"), "tx_index": F.lit(None).cast("int"), "event_ordinal": F.lit(0)})
    got = fold.cascade(staged, table(spark, d, "rs"), table(spark, d, "rv"), staged.where("false"), table(spark, d, "ag").where("trust_tier > 2"))
    rows = [got[k].agg(F.count("*").alias(k)) for k in ("feedbacks", "staged_feedbacks", "responses", "staged_responses")]
    return rows[0].crossJoin(F.broadcast(rows[1])).crossJoin(F.broadcast(rows[2])).crossJoin(F.broadcast(rows[3]))  # one row each


_KNOWN = "e AS (SELECT concat('a', c_custkey) AS asset, CASE WHEN c_custkey % 10 < 9 THEN c_custkey % 10 < 7 END AS there, CASE WHEN c_custkey % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS verdict FROM customer)"


def _existence(spark, d) -> tuple[DataFrame, DataFrame]:
    c = load(spark, d, "customer")
    return c.selectExpr("concat('a', c_custkey) AS asset", "CASE WHEN c_custkey % 10 < 9 THEN c_custkey % 10 < 7 END AS exists"), c.selectExpr("concat('a', c_custkey) AS asset", "CASE WHEN c_custkey % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS verdict")


@query(f"WITH {_KNOWN} SELECT fb.id, CASE WHEN status = 'PENDING' AND block_slot <= 60000 AND NOT there THEN 'ORPHANED' WHEN status = 'PENDING' AND block_slot <= 60000 AND there AND verdict = 'ok' THEN 'FINALIZED' ELSE status END AS status FROM fb LEFT JOIN e ON e.asset = fb.asset")
def verify_feedbacks(spark, d):
    return lifecycle.verify_feedbacks(table(spark, d, "fb"), *_existence(spark, d), 60_000, "block_slot").select("id", "status")


@query(f"""WITH {_KNOWN}, c AS (SELECT rs.*, CASE WHEN rs.status = 'PENDING' AND coalesce(fb.status = 'ORPHANED', TRUE) THEN 'ORPHANED' ELSE rs.status END AS s, coalesce(rs.seal_hash <> fb.seal_hash, FALSE) AS differs FROM rs LEFT JOIN fb ON fb.asset = rs.asset AND fb.client_address = rs.client_address AND fb.feedback_index = rs.feedback_index)
SELECT id, differs AS hash_differs, CASE WHEN s = 'PENDING' AND NOT there THEN 'ORPHANED' WHEN s = 'PENDING' AND there AND verdict = 'ok' THEN 'FINALIZED' ELSE s END AS status FROM c LEFT JOIN e ON e.asset = c.asset""")
def verify_responses(spark, d):
    return lifecycle.verify_children(table(spark, d, "rs"), table(spark, d, "fb"), *_existence(spark, d)).select("id", "hash_differs", "status")


@query(f"WITH {_KNOWN} SELECT rv.id, CASE WHEN rv.status = 'ORPHANED' AND there AND fb.id IS NOT NULL THEN 'PENDING' ELSE rv.status END AS status FROM rv LEFT JOIN e ON e.asset = rv.asset LEFT JOIN fb ON fb.feedback_index = rv.feedback_index AND fb.status <> 'ORPHANED'")
def recover_orphans(spark, d):
    return lifecycle.recover_orphans(table(spark, d, "rv"), _existence(spark, d)[0], "asset", table(spark, d, "fb")).select("id", "status")


@query(f"""WITH {_KNOWN}, m AS (SELECT max(agent_id) AS most FROM ag), v AS (SELECT ag.asset, agent_id, slot, tx_index, CASE WHEN status = 'PENDING' AND slot <= 50000 AND there THEN 'FINALIZED' WHEN status = 'PENDING' AND slot <= 50000 AND NOT there THEN 'ORPHANED' ELSE status END AS status,
CASE WHEN status = 'PENDING' AND slot <= 50000 AND there IS NOT NULL THEN 77 END AS verified_slot FROM ag LEFT JOIN e ON e.asset = ag.asset), n AS (SELECT asset, row_number() OVER (ORDER BY slot, tx_index, asset) AS k FROM v WHERE agent_id IS NULL AND status <> 'ORPHANED')
SELECT v.asset, status, verified_slot::BIGINT AS verified_slot, coalesce(agent_id, most + k) AS agent_id FROM v LEFT JOIN n ON n.asset = v.asset CROSS JOIN m""")
def verify_agents(spark, d):
    return lifecycle.verify_agents(table(spark, d, "ag"), _existence(spark, d)[0], 50_000, 77, ["slot", "tx_index", "asset"]).select("asset", "status", "verified_slot", "agent_id")


@query("SELECT status, verified, count(*) AS n FROM (SELECT CASE WHEN md.status = 'PENDING' AND starts_with(key, '_uri:') THEN 'FINALIZED' ELSE md.status END AS status, CASE WHEN md.status = 'PENDING' AND starts_with(key, '_uri:') THEN coalesce(ag.created_at, 0) END AS verified FROM md LEFT JOIN ag ON ag.asset = md.asset) GROUP BY 1, 2")
def finalize_uri_metadata(spark, d):
    agents = table(spark, d, "ag").select("asset", F.lit(None).cast("timestamp").alias("updated_at"), F.timestamp_seconds("created_at").alias("created_at"))
    got = lifecycle.finalize_uri_metadata(table(spark, d, "md").withColumn("verified_at", F.lit(None).cast("timestamp")), agents)
    return got.groupBy("status", scalar.to_unix(F.col("verified_at")).alias("verified")).agg(F.count("*").alias("n"))


@query("SELECT id, coalesce(seal_hash, CASE WHEN tx_index % 2 = 0 THEN concat('e', tx_signature) END) AS seal_hash FROM rs")
def backfill_seal_hash(spark, d):
    rs = table(spark, d, "rs")
    name = F.when(F.col("tx_index") % 2 == 0, "ResponseAppended").otherwise("NewFeedback")
    events = rs.select("tx_signature", "event_ordinal", name.alias("name"), F.concat(F.lit("e"), "tx_signature").alias("seal_hash"))
    return lifecycle.backfill_seal_hash(rs, events).select("id", "seal_hash")


@query(f"WITH {_KNOWN}, a AS (SELECT fb.status AS b, CASE WHEN status = 'PENDING' AND NOT there THEN 'ORPHANED' WHEN status = 'PENDING' AND there AND verdict = 'ok' THEN 'FINALIZED' ELSE status END AS s FROM fb LEFT JOIN e ON e.asset = fb.asset) SELECT count(*) FILTER (b <> 'FINALIZED' AND s = 'FINALIZED') AS verified, count(*) FILTER (b <> 'ORPHANED' AND s = 'ORPHANED') AS orphaned, count(*) FILTER (b = 'ORPHANED' AND s <> 'ORPHANED') AS recovered, count(*) FILTER (b = 'PENDING' AND s = 'PENDING') AS skipped, (SELECT count(*) FROM e WHERE verdict = 'mismatch') AS mismatches FROM a")
def cycle_stats(spark, d):
    fb, (there, verdicts) = table(spark, d, "fb"), _existence(spark, d)
    return lifecycle.cycle_stats(fb, lifecycle.verify_feedbacks(fb, there, verdicts), ["id"], verdicts)


# chains


def _events(spark, d) -> DataFrame:
    return load(spark, d, "events").selectExpr("concat('a', user_id) AS agent", "event_id", "unhex(sha2(concat(user_id, ':', event_id, ':', event_type), 256)) AS leaf")


def _stored(spark, d) -> DataFrame:
    """A chain of the events of each user; some digests are missing, some were tampered with."""
    plain = chain.digests(_events(spark, d).withColumn("digest", F.lit(None).cast("binary")), ["agent"], "event_id", hash=chain.SHA256)
    digest = F.when(F.col("event_id") % 97 == 0, F.col("leaf")).when(F.col("event_id") % 5 != 0, F.col("computed"))
    return plain.select("agent", "event_id", "leaf", digest.alias("digest"))


_HEX0 = "repeat('00', 32)"
_CHAIN = f"""RECURSIVE l AS (SELECT concat('a', user_id) AS agent, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, sha256(concat(user_id, ':', event_id, ':', event_type)) AS leaf FROM events),
r AS (SELECT agent, event_id, n, leaf, {_HEX0} AS d, {_HEX0} AS c, {_HEX0} AS s FROM (SELECT agent, NULL::BIGINT AS event_id, 0::BIGINT AS n, ''::VARCHAR AS leaf FROM l GROUP BY agent) UNION ALL
SELECT agent, event_id, n, leaf, d, c, CASE WHEN event_id % 97 = 0 THEN leaf WHEN event_id % 5 <> 0 THEN d END AS s FROM (SELECT l.agent, l.event_id, l.n, l.leaf, sha256(unhex(r.d) || encode('8004_FEEDBACK_V1') || unhex(l.leaf)) AS d, sha256(unhex(coalesce(r.s, r.c)) || encode('8004_FEEDBACK_V1') || unhex(l.leaf)) AS c FROM r JOIN l ON l.agent = r.agent AND l.n = r.n + 1)),
k AS (SELECT * FROM r WHERE n > 0), b AS (SELECT agent, count(*) AS events, min(n) FILTER (s IS NOT NULL AND s <> c) AS first_mismatch, arg_max(c, n) AS last FROM k GROUP BY 1)"""


def _chain_query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, f"WITH {_CHAIN} {sql}"
        return f

    return add


@_chain_query("SELECT agent, events, first_mismatch IS NULL AS valid, first_mismatch, CASE WHEN first_mismatch IS NULL THEN last END AS digest FROM b")
def chain_tampered(spark, d):
    got = chain.verify_chain(_stored(spark, d), ["agent"], "event_id", hash=chain.SHA256)
    return got.select("agent", "events", "valid", "first_mismatch", F.lower(F.hex("digest")).alias("digest"))


@_chain_query("SELECT agent, n AS count, c AS digest FROM k WHERE n % 10 = 0")
def chain_checkpoints(spark, d):
    return chain.checkpoints(chain.digests(_stored(spark, d), ["agent"], "event_id", hash=chain.SHA256), ["agent"], 10).select("agent", "count", F.lower(F.hex("digest")).alias("digest"))


@_chain_query("SELECT agent, max(n) AS count, arg_max(c, n) AS digest FROM k WHERE n % 10 = 0 GROUP BY 1")
def chain_latest_checkpoints(spark, d):
    points = chain.checkpoints(chain.digests(_stored(spark, d), ["agent"], "event_id", hash=chain.SHA256), ["agent"], 10)
    return chain.latest_checkpoints(points, ["agent"]).select("agent", "count", F.lower(F.hex("digest")).alias("digest"))


@_chain_query("SELECT agent, max(event_id) + 1 AS count, arg_max(s, event_id) FILTER (s IS NOT NULL) AS digest FROM k GROUP BY 1")
def chain_heads(spark, d):
    return chain.heads(_stored(spark, d), ["agent"], "event_id").select("agent", "count", F.lower(F.hex("digest")).alias("digest"))


@_chain_query(", p AS (SELECT agent, event_id, row_number() OVER (PARTITION BY agent ORDER BY event_id) AS i FROM l WHERE event_id >= 100) SELECT agent, event_id, bool_or(i > 3) OVER (PARTITION BY agent) AS has_more, max(event_id) FILTER (i <= 3) OVER (PARTITION BY agent) + 1 AS next_from FROM p QUALIFY i <= 3")
def chain_replay_page(spark, d):
    return chain.replay_page(_events(spark, d), ["agent"], "event_id", 100, 1 << 60, 3).drop("leaf")


@query("SELECT asset, arg_max(tx_signature, (slot, tx_signature)) AS tx_signature FROM (SELECT asset, slot, tx_signature FROM rs UNION ALL SELECT asset, slot, tx_signature FROM rv) GROUP BY 1")
def chain_latest_signature(spark, d):
    heads = table(spark, d, "rs").select("asset", "slot", "tx_signature").unionByName(table(spark, d, "rv").select("asset", "slot", "tx_signature"))
    return chain.latest_signature(heads, ["asset"])


@query("SELECT asset, CASE WHEN trust_tier > 2 THEN quality_score ELSE feedback_count END AS feedback_count FROM ag WHERE trust_tier <> 0")
def digest_cache(spark, d):
    ag = table(spark, d, "ag")
    cache = ag.where("trust_tier BETWEEN 1 AND 3").select("asset", "feedback_count")
    return chain.digest_cache(cache, ag.where("trust_tier > 2").select("asset", F.col("quality_score").alias("feedback_count")))


# documents, values, reconciliation


@query("SELECT asset, CASE WHEN coalesce(nft_name, '') = '' THEN n.name ELSE nft_name END AS nft_name FROM (SELECT asset, CASE WHEN trust_tier = 1 THEN '' WHEN trust_tier <> 2 THEN nft_name END AS nft_name FROM ag) LEFT JOIN (SELECT asset, max(value) AS name FROM md WHERE key = '_uri:name' GROUP BY 1) n USING (asset)")
def backfill_names(spark, d):
    name = F.when(F.col("trust_tier") == 1, "").when(F.col("trust_tier") != 2, F.col("nft_name"))
    return documents.backfill_names(table(spark, d, "ag").select("asset", name.alias("nft_name")), table(spark, d, "md"))


@query("SELECT asset, arg_max(value, (updated_at, value)) AS uri FROM md GROUP BY 1")
def latest_tasks(spark, d):
    return documents.latest_tasks(table(spark, d, "md").select("asset", F.col("value").alias("uri"), F.col("updated_at").alias("queued_at"))).select("asset", "uri")


@query("SELECT asset, key, value FROM md")
def old_values(spark, d):
    rows = table(spark, d, "md").withColumn("value", F.base64(F.col("value").cast("binary")))
    return documents.base64_to_binary(rows).select("asset", "key", F.col("value").cast("string").alias("value"))


@query("SELECT count(*) AS n, sum(octet_length(encode(value)))::BIGINT AS page_bytes, TRUE AS rejected FROM md WHERE asset <> ''")
def capped_page(spark, d):
    return documents.cap_bytes(table(spark, d, "md"), 1000).groupBy("page_bytes", "rejected").agg(F.count("*").alias("n"))


@query("SELECT asset, CASE WHEN trust_tier = 0 THEN 'oversize' WHEN trust_tier = 1 THEN 'timeout' WHEN trust_tier = 2 THEN 'invalid_json' ELSE 'ok' END AS doc_status, CASE WHEN trust_tier > 2 THEN nft_name END AS name, CASE WHEN trust_tier = 4 THEN '[\"oasf\"]' END AS trust, trust_tier = 3 AS truncated, CASE WHEN trust_tier = 3 THEN 52 WHEN trust_tier = 4 THEN 2 END AS n FROM ag")
def digest_documents(spark, d):
    tier = F.col("trust_tier")
    extra = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit('"k'), i, F.lit('":"v"'))), ",")
    named = F.concat(F.lit('{"name":"<b>'), "nft_name", F.lit('</b>"'))
    body = F.when(tier == 0, F.repeat(F.lit("x"), 3000)).when(tier == 2, "no json").when(tier == 3, F.concat(named, F.lit(',"active":true,"image":"",'), extra, F.lit("}"))).otherwise(F.concat(named, F.lit(',"supportedTrust":["OASF","none"]}')))
    docs = table(spark, d, "ag").select("asset", F.when(tier == 1, "timeout").otherwise("ok").alias("fetch"), body.alias("body"))
    got = documents.read_documents(docs, 2000, full=True, fetched="fetch")
    f = F.col("fields")
    return got.select("asset", "doc_status", F.try_element_at(f, F.lit("name")).alias("name"), F.try_element_at(f, F.lit("supported_trust")).alias("trust"), "truncated", F.when(f.isNotNull(), F.size(f)).alias("n"))


@query("SELECT asset, decoded FROM (SELECT asset, concat_ws('|', asset, client_address, feedback_index) AS decoded FROM fb)")
def ids_and_back(spark, d):
    parts = ("asset", "client", "n")
    rows = table(spark, d, "fb").select("asset", F.concat(F.when(F.col("feedback_index") % 2 == 0, "sol:").otherwise(""), scalar.compose_id(F.col("asset"), F.col("client_address"), F.col("feedback_index"))).alias("id"))
    return rows.select("asset", F.concat_ws("|", *[scalar.decompose_id(F.col("id"), *parts)[p] for p in parts]).alias("decoded"))


@query("SELECT asset, abs(((length(asset) * 0) + 0)) AS zero, nft_name AS clean, md5(asset) AS digest FROM ag")
def cleaned_texts(spark, d):
    rows = table(spark, d, "ag")
    digest = F.concat(F.when(F.col("trust_tier") > 2, "0x").otherwise("\\x"), F.upper(F.md5("asset")))
    tie = hashes.tie_breaker(F.col("asset"))
    return rows.select("asset", F.when((tie >= 0) & (tie < 10_000_000), F.lit(0).cast("long")).alias("zero"), scalar.strip_nul(F.concat("nft_name", F.lit("\0"))).alias("clean"), scalar.digest_text(digest).alias("digest"))


@query("""WITH f AS (SELECT DISTINCT asset, client_address, feedback_index, seal_hash FROM fb), t AS (SELECT * FROM fb WHERE score IS NOT NULL)
SELECT 'feedback' AS kind, count(*) AS expected, (SELECT count(*) FROM t) AS indexed, count(*) - (SELECT count(*) FROM t) AS missing, (SELECT count(*) FROM t WHERE score < 10) AS mismatched FROM f""")
def integrity_of_feedback(spark, d):
    fb = table(spark, d, "fb")
    log = fb.select(F.col("feedback_index").alias("line"), F.lit("feedback").alias("phase"), "asset", F.col("client_address").alias("wallet"), F.lit(None).cast("string").alias("client"), "feedback_index", "seal_hash", F.col("id").alias("tx_signature"))
    actions, _ = reconcile.expected_actions(log)
    have = fb.where("score IS NOT NULL").select("asset", F.col("client_address").alias("client"), "feedback_index", "seal_hash", F.lit("r").alias("responder"), F.when(F.col("score") < 10, "other").otherwise(F.col("id")).alias("tx_signature"))
    return reconcile.integrity(actions, {k: have for k in reconcile.ACTIONS}).where("kind = 'feedback'")


@query("""WITH f AS (SELECT DISTINCT asset, client_address, feedback_index, seal_hash FROM fb), t AS (SELECT * FROM fb WHERE score IS NOT NULL),
p AS (SELECT *, concat('r', feedback_index % 5) AS r FROM fb WHERE feedback_index % 2 = 0),
w AS (SELECT r, asset, feedback_index, seal_hash, max(concat('w', id)) AS want, (feedback_index % 3 = 0) AS paid, client_address FROM p GROUP BY ALL)
SELECT 'agent' AS kind, count(*) AS expected, count(*) FILTER (trust_tier > 0) AS indexed, count(*) FILTER (trust_tier = 0) AS missing, count(*) FILTER (trust_tier = 1) AS mismatched FROM ag
UNION ALL SELECT 'feedback', count(*), (SELECT count(*) FROM t), count(*) - (SELECT count(*) FROM t), (SELECT count(*) FROM t WHERE score < 10) FROM f
UNION ALL SELECT 'response', count(*), count(*) FILTER (feedback_index % 8 <> 0), count(*) FILTER (feedback_index % 8 = 0), 0 FROM w
UNION ALL SELECT 'revoke', count(*), count(*) FILTER (feedback_index % 4 <> 0), count(*) FILTER (feedback_index % 4 = 0), count(*) FILTER (feedback_index % 4 = 1) FROM fb WHERE is_revoked""")
def integrity_of_all_kinds(spark, d):
    """Agents, feedback, revocations, and responses whose client comes from a payload before them or, without one, from the only feedback that they can mean."""
    fb, none = table(spark, d, "fb"), F.lit(None).cast("string")
    line = lambda df, phase, wallet, client, at, tx="id": df.select(at.cast("long").alias("line"), F.lit(phase).alias("phase"), "asset", wallet.alias("wallet"), client.alias("client"), F.col("feedback_index").cast("string").alias("feedback_index"), "seal_hash", F.col(tx).alias("tx_signature"))
    index = F.col("feedback_index")
    told = fb.where(index % 2 == 0).withColumns({"r": F.concat(F.lit("r"), index % 5), "w": F.concat(F.lit("w"), F.col("id"))})
    agents = table(spark, d, "ag").select("asset", F.lit("0").alias("feedback_index"), none.alias("seal_hash"), F.concat(F.lit("g"), "asset").alias("id"))
    log = line(fb, "feedback", F.col("client_address"), none, index)
    for more in (
        line(told.where(index % 3 == 0), "response_payload", F.col("r"), F.col("client_address"), index * 2), line(told, "response", F.col("r"), none, index * 2 + 1, "w"),
        line(fb.where("is_revoked"), "revoke", F.col("client_address"), none, index), line(agents, "agent", none, none, F.lit(0)),
    ):
        log = log.unionByName(more)
    actions, _ = reconcile.expected_actions(log)
    have = lambda df, tx: df.select("asset", F.col("client_address").alias("client"), F.col("feedback_index").cast("string").alias("feedback_index"), "seal_hash", tx.alias("tx_signature"))
    other = lambda when, tx="id": F.when(when, "other").otherwise(F.col(tx))
    tables = {
        "agent": table(spark, d, "ag").where("trust_tier > 0").select("asset", F.when(F.col("trust_tier") == 1, "other").otherwise(F.concat(F.lit("g"), "asset")).alias("tx_signature")),
        "feedback": have(fb.where("score IS NOT NULL"), other(F.col("score") < 10)), "revoke": have(fb.where(F.col("is_revoked") & (index % 4 != 0)), other(index % 4 == 1)),
        "response": have(told.where(index % 8 != 0), F.col("w")).withColumn("responder", F.concat(F.lit("r"), F.col("feedback_index").cast("long") % 5)),
    }
    return reconcile.integrity(actions, tables)


@query("""SELECT asset, CASE WHEN c % 3 = 0 THEN 'IPFS' WHEN c % 3 = 1 THEN 'ARWEAVE' ELSE 'HTTP' END AS kind, substr(sha256(nft_name), 1, 32) AS key_hash, CASE WHEN status = 'PENDING' THEN 'PENDING' ELSE status END AS response_status, CASE WHEN c % 2 = 0 THEN 'COMPLETED' ELSE 'PENDING' END AS request_status,
CASE WHEN c % 2 = 0 THEN 101 ELSE 103 END AS cluster, (1700000000 + c)::BIGINT AS at, CASE WHEN c % 4 = 0 THEN 1584316800 + (slot * 400) // 1000 ELSE 1600000000 + c END AS block_at, concat(asset, ',', slot) AS place
FROM (SELECT *, substr(asset, 2)::BIGINT AS c FROM ag)""")
def plain_values(spark, d):
    """Kinds of addresses, hashes of keys, statuses, clusters, times, and cursors there and back, of every agent."""
    c, whole = F.substring("asset", 2, 20).cast("long"), lambda x: x.cast("long").cast("string")
    rows = table(spark, d, "ag").withColumn("c", c)
    uri = F.concat(F.when(c % 3 == 0, "ipfs://").when(c % 3 == 1, "ar://").otherwise("https://"), "asset")
    text = F.when(c % 3 == 0, whole(1_700_000_000 + c)).when(c % 3 == 1, whole((1_700_000_000 + c) * 1000)).otherwise(F.date_format(F.timestamp_seconds(1_700_000_000 + c), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    block = scalar.block_time(F.when(c % 4 != 0, 1_600_000_000 + c), F.col("slot"), F.lit(1_700_000_000_000))
    seen = paging.decode_cursor(F.col("cursor"), "asset string, slot long")
    rows = rows.withColumn("cursor", paging.encode_cursor("asset", "slot")).select("*", seen.alias("seen"))
    return rows.select(
        "asset", scalar.uri_type(uri).alias("kind"), scalar.key_hash(F.col("nft_name")).alias("key_hash"), scalar.response_status(F.col("status")).alias("response_status"), scalar.request_status(F.when(c % 2 == 0, c)).alias("request_status"),
        scalar.cluster_id(F.when(c % 2 == 0, "mainnet").otherwise("devnet")).alias("cluster"), scalar.to_unix(scalar.timestamp_literal(text)).alias("at"), scalar.to_unix(block).alias("block_at"), F.concat_ws(",", "seen.asset", F.col("seen.slot").cast("string")).alias("place"),
    )


@query("SELECT id FROM rs WHERE block_slot IS NOT NULL AND block_slot >= (SELECT max(block_slot) FROM rs) - 500")
def waiting_still(spark, d):
    """Staged responses that haven't waited 500 slots."""
    rs = table(spark, d, "rs")
    last = rs.agg(F.max("block_slot")).first()[0]  # one number
    return fold.expire(rs, last or 0, 500 * 400, "block_slot").select("id")


@query("SELECT count(*) FILTER (feedback_index % 7 = 0 AND feedback_index % 11 <> 0) AS missing, count(*) FILTER (feedback_index % 7 <> 0 AND feedback_index % 11 = 0) AS extra, 0::BIGINT AS changed, FALSE AS ok FROM fb")
def coherent_copies(spark, d):
    fb = table(spark, d, "fb").select("id", "feedback_index", "score")
    return reconcile.coherent(fb.where("feedback_index % 7 <> 0"), fb.where("feedback_index % 11 <> 0"), ["id"], ["score"])


@query("SELECT asset, count(*) FILTER (NOT is_revoked) AS feedback_count, coalesce(round(avg(score) FILTER (NOT is_revoked)), 0)::BIGINT AS raw_avg_score FROM fb WHERE asset <> '' GROUP BY 1")
def feedback_effects(spark, d):
    """The counts of agents after their feedback was folded, without any reputation event."""
    fb = table(spark, d, "fb")
    fields = ["new_trust_tier", "new_quality_score", "new_confidence", "new_risk_score", "new_diversity_ratio"]
    none = fb.where("false").select("asset", F.lit(True).alias("atom_enabled"), F.lit(True).alias("had_impact"), *[F.lit(0).alias(c) for c in fields], F.lit(0).alias("slot"), F.lit(0).alias("tx_index"), F.lit(0).alias("event_ordinal"), F.lit("").alias("tx_signature"))
    return projections.feedback_effects(fb.select("asset").distinct(), fb, none, none).select("asset", "feedback_count", "raw_avg_score")


@query("SELECT tag FROM (SELECT tag1 AS tag FROM fb WHERE status <> 'ORPHANED' UNION SELECT tag2 FROM fb WHERE status <> 'ORPHANED') ORDER BY tag LIMIT 100")
def tags_in_use(spark, d):
    return rollups.distinct_tags(table(spark, d, "fb").where(scalar.active()), ["tag1", "tag2"], 100)
