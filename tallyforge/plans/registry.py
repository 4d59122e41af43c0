"""Queries of the ledger operators over the given tables, and their SQL.

Stand-ins: a customer is an agent, an order its feedback, a lineitem a response,
a nation a collection, the events table a stream in order of event_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashes, scalar
from ..operators import chain, events, fold, ids, lifecycle, paging, projections, proofs, reconcile, registrations, rollups, tree
from ..sources.tables import load
from . import entities, folding

STATUS = {"P": "PENDING", "F": "FINALIZED", "O": "ORPHANED"}
_STATUS_SQL = "CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'FINALIZED' ELSE 'ORPHANED' END"


def agents(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    tier = F.greatest(F.lit(0), F.least(F.lit(4), F.floor(F.col("c_acctbal") / 2000))).cast("int")
    quality, confidence = (F.col("c_custkey") * 37 % 10_001).cast("long"), (F.col("c_custkey") * 91 % 10_001).cast("long")
    key = scalar.sort_key(tier, quality, confidence, F.col("c_custkey") % 10_000_000)
    return c.select(F.col("c_custkey").alias("asset"), F.col("c_nationkey").alias("collection"), tier.alias("trust_tier"), quality.alias("quality"), key.alias("sort_key"), F.col("c_name").alias("name"))


def feedbacks(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "F", "FINALIZED").otherwise("ORPHANED")
    score = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 101)
    return o.select(F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tag1"), score.alias("score"), status.alias("status"), (F.col("o_orderkey") % 7 == 0).alias("is_revoked"), "o_totalprice", "o_orderdate")


_A = """a AS (SELECT c_custkey AS asset, c_nationkey AS collection, greatest(0, least(4, floor(c_acctbal / 2000)))::INTEGER AS trust_tier, (c_custkey * 37 % 10001)::BIGINT AS quality,
  (greatest(0, least(4, floor(c_acctbal / 2000)))::BIGINT * 1000200010000000 + (c_custkey * 37 % 10001) * 100010000000 + (c_custkey * 91 % 10001) * 10000000 + c_custkey % 10000000)::BIGINT AS sort_key, c_name AS name FROM customer)"""
_F = f"""f AS (SELECT o_custkey AS asset, o_orderkey AS id, o_orderpriority AS tag1, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 101 END AS score, {_STATUS_SQL} AS status, o_orderkey % 7 = 0 AS is_revoked, o_totalprice, o_orderdate FROM orders)"""
_REP = """r AS (SELECT a.*, coalesce(s.n, 0)::BIGINT AS n, s.avg_score, coalesce(s.positive, 0)::BIGINT AS positive, coalesce(s.negative, 0)::BIGINT AS negative FROM a LEFT JOIN
  (SELECT asset, count(*) AS n, round(avg(score))::BIGINT AS avg_score, count(*) FILTER (score >= 50) AS positive, count(*) FILTER (score < 50) AS negative FROM f
   WHERE status <> 'ORPHANED' AND NOT is_revoked AND score IS NOT NULL GROUP BY asset) s USING (asset))"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {_A}, {_F}, {_REP} SELECT * FROM r WHERE trust_tier >= 2 ORDER BY sort_key DESC, asset LIMIT 100")
def leaderboard_reputation(spark, d):
    return rollups.leaderboard_reputation(agents(spark, d), feedbacks(spark, d), 100)


@query(f"WITH {_A}, {_F}, {_REP} SELECT * FROM r")
def agent_reputation(spark, d):
    return rollups.reputation(agents(spark, d), feedbacks(spark, d))


@query(f"WITH {_F} SELECT asset, count(*) FILTER (NOT is_revoked) AS feedback_count, coalesce(round(avg(score) FILTER (NOT is_revoked)), 0)::BIGINT AS raw_avg_score FROM f GROUP BY asset")
def feedback_rollup(spark, d):
    return rollups.feedback_rollup(feedbacks(spark, d), ["asset"])


@query(f"WITH {_A}, {_F} SELECT (SELECT count(*) FROM a) AS agents_total, (SELECT count(*) FILTER (trust_tier = 4) FROM a) AS agents_tier4, (SELECT count(*) FILTER (trust_tier = 3) FROM a) AS agents_tier3, (SELECT count(*) FROM f WHERE status <> 'ORPHANED') AS feedbacks_total")
def global_stats(spark, d):
    a, f = agents(spark, d), feedbacks(spark, d).where(scalar.active())
    return rollups.totals(agents=(a, {"total": F.count("*"), "tier4": F.count_if(F.col("trust_tier") == 4), "tier3": F.count_if(F.col("trust_tier") == 3)}), feedbacks=(f, {"total": F.count("*")}))


@query(f"""WITH {_F}, s AS (SELECT 'feedbacks' AS model, status FROM f UNION ALL SELECT 'responses', CASE l_linestatus WHEN 'O' THEN 'PENDING' ELSE 'FINALIZED' END FROM lineitem)
SELECT model, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'FINALIZED') AS finalized, count(*) FILTER (status = 'ORPHANED') AS orphaned FROM s GROUP BY model""")
def verification_stats(spark, d):
    responses = load(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "O", "PENDING").otherwise("FINALIZED").alias("status"))
    return rollups.status_counts(feedbacks=feedbacks(spark, d), responses=responses)


@query("SELECT tag FROM (SELECT o_orderpriority AS tag FROM orders UNION SELECT o_orderstatus FROM orders) WHERE tag <> '' ORDER BY tag LIMIT 100")
def distinct_tags(spark, d):
    return rollups.distinct_tags(load(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], 100)


@query(f"""WITH {_A}, {_F} SELECT n_nationkey AS collection, n_name, coalesce(x.c, 0)::BIGINT AS agent_count, coalesce(y.c, 0)::BIGINT AS total_feedbacks, y.s AS avg_score FROM nation
LEFT JOIN (SELECT collection, count(*) AS c FROM a GROUP BY 1) x ON x.collection = n_nationkey LEFT JOIN (SELECT collection, count(*) AS c, round(avg(score))::BIGINT AS s FROM f JOIN a USING (asset) GROUP BY 1) y ON y.collection = n_nationkey""")
def collection_stats(spark, d):
    c = load(spark, d, "nation").select(F.col("n_nationkey").alias("collection"), "n_name")
    return rollups.collection_stats(c, agents(spark, d), feedbacks(spark, d))


@query(f"WITH {_F} SELECT asset, id, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY o_totalprice DESC, id) AS rn FROM f) WHERE rn > 1 AND rn <= 4")
def page_per_group(spark, d):
    return paging.page_per_group(feedbacks(spark, d), ["asset"], [F.desc("o_totalprice"), F.col("id")], 3, 1).select("asset", "id", "rn")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_with_total(spark, d):
    return paging.page_with_total(load(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 50, 100)


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build') ORDER BY c_custkey LIMIT 250")
def agent_search(spark, d):
    return paging.search(load(spark, d, "customer"), ["c_name", "c_mktsegment"], "BUILD", [F.col("c_custkey")], 250).select("c_custkey", "c_name")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_min(event_type, (ts, event_id)) AS first_type, max(event_id) FILTER (event_type = (SELECT min(event_type) FROM events)) AS last_of_kind FROM events GROUP BY user_id""")
def fold_events(spark, d):
    e = load(spark, d, "events")
    order = F.struct("ts", "event_id")
    kind = e.agg(F.min("event_type").alias("kind"))
    e = e.join(F.broadcast(kind))  # one row
    of_kind = F.max(F.when(F.col("event_type") == F.col("kind"), F.col("event_id"))).alias("last_of_kind")
    return e.groupBy("user_id").agg(F.max_by("event_type", order).alias("last_type"), F.min_by("event_type", order).alias("first_type"), of_kind)


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, min(l_shipdate) AS s FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, min(l_shipdate) AS s FROM lineitem WHERE l_partkey % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(t.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(t.l_linenumber, b.l_linenumber) AS l_linenumber, CASE WHEN b.l_orderkey IS NOT NULL THEN b.q ELSE t.q END AS q, epoch(CASE WHEN t.l_orderkey IS NOT NULL THEN t.s ELSE b.s END)::BIGINT AS s FROM t FULL JOIN b ON t.l_orderkey = b.l_orderkey AND t.l_linenumber = b.l_linenumber""")
def merge_policies(spark, d):
    rows = load(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    half = lambda k: rows.where(F.col("l_partkey") % 2 == k).groupBy(*keys).agg(F.max("l_quantity").alias("q"), F.min("l_shipdate").alias("s"))
    return fold.merge(half(0), half(1), keys, {"q": "overwrite", "s": "keep"}).withColumn("s", scalar.to_unix(F.col("s").cast("timestamp")))


@query("SELECT l_orderkey, count(*) AS staged FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def stage_orphans(spark, d):
    parents = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return fold.stage(load(spark, d, "lineitem"), parents, ["l_orderkey"])[1].groupBy("l_orderkey").agg(F.count("*").alias("staged"))


@query("SELECT l_orderkey, count(*) AS promoted FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def promote_orphans(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    staged = fold.stage(load(spark, d, "lineitem"), o.where("o_orderstatus = 'F'"), ["l_orderkey"])[1]
    return fold.promote(staged, o.where("o_orderstatus = 'O'"), ["l_orderkey"])[0].groupBy("l_orderkey").agg(F.count("*").alias("promoted"))


@query(f"WITH {_F} SELECT asset, id, CASE WHEN status <> 'ORPHANED' THEN row_number() OVER (PARTITION BY asset, status <> 'ORPHANED' ORDER BY o_orderdate, id) END::BIGINT AS feedback_id FROM f")
def scoped_ids(spark, d):
    rows = feedbacks(spark, d).withColumn("feedback_id", F.lit(None).cast("long"))
    return ids.assign_ids(rows, ["asset"], [F.col("o_orderdate"), F.col("id")], "feedback_id", scalar.active()).select("asset", "id", "feedback_id")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey)::BIGINT AS agent_id FROM customer")
def global_ids(spark, d):
    return ids.assign_global_ids(load(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey", "c_custkey"], "agent_id").select("c_custkey", "agent_id")


@query("SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(DISTINCT l_linenumber) AS kinds FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)")
def audit_gapless(spark, d):
    return ids.audit_gapless(load(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


_TREE = "n AS (SELECT c_custkey AS node, CASE WHEN c_custkey >= 7 THEN c_custkey // 7 END AS parent FROM customer)"


def _nodes(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") >= 7, F.floor(F.col("c_custkey") / 7)).alias("parent"))


@query(f"WITH RECURSIVE {_TREE}, t AS (SELECT node AS root, node, 0 AS depth, node::VARCHAR AS path FROM n WHERE parent IS NULL UNION ALL SELECT t.root, n.node, depth + 1, path || ':' || n.node FROM t JOIN n ON n.parent = t.node WHERE depth < 8) SELECT * FROM t")
def tree_forest(spark, d):
    return tree.forest(_nodes(spark, d)).withColumn("path", F.concat_ws(":", F.col("path").cast("array<string>")))


@query(f"WITH RECURSIVE {_TREE}, t AS (SELECT node AS root, node, 0 AS depth FROM n UNION ALL SELECT t.root, n.parent, depth + 1 FROM t JOIN n ON n.node = t.node WHERE n.parent IS NOT NULL AND depth < 32) SELECT * FROM t")
def tree_lineage_all(spark, d):
    nodes = _nodes(spark, d)
    return tree.lineage(nodes.select("node"), nodes)


@query("SELECT user_id, event_id, missing FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id - 1 AS missing FROM events) WHERE missing > 0")
def chain_gaps(spark, d):
    return chain.gaps(load(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("""WITH h AS (SELECT user_id, count(*) AS count, sha256(max(event_type)) AS digest FROM events GROUP BY 1), a AS (SELECT user_id, count(*) + (user_id % 3) - 1 AS auth_count, sha256(CASE WHEN user_id % 4 = 0 THEN 'x' ELSE max(event_type) END) AS auth_digest FROM events WHERE user_id % 5 <> 0 GROUP BY 1)
SELECT user_id, CASE WHEN auth_count IS NULL THEN 'keep' WHEN count < auth_count THEN 'behind' WHEN count > auth_count THEN 'exceeds' WHEN digest = auth_digest THEN 'ok' ELSE 'mismatch' END AS verdict FROM h LEFT JOIN a USING (user_id)""")
def compare_heads(spark, d):
    e = load(spark, d, "events")
    ours = e.groupBy("user_id").agg(F.count("*").alias("count"), F.sha2(F.max("event_type"), 256).alias("digest"))
    last = F.when(F.col("user_id") % 4 == 0, "x").otherwise(F.max("event_type"))
    authority = e.where("user_id % 5 <> 0").groupBy("user_id").agg((F.count("*") + F.col("user_id") % 3 - 1).alias("auth_count"), F.sha2(last, 256).alias("auth_digest"))
    return chain.compare_heads(ours, authority, ["user_id"]).select("user_id", "verdict")


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_custkey % 10 < 6 THEN 'FINALIZED' WHEN o_orderstatus = 'P' AND o_custkey % 10 < 9 THEN 'ORPHANED' ELSE {_STATUS_SQL} END AS status FROM orders")
def verify_existence(spark, d):
    known = load(spark, d, "customer").select(F.col("c_custkey").alias("asset"), F.when(F.col("c_custkey") % 10 < 9, F.col("c_custkey") % 10 < 6).alias("exists"))
    return lifecycle.verify_existence(feedbacks(spark, d), known, "asset").select(F.col("id").alias("o_orderkey"), "status")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 11 = 0 THEN 'extra' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0 OR o_orderkey % 7 <> 0 AND (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0)")
def compare_copies(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    left = o.where("o_orderkey % 7 <> 0")
    right = o.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, -1.0).otherwise(F.col("o_totalprice")))
    return reconcile.compare(left, right, ["o_orderkey"], ["o_totalprice"])


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS known FROM customer")
def multi_get(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return reconcile.with_flag(load(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], "known")


@query("SELECT count(*) FILTER (NOT l_quantity BETWEEN 1 AND 40) AS quantity, count(*) FILTER (NOT l_discount <= 0.05) AS discount FROM lineitem")
def range_violations(spark, d):
    return load(spark, d, "lineitem").agg(*scalar.violations({"quantity": F.col("l_quantity").between(1, 40), "discount": F.col("l_discount") <= 0.05}))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey >= 100 AND o_custkey < 500")
def filtered(spark, d):
    return load(spark, d, "orders").where(scalar.where(o_orderstatus_in=["F", "P"], o_orderkey_gte=100, o_custkey_lt=500, o_orderpriority=None)).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, '#' || lpad(o_orderkey::VARCHAR, CASE WHEN o_orderkey < 1000 THEN 3 WHEN o_orderkey < 10000 THEN 4 WHEN o_orderkey < 100000 THEN 5 ELSE greatest(6, length(o_orderkey::VARCHAR)) END::INTEGER, '0') AS label, rtrim(rtrim(format('{}.{:03d}', o_orderkey // 1000, o_orderkey % 1000), '0'), '.') AS value FROM orders")
def value_texts(spark, d):
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", scalar.format_id(k).alias("label"), scalar.normalize_value(k.cast("string"), F.lit(3)).alias("value"))


@query("SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def pivot_keys(spark, d):
    return rollups.pivot_keys(load(spark, d, "events"), "user_id", "event_type", F.col("value"), ["click", "view"])


def _raw(spark, d) -> DataFrame:
    """Customers register, orders are their feedback, returned lineitems revoke it, as raw events."""
    place = {"tx_index": F.lit(0), "event_ordinal": F.lit(None).cast("int")}
    text = lambda c: F.col(c).cast("string")
    digest = lambda *c: F.sha2(F.concat_ws(":", *c), 256)
    c = load(spark, d, "customer").select(F.lit("AgentRegistered").alias("name"), F.to_json(F.struct(text("c_custkey").alias("asset"), text("c_nationkey").alias("collection"), F.col("c_name").alias("owner"), F.col("c_mktsegment").alias("agentUri"))).alias("data"), F.concat(F.lit("c"), "c_custkey").alias("tx_signature"), F.lit(0).cast("long").alias("slot"))
    o = load(spark, d, "orders").select(F.lit("UriUpdated").alias("name"), F.to_json(F.struct(text("o_custkey").alias("asset"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).otherwise("").alias("newUri"), F.col("o_orderstatus").alias("updatedBy"))).alias("data"), F.concat(F.lit("o"), "o_orderkey").alias("tx_signature"), F.col("o_orderkey").alias("slot"))
    v = load(spark, d, "lineitem").select(F.lit("ValidationRequested").alias("name"), F.to_json(F.struct(text("l_orderkey").alias("asset"), text("l_suppkey").alias("validatorAddress"), F.when(F.col("l_linenumber") != 6, text("l_linenumber")).alias("nonce"), digest("l_orderkey", "l_linenumber").alias("requestHash"), F.col("l_returnflag").alias("requester"))).alias("data"), F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber").alias("tx_signature"), F.col("l_orderkey").alias("slot"))
    rows = c.unionByName(o).unionByName(v)
    return rows.select("*", *[v.alias(k) for k, v in place.items()])


@query("SELECT l_returnflag AS requester, l_linenumber <> 6 AS ok, count(*) AS n, sum(CASE WHEN l_linenumber <> 6 THEN l_linenumber END)::BIGINT AS nonces, max(sha256(l_orderkey || ':' || l_linenumber)) AS top FROM lineitem GROUP BY 1, 2")
def typed_events(spark, d):
    rows = events.typed(_raw(spark, d), "ValidationRequested")
    return rows.groupBy("requester", "ok").agg(F.count("*").alias("n"), F.sum("nonce").cast("long").alias("nonces"), F.lower(F.hex(F.max("request_hash"))).alias("top"))


@query("""SELECT c_custkey::VARCHAR AS asset, c_name AS owner, c_nationkey::VARCHAR AS collection, CASE WHEN o.asset IS NULL THEN nullif(c_mktsegment, '') ELSE nullif(o.uri, '') END AS uri
FROM customer LEFT JOIN (SELECT o_custkey AS asset, arg_max(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE '' END, o_orderkey) AS uri FROM orders GROUP BY 1) o ON asset = c_custkey""")
def project_agents(spark, d):
    raw = _raw(spark, d)
    of = lambda kind: events.typed(raw, kind).where("ok")
    none = lambda kind: of(kind).where("false")  # noqa: E731  # kinds that the tables don't hold
    got = projections.agents(of("AgentRegistered"), none("AgentOwnerSynced"), none("AtomEnabled"), of("UriUpdated"), none("WalletUpdated"), none("WalletResetOnOwnerSync"), none("ParentAssetSet"))
    return got.select("asset", "owner", "collection", "uri")


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem WHERE l_linenumber <> 6), t AS (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber, TRUE AS told FROM lineitem WHERE l_linestatus = 'F')
SELECT CASE WHEN told THEN 'RESPONDED' ELSE 'PENDING' END AS status, count(*) AS n FROM r FULL JOIN t USING (l_orderkey, l_suppkey, l_linenumber) GROUP BY 1""")
def project_validations(spark, d):
    place = [F.lit(0).alias("tx_index"), F.lit(0).alias("event_ordinal"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tx_signature"), F.col("l_orderkey").alias("slot")]
    key = [F.col("l_orderkey").cast("string").alias("asset"), F.col("l_suppkey").cast("string").alias("validator_address"), F.col("l_linenumber").cast("decimal(20,0)").alias("nonce")]
    told = load(spark, d, "lineitem").where("l_linestatus = 'F'").select(*key, *place, F.col("l_tax").alias("response"), F.lit("").alias("response_uri"), F.lit("").alias("response_hash"), F.col("l_returnflag").alias("tag"))
    return projections.validations(events.typed(_raw(spark, d), "ValidationRequested").where("ok"), told).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_F}, p AS (SELECT asset, tag1, min(id) AS first_seen, max(id) AS last_seen FROM f GROUP BY 1, 2), h AS (SELECT asset, arg_max(tag1, id) AS tag1 FROM f GROUP BY 1) SELECT p.tag1 AS col, (p.asset % 50)::VARCHAR AS creator, min(first_seen) AS first_seen_slot, max(last_seen) AS last_seen_slot, count(h.asset) AS asset_count FROM p LEFT JOIN h USING (asset, tag1) GROUP BY 1, 2")
def project_pointers(spark, d):
    f = feedbacks(spark, d).select("asset", F.col("tag1").alias("col"), F.lit(None).cast("boolean").alias("lock"), F.col("id").alias("slot"), F.lit(0).alias("tx_index"), F.lit(0).alias("event_ordinal"), F.lit("").alias("tx_signature"))
    known = load(spark, d, "customer").select(F.col("c_custkey").alias("asset"), F.lit(None).cast("string").alias("creator"), (F.col("c_custkey") % 50).cast("string").alias("owner"))
    return projections.pointers(known, f)[1]


@query("""WITH l AS (SELECT user_id, event_id, event_type = (SELECT min(event_type) FROM events) AS gone, event_id % 13 = 0 AS fixed FROM events), c AS (SELECT user_id, max(event_id) FILTER (gone) AS cut FROM l GROUP BY 1),
v AS (SELECT l.* FROM l JOIN c USING (user_id) WHERE NOT gone AND (cut IS NULL OR event_id > cut)), s AS (SELECT user_id, min(event_id) FILTER (fixed) AS stop FROM v GROUP BY 1)
SELECT user_id, max(event_id) AS value, bool_or(fixed) AS immutable FROM v JOIN s USING (user_id) WHERE stop IS NULL OR event_id <= stop GROUP BY 1""")
def metadata_state(spark, d):
    e = load(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("kind"))  # one row
    ops = e.join(F.broadcast(kind)).select("user_id", "event_id", F.when(F.col("event_type") == F.col("kind"), "delete").otherwise("set").alias("op"), F.col("event_id").alias("value"), (F.col("event_id") % 13 == 0).alias("immutable"))
    return fold.metadata_state(ops, ["user_id"], F.col("event_id"))


@query("SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS event_ordinal FROM orders")
def event_ordinals(spark, d):
    tx = load(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("events"))
    return events.with_ordinal(tx).select(F.col("event").alias("o_orderkey"), "o_custkey", "event_ordinal")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS n FROM lineitem WHERE l_linestatus = 'O'), h AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS n FROM lineitem WHERE l_quantity > 20 AND l_linestatus = 'O')
SELECT coalesce(CASE WHEN e.l_suppkey % 3 = 0 THEN FALSE END, h.l_tax > 0.04) AS lock, count(*) AS n FROM e LEFT JOIN h USING (l_orderkey, l_returnflag, n) GROUP BY 1""")
def lock_hints(spark, d):
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax")  # the SQL's order, and what it leaves open by all that a row says
    rows = load(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("tx_signature"), F.col("l_returnflag").alias("kind"), place.alias("event_ordinal"), F.when(F.col("l_suppkey") % 3 == 0, False).alias("lock"), "l_quantity", "l_tax")
    hints = rows.where("l_quantity > 20").select("tx_signature", "kind", F.col("event_ordinal").alias("position"), (F.col("l_tax") > 0.04).alias("lock"))
    return events.with_lock_hints(rows, hints).groupBy("lock").agg(F.count("*").alias("n"))


@query("""SELECT program, sum(n)::BIGINT AS n FROM (SELECT 'P' || o_custkey % 7 AS program, 3 AS n FROM orders UNION ALL SELECT 'Q' || o_orderkey % 5, 3 FROM orders UNION ALL SELECT NULL, 1 FROM orders) GROUP BY 1""")
def log_frames(spark, d):
    p, q = F.concat(F.lit("Program P"), F.col("o_custkey") % 7), F.concat(F.lit("Program Q"), F.col("o_orderkey") % 5)
    end = F.when(F.col("o_orderkey") % 2 == 0, " success").otherwise(" failed: x")
    logs = F.array(F.lit("before"), F.concat(p, F.lit(" invoke [1]")), F.concat(q, F.lit(" invoke [2]")), F.lit("Program log: x"), F.concat(q, end), F.lit("Program data: y"), F.concat(p, F.lit(" success")))
    return events.attribute_frames(load(spark, d, "orders").select("o_orderkey", logs.alias("logs"))).groupBy("program").agg(F.count("*").alias("n"))


@query("SELECT o_custkey % 10 AS g, count(*) FILTER (o_orderstatus = 'F') AS proved, count(*) AS n FROM orders GROUP BY 1")
def proof_flag(spark, d):
    keyed = load(spark, d, "orders").select("o_orderstatus", "o_custkey", F.concat(F.lit("t"), "o_orderkey").alias("tx_signature"), F.col("o_custkey").alias("asset"), F.lit("c").alias("client_address"), F.col("o_orderkey").alias("feedback_index"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"))
    got = proofs.flag(keyed, keyed.where("o_orderstatus = 'F'"))
    return got.groupBy((F.col("o_custkey") % 10).alias("g")).agg(F.count_if("proved").alias("proved"), F.count("*").alias("n"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS back FROM documents")
def base58_round_trip(spark, d):
    """The digests of texts as base58 and back."""
    raw = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return load(spark, d, "documents").select("doc_id", F.lower(F.hex(hashes.from_base58(hashes.base58(raw)))).alias("back"))


@query()
def keccak_leaves(spark, d):
    """The hash of each feedback's leaf; tests hold the hash against known digests."""
    of = lambda c: F.unhex(F.sha2(F.col(c).cast("string"), 256))
    data = hashes.leaf("feedback", of("o_custkey"), of("o_orderpriority"), F.col("o_orderkey"), of("o_orderkey"), F.col("o_orderkey"))
    return load(spark, d, "orders").select("o_orderkey", F.lower(F.hex(hashes.keccak256(data))).alias("leaf"))


@query("""WITH k AS (SELECT o_custkey, ['mcp', 'a2a', 'ens', 'sns', 'wallet', 'other', 'oasf'][o_orderkey % 7 + 1] AS kind, o_orderkey % 7 AS n, o_orderkey % 3 AS form FROM orders)
SELECT kind, count(*) AS n FROM k WHERE n <> 5 AND ((form = 0 AND n IN (0, 1, 6)) OR (form = 1 AND n IN (2, 3)) OR (form = 2 AND n = 4)) GROUP BY 1""")
def service_kinds(spark, d):
    """The kinds of the valid services; each order states one, in one of three forms of endpoint."""
    key = F.col("o_orderkey")
    kind = F.get(F.array(*[F.lit(k) for k in ("MCP", "a2a", "ens", "sns", "wallet", "other", "oasf")]), (key % 7).cast("int"))
    end = F.when(key % 3 == 0, F.concat(F.lit("https://a.b/"), key)).when(key % 3 == 1, F.concat(F.lit("n"), key, F.lit(".sol"))).otherwise(F.concat(F.lit("eip155:1:0x"), F.lpad(key.cast("string"), 40, "0")))
    made = F.to_json(F.array(F.struct(kind.alias("name"), end.alias("endpoint"))))
    rows = load(spark, d, "orders").select(F.explode(registrations.sanitize_services(made)).alias("s"))
    return rows.groupBy(F.col("s.name").alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS asset, c_name AS name, c_custkey % 2 = 0 AS active, CASE WHEN c_custkey % 3 = 0 THEN 'https://m/' || c_custkey END AS mcp_endpoint,
CASE WHEN c_custkey % 3 = 1 THEN 'own' || c_nationkey WHEN c_custkey % 5 <> 0 THEN 'old' END AS skill, c_custkey % 3 = 1 OR c_custkey % 5 <> 0 AS has_oasf FROM customer""")
def registration_files(spark, d):
    key = F.col("c_custkey")
    service = F.when(key % 3 == 0, F.concat(F.lit('[{"name":"MCP","endpoint":"https://m/'), key, F.lit('"}]'))).when(key % 3 == 1, F.concat(F.lit('[{"type":"oasf","skills":["own'), "c_nationkey", F.lit('"]}]')))
    fields = {"_uri:name": F.col("c_name"), "_uri:active": F.when(key % 2 == 0, "1").otherwise("False"), "_uri:services": service, "_uri:skills": F.when(key % 5 != 0, '["old"]')}
    entries = F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*fields.values()))
    rows = load(spark, d, "customer").select(key.alias("asset"), F.explode(entries).alias("key", "value")).where("value IS NOT NULL")
    return registrations.registration_files(rows).select("asset", "name", "active", "mcp_endpoint", F.get("oasf_skills", F.lit(0)).alias("skill"), "has_oasf")


@query("""SELECT o_orderkey AS asset, 'c1:' || o_custkey AS canonical_col FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 <> 0
WHERE c_custkey IS NULL OR c_custkey % 4 = 1 OR c_acctbal < 1000""")
def collections_to_refresh(spark, d):
    agents = load(spark, d, "orders").select(F.col("o_orderkey").alias("asset"), F.concat(F.lit("c1:"), "o_custkey").alias("canonical_col"), F.lit(None).cast("string").alias("creator"), F.lit("o").alias("owner"))
    key = F.col("c_custkey")
    status = F.when(key % 4 == 1, "error").otherwise("ok")
    pointers = load(spark, d, "customer").where(key % 4 != 0).select(F.concat(F.lit("c1:"), key).alias("col"), F.lit("o").alias("creator"), status.alias("metadata_status"), F.col("c_acctbal").alias("metadata_updated_at"), F.lit(1000).alias("last_seen_at"))
    return registrations.collections_to_refresh(agents, pointers)


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://ipfs.io/ipfs/' || url WHEN page_id % 3 = 1 THEN 'https://arweave.net/' || url WHEN url LIKE 'https://%' THEN url END AS fetched FROM pages")
def fetch_urls(spark, d):
    uri = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("ipfs://"), "url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("ar://"), "url")).otherwise(F.col("url"))
    return load(spark, d, "pages").select("page_id", registrations.fetch_url(uri).alias("fetched"))


def queries() -> dict:
    return QUERIES | entities.QUERIES | folding.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | entities.SQL | folding.SQL
