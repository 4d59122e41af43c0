"""Services, registrations, wide records and collection documents on small inputs."""

import json

from pyspark.sql import functions as F

from tallyforge.operators import registrations as r


def test_services(spark):
    items = [
        {"name": "MCP", "endpoint": "https://a.b/c", "version": "v" * 30, "mcpTools": ["t", 5, "<b></b>", " u "]},
        {"name": "other", "type": "ENS", "endpoint": "Name.ETH"},
        {"name": "sns", "endpoint": "x.eth"},
        {"name": "wallet", "endpoint": "eip155:1:0x" + "a" * 40},
        {"name": "did", "endpoint": "did:web:a.b"},
        {"name": "oasf", "skills": ["a/b", "A b", 1], "domains": "no"},
        {"name": 7, "endpoint": "https://a.b/c"},
        "text",
        None,
    ]
    rows = spark.createDataFrame([(json.dumps(items),), ("{}",), ("bad",), (None,), (json.dumps(items[:1] * 30),)], "t string")
    got = [x[0] for x in rows.select(r.sanitize_services(F.col("t"))).collect()]
    assert [(s.name, s.endpoint) for s in got[0]] == [("mcp", "https://a.b/c"), ("ens", "name.eth"), ("wallet", "eip155:1:0x" + "a" * 40), ("did", "did:web:a.b"), ("oasf", None)]
    assert got[0][0].mcpTools == ["t", "u"] and got[0][0].version == "v" * 20 and got[0][1].type == "ens"
    assert got[0][4].skills == ["a/b"] and got[0][4].domains is None
    assert got[1:4] == [[], [], []] and len(got[4]) == 20


def test_registrations(spark):
    items = [{"agentId": i, "agentRegistry": "eip155:1:0xAb"} for i in (0, 12, -1, 1.5, 3.0, " 77 ", "x", True, None)] + [{"agentId": 1, "agentRegistry": "bad"}, 3]
    got = spark.createDataFrame([(json.dumps(items),), (None,)], "t string").select(r.sanitize_registrations(F.col("t"))).collect()
    assert [x.agentId for x in got[0][0]] == ["0", "12", "3", "77"] and got[1][0] == []


def test_registration_files(spark):
    services = json.dumps([{"name": " MCP ", "endpoint": "e1", "tools": ["t"]}, {"type": "a2a", "endpoint": "e2", "a2aSkills": ["s"], "skills": ["no"]}, {"name": "oasf", "skills": ["x"]}, {"name": "mcp", "endpoint": "later"}])
    rows = [("a", "_uri:name", "N"), ("a", "_uri:active", " TRUE "), ("a", "_uri:services", services), ("a", "_uri:domains", '["d"]'), ("a", "_uri:skills", '["old"]'), ("a", "_uri:supported_trust", '["t", 1]'), ("a", "own", "x")]
    rows += [("b", "_uri:active", "no"), ("b", "_uri:x402_support", "0"), ("b", "_uri:services", "bad"), ("b", "_uri:skills", ""), ("c", "own", "x")]
    got = {x.asset: x for x in r.registration_files(spark.createDataFrame(rows, "asset string, key string, value string")).collect()}
    a, b = got["a"], got["b"]
    assert (a.name, a.active, a.mcp_endpoint, a.mcp_tools, a.a2a_endpoint, a.a2a_skills) == ("N", True, "e1", ["t"], "e2", ["s"])
    assert (a.oasf_skills, a.oasf_domains, a.has_oasf, a.supported_trusts) == (["x"], ["d"], True, None)
    assert (b.active, b.x402_support, b.mcp_endpoint, b.oasf_skills, b.has_oasf) == (None, False, None, None, False) and "c" not in got


def test_collections(spark):
    body = json.dumps({"name": "n" * 200, "symbol": 5, "image": "https://a.b/i", "socials": {"x": "<b>h</b>", "website": "bad"}}).encode()
    docs = spark.createDataFrame([("c1:Qm1", body), ("Qm1", body), ("c1:Qm1/x", b"{"), ("c1:Q", None), ("c1:Q", b"1" * 900), ("c1:Q", b"null"), ("c1:Q", b"[]"), (None, b"{}")], "pointer string, body binary")
    got = r.digest_collections(docs, 800).collect()
    assert [x.doc_status for x in got] == ["ok", "error", "invalid_json", "error", "oversize", "error", "ok", "error"]
    assert (got[0].name, got[0].symbol, got[0].image, got[0].socials_x, got[0].socials_website) == ("n" * 128, None, "https://a.b/i", "h", None)
    assert got[1].name is None and got[4].sha256 is None and got[4].bytes == 900
    agents = spark.createDataFrame([(i, p, None, o) for i, p, o in [(1, "p", "o"), (2, "q", "o"), (3, "r", "o"), (4, "", "o"), (5, None, "o"), (6, "s", "o"), (7, "p", "z"), (8, "t", "o")]], "asset long, canonical_col string, creator string, owner string")
    pointers = spark.createDataFrame([("p", "o", "ok", 2, 2), ("q", "o", "error", 2, 2), ("r", "o", "ok", 1, 2), ("s", "o", "ok", None, 2), ("t", "o", "ok", 1, None)], "col string, creator string, metadata_status string, metadata_updated_at int, last_seen_at int")
    assert sorted(x.asset for x in r.collections_to_refresh(agents, pointers).collect()) == [2, 3, 6, 7]


def test_fetch_url(spark):
    rows = spark.createDataFrame([("ipfs://Q/a",), ("/ipfs/Q",), ("ar://x",), ("https://a",), ("http://a",), ("ftp://a",), (None,)], "u string")
    got = [x[0] for x in rows.select(r.fetch_url(F.col("u"), "https://g/")).collect()]
    assert got == ["https://g/ipfs/Q/a", "https://g/ipfs/Q", "https://arweave.net/x", "https://a", None, None, None]
    assert rows.select(r.fetch_url(F.col("u"), insecure=True)).collect()[4][0] == "http://a"
