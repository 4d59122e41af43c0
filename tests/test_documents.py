"""Documents and metadata values on small inputs."""

from pyspark.sql import functions as F

from tallyforge.operators import documents


def test_clean(spark):
    rows = spark.createDataFrame([("  <b>Hi\x01</b> ", "https://a.b/c"), ("<i></i>", "javascript:alert(1)"), (None, None)], "t string, u string")
    got = [tuple(r) for r in rows.select(documents.clean_text(F.col("t")), documents.clean_url(F.col("u"))).collect()]
    assert got == [("Hi", "https://a.b/c"), (None, None), (None, None)]


def test_documents_become_metadata(spark):
    docs = spark.createDataFrame([("a", "u1", b'{"name": "N", "description": "dddddddddd", "image": ""}'), ("b", "old", b'{"name": "M"}'), ("c", "u3", b"[1]"), ("d", "u4", None), ("e", "u5", b"x" * 200)], "asset string, uri string, body binary")
    agents = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "u3"), ("d", "u4"), ("e", "u5"), ("f", "")], "asset string, uri string")
    digested = documents.digest(docs, 100)
    assert {r.asset: r.doc_status for r in digested.collect()} == {"a": "ok", "b": "ok", "c": "invalid_json", "d": "error", "e": "oversize"}
    meta = documents.to_metadata(digested, agents, 5)
    assert {r.key for r in meta.where("asset = 'a'").collect()} == {"_uri:name", "_uri:description_meta", "_uri:_source", "_uri:_status"}
    assert meta.where("asset = 'b'").count() == 0
    assert sorted(r.asset for r in documents.to_refresh(agents, meta).collect()) == ["b", "d"]
    old = spark.createDataFrame([("a", "_uri:name", "fixed", True), ("a", "_uri:gone", "x", False), ("a", "own", "y", False), ("z", "_uri:k", "z", False)], "asset string, key string, value string, immutable boolean")
    got = {(r.asset, r.key): r.value for r in documents.replace_metadata(old, meta.where("asset = 'a'")).collect()}
    assert got[("a", "_uri:name")] == "fixed" and ("a", "_uri:gone") not in got and got[("a", "own")] == "y" and got[("z", "_uri:k")] == "z"


def test_values_come_back(spark):
    rows = spark.createDataFrame([(b"",), (b"short",), (b"long" * 500,), (None,)], "v binary")
    got = rows.select("v", documents.encode_value("v").alias("e")).select("v", "e", documents.decode_value("e").alias("d")).collect()
    assert all(r.v == r.d for r in got) and len(got[2].e) < 100
    odd = spark.createDataFrame([(b"legacy",), (b"\1damaged",), (b"",)], "v binary").select(documents.decode_value("v")).collect()
    assert [r[0] for r in odd] == [b"legacy", None, b""]
    import zstandard

    bomb = spark.createDataFrame([(b"\1" + zstandard.ZstdCompressor().compress(bytes(documents.EXPANDED + 1)),)], "v binary")
    assert bomb.select(documents.decode_value("v")).first()[0] is None


def test_plain_keys_stay_plain(spark):
    rows = spark.createDataFrame([("_uri:name", b"x" * 900), ("own", b"x" * 900), ("own2", b"y"), ("_uri:image", None)], "key string, value binary")
    got = {r["key"]: r["value"] and bytes(r["value"]) for r in documents.encode_values(rows).collect()}
    assert got["_uri:name"] == b"\0" + b"x" * 900 and got["own"][:1] == b"\1" and len(got["own"]) < 100 and got["own2"] == b"\0y" and got["_uri:image"] is None


def test_urls(spark):
    good = ["http://a.b", "https://a.b/c?d=e#f", "ipfs://Qm1/x.json", "ar://a_-9/y", " https://a.b "]
    bad = ["javascript:x", "ipfs://", "ipfs://a-b", "ar://a.b", "https://", "ftp://a.b", "data:text/html,x", "https://a b", ""]
    got = {r["u"]: r["c"] for r in spark.createDataFrame([(u,) for u in good + bad], "u string").select("u", documents.clean_url(F.col("u")).alias("c")).collect()}
    assert [got[u] for u in good] == [u.strip() for u in good] and [got[u] for u in bad] == [None] * len(bad)


def test_documents_in_full(spark):
    body = '{"name":"<i>N</i>","supportedTrust":["OASF","x402","other"],"active":true,"x402Support":"yes","image":"javascript:x","extra":{"a":1},"more":"<b>t</b>","none":""}'
    docs = spark.createDataFrame([("a", body.encode(), "ok"), ("b", body.encode(), "blocked"), ("c", None, "timeout"), ("d", b"{}", None)], "asset string, body binary, fetch string")
    got = {r["asset"]: r for r in documents.read_documents(docs, 10_000, full=True, fetched="fetch").collect()}
    assert got["a"]["fields"] == {"name": "N", "supported_trust": '["oasf","x402"]', "active": "true", "extra": '{"a":1}', "more": "t"}
    assert [got[k]["doc_status"] for k in "abcd"] == ["ok", "blocked", "timeout", "ok"] and got["b"]["fields"] is None and got["d"]["fields"] == {}
    plain = {r["asset"]: r for r in documents.read_documents(docs, 10_000).collect()}
    assert plain["a"]["fields"] == {"name": "N", "supported_trust": '["oasf","x402"]', "active": "true"} and not plain["a"]["truncated"]
