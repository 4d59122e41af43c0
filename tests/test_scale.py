"""What one hot key, one long chain or one deep tree does to the operators, and the texts of documents."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import hashes
from tallyforge.operators import chain, documents, ids, tree


def test_ids_of_a_hot_scope(spark):
    """A million rows of one asset, some with ids, and a few others: gapless, in order, and no task holds the asset."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("hot").alias("asset"), (F.col("id") * 7919 % n).alias("slot"), F.lit(None).cast("long").alias("k"))
    few = spark.range(50).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("a"), F.col("id") % 3)).alias("asset"), F.col("id").alias("slot"), F.when(F.col("id") < 6, F.floor(F.col("id") / 3) + 1).alias("k"))
    got = ids.assign_ids(rows.unionByName(few), ["asset"], [F.col("slot").asc()], "k")
    hot = got.where("asset = 'hot'").agg(F.count("*"), F.countDistinct("k"), F.min("k"), F.max("k"), F.count_if(F.col("k") != F.col("slot") + 1)).first()
    assert tuple(hot) == (n, n, 1, n, 0)
    want = {}
    for i in range(50):
        want.setdefault(f"a{i % 3}" if i % 3 else None, []).append(i)
    assert {(r["asset"], r["slot"]): r["k"] for r in got.where("asset IS NULL OR asset <> 'hot'").collect()} == {(a, s): k + 1 for a, slots in want.items() for k, s in enumerate(slots)}
    shares = [r["count"] for r in rows.repartitionByRange("asset", "slot").groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < n / 2


def test_ids_beside_existing_ones_in_several_ranges(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("xyz"), i, rnd.random() < 0.8) for i in range(4000)]
    frame = spark.createDataFrame(rows, "asset string, slot int, ok boolean").withColumn("k", F.when(F.col("slot") == 3999, 900).cast("long"))
    got = {r["slot"]: r["k"] for r in ids.assign_ids(frame.repartition(3), ["asset"], [F.col("slot").desc()], "k", F.col("ok")).collect()}
    top = {a: 900 if rows[3999][0] == a else 0 for a in "xyz"}
    for a, slot, ok in reversed(rows):
        if slot == 3999:
            assert got[slot] == 900
        elif not ok:
            assert got[slot] is None
        else:
            top[a] += 1
            assert got[slot] == top[a]


def test_one_message_hashes_as_many():
    rnd = random.Random(1)
    messages = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 80, 135, 136, 137, 272, 300)]
    assert [hashes.keccak_one(m) for m in messages] == [hashes.keccak_batch([m] * hashes.FEW)[0] for m in messages]
    began = time.process_time()
    for _ in range(100):
        hashes.keccak_one(b"x" * 80)
    assert time.process_time() - began < 1


def test_a_long_chain_runs_apart_from_its_checkpoints(spark, monkeypatch):
    """A chain without stored digests, with checkpoints: as many pieces as checkpoints, the same digests, and a changed leaf shows at the next one."""
    monkeypatch.setattr(chain, "CHUNK", 700)
    n, every = 5000, 500
    rows = spark.range(1, n + 1).select(F.lit("a").alias("agent"), F.col("id").alias("n"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"), F.lit(None).cast("binary").alias("digest"))
    known, digest, points = {}, chain.GENESIS, []
    for k in range(1, n + 1):
        digest = chain.SHA256.batch([digest + hashes.LINK_DOMAIN["feedback"].encode() + chain.hashlib.sha256(str(k).encode()).digest()])[0]
        known[k] = digest
        if k % every == 0:
            points.append(("a", k, digest))
    marks = spark.createDataFrame(points, "agent string, count long, digest binary")
    found = chain.digests(rows, ["agent"], "n", hash=chain.SHA256, checkpoints=marks)
    assert {r["n"]: bytes(r["computed"]) for r in found.collect()} == known
    assert chain.pieces(rows, ["agent"], "n", checkpoints=marks) == n // every
    got = chain.verify_chain(rows, ["agent"], "n", hash=chain.SHA256, checkpoints=marks).first()
    assert got["valid"] and got["events"] == n and bytes(got["digest"]) == known[n]
    broken = rows.withColumn("leaf", F.when(F.col("n") == 1234, F.unhex(F.lit("00" * 32))).otherwise(F.col("leaf")))
    got = chain.verify_chain(broken, ["agent"], "n", hash=chain.SHA256, checkpoints=marks).first()
    assert not got["valid"] and got["first_mismatch"] == 1500


def walked(parent, start, most=32):
    path = [start]
    while len(path) <= most and parent.get(path[-1]) is not None and parent[path[-1]] not in path:
        path.append(parent[path[-1]])
    return {(start, x, d) for d, x in enumerate(path)}


@pytest.mark.parametrize("most", [1, 5, 32])
def test_lineage_by_doubling(spark, most):
    rnd = random.Random(most)
    parent = {i: rnd.randrange(i) if rnd.random() < 0.5 else i - 1 for i in range(1, 60)} | {i: i - 1 for i in range(60, 120)}
    parent |= {200: 201, 201: 202, 202: 200, 203: 201, 300: 300, 301: 999, 0: None}
    nodes = spark.createDataFrame(list(parent.items()), "node int, parent int")
    got = {tuple(r) for r in tree.lineage(nodes.select("node"), nodes, most).select("root", "node", "depth").collect()}
    assert got == set().union(*(walked(parent, s, most) for s in parent))


@pytest.mark.parametrize(
    "text, want",
    [
        ('<script>alert("xss")</script>', None), ('<img src=x onerror="alert(1)">', None), ('<svg onload="alert(1)"></svg>', None), ("Test Agent - AI Assistant v2.0", "Test Agent - AI Assistant v2.0"), ("エージェント 🤖 代理人", "エージェント 🤖 代理人"),
        ("<div><script>evil()</script><p>Text</p></div>", "Text"), ('<div onclick="evil()">Click me</div>', "Click me"), ("a < b and c > d", "a &lt; b and c &gt; d"), ("c > d & e", "c > d & e"), ('<a title="1 > 0" href=\'>\'>x</a>y', "xy"), ("<b title=it's>x</b>", "x"),
        ("<!-- a > b --> x <!-- <b> -->y", "x y"), ("x<!-- open", "x"), ("x <b", "x"), ("1 <2", "1 &lt;2"), ("<p>Tom & Jerry &amp; &lt;b&gt; &quot;q&quot; &#65;&#x1F916;&#60;</p>", 'Tom &amp; Jerry &amp; &lt;b&gt; "q" A🤖&lt;'), ("<style>a > b</style>t<STYLE>", "t"), ("</>a</ b>c<?x?>d<!DOCTYPE html>e", "acde"),
        ("\x07 \t<i> x\x01y </i>\u00a0\n", " \t xy &nbsp;"), (" \x0b<b></b> ", None), ("<title>t</title><scripty>k</scripty>", "k"),
    ],
)
def test_texts_without_markup(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(documents.clean_text(F.col("t"))).first()[0] == want


def test_audit_keeps_no_row_for_each_id(spark):
    """Gaps, repeats and missing ids on either side of a mask's end are found, without a group for each id."""
    held = {"whole": [*range(1, 200)], "gap": [*range(1, 64), *range(65, 130)], "twice": [*range(1, 129), 128], "swapped": [*range(1, 64), 66, 65, 65], "far": [1, 2**62], "low": [-1, 1, 2], "none": [None], "late": [1, 2, None]}
    rows = spark.createDataFrame([(a, i) for a, some in held.items() for i in some], "a string, i long")
    got = ids.audit_gapless(rows, ["a"], "i", F.lit(True))
    assert {r["a"]: (r["kinds"], r["missing"]) for r in got.collect()} == {a: (len({*some} - {None}), some.count(None)) for a, some in held.items() if a != "whole"}
    assert "distinct" not in got._jdf.queryExecution().optimizedPlan().toString()
