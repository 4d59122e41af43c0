"""Semantics that the tables alone don't show."""

from pyspark.sql import functions as F

from tallyforge.functions import scalar
from tallyforge.operators import fold, tree
from tallyforge.plans import registry


def test_values(spark):
    rows = spark.createDataFrame([("-1200", 3), ("5", 2), ("0", 4), ("340282366920938463463374607431768211455", 18)], "raw string, d int")
    got = [r[0] for r in rows.select(scalar.normalize_value(F.col("raw"), F.col("d"))).collect()]
    assert got == ["-1.2", "0.05", "0", "340282366920938463463.374607431768211455"]


def test_immutable_run(spark):
    ops = spark.createDataFrame([(1, "set", "a", False), (2, "set", "b", True), (3, "set", "c", False), (4, "delete", None, None), (5, "set", "d", False)], "n int, op string, value string, immutable boolean").withColumn("k", F.lit(1))
    assert fold.metadata_state(ops.where("n < 4"), ["k"], F.col("n")).first()["value"] == "b"
    assert fold.metadata_state(ops, ["k"], F.col("n")).first()["value"] == "d"


def test_tree_cycle(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "node int, parent int")
    assert sorted((r.node, r.depth) for r in tree.forest(nodes).collect()) == [(1, 0), (2, 1), (3, 2)]
    assert sorted(r.node for r in tree.lineage(nodes.where("node = 4").select("node"), nodes).collect()) == [4, 5]


def test_one_tree_and_one_line(spark):
    rows = [("a", None, "ok"), ("b", "a", "ok"), ("c", "b", "ok"), ("d", "c", "ORPHANED"), ("e", "d", "ok"), ("f", "a", "ok"), ("x", "y", "ok"), ("y", "x", "ok")]
    agents = spark.createDataFrame(rows, "asset string, parent_asset string, status string")
    assert [(r.node, r.depth) for r in tree.subtree(agents, "a").collect()] == [("a", 0), ("b", 1), ("f", 1), ("c", 2)]
    assert [r.node for r in tree.subtree(agents, "a", 1, include_root=False).collect()] == ["b", "f"]
    assert [r.node for r in tree.subtree(agents, "x", 99).collect()] == ["x", "y"] and tree.subtree(agents, "none").isEmpty()
    assert [(r.node, r.depth) for r in tree.ancestors(agents, "c").collect()] == [("a", 2), ("b", 1), ("c", 0)]
    assert [r.node for r in tree.ancestors(agents, "e").collect()] == ["e"] and [r.node for r in tree.ancestors(agents, "c", include_self=False).collect()] == ["a", "b"]


def test_order_of_rows_is_irrelevant(spark):
    rows = [(1, i, f"v{i}") for i in range(20)]
    one, two = (spark.createDataFrame(r, "k int, n int, v string") for r in (rows, rows[::-1]))
    f = lambda df: fold.project(df, ["k"], F.struct("n"), last={"l": F.col("v")}, first={"f": F.col("v")}).collect()
    assert f(one) == f(two)


def test_lineage_query_starts_from_every_customer(spark):
    parents = {r["c_custkey"]: r["c_custkey"] // 7 or None for r in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select("c_custkey").collect()}
    want = set()
    for root in parents:
        node, depth = root, 0
        while node is not None:
            want.add((root, node, depth))
            node, depth = parents.get(node), depth + 1
    got = registry.queries()["tree_lineage_all"](spark, "/root/testdata/sf0.001").select("root", "node", "depth").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
