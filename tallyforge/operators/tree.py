"""Hierarchies: descendants and ancestors for all rows at once, safe against cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpoint


def walk(starts: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """root, node, depth, path: from each start (column node) along edges (src, dst), without visiting a node twice on a path."""
    level = starts.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    found = level
    for depth in range(1, max_depth + 1):
        level = level.join(edges, level["node"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        level = checkpoint(level.select("root", F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("dst")).alias("path")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def forest(nodes: DataFrame, max_depth: int = 8) -> DataFrame:
    """Descendants of every root (nodes: node, parent; a root has no parent)."""
    return walk(nodes.where("parent IS NULL"), nodes.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("node").alias("dst")), max_depth)


def lineage(starts: DataFrame, nodes: DataFrame, max_depth: int = 32) -> DataFrame:
    """root, node, depth of each start (column node) and its ancestors, each node once; nodes: node, parent, a row for each node.

    By doubling: who is up to d steps above a node, joined to who is up to d
    steps above those at the d-th, is who is up to 2 d above; so five joins do
    for 32 steps. On a cycle the walk ends before the node that it has met.
    """
    up = nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("above"), F.lit(1).alias("depth"))
    reach, far = up, 1
    while far < max_depth:
        reach = checkpoint(reach)
        ends = reach.where(F.col("depth") == far).select(F.col("node").alias("root"), F.col("above").alias("node"))
        if ends.isEmpty():
            break
        more = ends.join(reach, "node").select(F.col("root").alias("node"), "above", (F.col("depth") + far).alias("depth"))
        reach, far = reach.unionByName(more.where(F.col("depth") <= max_depth)), 2 * far
    from_ = starts.select(F.col("node").alias("root"))
    own = from_.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    found = own.unionByName(from_.join(reach.where(F.col("depth") <= max_depth), F.col("root") == F.col("node")).select("root", F.col("above").alias("node"), "depth"))
    return found.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def _live(agents: DataFrame) -> DataFrame:
    """node, parent of the agents that aren't orphaned: an orphaned one cuts the walk."""
    return agents.where("status <> 'ORPHANED'").select(F.col("asset").alias("node"), F.col("parent_asset").alias("parent"))


def subtree(agents: DataFrame, root: str, max_depth: int = 8, include_root: bool = True) -> DataFrame:
    """node, depth, path of an agent's descendants, at most 8 deep, by depth and path; without a root there is nothing."""
    nodes = _live(agents)
    edges = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    found = walk(nodes.where(F.col("node") == root).select("node"), edges, max(1, min(max_depth, 8)))
    return found.where(F.col("depth") >= (0 if include_root else 1)).select("node", "depth", "path").orderBy("depth", "path")


def ancestors(agents: DataFrame, asset: str, include_self: bool = True, max_depth: int = 32) -> DataFrame:
    """node, depth of an agent's ancestors, the root first."""
    nodes = _live(agents)
    known = nodes.select(F.col("node").alias("_known"))
    edges = nodes.where("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    found = walk(nodes.where(F.col("node") == asset).select("node"), edges, max(1, min(max_depth, 32)))
    # a parent that isn't there, or is orphaned, ends the line
    return found.join(known, F.col("node") == F.col("_known"), "left_semi").where(F.col("depth") >= (0 if include_self else 1)).select("node", "depth").orderBy(F.desc("depth"), "node")
