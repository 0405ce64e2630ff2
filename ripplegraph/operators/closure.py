"""Reachability and path enumeration over edge tables, all roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.budgets import BudgetExceeded, Limits, check
from ripplegraph.operators.lineage import broadcast_few, settle


def reach(edges: DataFrame, roots: DataFrame, limits: Limits | None = None) -> DataFrame:
    """root_id, node and level (the least distance) of all nodes that each root reaches, itself at 0.

    edges: node, next. roots: root_id, node. Semi-naive: only a level's new pairs are joined on, and pairs seen
    before are dropped by an anti join, so cycles end. Each level is written once. Nodes that lead nowhere, most of
    them in a graph of facts, stay out of the levels and are joined to what was reached at the end. Ceilings on depth
    and nodes hold where limits are given, as for one analysis; without, the walk ends when nothing is new.
    """
    limits = limits and limits.normalised()
    edges = settle(edges.select("node", "next").where("node is not null and next is not null").distinct())
    leading = edges.select(F.col("node").alias("next")).distinct()
    inner = settle(edges.join(leading, "next", "left_semi"))
    new = settle(roots.select("root_id", "node").distinct().withColumn("level", F.lit(0)))
    seen, level, total = new, 0, 0
    while found := new.count():
        if limits:
            total += found
            check("total nodes", total, limits.total_nodes)
            if level == limits.depth:
                if not new.join(edges, "node").isEmpty():
                    raise BudgetExceeded("depth", level + 1, limits.depth)
                break
        level += 1
        step = new.join(inner, "node").select("root_id", F.col("next").alias("node")).distinct()
        new = settle(step.join(seen, ["root_id", "node"], "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(new)
    ends = edges.join(leading, "next", "left_anti")
    last = seen.join(ends, "node").select("root_id", F.col("next").alias("node"), (F.col("level") + 1).alias("level"))
    out = seen.unionByName(last).groupBy("root_id", "node").agg(F.min("level").alias("level"))
    if limits:
        out = settle(out)
        check("total nodes", out.count(), limits.total_nodes)
        check("nodes per root", out.groupBy("root_id").count().agg(F.max("count")).first()[0], limits.nodes_per_root)
    return out


def toward(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges (node, next), once each, from whose end a walk leads to one of targets (node) or that end in one.

    Ends that neither lead on nor are targets, most of a graph of facts, go first, by a hash of theirs that needs no
    shuffle of the edges and may keep some in vain; going back from the targets on the rest is exact.
    """
    edges = edges.select("node", "next").where("node is not null and next is not null")
    new = settle(targets.select("node").where("node is not null").distinct())
    known = broadcast_few(edges.select("node").union(new).select(F.xxhash64("node").alias("_key")).distinct())
    rest = settle(edges.withColumn("_key", F.xxhash64("next")).join(known, "_key", "left_semi").drop("_key").distinct())
    seen = new
    while not new.isEmpty():
        before = rest.join(new.select(F.col("node").alias("next")), "next", "left_semi").select("node").distinct()
        new = settle(before.join(seen, "node", "left_anti"))
        seen = seen.unionByName(new)
    return rest.join(seen.select(F.col("node").alias("next")), "next", "left_semi").select("node", "next")


def closure(edges: DataFrame, limits: Limits | None = None) -> DataFrame:
    """ancestor and descendant for all nodes of edges (parent, child), themselves included; cycles are safe."""
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    found = reach(edges.select(F.col("parent").alias("node"), F.col("child").alias("next")), nodes.select(F.col("node").alias("root_id"), "node"), limits)
    return found.select(F.col("root_id").alias("ancestor"), F.col("node").alias("descendant"), "level")


def paths(edges: DataFrame, roots: DataFrame, limits: Limits | None = None) -> DataFrame:
    """root_id, node, level, path, relations and cycle for all simple paths of each root.

    edges: node, next, relation. A step to a node on the path ends it there, marked as a cycle; the node is then
    repeated at the path's end. Counts every step against the limits, where given, before going on.
    """
    limits = limits and limits.normalised()
    edges = settle(edges.select("node", "next", "relation").where("node is not null and next is not null").distinct())
    new = settle(roots.select("root_id", "node").distinct().select("root_id", "node", F.lit(0).alias("level"), F.array("node").alias("path"), F.array().cast("array<string>").alias("relations"), F.lit(False).alias("cycle")))
    found, total = new, 0
    level = 0
    while n := new.count():
        total += n
        level += 1
        if limits:
            check("total nodes", total, limits.total_nodes)
            if total > limits.nodes_per_root:
                check("nodes per root", found.groupBy("root_id").count().agg(F.max("count")).first()[0], limits.nodes_per_root)
            if level > limits.depth:
                raise BudgetExceeded("depth", level, limits.depth)
        step = new.where(~F.col("cycle")).join(edges, "node")
        new = settle(
            step.select(
                "root_id",
                F.col("next").alias("node"),
                F.lit(level).alias("level"),
                F.concat("path", F.array("next")).alias("path"),
                F.concat("relations", F.array("relation")).alias("relations"),
                F.array_contains("path", F.col("next")).alias("cycle"),
            )
        )
        found = found.unionByName(new)
    return found


def shortest(found: DataFrame, by: list[str], keys: str = "path") -> DataFrame:
    """Of each group the shortest path; of equally short ones the least."""
    order = F.struct(F.size(keys), F.col(keys))
    rest = [c for c in found.columns if c not in by]
    return found.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_best")).select(*by, "_best.*")
