"""From changed symbols to endpoints: reach, trees, events and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S
from ripplegraph.operators import closure
from ripplegraph.operators.budgets import Limits
from ripplegraph.operators.lineage import settle


def reverse_edges(references: DataFrame) -> DataFrame:
    """node and next: who depends on a symbol, with the relation that a walk reports."""
    return references.where("to_symbol is not null").select(F.col("to_symbol").alias("node"), F.col("from_symbol").alias("next"), S.reference_relation(F.col("kind")).alias("relation"))


def referrers(references: DataFrame) -> DataFrame:
    """Each symbol with its references in order of (from, line, kind, id)."""
    order = F.array_sort(F.collect_list(F.struct("from_symbol", "sl", "kind", "id")))
    return references.where("to_symbol is not null").groupBy("to_symbol").agg(order.alias("references"))


def calls(references: DataFrame) -> DataFrame:
    """caller and callee, once each."""
    return references.where("kind = 'call' and from_symbol <> '' and to_symbol <> ''").select(F.col("from_symbol").alias("caller"), F.col("to_symbol").alias("callee")).distinct()


def terminals(resolved: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """node, method and path: where a walk that arrives at a symbol leaves the project.

    extra: further (node, route_id), as of middleware and of what routes refer to.
    """
    own = resolved.where("handler_symbol is not null").select(F.col("handler_symbol").alias("node"), "method", "path")
    if extra is not None:
        own = own.union(extra.join(resolved.select("route_id", "method", "path"), "route_id").select("node", "method", "path"))
    return own.distinct()


def affected_endpoints(references: DataFrame, roots: DataFrame, ends: DataFrame, limits: Limits | None = None) -> DataFrame:
    """root_id, method, path and level: the endpoints of each root, and the least number of steps to a symbol that
    leads there. Needs reachability alone: every reachable node lies on some simple path.
    """
    found = closure.reach(reverse_edges(references), roots, limits)
    return found.join(ends, "node").groupBy("root_id", "method", "path").agg(F.min("level").alias("level"))


def trees(references: DataFrame, roots: DataFrame, limits: Limits | None = None) -> DataFrame:
    """All simple paths of dependents of each root, as closure.paths."""
    return closure.paths(reverse_edges(references), roots, limits)


def shortest_chains(found: DataFrame, ends: DataFrame) -> DataFrame:
    """Of each root and endpoint the shortest path, of equal ones the least."""
    hit = found.where(~F.col("cycle")).withColumnRenamed("path", "chain").join(ends, "node").select("root_id", "method", "path", "level", "chain")
    return closure.shortest(hit, ["root_id", "method", "path"], "chain")


def events_on_paths(found: DataFrame, events: DataFrame) -> DataFrame:
    """root_id, event and sender: events whose sender ends a path that passes one of their dependencies.

    events: event, sender_symbol, symbol_id (a dependency), relation.
    """
    ended = found.where(~F.col("cycle")).select("root_id", "path", F.col("node").alias("sender_symbol"))
    return ended.join(events, "sender_symbol").where(F.array_contains("path", F.col("symbol_id"))).select("root_id", "event", "sender_symbol").distinct()


def events_by_evidence(changes: DataFrame, events: DataFrame) -> DataFrame:
    """change and event whose sender is the changed symbol itself and whose evidence the changed lines touch."""
    joined = changes.join(events, (changes.symbol_id == events.sender_symbol) & (changes.file == events.evidence_file))
    touch = S.ranges_overlap(F.col("start_line"), F.col("end_line"), F.col("evidence_start"), F.col("evidence_end"))
    return joined.where(touch).select(F.col("change_id"), "event").distinct()


def root_dispatch(changes: DataFrame, tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """change_id and the kind of the first of the tables (name, ids) that holds its target."""
    out = changes
    kind = F.lit(None).cast("string")
    for name, ids in reversed(tables):
        flag = ids.select(F.col("id").alias("target_id"), F.lit(True).alias(f"_{name}")).distinct()
        out = out.join(flag, "target_id", "left")
        kind = F.when(F.col(f"_{name}"), F.lit(name)).otherwise(kind)
    return out.select("change_id", "target_id", F.coalesce(kind, F.lit("file")).alias("root_kind"))


def merge_endpoints(found: DataFrame) -> DataFrame:
    """method, path, the number of roots that reach it, and the least level."""
    return found.groupBy("method", "path").agg(F.count_distinct("root_id").alias("n_roots"), F.min("level").alias("level"))


def global_summary(found: DataFrame) -> DataFrame:
    """One row of distinct counts."""
    return found.agg(F.count_distinct("root_id").alias("roots"), F.count_distinct("method", "path").alias("endpoints"), F.count("*").alias("pairs"))


def summary_of_keys(references: DataFrame, roots: DataFrame, keys: DataFrame) -> DataFrame:
    """global_summary() of affected_endpoints(), of endpoints.keys().

    Endpoints with the same symbols have the same roots: the roots of such a group are found once, and counted for
    all its endpoints.
    """
    own = keys.repartition("method", "path").groupBy("method", "path").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    group = settle(own.groupBy("nodes").agg(F.count("*").alias("_n")))
    sets = settle(group.select("nodes", F.explode("nodes").alias("node")))
    edges = closure.toward(reverse_edges(references), sets)
    found = settle(closure.reach(edges, roots).join(sets, "node").select("nodes", "root_id").distinct())
    each = group.join(found.groupBy("nodes").agg(F.count("*").alias("_roots")), "nodes")
    counts = each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("endpoints"), F.coalesce(F.sum(F.col("_n") * F.col("_roots")), F.lit(0)).alias("pairs"))
    return found.agg(F.count_distinct("root_id").alias("roots")).crossJoin(counts)
