"""Route groups, prefixes and middleware scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S
from ripplegraph.operators import closure, spans
from ripplegraph.operators.budgets import BudgetExceeded, Limits
from ripplegraph.operators.lineage import broadcast_few, settle


def effective_group(group_id: Column, route_func: Column, group_var: Column) -> Column:
    """A group's own id, or one made of function and variable, so that equal names in two functions stay apart."""
    return F.coalesce(S.blank_to_null(group_id), F.concat(route_func, F.lit("::"), group_var))


def group_edges(groups: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """parent and child, from parent fields and cross-function flows together, once each, without loops."""
    own = groups.where("parent_group_id is not null").select(F.col("parent_group_id").alias("parent"), F.col("id").alias("child"))
    if flows is not None:
        own = own.union(flows.select("parent_group_id", "child_group_id"))
    return own.where("parent <> child").distinct()


def group_routes(edges: DataFrame, routes: DataFrame, limits: Limits | None = None) -> DataFrame:
    """ancestor group and route of its whole subtree."""
    below = closure.closure(edges, limits)
    own = routes.select(F.col("group_id").alias("descendant"), F.col("id").alias("route_id"))
    alone = own.select(F.col("descendant").alias("ancestor"), "descendant").distinct()
    return below.select("ancestor", "descendant").union(alone).distinct().join(own, "descendant").select("ancestor", "route_id").distinct()


def group_prefixes(groups: DataFrame, most: int = 256) -> DataFrame:
    """id and full_prefix: prefixes joined from the root group down, a level a round; groups without any below them at the end.

    groups: id, parent_group_id, prefix. Groups on a ring have no root and no prefix.
    """
    groups = settle(groups.select("id", "parent_group_id", "prefix"))
    parents = broadcast_few(groups.select(F.col("parent_group_id").alias("_known")).where("_known is not null").distinct())
    inner = settle(groups.join(parents, groups.id == parents["_known"], "left_semi"))
    outer = groups.join(parents, groups.id == parents["_known"], "left_anti")
    ids = inner.select(F.col("id").alias("_known")).distinct()  # a parent that is known has a child, so it is here
    top = inner.join(ids, inner.parent_group_id == ids["_known"], "left_anti")
    new = settle(top.select("id", S.join_path(F.lit(""), F.col("prefix")).alias("full_prefix")))
    done = new
    for _ in range(most):
        if new.isEmpty():
            named = settle(ids.join(done.select(F.col("id").alias("_known"), F.col("full_prefix").alias("_above")), "_known", "left"))
            last = outer.join(named, outer.parent_group_id == named["_known"], "left").where("_known is null or _above is not null")
            return done.unionByName(last.select("id", S.join_path(F.col("_above"), F.col("prefix")).alias("full_prefix")))
        above = new.select(F.col("id").alias("parent_group_id"), F.col("full_prefix").alias("_above"))
        new = settle(inner.join(above, "parent_group_id").select("id", S.join_path(F.col("_above"), F.col("prefix")).alias("full_prefix")))
        done = done.unionByName(new)
    raise BudgetExceeded("group depth", most + 1, most)


def resolved_paths(routes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """routes with resolved_path; null where the local path isn't known."""
    p = prefixes.select(F.col("id").alias("group_id"), "full_prefix")
    full = F.when(F.col("local_path").isNotNull(), S.join_path(F.coalesce("full_prefix", F.lit("")), F.col("local_path")))
    return routes.drop("resolved_path").join(p, "group_id", "left").withColumn("resolved_path", full).drop("full_prefix")


def unique_prefixes(calls: DataFrame, seeds: DataFrame, most: int = 256) -> DataFrame:
    """callee and prefix for parameters that get one prefix however they are reached.

    Calls nested deeper than `most` raise BudgetExceeded; so does a ring of calls that adds to a prefix forever.

    calls: caller, callee, prefix (added by the call). seeds: node, prefix, for callers that none calls.
    Sets of prefixes grow along the calls until nothing is new; only sets of one stay.
    """
    calls = settle(calls.select("caller", "callee", "prefix").distinct())
    called = calls.select(F.col("callee").alias("node")).distinct()
    new = settle(seeds.select("node", "prefix").distinct().join(called, "node", "left_anti"))
    seen = new
    for _ in range(most):
        step = new.select(F.col("node").alias("caller"), F.col("prefix").alias("_context")).join(calls, "caller")
        step = step.select(F.col("callee").alias("node"), S.join_context_prefix(F.col("_context"), F.col("prefix")).alias("prefix")).distinct()
        new = settle(step.join(seen, ["node", "prefix"], "left_anti"))
        if new.isEmpty():
            break
        seen = settle(seen.unionByName(new))
    else:
        raise BudgetExceeded("prefix depth", most + 1, most)
    return seen.groupBy("node").agg(F.count_distinct("prefix").alias("_n"), F.min("prefix").alias("prefix")).where("_n = 1").drop("_n")


def flow_edges(arguments: DataFrame, parameters: DataFrame, returns: DataFrame, receivers: DataFrame) -> DataFrame:
    """Group flows between functions: an argument's group to the parameter's root group, and a returned group to
    the one that receives it.

    arguments: call_id, callee, position, group_id. parameters: callee, position, group_id. returns: callee,
    group_id. receivers: call_id, callee, group_id.
    """
    p = parameters.select("callee", "position", F.col("group_id").alias("child_group_id"))
    into = arguments.select("callee", "position", F.col("group_id").alias("parent_group_id")).join(p, ["callee", "position"])
    back = returns.select("callee", F.col("group_id").alias("parent_group_id")).distinct().join(receivers.select("callee", F.col("group_id").alias("child_group_id")).distinct(), "callee")
    both = into.select("parent_group_id", "child_group_id").union(back.select("parent_group_id", "child_group_id"))
    return both.where("parent_group_id <> child_group_id").distinct().withColumn("id", S.fact_id("flow", F.col("parent_group_id"), F.col("child_group_id")))


def middleware_routes(middleware: DataFrame, subtree: DataFrame, routes: DataFrame) -> DataFrame:
    """middleware_id and route_id: a binding covers its group's subtree, and of its own function only what comes later."""
    m = middleware.select(F.col("id").alias("middleware_id"), F.col("group_id").alias("ancestor"), F.col("route_func").alias("_func"), F.col("statement_index").alias("_index"))
    r = routes.select(F.col("id").alias("route_id"), "route_func", "statement_index")
    below = m.join(subtree, "ancestor").join(r, "route_id")
    later = (F.col("_func") != F.col("route_func")) | (F.col("_index") < F.col("statement_index"))
    return below.where(later).select("middleware_id", "route_id").distinct()


def _span(df: DataFrame, side: str, *columns: Column | str) -> DataFrame:
    return df.select("file", *columns, *[F.col(c).alias(f"{side}_{c}") for c in ("sl", "sc", "el", "ec")])


def route_dependencies(references: DataFrame, routes: DataFrame) -> DataFrame:
    """reference_id and route_id: what a route's own text refers to, but for its handler.

    references: id, from_symbol, to_symbol and a span; routes: id, route_func, handler_symbol and a span.
    """
    i = _span(references, "inner", F.col("id").alias("reference_id"), F.col("from_symbol").alias("_func"), "to_symbol")
    o = _span(routes, "outer", F.col("id").alias("route_id"), F.col("route_func").alias("_func"), "handler_symbol")
    other = ~F.col("to_symbol").eqNullSafe(F.col("handler_symbol"))
    return spans.contained(i, o, ["file", "_func"]).where(other).select("reference_id", "to_symbol", "route_id")


def group_dependencies(references: DataFrame, groups: DataFrame, subtree: DataFrame) -> DataFrame:
    """to_symbol and route_id: what a group's own text refers to, for all routes of its subtree."""
    i = _span(references, "inner", F.col("from_symbol").alias("_func"), "to_symbol")
    o = _span(groups, "outer", F.col("id").alias("ancestor"), F.col("route_func").alias("_func"))
    held = spans.contained(i, o, ["file", "_func"]).select("to_symbol", "ancestor").distinct()
    return held.join(subtree, "ancestor").select("to_symbol", "route_id").distinct()


def route_diagnostics(routes: DataFrame) -> DataFrame:
    """code and route id: dynamic paths, unresolved handlers and guessed wrappers."""
    checks = [("route_dynamic_path", F.col("local_path").isNull()), ("route_unresolved_handler", F.col("handler_symbol").isNull()), ("route_guessed_wrapper", F.coalesce(F.col("guessed"), F.lit(False)))]
    codes = F.filter(F.array(*[F.when(test, F.lit(code)) for code, test in checks]), lambda c: c.isNotNull())
    return routes.select("id", F.explode(codes).alias("code"))
