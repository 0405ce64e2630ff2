"""The endpoint catalog: annotation first, routes as evidence and fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S
from ripplegraph.operators.budgets import EndpointNotFound
from ripplegraph.operators.lineage import broadcast_few, settle


def resolutions(routes: DataFrame, annotations: DataFrame) -> DataFrame:
    """method, path, handler_symbol, route_id, annotation_id and source, a row for each way an endpoint is known.

    A handler's annotations name the endpoint; what they lack comes from each of its routes. Routes whose handler
    has no annotation stand for themselves, also without a handler. Incomplete keys are dropped.
    """
    r = routes.select(F.col("id").alias("route_id"), "handler_symbol", F.col("method").alias("r_method"), F.coalesce(S.blank_to_null(F.col("resolved_path")), S.blank_to_null(F.col("local_path"))).alias("r_path"))
    a = annotations.select(F.col("id").alias("annotation_id"), "handler_symbol", S.blank_to_null(F.col("method")).alias("a_method"), S.blank_to_null(F.col("path")).alias("a_path"))
    noted = a.join(r, "handler_symbol", "left").select("handler_symbol", "route_id", "annotation_id", F.coalesce("a_method", "r_method").alias("method"), F.coalesce("a_path", "r_path").alias("path"), F.lit("annotation").alias("source"))
    plain = r.join(a.select("handler_symbol"), "handler_symbol", "left_anti")
    plain = plain.select("handler_symbol", "route_id", F.lit(None).cast("string").alias("annotation_id"), F.col("r_method").alias("method"), F.col("r_path").alias("path"), F.lit("route").alias("source"))
    both = noted.unionByName(plain).withColumn("method", S.endpoint_method(F.col("method"))).withColumn("path", S.endpoint_path(F.col("path")))
    return both.where("method <> '' and path <> ''")


def keys(routes: DataFrame, annotations: DataFrame) -> DataFrame:
    """node, method and path of resolutions() that have a handler (node), without their evidence; rows may repeat.

    Annotations that name both method and path need no route, so routes are only read for handlers without any.
    """
    a = settle(annotations.select("handler_symbol", S.blank_to_null(F.col("method")).alias("method"), S.blank_to_null(F.col("path")).alias("path")).where("handler_symbol is not null"))
    r = routes.where("handler_symbol is not null").select("handler_symbol", F.col("method").alias("r_method"), F.coalesce(S.blank_to_null(F.col("resolved_path")), S.blank_to_null(F.col("local_path"))).alias("r_path"))
    plain = r.join(broadcast_few(a.select("handler_symbol").distinct(), 1 << 19), "handler_symbol", "left_anti").select("handler_symbol", F.col("r_method").alias("method"), F.col("r_path").alias("path"))
    whole, part = a.where("method is not null and path is not null"), a.where("method is null or path is null")
    out = plain.unionByName(whole)
    if not part.isEmpty():
        out = out.unionByName(part.join(r, "handler_symbol", "left").select("handler_symbol", F.coalesce("method", "r_method").alias("method"), F.coalesce("path", "r_path").alias("path")))
    return out.select(F.col("handler_symbol").alias("node"), S.endpoint_method(F.col("method")).alias("method"), S.endpoint_path(F.col("path")).alias("path")).where("method <> '' and path <> ''")


def catalog(resolved: DataFrame) -> DataFrame:
    """method, path and the sorted handlers, routes and annotations of each endpoint."""
    sets = [F.array_sort(F.collect_set(c)).alias(name) for c, name in (("handler_symbol", "handlers"), ("route_id", "routes"), ("annotation_id", "annotations"))]
    return resolved.groupBy("method", "path").agg(*sets)


def uncovered_routes(routes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Routes that no resolution holds."""
    return routes.join(resolved.select(F.col("route_id").alias("id")), "id", "left_anti")


def lookup(queries: DataFrame, resolved: DataFrame, routes: DataFrame, strict: bool = False) -> DataFrame:
    """query (method, path) with the endpoint it means: itself if known, else the first endpoint that has a route
    so registered as evidence.
    """
    q = queries.select(S.endpoint_method(F.col("method")).alias("q_method"), S.endpoint_path(F.col("path")).alias("q_path")).distinct()
    known = resolved.select("method", "path").distinct()
    exact = q.join(known, (q.q_method == known.method) & (q.q_path == known.path)).select("q_method", "q_path", "method", "path", F.lit("exact").alias("match"))
    rest = q.join(known, (q.q_method == known.method) & (q.q_path == known.path), "left_anti")
    registered = routes.select(F.col("id").alias("route_id"), S.endpoint_method(F.col("method")).alias("q_method"), S.endpoint_path(F.coalesce(S.blank_to_null(F.col("resolved_path")), F.col("local_path"))).alias("q_path"))
    by_route = rest.join(registered, ["q_method", "q_path"]).join(resolved.select("route_id", "method", "path"), "route_id")
    first = by_route.groupBy("q_method", "q_path").agg(F.min(F.struct("method", "path")).alias("e")).select("q_method", "q_path", "e.*", F.lit("route").alias("match"))
    found = exact.unionByName(first)
    if strict:
        missing = q.join(found.select("q_method", "q_path"), ["q_method", "q_path"], "left_anti").first()
        if missing:
            raise EndpointNotFound(f"{missing.q_method} {missing.q_path}")
    return found
