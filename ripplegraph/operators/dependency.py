"""Endpoints and the remote operations they call, in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators import closure
from ripplegraph.operators.budgets import Limits


def endpoint_operations(resolved: DataFrame, calls: DataFrame, remote: DataFrame, limits: Limits | None = None) -> DataFrame:
    """method, path and operation_id: operations that an endpoint's handlers reach.

    calls: caller, callee. remote: caller_symbol, operation_id. One table answers both directions, so an endpoint
    has an operation exactly if the operation has the endpoint.
    """
    handlers = resolved.where("handler_symbol is not null").select("method", "path", F.col("handler_symbol").alias("root_id")).distinct()
    edges = calls.select(F.col("caller").alias("node"), F.col("callee").alias("next"))
    found = closure.reach(edges, handlers.select("root_id", F.col("root_id").alias("node")).distinct(), limits)
    hit = found.join(remote.select(F.col("caller_symbol").alias("node"), "operation_id").distinct(), "node").select("root_id", "operation_id").distinct()
    return handlers.join(hit, "root_id").select("method", "path", "operation_id").distinct()


def merged_operations(client: DataFrame, server: DataFrame) -> DataFrame:
    """operation_id, symbol and source of called and served operations; what the project calls itself is a client's."""
    known = client.select("operation_id").distinct()
    served = server.join(known, "operation_id", "left_anti").withColumn("source", F.lit("server"))
    return client.withColumn("source", F.lit("client")).unionByName(served)


def operations_of(pairs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Sorted operations of the given endpoints (method, path)."""
    own = pairs.join(endpoints.select("method", "path").distinct(), ["method", "path"])
    return own.groupBy("method", "path").agg(F.array_sort(F.collect_set("operation_id")).alias("operations"))


def endpoints_of(pairs: DataFrame, operations: DataFrame) -> DataFrame:
    """Sorted endpoints of the given operations."""
    own = pairs.join(operations.select("operation_id").distinct(), "operation_id")
    return own.groupBy("operation_id").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "method", "path"))).alias("endpoints"))


def operation_endpoints(resolved: DataFrame, calls: DataFrame, remote: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The pairs of endpoint_operations(), found the other way: from remote calls up to the handlers they serve."""
    asked = remote.select(F.col("operation_id").alias("root_id"), F.col("caller_symbol").alias("node")).distinct()
    edges = calls.select(F.col("callee").alias("node"), F.col("caller").alias("next"))
    found = closure.reach(edges, asked, limits).select(F.col("root_id").alias("operation_id"), F.col("node").alias("handler_symbol"))
    return resolved.select("method", "path", "handler_symbol").distinct().join(found, "handler_symbol").select("method", "path", "operation_id").distinct()


def agreement(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """operation_id and how many of its pairs either direction has, and both."""
    marked = forward.select("operation_id", "method", "path", F.lit(1).alias("f"), F.lit(0).alias("b")).unionByName(backward.select("operation_id", "method", "path", F.lit(0).alias("f"), F.lit(1).alias("b")))
    each = marked.groupBy("operation_id", "method", "path").agg(F.max("f").alias("f"), F.max("b").alias("b"))
    return each.groupBy("operation_id").agg(F.sum("f").alias("forward"), F.sum("b").alias("backward"), F.sum(F.col("f") * F.col("b")).alias("agreed"))


def chains(handlers: DataFrame, calls: DataFrame, remote: DataFrame, limits: Limits | None = None) -> DataFrame:
    """root_id, operation_id and chain: all call paths from handlers (root_id, node) to remote calls, without cycles.

    Only symbols that can reach a remote call are walked.
    """
    edges = calls.select(F.col("caller").alias("node"), F.col("callee").alias("next"))
    ends = remote.select(F.col("caller_symbol").alias("node")).distinct()
    back = closure.reach(edges.select(F.col("next").alias("node"), F.col("node").alias("next")), ends.select(F.col("node").alias("root_id"), "node"), limits)
    useful = back.select("node").distinct()
    kept = edges.join(useful, "node").join(useful.withColumnRenamed("node", "next"), "next").select("node", "next", F.lit("call").alias("relation"))
    found = closure.paths(kept, handlers.join(useful, "node").select("root_id", "node"), limits).where(~F.col("cycle"))
    return found.join(remote.select(F.col("caller_symbol").alias("node"), "operation_id").distinct(), "node").select("root_id", "operation_id", F.col("path").alias("chain"))
