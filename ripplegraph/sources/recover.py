"""Routes that a diff deletes, read back from the deleted lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S
from ripplegraph.operators import routes, spans
from ripplegraph.operators.lineage import settle
from ripplegraph.sources import golang, project
from ripplegraph.sources.extract import HTTP_METHODS, handler_like, last_name
from ripplegraph.sources.golang import selector_parts

_CALLS = "diff_id int, file_no long, file string, anchor int, i int, method string, path string, path_raw string, group_var string, handler_raw string, parts array<string>, handler array<string>"


def calls_in(text: str) -> list[dict]:
    """Route calls in a piece of a function's body; of one that is no piece, in each of its lines alone."""
    found = []
    for piece in [text, *text.split("\n")]:
        try:
            _, tree = golang.parse(f"package p\nfunc f() {{\n{piece}\n}}".encode())
        except golang.Unparsed:
            continue
        for x in tree.walk():
            if x.kind != "call" or x.fun.kind != "selector" or last_name(x.fun) not in HTTP_METHODS or len(x.args) < 2:
                continue
            group, handler = x.fun.x, x.args[1]
            while group.kind == "call" and group.args:
                group = group.args[0]
            while handler.kind == "call" and (likely := [a for a in handler.args if handler_like(a)]):
                handler = likely[-1]
            lit = x.args[0]
            path = lit.text[1:-1] if lit.kind == "lit" and lit.lit in ("str", "raw") else None
            if group.kind == "ident":
                raw = ".".join(selector_parts(handler) or [])
                found.append({"method": x.fun.name, "path": path, "path_raw": None if path is not None else "?", "group_var": group.name, "handler_raw": raw, "handler": selector_parts(handler)})
        if found:
            break
    return found


def deleted_routes(spark: SparkSession, fb: project.FactBase, blocks: DataFrame, named: DataFrame) -> DataFrame | None:
    """Route rows, `recovered`, of the deleted blocks of Go files that still exist; None if there are none.

    A route's group is the nearest one above with its variable in the enclosing function, else the parameter of
    that name. Routes that are still registered with the same method, path and function are no loss.
    """
    own = blocks.join(named.where("status <> 'deleted'"), ["diff_id", "file_no"]).where(F.col("file").endswith(".go"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for diff_id, file_no, file, anchor, lines in zip(b.diff_id, b.file_no, b.file, b.new_anchor, b.lines):
                for i, c in enumerate(calls_in("\n".join(lines))):
                    rows.append({"diff_id": diff_id, "file_no": file_no, "file": file, "anchor": anchor, "i": i, **c, "parts": c["handler"]})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CALLS.split(", ")])

    found = settle(own.select("diff_id", F.col("file_no").cast("long").alias("file_no"), "file", "new_anchor", "lines").mapInPandas(work, _CALLS))
    if found.isEmpty():
        return None
    functions = fb.symbols.where("kind in ('func', 'method')").select("file", "id", "package_path", "sl", "el")
    inside = spans.innermost(found.select("file", F.col("anchor").alias("line")).distinct(), functions, [])
    placed = found.join(inside.select("file", F.col("line").alias("anchor"), F.col("id").alias("route_func"), "package_path"), ["file", "anchor"])
    groups = fb.route_groups.select("file", "route_func", "group_var", F.col("sl").alias("since"), F.col("id").alias("group_id"))
    placed = spans.as_of(placed, groups, ["file", "route_func", "group_var"], "anchor", "since", ["group_id"], ["group_id"])
    number = lambda c: F.col(c).cast("string")
    rows = placed.select(
        F.concat_ws(":", F.lit("deleted_route"), "route_func", "method", F.coalesce("path", "path_raw"), number("anchor"), number("i")).alias("id"), "method", F.col("path").alias("local_path"), "path_raw",
        F.coalesce("group_id", F.concat_ws("::", "route_func", "group_var")).alias("group_id"), "group_var", "handler_raw", "route_func", F.lit(0).alias("statement_index"), "file", F.col("anchor").alias("sl"), F.lit(1).alias("sc"), F.col("anchor").alias("el"), F.lit(1).alias("ec"), "handler", "package_path",
    )
    rows = settle(rows.join(fb.routes.select("method", "local_path", "route_func"), ["method", "local_path", "route_func"], "left_anti"))
    imported = fb.imports.select("file", "alias", F.col("import_path").alias("imported"))
    asked = rows.where("handler is not null").withColumn("alias", F.get("handler", F.lit(0))).join(imported, ["file", "alias"], "left")
    mentions = asked.select(
        F.monotonically_increasing_id().cast("int").alias("n"), F.col("route_func").alias("from_symbol"), F.lit("handler").alias("role"), F.col("id").alias("owner"), "package_path", "file", "imported", F.col("handler").alias("parts"),
        F.lit(False).alias("is_local"), F.array().cast("array<struct<type_package: string, type_name_of: string, maker: string>>").alias("types"),
    )
    mentions = settle(project.keyed(mentions))
    inner = project.embedded(fb.embeds, fb.returns, fb.symbols)
    ends = project.chain_ends(mentions, fb.symbols, fb.relations["values"], fb.relations["fields"], fb.returns, fb.elements, fb.interfaces, inner)
    resolved = project.resolve(mentions, fb.symbols, ends, inner)
    handlers = resolved.groupBy(F.col("owner").alias("id")).agg(F.min("symbol").alias("handler_symbol"))
    full = routes.resolved_paths(rows.drop("handler", "package_path"), routes.group_prefixes(fb.route_groups.select("id", "parent_group_id", "prefix")))
    return settle(full.withColumn("resolved_path", S.collapse_slashes(F.col("resolved_path"))).join(handlers, "id", "left").withColumn("recovered", F.lit(True)))
