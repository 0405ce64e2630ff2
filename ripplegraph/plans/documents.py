"""Whole analyses of a project: facts, impact of a diff, endpoint operations, as documents.

Reachability, joins and endpoint resolution are DataFrames over all roots at once; what is reachable is bounded
by the budget before it comes to the driver, where nested trees, which Spark has no type for, are put together.
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S
from ripplegraph.operators import closure, contracts, dependency, diffs, endpoints, impact, modules, routes
from ripplegraph.operators.budgets import BudgetExceeded, ConfigInvalid, DiffInvalid, InvalidInput, Limits, OperationNotFound, check, check_diff, within
from ripplegraph.operators.lineage import settle
from ripplegraph.sources import project, recover, services
from ripplegraph.sources.project import FactBase


@dataclass(frozen=True)
class Config:
    """Whether module changes count, and which modules (names or globs) don't."""

    analyze_module_changes: bool = True
    ignored_module_changes: tuple[str, ...] = ()

    @staticmethod
    def read(path: str | None) -> Config:
        """Strict: unknown fields, other types and bad patterns are errors; a missing default file is none."""
        if path is None or not os.path.exists(path):
            return Config()
        try:
            with open(path) as f:
                given = json.load(f)
        except ValueError as e:
            raise ConfigInvalid(f"{path}: {e}") from e
        if not isinstance(given, dict) or set(given) - {"analyzeModuleChanges", "ignoredModuleChanges"}:
            raise ConfigInvalid(f"{path}: unknown fields")
        on, ignored = given.get("analyzeModuleChanges", True), given.get("ignoredModuleChanges", [])
        if not isinstance(on, bool) or not isinstance(ignored, list) or not all(isinstance(g, str) and g for g in ignored):
            raise ConfigInvalid(f"{path}: fields of the wrong type")
        if any(g.count("[") != g.count("]") for g in ignored):
            raise ConfigInvalid(f"{path}: malformed pattern")
        return Config(on, tuple(ignored))

    def ignores(self, module: str) -> bool:
        return any(module == g or fnmatch.fnmatchcase(module, g) and g.count("/") == module.count("/") for g in self.ignored_module_changes)


def facts_document(fb: FactBase) -> dict:
    """All public relations in order of their ids."""

    def span(r) -> dict:
        return {"file": r.file, "start_line": r.sl, "start_col": r.sc, "end_line": r.el, "end_col": r.ec}

    def rows(df: DataFrame, make) -> list[dict]:
        return [{k: v for k, v in make(r).items() if v is not None} for r in df.orderBy("id").toLocalIterator()]

    evidence = {"call": "call_expr", "type": "type_expr", "value": "value_expr"}
    return {
        "project": {"root": ".", "module_path": fb.module_path},
        "symbols": rows(fb.symbols, lambda r: {"id": r.id, "kind": r.kind, "package_path": r.package_path, "receiver": r.receiver, "name": r.name, "span": span(r)}),
        "references": rows(fb.references, lambda r: {"id": r.id, "kind": r.kind, "from_symbol": r.from_symbol, "to_symbol": r.to_symbol, "to_raw": r.to_raw, "span": span(r), "evidence": [{"kind": evidence[r.kind], "raw": r.to_raw, "span": span(r)}]}),
        "annotations": rows(fb.annotations, lambda r: {"id": r.id, "method": r.method, "path": r.path, "raw": r.raw, "handler_symbol": r.handler_symbol, "span": span(r)}),
        "route_groups": rows(fb.route_groups, lambda r: {"id": r.id, "group_var": r.group_var, "parent_group_id": r.parent_group_id, "prefix": r.prefix, "route_func": r.route_func, "statement_index": r.statement_index, "span": span(r)}),
        "routes": rows(fb.routes, lambda r: {"id": r.id, "method": r.method, "local_path": r.local_path, "path_raw": r.path_raw, "resolved_path": r.resolved_path, "group_id": r.group_id, "handler_raw": r.handler_raw, "handler_symbol": r.handler_symbol, "wrappers": [w.asDict() for w in r.wrappers or []], "route_func": r.route_func, "statement_index": r.statement_index, "span": span(r)}),
        "middleware": rows(fb.middleware, lambda r: {"id": r.id, "group_id": r.group_id, "middleware_raw": r.middleware_raw, "middleware_symbols": r.middleware_symbols or [], "route_func": r.route_func, "statement_index": r.statement_index, "span": span(r)}),
        "im_events": rows(fb.im_events, lambda r: {"id": r.id, "event": r.event, "event_raw": r.event_raw, "sender_symbol": r.sender_symbol, "resolved": r.resolved, "evidence": [span(e) for e in r.evidence]}),
        "grpc_operations": [{"id": r.operation_id, "source": r.source, "symbols": r.symbols} for r in services.operations(fb).groupBy("operation_id", "source").agg(F.array_sort(F.collect_set("symbol")).alias("symbols")).orderBy("operation_id").collect()],
        "modules": [{k: v for k, v in r.asDict().items() if v is not None and k != "path"} for r in fb.modules.orderBy("module").collect()],
        "diagnostics": [r.asDict() for r in fb.diagnostics.unionByName(services.diagnostics(fb)).orderBy("file", "code", "message").collect()],
    }


def endpoint_resolutions(fb: FactBase) -> DataFrame:
    return endpoints.resolutions(fb.routes, fb.annotations)


def group_subtree(fb: FactBase, limits: Limits | None = None) -> DataFrame:
    return settle(routes.group_routes(routes.group_edges(fb.route_groups, fb.flows), fb.routes, limits))


def steps(fb: FactBase, resolved: DataFrame, subtree: DataFrame) -> DataFrame:
    """node, next, relation and raw of all steps that a walk from a change takes, and the order among them."""
    no = lambda: F.lit(None).cast("string")
    refs = fb.references.select(F.col("to_symbol").alias("node"), F.col("from_symbol").alias("next"), S.reference_relation(F.col("kind")).alias("relation"), F.col("to_raw").alias("raw"), F.col("sl").alias("line"))
    handled = fb.routes.where("handler_symbol is not null").select(F.col("handler_symbol").alias("node"), F.col("id").alias("next"), F.lit("registered_handler").alias("relation"), F.col("handler_raw").alias("raw"), F.col("sl").alias("line"))
    depends = routes.route_dependencies(fb.references, fb.routes).select("to_symbol", "route_id").unionByName(routes.group_dependencies(fb.references, fb.route_groups, subtree))
    raw = fb.routes.select(F.col("id").alias("route_id"), "handler_raw", F.col("sl").alias("line"))
    near = depends.distinct().join(raw, "route_id").select(F.col("to_symbol").alias("node"), F.col("route_id").alias("next"), F.lit("route_dependency").alias("relation"), F.col("handler_raw").alias("raw"), "line")
    guarded = fb.middleware.select(F.explode("middleware_symbols").alias("node"), F.col("id").alias("next"), F.lit("middleware_symbol").alias("relation"), F.col("middleware_raw").alias("raw"), F.col("sl").alias("line"))
    covers = routes.middleware_routes(fb.middleware, subtree, fb.routes).join(raw, "route_id").select(F.col("middleware_id").alias("node"), F.col("route_id").alias("next"), F.lit("middleware_applies_to").alias("relation"), F.col("handler_raw").alias("raw"), "line")
    holds = subtree.join(raw, "route_id").select(F.col("ancestor").alias("node"), F.col("route_id").alias("next"), F.lit("route_group_contains").alias("relation"), F.col("handler_raw").alias("raw"), "line")
    noted = fb.annotations.select(F.col("id").alias("annotation_id"), F.col("raw").alias("_raw"), F.col("sl").alias("line"))
    r = resolved.join(noted, "annotation_id", "left")
    end = F.concat_ws(":", F.lit("endpoint"), "method", "path")
    to_note = r.where("annotation_id is not null and route_id is not null").select(F.col("route_id").alias("node"), F.col("annotation_id").alias("next"), F.lit("handler_annotation").alias("relation"), F.col("_raw").alias("raw"), "line")
    note_end = r.where("annotation_id is not null").select(F.col("annotation_id").alias("node"), end.alias("next"), F.lit("annotation_endpoint").alias("relation"), no().alias("raw"), "line")
    relation = F.lit("route_endpoint")
    if "recovered" in fb.routes.columns:
        r = r.join(fb.routes.where("recovered").select(F.col("id").alias("route_id"), "recovered"), "route_id", "left")
        relation = F.when(F.col("recovered"), "deleted_route_endpoint").otherwise(relation)
    route_end = r.where("annotation_id is null").select(F.col("route_id").alias("node"), end.alias("next"), relation.alias("relation"), no().alias("raw"), F.lit(0).alias("line"))
    out = refs
    for part in (handled, near, guarded, covers, holds, to_note, note_end, route_end):
        out = out.unionByName(part)
    return out.groupBy("node", "next", "relation").agg(F.min_by("raw", "line").alias("raw"))


def node_rows(fb: FactBase, resolved: DataFrame) -> DataFrame:
    """id, kind, name, file, package, method and path of all nodes of a walk."""
    no = lambda: F.lit(None).cast("string")
    path = F.coalesce("resolved_path", "local_path")
    out = fb.symbols.select("id", "kind", "name", "file", F.col("package_path").alias("package"), no().alias("method"), no().alias("path"))
    out = out.unionByName(fb.routes.select("id", F.lit("route").alias("kind"), F.trim(F.concat_ws(" ", "method", path)).alias("name"), "file", no().alias("package"), "method", path.alias("path")))
    out = out.unionByName(fb.route_groups.select("id", F.lit("route_group").alias("kind"), F.col("group_var").alias("name"), "file", no().alias("package"), no().alias("method"), no().alias("path")))
    out = out.unionByName(fb.middleware.select("id", F.lit("middleware").alias("kind"), F.col("middleware_raw").alias("name"), "file", no().alias("package"), no().alias("method"), no().alias("path")))
    out = out.unionByName(fb.annotations.select("id", F.lit("annotation").alias("kind"), F.concat_ws(" ", "method", "path").alias("name"), "file", no().alias("package"), "method", "path"))
    where = fb.annotations.select(F.col("id").alias("annotation_id"), F.col("file").alias("_a")), fb.routes.select(F.col("id").alias("route_id"), F.col("file").alias("_r"))
    ends = resolved.join(where[0], "annotation_id", "left").join(where[1], "route_id", "left").groupBy("method", "path").agg(F.min(F.coalesce("_a", "_r")).alias("file"))
    return out.unionByName(ends.select(F.concat_ws(":", F.lit("endpoint"), "method", "path").alias("id"), F.lit("endpoint").alias("kind"), F.concat_ws(" ", "method", "path").alias("name"), "file", no().alias("package"), "method", "path"))


class Walk:
    """Trees of simple paths over the reachable steps. Every node counts against the budget before it is merged."""

    def __init__(self, edges: list, nodes: dict[str, dict], limits: Limits):
        self.nodes, self.limits, self.total, self.of_root = nodes, limits, 0, 0
        self.next = defaultdict(list)
        for e in sorted(edges, key=lambda e: (e.node, e.relation, e.next)):
            self.next[e.node].append(e)

    def tree(self, root: str) -> dict:
        self.of_root = 0
        return self._node(root, None, None, 0, {root})

    def _node(self, node: str, relation: str | None, raw: str | None, level: int, path: set[str]) -> dict:
        self.total += 1
        self.of_root += 1
        if level > self.limits.depth:
            raise BudgetExceeded("depth", level, self.limits.depth)
        check("nodes per root", self.of_root, self.limits.nodes_per_root)
        check("total nodes", self.total, self.limits.total_nodes)
        known = self.nodes.get(node) or {"kind": node.split(":")[0], "name": node.split(":")[-1]}
        out = {"id": node, **{k: known.get(k) for k in ("kind", "name", "file", "package")}, "relation": relation, "raw": raw, "level": level, "method": known.get("method"), "path": known.get("path"), "children": []}
        for e in self.next[node]:
            if e.next in path:
                child = self._node_end(e, level + 1)
            else:
                path.add(e.next)
                child = self._node(e.next, e.relation, e.raw, level + 1, path)
                path.discard(e.next)
            out["children"].append(child)
        out["children"].sort(key=lambda c: (c["level"], c["kind"], c.get("file") or "", c.get("package") or "", c["id"], c.get("relation") or ""))
        return {k: v for k, v in out.items() if v is not None}

    def _node_end(self, e, level: int) -> dict:
        self.total += 1
        known = self.nodes.get(e.next, {})
        return {k: v for k, v in {"id": e.next, **{k: known.get(k) for k in ("kind", "name", "file", "package")}, "relation": e.relation, "raw": e.raw, "level": level, "cycle": True, "children": []}.items() if v is not None}


def label(node: dict) -> str:
    return node.get("name", "") if node["kind"] == "endpoint" else f"{node['kind']} {node.get('name') or node['id']}".strip()


def shortest_chains(tree: dict) -> dict[tuple[str, str], list[str]]:
    """Labels of the first shortest path to each endpoint of a tree."""
    found: dict[tuple[str, str], list[str]] = {}

    def visit(node: dict, path: list[str]) -> None:
        path = [*path, label(node)]
        if node["kind"] == "endpoint":
            key = node["method"], node["path"]
            if key not in found or len(path) < len(found[key]):
                found[key] = path
        for c in node["children"]:
            visit(c, path)

    visit(tree, [])
    return found


def facts_to_map(fb: FactBase) -> DataFrame:
    """kind, id, ordinal, file, sl and el of the facts that changed lines are tried on before symbols."""
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", F.lit(0).alias("ordinal"), "file", "sl", "el")
    return part(fb.annotations, "annotation").unionByName(part(fb.route_groups, "route_group")).unionByName(part(fb.routes, "route")).unionByName(part(fb.middleware, "middleware"))


def changed_modules(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Module changes that a diff of the top module file makes: its removed and added lines, old and new."""
    own = files.where("new_path = 'go.mod' or old_path = 'go.mod'").select("diff_id", "file_no")
    text = lines.where("kind in ('add', 'del')").join(own, ["diff_id", "file_no"]).select("kind", S.strip(F.substring("line", 2, 1 << 30)).alias("text"))
    bare = text.select("kind", F.regexp_replace("text", r"^(require|replace)\s+", "").alias("text"))
    required = bare.where(~F.col("text").contains("=>")).select("kind", F.split("text", r"\s+").alias("f")).where(F.get("f", F.lit(1)).startswith("v")).select("kind", F.get("f", F.lit(0)).alias("path"), F.get("f", F.lit(1)).alias("version"))
    sides = F.split("text", r"\s*=>\s*")
    left, right = F.split(F.get(sides, F.lit(0)), r"\s+"), F.split(F.get(sides, F.lit(1)), r"\s+")
    replaced = bare.where(F.col("text").contains("=>")).select("kind", F.get(left, F.lit(0)).alias("path"), F.get(right, F.lit(0)).alias("replace_path"), F.get(right, F.lit(1)).alias("replace_version"))
    both = required.join(replaced, ["kind", "path"], "full")
    return settle(modules.changes(both.where("kind = 'del'").drop("kind"), both.where("kind = 'add'").drop("kind")))


@dataclass
class Changed:
    """A project, and what a diff changes in it."""

    fb: FactBase
    files: DataFrame
    roots: DataFrame
    modules: DataFrame
    usage: DataFrame
    module_diff: bool
    limits: Limits
    mapped: DataFrame


def changed(spark: SparkSession, root: str, diff: str, config: Config | None, limits: Limits | None, verify: bool = True, recovering: bool = True, build: dict | None = None) -> Changed:
    """The roots of a unified diff: facts and symbols its lines hit, deleted routes, and users of changed modules."""
    limits, config = (limits or Limits()).normalised(), config or Config()
    check_diff(diff, limits)
    lines = settle(diffs.diff_lines(spark.createDataFrame([(0, diff)], "diff_id int, content string")))
    diffs.check_parsed(lines)
    files = settle(diffs.diff_files(lines))
    check("files", files.count(), limits.files)
    fb = within(spark, limits.load_seconds, "load", lambda: project.load(spark, root, **(build or {})))
    named = files.select("diff_id", "file_no", F.when(F.col("new_path") == "", F.col("old_path")).otherwise(F.col("new_path")).alias("file"), "status", "raw")
    if verify:
        text = fb.files.join(named.select(F.col("file").alias("path")).distinct(), "path").select(F.col("path").alias("file"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("_i", "text"))
        diffs.check_applied(diffs.unapplied(diffs.expected_lines(lines, files), files, text.select("file", (F.col("_i") + 1).alias("line"), "text"), diffs.deleted_blocks(lines)))
    broken = fb.diagnostics.where("severity = 'error'").join(named.select("file"), "file").first()
    if broken:
        raise DiffInvalid(f"a changed file can't be parsed: {broken.message}")
    ranges = diffs.diff_ranges(lines, files).join(named.select("diff_id", "file_no", "file"), ["diff_id", "file_no"])
    changed = ranges.select("file", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    mapped = settle(diffs.changes(diffs.map_lines(changed, facts_to_map(fb), fb.symbols)))
    found_modules = changed_modules(lines, files)
    module_diff = not found_modules.isEmpty()
    if not config.analyze_module_changes:
        found_modules = found_modules.where("false")
    found_modules = settle(modules.not_ignored(found_modules, list(config.ignored_module_changes)))
    uses = fb.mentions.where("imported is not null").join(fb.imports.select("file", "alias", "import_path"), "file").where("alias = parts[0]").select("file", "alias", F.col("from_symbol").alias("symbol_id")).distinct()
    usage = settle(modules.usages(found_modules, fb.imports.select("file", "alias", "import_path"), uses, fb.symbols.select("id", "file")))
    roots = mapped.select(F.coalesce("target_id", "file").alias("root_id"), F.col("kind"), "file", F.lit(None).cast("string").alias("module_path"), F.lit("diff").alias("source"))
    roots = roots.unionByName(modules.roots(usage).select(F.col("target_id").alias("root_id"), F.when(F.col("kind") == "file_changed", "file").otherwise("symbol").alias("kind"), "file", "module_path", "source"))
    recovered = recover.deleted_routes(spark, fb, diffs.deleted_blocks(lines), named) if recovering else None
    if recovered is not None:
        # A file root that only stands for recovered lines goes.
        own = recovered.select(F.col("id").alias("root_id"), F.lit("route").alias("kind"), "file", F.lit(None).cast("string").alias("module_path"), F.lit("diff").alias("source"))
        gone = roots.where("kind = 'file' and source = 'diff'").join(recovered.select("file"), "file", "left_semi")
        roots = roots.exceptAll(gone).unionByName(own)
        fb.relations["routes"] = fb.routes.withColumn("recovered", F.lit(False)).unionByName(recovered, allowMissingColumns=True)
    roots = settle(roots.distinct())
    check("roots", roots.count(), limits.roots)
    return Changed(fb, named, roots, found_modules, usage, module_diff, limits, mapped)


def impact_document(spark: SparkSession, root: str, diff: str, config: Config | None = None, limits: Limits | None = None, operations: list[str] | None = None, verify: bool = True, build: dict | None = None) -> dict:
    """The impact of a unified diff, applied to the project below root, on its endpoints and outbound events; of operations as well.

    build: what project.load() takes besides the folder.
    """
    c = changed(spark, root, diff, config, limits, verify, build=build)
    fb, roots, limits = c.fb, c.roots, c.limits
    resolved, subtree = settle(endpoint_resolutions(fb)), group_subtree(fb, limits)
    edges = settle(steps(fb, resolved, subtree))
    # A root annotation leads to the routes of its handler.
    starts = roots.where("kind <> 'file'").select("root_id", F.col("root_id").alias("node")).distinct()
    extra = fb.annotations.join(starts.select(F.col("root_id").alias("id")), "id").select(F.col("id").alias("node"), "handler_symbol").join(fb.routes.select("handler_symbol", F.col("id").alias("next"), "handler_raw"), "handler_symbol")
    edges = edges.unionByName(extra.select("node", "next", F.lit("registered_route").alias("relation"), F.col("handler_raw").alias("raw")))
    reached = within(spark, limits.walk_seconds, "walk", lambda: closure.reach(edges.select("node", "next"), starts, limits)).select("node").distinct()
    near = edges.join(reached, "node").collect()  # within the budget by now
    nodes = {r.id: r.asDict() for r in node_rows(fb, resolved).join(reached.withColumnRenamed("node", "id"), "id").collect()}
    evidence = defaultdict(set)
    for r in resolved.join(fb.routes.select(F.col("id").alias("route_id"), F.col("method").alias("_m"), F.coalesce("resolved_path", "local_path").alias("_p")), "route_id").select("method", "path", "_m", "_p").collect():
        evidence[r.method, r.path].add((r["_m"], r["_p"]))
    sent = sent_events(fb, reached, c.mapped)
    out = _assemble(roots.collect(), c.files.collect(), c.modules.collect(), c.usage.collect(), Walk(near, nodes, limits), evidence, c.module_diff, sent)
    return out | {"grpcSources": operation_sources(spark, fb, operations, limits) if operations else []}


class Sent:
    """Which events a tree of dependents sends: those whose sender ends a path through one of their dependencies, and
    those of a changed sender whose evidence the changed lines touch.
    """

    def __init__(self, by_sender: dict[str, list[tuple[str, set[str]]]], touched: dict[str, set[str]]):
        self.by_sender, self.touched = by_sender, touched

    def of(self, tree: dict) -> set[str]:
        found = set(self.touched.get(tree["id"], ()))

        def visit(node: dict, path: set[str]) -> None:
            path = path | {node["id"]}
            found.update(event for event, needs in self.by_sender.get(node["id"], ()) if needs & path)
            for child in node["children"]:
                visit(child, path)

        visit(tree, set())
        return found


def sent_events(fb: FactBase, reached: DataFrame, mapped: DataFrame) -> Sent:
    """The events of reached senders, with what they hang on."""
    name = F.coalesce("event", "event_raw")
    own = settle(fb.im_events.join(reached.select(F.col("node").alias("sender_symbol")), "sender_symbol").select("id", name.alias("event"), "sender_symbol", "evidence"))
    needs = defaultdict(set)
    for r in fb.im_dependencies.join(own.select("id"), "id").collect():  # of senders within the budget
        needs[r.id].add(r.symbol_id)
    by_sender = defaultdict(list)
    for r in own.collect():
        by_sender[r.sender_symbol].append((r.event, needs[r.id]))
    places = own.select("event", "sender_symbol", F.explode("evidence").alias("e")).select("event", "sender_symbol", F.col("e.file").alias("evidence_file"), F.col("e.sl").alias("evidence_start"), F.col("e.el").alias("evidence_end"))
    changes = mapped.where("target_id is not null").select(F.col("target_id").alias("change_id"), F.col("target_id").alias("symbol_id"), "file", "start_line", "end_line")
    touched = defaultdict(set)
    for r in impact.events_by_evidence(changes, places).collect():
        touched[r.change_id].add(r.event)
    return Sent(by_sender, touched)


def operation_sources(spark: SparkSession, fb: FactBase, asked: list[str], limits: Limits | None = None) -> list[dict]:
    """The endpoints that lead to each asked operation (`<import path>.<Service>/<Method>`)."""
    package, service, method = S.parse_operation(F.col("raw"))
    parsed = spark.createDataFrame([(a,) for a in asked], "raw string").withColumn("operation_id", F.concat(F.lit("grpc:"), S.operation_identity(package, service, method)))
    bad = parsed.where("operation_id is null").first()
    if bad:
        raise InvalidInput(f"not an operation: {bad.raw!r}")
    remote = services.client_calls(fb, strict=True)
    unknown = parsed.join(remote, "operation_id", "left_anti").first()
    if unknown:
        raise OperationNotFound(unknown.raw)
    pairs = dependency.endpoint_operations(endpoint_resolutions(fb), impact.calls(fb.references), remote, limits)
    found = dependency.endpoints_of(pairs, parsed).join(parsed, "operation_id", "right")
    return [{"grpc": {"identity": r.raw, "goMethod": r.raw.rsplit("/", 1)[-1]}, "impactedEndpoints": [dict(zip(("method", "path"), e.split(" ", 1))) for e in r.endpoints or []]} for r in found.orderBy("raw").collect()]


def service_document(spark: SparkSession, root: str, diff: str, config: Config | None = None, limits: Limits | None = None, verify: bool = True, build: dict | None = None) -> dict:
    """The impact of a diff on the contracts of four protocols. Generated glue is not walked through; deleted routes
    and annotations play no part, so HTTP contracts are named by their routes.
    """
    c = changed(spark, root, diff, config, limits, verify, recovering=False, build=build)
    fb, limits = c.fb, c.limits
    found = settle(services.all_contracts(fb))
    # What a root that is no symbol stands for: the handlers of its routes, the function that registers it.
    subtree = group_subtree(fb, limits)
    handler = fb.routes.where("handler_symbol is not null").select(F.col("id").alias("route_id"), "handler_symbol")
    stands = subtree.join(handler, "route_id").select(F.col("ancestor").alias("root_id"), F.col("handler_symbol").alias("node"))
    stands = stands.unionByName(routes.middleware_routes(fb.middleware, subtree, fb.routes).join(handler, "route_id").select(F.col("middleware_id").alias("root_id"), F.col("handler_symbol").alias("node")))
    stands = stands.unionByName(handler.select(F.col("route_id").alias("root_id"), F.col("handler_symbol").alias("node"))).unionByName(fb.annotations.select(F.col("id").alias("root_id"), F.col("handler_symbol").alias("node")))
    roots = c.roots.where("kind <> 'file'").select("root_id").distinct()
    # Changed facts other than symbols lead to their own contracts and no further.
    symbols = roots.join(fb.symbols.select(F.col("id").alias("root_id")), "root_id").select("root_id", F.col("root_id").alias("node"))
    walked = contracts.impact(fb.references, symbols, found, limits)
    direct = roots.join(stands, "root_id").join(found.where("kind = 'http'").withColumnRenamed("entry_symbol", "node"), "node").select("root_id", "id", "kind", "identity", F.lit(0).alias("level"))
    hit = settle(walked.unionByName(direct).groupBy("root_id", "id", "kind", "identity").agg(F.min("level").alias("level")))
    where = c.roots.select("root_id", "file", "module_path").distinct()
    rows = hit.join(where, "root_id").join(found.groupBy("id").agg(F.min("resolution").alias("resolution")), "id").collect()
    contract = lambda r: {"id": r.id, "kind": r.kind, "identity": r.identity, "identityResolution": r.resolution}

    def buckets(own: list) -> dict:
        unique = {r.id: contract(r) for r in own}
        return {k: [unique[i] for i in sorted(unique, key=lambda i: (unique[i]["identity"], i)) if unique[i]["kind"] == k] for k in contracts.PROTOCOLS}

    files = []
    for f in sorted({f.file for f in c.files.collect()} | {r.file for r in rows if not r.module_path}):
        own = [r for r in rows if r.file == f and not r.module_path]
        files.append({"sourceFile": f, "roots": sorted({r.root_id for r in own}), "impactedContracts": buckets(own)})
    reverse = {k: [] for k in contracts.PROTOCOLS}
    for i in sorted({r.id for r in rows}, key=lambda i: (next(r.identity for r in rows if r.id == i), i)):
        own = [r for r in rows if r.id == i]
        sources = sorted({(r.module_path or "", r.file) for r in own})
        entry = contract(own[0]) | {"sources": [{"sourceType": "module" if m else "file", **({"modulePath": m} if m else {}), "sourceFile": f, "roots": sorted({(r.root_id, r.level) for r in own if (r.module_path or "", r.file) == (m, f)})} for m, f in sources]}
        for source in entry["sources"]:
            source["roots"] = [{"id": root_id, "level": level} for root_id, level in source["roots"]]
        reverse[own[0].kind].append(entry)
    out = {"summary": buckets(rows), "fileSources": files}
    if not c.modules.isEmpty():
        out["moduleSources"] = [{"modulePath": m.path, "changeType": m.kind, "impactedContracts": buckets([r for r in rows if r.module_path == m.path])} for m in c.modules.orderBy("path").collect()]
    return out | {"entrySourcesSummary": reverse}


def _assemble(roots: list, files: list, found_modules: list, usage: list, walk: Walk, evidence: dict, module_diff: bool, sent: Sent) -> dict:
    by_file, by_module, all_ends, all_events = {}, {}, set(), set()
    strongest = defaultdict(lambda: "unreferenced")
    for u in usage:
        strongest[u.module_path] = max(strongest[u.module_path], u.basis, key=S.BASIS_RANKS.get)
    for f in sorted(files, key=lambda f: (f.file, f.diff_id, f.file_no)):
        if f.file != "go.mod" or not module_diff:
            own = by_file.setdefault(f.file, {"sourceFile": f.file, "diff": "", "symbols": {}, "ends": set(), "events": set()})
            own["diff"] += f.raw
    for m in sorted(found_modules, key=lambda m: m.path):
        fields = {"modulePath": m.path, "changeType": m.kind, "versionBefore": m.old_version, "versionAfter": m.new_version}
        for side, p, v in (("replacementBefore", m.old_replace_path, m.old_replace_version), ("replacementAfter", m.new_replace_path, m.new_replace_version)):
            fields[side] = {"path": p} | ({"version": v} if v else {}) if p else None
        by_module[m.path] = {k: v for k, v in fields.items() if v is not None} | {"basis": strongest[m.path], "files": {}}
    sources = defaultdict(lambda: defaultdict(lambda: {"rootSymbols": {}, "chains": set()}))
    trees: dict[str, dict] = {}
    for r in sorted(roots, key=lambda r: (r.root_id, r.file, r.module_path or "")):
        if r.file == "go.mod" and r.source == "diff" and module_diff:
            continue
        if r.kind == "file":
            key, tree = "__non_symbol__", {"id": r.file, "kind": "file", "name": r.file, "file": r.file, "level": 0, "children": []}
        else:
            key, tree = r.root_id, trees.setdefault(r.root_id, None) or walk.tree(r.root_id)
            trees[r.root_id] = tree
        owner = by_module[r.module_path]["files"] if r.module_path else by_file
        own = owner.setdefault(r.file, {"sourceFile": r.file, "diff": "", "symbols": {}, "ends": set(), "events": set()})
        own["symbols"][key] = tree
        own["events"] |= sent.of(tree)
        all_events |= own["events"]
        for end, chain in shortest_chains(tree).items():
            own["ends"].add(end)
            all_ends.add(end)
            m = by_module.get(r.module_path)
            source = ("module", r.module_path, r.file) if m else ("file", "", r.file)
            entry = sources[end][source]
            entry["rootSymbols"][tree["id"]] = {k: tree[k] for k in ("id", "kind", "name", "file") if tree.get(k)}
            entry["chains"].add(tuple([f"module {r.module_path}", f"import {r.file}", *chain] if m else chain))

    def ends(found: set) -> list[dict]:
        return [{"method": m, "path": p, "routes": [{"method": a, "path": b} for a, b in sorted(evidence[m, p], key=str)]} for m, p in sorted(found)]

    def file_source(own: dict) -> dict:
        out = {"sourceFile": own["sourceFile"], "diff": own["diff"], "symbols": dict(sorted(own["symbols"].items())), "impactedEndpoints": ends(own["ends"]), "impactedIMEvents": sorted(own["events"])}
        return out if own["diff"] else {k: v for k, v in out.items() if k != "diff"}

    summary = []
    for (method, path), of_end in sorted(sources.items()):
        rows = []
        for (kind, name, file), entry in sorted(of_end.items()):
            module = {k: by_module[name][k] for k in ("modulePath", "changeType", "versionBefore", "versionAfter") if k in by_module[name]} if kind == "module" else {}
            rows.append({"sourceType": kind, "sourceFile": file, **module} | {"rootSymbols": [entry["rootSymbols"][k] for k in sorted(entry["rootSymbols"])], "chains": [list(c) for c in sorted(entry["chains"])]})
        summary.append({"method": method, "path": path, "sources": rows})
    out = {
        "summary": {"impactedEndpointCount": len(all_ends), "impactedEndpoints": ends(all_ends), "impactedIMCount": len(all_events), "impactedIMEvents": sorted(all_events)},
        "fileSources": [file_source(by_file[f]) for f in sorted(by_file)],
    }
    if by_module:
        out["moduleSources"] = [{**{k: v for k, v in m.items() if k != "files"}, "sourceFiles": [file_source(m["files"][f]) for f in sorted(m["files"])]} for _, m in sorted(by_module.items())]
    return out | {"endpointSourcesSummary": summary}


def endpoint_assets(spark: SparkSession, fb: FactBase, asked: list[str], remote: DataFrame, limits: Limits | None = None) -> dict:
    """The remote operations of each asked endpoint (`METHOD /path`); an unknown one fails the whole query."""
    df = spark.createDataFrame([(a,) for a in asked], "raw string")
    method, path = S.parse_endpoint(F.col("raw"))
    parsed = df.select("raw", method.alias("method"), path.alias("path"))
    bad = parsed.where("method is null").first()
    if bad:
        raise InvalidInput(f"not an endpoint: {bad.raw!r}")
    resolved = settle(endpoint_resolutions(fb))
    found = endpoints.lookup(parsed, resolved, fb.routes, strict=True)
    pairs = dependency.endpoint_operations(resolved, impact.calls(fb.references), remote, limits)
    own = found.join(pairs, ["method", "path"], "left").groupBy("method", "path").agg(F.array_sort(F.collect_set("operation_id")).alias("operations"))
    return {"endpoints": [{"method": r.method, "path": r.path, "operations": r.operations} for r in own.orderBy("method", "path").collect()]}


def write_json(document: dict, path: str) -> None:
    """Indented, stable JSON, in place only when whole."""
    text = json.dumps(document, indent=2, ensure_ascii=False) + "\n"
    with open(f"{path}.part", "w") as f:
        f.write(text)
    os.replace(f"{path}.part", path)
