"""Reachability, paths, catalogs, contracts and summaries over the adapter relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S
from ripplegraph.operators import closure, contracts, dependency, endpoints, events, impact, links, routes
from ripplegraph.operators.lineage import scratch
from ripplegraph.plans.adapters import Relations
from ripplegraph.plans.registry import query

#: Changed symbols: all types and all suppliers.
ROOTS = "SELECT id AS root_id, id AS node FROM {v_symbols} WHERE kind = 'type' OR package_path = 'supplier'"
REACH = (
    "roots AS (" + ROOTS + "), "
    "reach(root_id, node, level) AS (SELECT root_id, node, 0 FROM roots UNION SELECT r.root_id, e.from_symbol, r.level + 1 FROM reach r JOIN {v_refs} e ON e.to_symbol = r.node WHERE r.level < 16), "
    "least AS (SELECT root_id, node, min(level) AS level FROM reach GROUP BY root_id, node)"
)
PREFIXES = (
    "gp(id, full_prefix) AS (SELECT id, CASE WHEN rtrim(ltrim(prefix, '/'), '/') = '' THEN '/' ELSE '/' || rtrim(ltrim(prefix, '/'), '/') END FROM {v_groups} WHERE parent_group_id IS NULL OR parent_group_id NOT IN (SELECT id FROM {v_groups}) "
    "UNION ALL SELECT g.id, CASE WHEN rtrim(ltrim(g.prefix, '/'), '/') = '' THEN p.full_prefix ELSE rtrim(p.full_prefix, '/') || '/' || rtrim(ltrim(g.prefix, '/'), '/') END FROM {v_groups} g JOIN gp p ON g.parent_group_id = p.id)"
)
RESOLVED_ROUTES = (
    "rr AS (SELECT r.id, r.handler_symbol, r.method, r.local_path, CASE WHEN r.local_path IS NULL THEN NULL ELSE CASE WHEN ltrim(rtrim(r.local_path, '/'), '/') = '' THEN coalesce(p.full_prefix, '/') ELSE rtrim(coalesce(p.full_prefix, ''), '/') || '/' || ltrim(rtrim(r.local_path, '/'), '/') END END AS resolved_path "
    "FROM {v_routes} r LEFT JOIN gp p ON r.group_id = p.id)"
)
RESOLUTIONS = (
    "res AS (SELECT handler_symbol, route_id, annotation_id, upper(trim(method)) AS method, trim(path) AS path, source FROM ("
    "SELECT a.handler_symbol, r.id AS route_id, a.id AS annotation_id, coalesce(nullif(a.method, ''), r.method) AS method, coalesce(nullif(a.path, ''), r.resolved_path) AS path, 'annotation' AS source FROM {v_annotations} a LEFT JOIN rr r ON a.handler_symbol = r.handler_symbol "
    "UNION ALL SELECT handler_symbol, id, NULL, method, resolved_path, 'route' FROM rr WHERE handler_symbol IS NULL OR handler_symbol NOT IN (SELECT handler_symbol FROM {v_annotations})) z WHERE method <> '' AND path <> '')"
)
CATALOG = ", ".join((PREFIXES, RESOLVED_ROUTES, RESOLUTIONS))
ENDS = "ends AS (SELECT DISTINCT handler_symbol AS node, method, path FROM res WHERE handler_symbol IS NOT NULL)"
SUBTREE = (
    "ge AS (SELECT DISTINCT parent_group_id AS parent, id AS child FROM {v_groups} WHERE parent_group_id IS NOT NULL), "
    "below(ancestor, descendant) AS (SELECT id, id FROM {v_groups} UNION SELECT b.ancestor, e.child FROM below b JOIN ge e ON e.parent = b.descendant), "
    "gr AS (SELECT DISTINCT b.ancestor, r.id AS route_id FROM below b JOIN {v_routes} r ON r.group_id = b.descendant)"
)


def roots(t: Relations) -> DataFrame:
    own = t("v_symbols").where("kind = 'type' or package_path = 'supplier'")
    return own.select(F.col("id").alias("root_id"), F.col("id").alias("node"))


def resolved_routes(t: Relations) -> DataFrame:
    return t.once("resolved_routes", lambda: routes.resolved_paths(t("v_routes"), routes.group_prefixes(t("v_groups"))))


def resolved(t: Relations) -> DataFrame:
    return t.once("resolved", lambda: endpoints.resolutions(resolved_routes(t), t("v_annotations")))


def ends(t: Relations) -> DataFrame:
    return impact.terminals(resolved(t))


def subtree(t: Relations) -> DataFrame:
    return routes.group_routes(routes.group_edges(t("v_groups")), t("v_routes"))


@query("reach_impact_summary", f"WITH RECURSIVE {REACH}, {CATALOG}, {ENDS} SELECT root_id, method, path, CAST(min(level) AS INTEGER) AS level FROM least JOIN ends USING (node) GROUP BY root_id, method, path")
def reach_impact_summary(t: Relations) -> DataFrame:
    return impact.affected_endpoints(t("v_refs"), roots(t), ends(t))


@query("min_distance", f"WITH RECURSIVE {REACH} SELECT root_id, node, CAST(level AS INTEGER) AS level FROM least")
def min_distance(t: Relations) -> DataFrame:
    return closure.reach(impact.reverse_edges(t("v_refs")), roots(t))


SMALL = "SELECT id AS root_id, id AS node FROM {v_symbols} WHERE package_path = 'supplier'"
PATHS = (
    "p(root_id, node, level, path, relations, is_cycle) AS (SELECT root_id, node, 0, [node], CAST([] AS VARCHAR[]), false FROM (" + SMALL + ") s "
    "UNION ALL SELECT p.root_id, e.from_symbol, p.level + 1, list_append(p.path, e.from_symbol), list_append(p.relations, e.relation), list_contains(p.path, e.from_symbol) "
    "FROM p JOIN (SELECT DISTINCT to_symbol, from_symbol, CASE kind WHEN 'type' THEN 'type_ref' WHEN 'value' THEN 'value_ref' ELSE 'call' END AS relation FROM {v_refs} WHERE kind <> 'call' OR from_symbol LIKE 'func:supplier%') e ON e.to_symbol = p.node WHERE NOT p.is_cycle)"
)


def small_trees(t: Relations) -> DataFrame:
    own = t("v_symbols").where("package_path = 'supplier'").select(F.col("id").alias("root_id"), F.col("id").alias("node"))
    return impact.trees(t("v_refs").where("kind <> 'call' or from_symbol like 'func:supplier%'"), own)


@query("impact_paths", f"WITH RECURSIVE {PATHS} SELECT root_id, node, CAST(level AS INTEGER) AS level, array_to_string(path, ' < ') AS path, array_to_string(relations, ',') AS relations FROM p")
def impact_paths(t: Relations) -> DataFrame:
    return small_trees(t).select("root_id", "node", "level", F.array_join("path", " < ").alias("path"), F.array_join("relations", ",").alias("relations"))


@query("cycle_flags", f"WITH RECURSIVE {PATHS} SELECT root_id, node, CAST(count(*) AS BIGINT) AS n FROM p WHERE is_cycle GROUP BY root_id, node")
def cycle_flags(t: Relations) -> DataFrame:
    return small_trees(t).where("cycle").groupBy("root_id", "node").agg(F.count("*").alias("n"))


@query("shortest_chain", f"WITH RECURSIVE {PATHS}, {CATALOG}, {ENDS}, h AS (SELECT root_id, e.method, e.path AS endpoint, p.level, p.path AS chain, row_number() OVER (PARTITION BY root_id, e.method, e.path ORDER BY len(p.path), p.path) AS n FROM p JOIN ends e USING (node) WHERE NOT is_cycle) SELECT root_id, method, endpoint, CAST(level AS INTEGER) AS level, array_to_string(chain, ' < ') AS chain FROM h WHERE n = 1")
def shortest_chain(t: Relations) -> DataFrame:
    found = impact.shortest_chains(small_trees(t), ends(t))
    return found.select("root_id", "method", F.col("path").alias("endpoint"), "level", F.array_join("chain", " < ").alias("chain"))


@query("reverse_refs", "SELECT to_symbol, string_agg(from_symbol || '|' || CAST(sl AS VARCHAR) || '|' || kind, ';' ORDER BY from_symbol, sl, kind, id) AS refs, CAST(count(*) AS BIGINT) AS n FROM {v_refs} WHERE to_symbol IS NOT NULL GROUP BY to_symbol")
def reverse_refs(t: Relations) -> DataFrame:
    shown = F.transform("references", lambda r: F.concat_ws("|", r["from_symbol"], r["sl"].cast("string"), r["kind"]))
    return impact.referrers(t("v_refs")).select("to_symbol", F.array_join(shown, ";").alias("refs"), F.size("references").cast("long").alias("n"))


@query("call_graph", "SELECT DISTINCT from_symbol AS caller, to_symbol AS callee FROM {v_refs} WHERE kind = 'call' AND from_symbol <> '' AND to_symbol <> ''")
def call_graph(t: Relations) -> DataFrame:
    return impact.calls(t("v_refs"))


@query("group_closure", f"WITH RECURSIVE {SUBTREE} SELECT ancestor, CAST(count(*) AS BIGINT) AS n_routes, min(route_id) AS first_route FROM gr GROUP BY ancestor")
def group_closure(t: Relations) -> DataFrame:
    return subtree(t).groupBy("ancestor").agg(F.count("*").alias("n_routes"), F.min("route_id").alias("first_route"))


@query("group_prefix_fold", f"WITH RECURSIVE {PREFIXES} SELECT id, full_prefix FROM gp")
def group_prefix_fold(t: Relations) -> DataFrame:
    return routes.group_prefixes(t("v_groups"))


@query("resolved_route_paths", f"WITH RECURSIVE {PREFIXES}, {RESOLVED_ROUTES} SELECT id, resolved_path FROM rr")
def resolved_route_paths(t: Relations) -> DataFrame:
    return resolved_routes(t).select("id", "resolved_path")


@query(
    "unique_prefix_fixpoint",
    "WITH RECURSIVE calls AS (SELECT DISTINCT 'n' || CAST(n_nationkey AS VARCHAR) AS callee, 'r' || CAST(n_regionkey AS VARCHAR) AS caller, '/r' || CAST(n_regionkey AS VARCHAR) AS prefix FROM nation UNION SELECT DISTINCT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR), '/n' || CAST(s_nationkey AS VARCHAR) FROM supplier UNION SELECT DISTINCT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST((s_nationkey + 1) % 25 AS VARCHAR), '/x' FROM supplier WHERE s_suppkey % 4 = 0 UNION SELECT 's' || CAST(s_suppkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR), '' FROM supplier WHERE s_suppkey % 5 = 0), "
    "f(node, prefix) AS (SELECT DISTINCT caller, '/api' FROM calls WHERE caller NOT IN (SELECT callee FROM calls) UNION SELECT c.callee, CASE WHEN c.prefix = '' THEN CASE WHEN f.prefix = '/' THEN '/' ELSE f.prefix END WHEN c.prefix = f.prefix OR starts_with(c.prefix, f.prefix || '/') THEN c.prefix ELSE f.prefix || c.prefix END FROM f JOIN calls c ON c.caller = f.node) "
    "SELECT node, min(prefix) AS prefix FROM f GROUP BY node HAVING count(DISTINCT prefix) = 1",
)
def unique_prefix_fixpoint(t: Relations) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    s = t("supplier")
    calls = (
        t("nation").select(key("n", F.col("n_nationkey")).alias("callee"), key("r", F.col("n_regionkey")).alias("caller"), key("/r", F.col("n_regionkey")).alias("prefix"))
        .union(s.select(key("s", F.col("s_suppkey")), key("n", F.col("s_nationkey")), key("/n", F.col("s_nationkey"))))
        .union(s.where("s_suppkey % 4 = 0").select(key("s", F.col("s_suppkey")), key("n", (F.col("s_nationkey") + 1) % 25), F.lit("/x")))
        .union(s.where("s_suppkey % 5 = 0").select(key("s", F.col("s_suppkey")), key("s", F.col("s_suppkey")), F.lit("")))
    )
    return routes.unique_prefixes(calls, calls.select(F.col("caller").alias("node"), F.lit("/api").alias("prefix")))


@query("middleware_after", f"WITH RECURSIVE {SUBTREE} SELECT DISTINCT m.id AS middleware_id, gr.route_id FROM {{v_middleware}} m JOIN gr ON gr.ancestor = m.group_id JOIN {{v_routes}} r ON r.id = gr.route_id WHERE m.route_func <> r.route_func OR m.statement_index < r.statement_index")
def middleware_after(t: Relations) -> DataFrame:
    return routes.middleware_routes(t("v_middleware"), subtree(t), t("v_routes"))


@query("middleware_symbol_routes", f"WITH RECURSIVE {SUBTREE} SELECT m.symbol, CAST(count(DISTINCT gr.route_id) AS BIGINT) AS n_routes FROM {{v_middleware}} m JOIN gr ON gr.ancestor = m.group_id JOIN {{v_routes}} r ON r.id = gr.route_id WHERE m.route_func <> r.route_func OR m.statement_index < r.statement_index GROUP BY m.symbol")
def middleware_symbol_routes(t: Relations) -> DataFrame:
    covered = routes.middleware_routes(t("v_middleware"), subtree(t), t("v_routes"))
    return covered.join(t("v_middleware").select(F.col("id").alias("middleware_id"), "symbol"), "middleware_id").groupBy("symbol").agg(F.count_distinct("route_id").alias("n_routes"))


SPAN_REFS = "sr AS (SELECT 'ref' || id AS id, route_func AS from_symbol, CASE WHEN statement_index % 2 = 0 THEN handler_symbol ELSE 'func:helper::H' || CAST(statement_index AS VARCHAR) END AS to_symbol, file, sl, sc + 2 AS sc, el, CAST(30 AS BIGINT) AS ec FROM {v_routes})"


def span_references(t: Relations) -> DataFrame:
    other = F.concat(F.lit("func:helper::H"), F.col("statement_index").cast("string"))
    return t("v_routes").select(F.concat(F.lit("ref"), "id").alias("id"), F.col("route_func").alias("from_symbol"), F.when(F.col("statement_index") % 2 == 0, F.col("handler_symbol")).otherwise(other).alias("to_symbol"), "file", "sl", (F.col("sc") + 2).alias("sc"), "el", F.lit(30).cast("long").alias("ec"))


@query("route_span_dependency", f"WITH {SPAN_REFS} SELECT i.id AS reference_id, i.to_symbol, o.id AS route_id FROM sr i JOIN {{v_routes}} o ON i.from_symbol = o.route_func AND i.file = o.file WHERE i.to_symbol IS DISTINCT FROM o.handler_symbol AND (o.sl < i.sl OR (o.sl = i.sl AND o.sc <= i.sc)) AND (o.el > i.el OR (o.el = i.el AND o.ec >= i.ec))")
def route_span_dependency(t: Relations) -> DataFrame:
    return routes.route_dependencies(span_references(t), t("v_routes"))


GROUP_SPANS = "gs AS (SELECT id, route_func, 'orders_' || CAST(CAST((sl - 1) // 10 AS BIGINT) % 97 AS VARCHAR) || '.go' AS file, sl, CAST(1 AS BIGINT) AS sc, el, CAST(80 AS BIGINT) AS ec FROM {v_groups} WHERE id LIKE 'group:o%')"


@query("group_span_dependency", f"WITH RECURSIVE {SUBTREE}, {SPAN_REFS}, {GROUP_SPANS} SELECT DISTINCT i.to_symbol, gr.route_id FROM sr i JOIN gs o ON i.from_symbol = o.route_func AND i.file = o.file JOIN gr ON gr.ancestor = o.id WHERE (o.sl < i.sl OR (o.sl = i.sl AND o.sc <= i.sc)) AND (o.el > i.el OR (o.el = i.el AND o.ec >= i.ec))")
def group_span_dependency(t: Relations) -> DataFrame:
    file = F.concat(F.lit("orders_"), (F.floor((F.col("sl") - 1) / 10) % 97).cast("string"), F.lit(".go"))
    groups = t("v_groups").where("id like 'group:o%'").select("id", "route_func", file.alias("file"), "sl", F.lit(1).cast("long").alias("sc"), "el", F.lit(80).cast("long").alias("ec"))
    return routes.group_dependencies(span_references(t), groups, subtree(t))


@query("endpoint_catalog", f"WITH RECURSIVE {CATALOG} SELECT method, path, coalesce(string_agg(DISTINCT handler_symbol, ',' ORDER BY handler_symbol), '') AS handlers, CAST(count(DISTINCT route_id) AS BIGINT) AS n_routes, CAST(count(DISTINCT annotation_id) AS BIGINT) AS n_annotations FROM res GROUP BY method, path")
def endpoint_catalog(t: Relations) -> DataFrame:
    found = endpoints.catalog(resolved(t))
    return found.select("method", "path", F.array_join("handlers", ",").alias("handlers"), F.size("routes").cast("long").alias("n_routes"), F.size("annotations").cast("long").alias("n_annotations"))


@query("uncovered_routes", f"WITH RECURSIVE {CATALOG} SELECT id, method FROM rr WHERE id NOT IN (SELECT route_id FROM res WHERE route_id IS NOT NULL)")
def uncovered_routes(t: Relations) -> DataFrame:
    return endpoints.uncovered_routes(resolved_routes(t), resolved(t)).select("id", "method")


LOOKUPS = "q AS (SELECT DISTINCT upper(trim(method)) AS q_method, trim(resolved_path) AS q_path FROM rr WHERE resolved_path IS NOT NULL UNION SELECT 'GET', '/s/' || CAST(s_suppkey AS VARCHAR) FROM supplier)"


@query("endpoint_lookup_fallback", f"WITH RECURSIVE {CATALOG}, {LOOKUPS}, known AS (SELECT DISTINCT method, path FROM res), f AS (SELECT q_method, q_path, res.method, res.path, row_number() OVER (PARTITION BY q_method, q_path ORDER BY res.method, res.path) AS n FROM q JOIN rr ON upper(trim(rr.method)) = q_method AND trim(coalesce(rr.resolved_path, rr.local_path)) = q_path JOIN res ON res.route_id = rr.id WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.method = q_method AND k.path = q_path)) SELECT q_method, q_path, method, path, 'exact' AS match FROM q JOIN known ON q_method = method AND q_path = path UNION ALL SELECT q_method, q_path, method, path, 'route' FROM f WHERE n = 1")
def endpoint_lookup_fallback(t: Relations) -> DataFrame:
    asked = resolved_routes(t).where("resolved_path is not null").select("method", F.col("resolved_path").alias("path"))
    asked = asked.union(t("supplier").select(F.lit("GET"), F.concat(F.lit("/s/"), F.col("s_suppkey").cast("string"))))
    return endpoints.lookup(asked, resolved(t), resolved_routes(t))


@query("route_diagnostics", "SELECT id, code FROM (SELECT id, 'route_dynamic_path' AS code FROM {v_routes} WHERE local_path IS NULL UNION ALL SELECT id, 'route_unresolved_handler' FROM {v_routes} WHERE handler_symbol IS NULL UNION ALL SELECT id, 'route_guessed_wrapper' FROM {v_routes} WHERE guessed) x")
def route_diagnostics(t: Relations) -> DataFrame:
    return routes.route_diagnostics(t("v_routes"))


EVENT_PATHS = (
    "er(root_id, node, path) AS (SELECT id, id, [id] FROM {v_symbols} WHERE package_path = 'nation' UNION ALL SELECT er.root_id, e.from_symbol, list_append(er.path, e.from_symbol) FROM er JOIN (SELECT DISTINCT to_symbol, from_symbol FROM {v_refs} WHERE kind = 'type') e ON e.to_symbol = er.node WHERE NOT list_contains(er.path, e.from_symbol))"
)


@query("im_event_match", f"WITH RECURSIVE {EVENT_PATHS} SELECT DISTINCT root_id, event, sender_symbol FROM er JOIN {{v_events}} v ON v.sender_symbol = er.node WHERE list_contains(er.path, v.symbol_id)")
def im_event_match(t: Relations) -> DataFrame:
    own = t("v_symbols").where("package_path = 'nation'").select(F.col("id").alias("root_id"), F.col("id").alias("node"))
    return impact.events_on_paths(impact.trees(t("v_refs").where("kind = 'type'"), own), t("v_events"))


@query("im_evidence_overlap", "SELECT DISTINCT s.id AS change_id, v.event FROM {v_symbols} s JOIN {v_events} v ON s.id = v.sender_symbol AND s.file = v.evidence_file WHERE s.sl <= CASE WHEN v.evidence_end = 0 THEN v.evidence_start ELSE v.evidence_end END AND v.evidence_start <= s.sl + 2")
def im_evidence_overlap(t: Relations) -> DataFrame:
    changes = t("v_symbols").select(F.col("id").alias("change_id"), F.col("id").alias("symbol_id"), "file", F.col("sl").alias("start_line"), (F.col("sl") + 2).alias("end_line"))
    return impact.events_by_evidence(changes, t("v_events"))


ALIVE = "reg AS (SELECT DISTINCT route_func AS symbol FROM {v_routes} UNION SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'func:x::Register' ELSE 'func:x::setup' END || CAST(s_suppkey AS VARCHAR) FROM supplier UNION SELECT 'func:supplier::S' || CAST(s_suppkey AS VARCHAR) FROM supplier), used AS (SELECT DISTINCT to_symbol FROM {v_refs} UNION SELECT DISTINCT route_func FROM {v_routes} WHERE statement_index = 1), alive AS (SELECT symbol, (symbol IN (SELECT to_symbol FROM used) OR regexp_extract(symbol, '[^:]*$') = 'main' OR starts_with(regexp_extract(symbol, '[^:]*$'), 'Register') OR starts_with(regexp_extract(symbol, '[^:]*$'), 'Initialize')) AS is_live FROM reg)"


def alive(t: Relations) -> DataFrame:
    s = t("supplier")
    registered = t("v_routes").select(F.col("route_func").alias("symbol")).union(s.select(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "func:x::Register").otherwise("func:x::setup"), F.col("s_suppkey").cast("string")))).union(s.select(F.concat(F.lit("func:supplier::S"), F.col("s_suppkey").cast("string"))))
    used = t.repeated("v_refs").select("to_symbol").union(t("v_routes").where("statement_index = 1").select("route_func"))
    return contracts.live(registered, used)


@query("liveness", f"WITH {ALIVE} SELECT symbol, is_live FROM alive")
def liveness(t: Relations) -> DataFrame:
    return alive(t)


CONTRACTS = (
    "con AS (SELECT DISTINCT kind || ':' || identity AS id, kind, identity, resolution, entry_symbol FROM ("
    "SELECT 'grpc' AS kind, 'example.com/api.Svc/M' || CAST(s_suppkey AS VARCHAR) AS identity, 'exact' AS resolution, unnest([h, 'func:impl::I' || CAST(s_suppkey AS VARCHAR), reg]) AS entry_symbol, reg FROM (SELECT *, 'func:supplier::S' || CAST(s_suppkey AS VARCHAR) AS h, 'func:x::Register' || CAST(s_suppkey AS VARCHAR) AS reg FROM supplier) a "
    "UNION ALL SELECT 'dubbo', 'com.x.I' || CAST(s_suppkey % 9 AS VARCHAR) || '/m' || CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN 'symbolic' ELSE 'exact' END, 'func:supplier::S' || CAST(s_suppkey AS VARCHAR), 'func:x::Register' || CAST(s_suppkey % 6 AS VARCHAR) FROM supplier "
    "UNION ALL SELECT 'http', method || ' ' || coalesce(resolved_path, 'raw' || id), CASE WHEN resolved_path IS NULL THEN 'symbolic' ELSE 'exact' END, handler_symbol, route_func FROM rr JOIN (SELECT id, route_func FROM {v_routes}) f USING (id) "
    "UNION ALL SELECT 'job', 'job' || CAST(s_suppkey AS VARCHAR), 'exact', 'func:supplier::S' || CAST(s_suppkey AS VARCHAR), 'func:supplier::S' || CAST(s_suppkey AS VARCHAR) FROM supplier) x WHERE entry_symbol IS NOT NULL AND reg IN (SELECT symbol FROM alive WHERE is_live))"
)


def contract_parts(t: Relations, resolved: DataFrame) -> tuple[DataFrame, ...]:
    s = t("supplier")
    k = F.col("s_suppkey").cast("string")
    named = lambda prefix, key=k: F.concat(F.lit(prefix), key)
    grpc = s.select(named("example.com/api.Svc/M").alias("identity"), named("func:supplier::S").alias("handler_symbol"), named("func:impl::I").alias("implementation_symbol"), named("func:x::Register").alias("registration_symbol"))
    dubbo = s.select(named("com.x.I", (F.col("s_suppkey") % 9).cast("string")).alias("interface"), named("m").alias("method"), F.when(F.col("s_suppkey") % 2 != 0, "1.0").alias("version"), named("func:supplier::S").alias("handler_symbol"), named("func:x::Register", (F.col("s_suppkey") % 6).cast("string")).alias("registration_symbol"))
    http = resolved.select("method", "resolved_path", F.concat(F.lit("raw"), "id").alias("path_raw"), "handler_symbol", "route_func")
    jobs = s.select(named("job").alias("name"), named("func:supplier::S").alias("handler_symbol"), named("func:supplier::S").alias("registration_symbol"))
    return grpc, dubbo, http, jobs, alive(t)


def all_contracts(t: Relations) -> DataFrame:
    return contracts.contracts(*contract_parts(t, resolved_routes(t)))


def contract_entries(t: Relations) -> DataFrame:
    """Of routes only what contracts are made of, which is read once."""
    unnamed = F.when(F.col("local_path").isNull(), F.col("id")).alias("id")
    own = t("v_routes").where("handler_symbol is not null").select(unnamed, "group_id", "method", "local_path", "handler_symbol", "route_func")
    return contracts.contract_entries(*contract_parts(t, routes.resolved_paths(own, routes.group_prefixes(t("v_groups")))))


@query("contract_index", f"WITH RECURSIVE {PREFIXES}, {RESOLVED_ROUTES}, {ALIVE}, {CONTRACTS} SELECT id, kind, identity, resolution, entry_symbol FROM con")
def contract_index(t: Relations) -> DataFrame:
    return all_contracts(t)


CONTRACT_IMPACT = f"WITH RECURSIVE {PREFIXES}, {RESOLVED_ROUTES}, {ALIVE}, {CONTRACTS}, {REACH}, ci AS (SELECT root_id, con.id, kind, identity, min(level) AS level FROM least JOIN con ON con.entry_symbol = least.node GROUP BY root_id, con.id, kind, identity)"


@query("contract_impact", CONTRACT_IMPACT + " SELECT root_id, id, kind, identity, CAST(level AS INTEGER) AS level FROM ci")
def contract_impact(t: Relations) -> DataFrame:
    return contracts.impact_by_entries(t.repeated("v_refs"), roots(t), contract_entries(t))


@query("protocol_groups", CONTRACT_IMPACT + " SELECT root_id, " + ", ".join(f"coalesce(string_agg(DISTINCT identity, ';' ORDER BY identity) FILTER (WHERE kind = '{k}'), '') AS {k}" for k in contracts.PROTOCOLS) + " FROM ci GROUP BY root_id")
def protocol_groups(t: Relations) -> DataFrame:
    with scratch(t.spark) as keep:
        t.once("v_lines", lambda: t("v_lines").drop("quantity"))  # read for routes and for live registrations
        return contracts.protocol_lists(t.repeated("v_refs"), roots(t), contract_entries(t), keep)


PAIRS = f"{CATALOG}, cr(root_id, node) AS (SELECT DISTINCT handler_symbol, handler_symbol FROM res WHERE handler_symbol IS NOT NULL UNION SELECT cr.root_id, c.callee FROM cr JOIN {{v_calls}} c ON c.caller = cr.node), pairs AS (SELECT DISTINCT r.method, r.path, m.operation_id FROM res r JOIN cr ON cr.root_id = r.handler_symbol JOIN {{v_remote}} m ON m.caller_symbol = cr.node)"


def pairs(t: Relations) -> DataFrame:
    return dependency.endpoint_operations(resolved(t), t("v_calls"), t("v_remote"))


@query("endpoint_to_grpc", f"WITH RECURSIVE {PAIRS} SELECT method, path, string_agg(operation_id, ',' ORDER BY operation_id) AS operations FROM pairs WHERE method = 'GET' GROUP BY method, path")
def endpoint_to_grpc(t: Relations) -> DataFrame:
    asked = resolved(t).where("method = 'GET'")
    return dependency.operations_of(pairs(t), asked).select("method", "path", F.array_join("operations", ",").alias("operations"))


@query("grpc_to_endpoint", f"WITH RECURSIVE {PAIRS} SELECT operation_id, CAST(count(*) AS BIGINT) AS n, min(method || ' ' || path) AS first_endpoint FROM pairs GROUP BY operation_id")
def grpc_to_endpoint(t: Relations) -> DataFrame:
    found = dependency.endpoints_of(pairs(t), t("v_remote"))
    return found.select("operation_id", F.size("endpoints").cast("long").alias("n"), F.get("endpoints", F.lit(0)).alias("first_endpoint"))


BACK = "ob(operation_id, node) AS (SELECT DISTINCT operation_id, caller_symbol FROM {v_remote} UNION SELECT ob.operation_id, c.caller FROM ob JOIN {v_calls} c ON c.callee = ob.node), back AS (SELECT DISTINCT r.method, r.path, ob.operation_id FROM ob JOIN res r ON r.handler_symbol = ob.node)"


@query("bidirectional_invariant", f"WITH RECURSIVE {PAIRS}, {BACK}, n AS (SELECT operation_id, method, path, 1 AS f, 0 AS b FROM pairs UNION ALL SELECT operation_id, method, path, 0, 1 FROM back), e AS (SELECT operation_id, method, path, max(f) AS f, max(b) AS b FROM n GROUP BY ALL) SELECT operation_id, CAST(sum(f) AS BIGINT) AS forward, CAST(sum(b) AS BIGINT) AS backward, CAST(sum(f * b) AS BIGINT) AS agreed FROM e GROUP BY operation_id")
def bidirectional_invariant(t: Relations) -> DataFrame:
    """Pairs found from the endpoints down, from the operations up, and by both; the three are equal."""
    down, up = pairs(t), dependency.operation_endpoints(resolved(t), t("v_calls"), t("v_remote"))
    return dependency.agreement(down, up)


@query(
    "grpc_chains",
    "WITH RECURSIVE ch(root_id, node, path) AS (SELECT id, id, [id] FROM {v_symbols} WHERE package_path = 'orders' UNION ALL SELECT ch.root_id, c.callee, list_append(ch.path, c.callee) FROM ch JOIN {v_calls} c ON c.caller = ch.node WHERE NOT list_contains(ch.path, c.callee)) SELECT DISTINCT root_id, operation_id, array_to_string(path, ' > ') AS chain FROM ch JOIN {v_remote} m ON m.caller_symbol = ch.node",
)
def grpc_chains(t: Relations) -> DataFrame:
    handlers = t("v_symbols").where("package_path = 'orders'").select(F.col("id").alias("root_id"), F.col("id").alias("node"))
    return dependency.chains(handlers, t("v_calls"), t("v_remote")).select("root_id", "operation_id", F.array_join("chain", " > ").alias("chain"))


@query("operation_union", "SELECT operation_id, CASE WHEN operation_id IN (SELECT operation_id FROM {v_remote}) THEN 'client' ELSE 'server' END AS source, CAST(count(*) AS BIGINT) AS n FROM (SELECT operation_id, caller_symbol AS symbol FROM {v_remote} UNION ALL SELECT operation_id, handler_symbol FROM {v_served} WHERE operation_id NOT IN (SELECT operation_id FROM {v_remote})) x GROUP BY operation_id")
def operation_union(t: Relations) -> DataFrame:
    client = t("v_remote").select("operation_id", F.col("caller_symbol").alias("symbol"))
    return dependency.merged_operations(client, t("v_served").select("operation_id", F.col("handler_symbol").alias("symbol"))).groupBy("operation_id", "source").agg(F.count("*").alias("n"))


SOURCES = "down(entry_symbol, node) AS (SELECT DISTINCT entry_symbol, entry_symbol FROM con UNION SELECT d.entry_symbol, e.to_symbol FROM down d JOIN {v_refs} e ON e.from_symbol = d.node), back AS (SELECT DISTINCT r.root_id, con.id, con.kind FROM con JOIN down d ON d.entry_symbol = con.entry_symbol JOIN roots r ON r.node = d.node)"


@query("summary_agreement", CONTRACT_IMPACT + f", {SOURCES}, n AS (SELECT root_id, id, kind, 1 AS f, 0 AS b FROM ci UNION ALL SELECT root_id, id, kind, 0, 1 FROM back), e AS (SELECT root_id, id, kind, max(f) AS f, max(b) AS b FROM n GROUP BY ALL) SELECT kind, CAST(sum(f) AS BIGINT) AS summary, CAST(sum(b) AS BIGINT) AS reverse_summary, CAST(sum(f * b) AS BIGINT) AS agreed FROM e GROUP BY kind")
def summary_agreement(t: Relations) -> DataFrame:
    """Contracts of each root from the root up, and roots of each contract from its entry down: the same pairs."""
    return contracts.agreement(t.repeated("v_refs"), roots(t), contract_entries(t))


@query("im_reachability", "WITH RECURSIVE up(kind, node) AS (SELECT 'scheme', id FROM {v_anchors} WHERE scheme UNION SELECT 'endpoint', id FROM {v_anchors} WHERE endpoint UNION SELECT up.kind, e.from_symbol FROM up JOIN {v_refs} e ON e.to_symbol = up.node AND e.kind IN ('call', 'value')) SELECT node AS symbol, bool_or(kind = 'scheme') AS scheme, bool_or(kind = 'endpoint') AS endpoint FROM up GROUP BY node")
def im_reachability(t: Relations) -> DataFrame:
    return events.protocol_reach(t("v_anchors"), t("v_refs"))


@query("im_summary_fixpoint", "WITH RECURSIVE s(function, event, is_open, payload) AS (SELECT function, prefix, true, payload FROM {v_event_calls} UNION SELECT c.function, s.event || coalesce(c.given, ''), c.given IS NULL, s.payload FROM s JOIN {v_event_calls} c ON c.callee = s.function WHERE s.is_open) SELECT function, event, is_open, payload FROM s")
def im_summary_fixpoint(t: Relations) -> DataFrame:
    own, no = t("v_event_calls"), F.lit(None).cast("string")
    part = lambda text, param: F.struct(text.alias("text"), no.alias("pkg"), no.alias("name"), param.cast("int").alias("param"))
    names = F.array().cast(events.NAMES)
    place = [F.lit("supplier.go").alias("file"), *[F.lit(1).alias(c) for c in ("sl", "sc", "el", "ec")]]
    sent = F.array(part(F.col("prefix"), F.lit(None)), part(no, F.lit(0)))
    start = own.select("function", sent.alias("event"), no.alias("event_raw"), F.array(F.struct(F.lit("nation").alias("pkg"), F.col("payload").alias("name"))).alias("payload"), F.array().cast("array<int>").alias("params"), names.alias("controls"), F.array().cast("array<struct<file: string, sl: int, sc: int, el: int, ec: int>>").alias("evidence"))
    given = F.when(F.col("given").isNull(), part(no, F.lit(0))).otherwise(part(F.col("given"), F.lit(None)))
    calls = own.select("function", "callee", F.array(F.struct(F.array(given).alias("parts"), names.alias("deps"), F.array().cast("array<int>").alias("params"), no.alias("raw"))).alias("args"), names.alias("controls"), *place)
    found = events.fixpoint(start, calls)
    return found.select("function", F.array_join(F.transform("event", lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("event"), events.is_open(F.col("event"), F.col("params")).alias("is_open"), F.array_join(F.transform("payload", lambda n: n["name"]), ",").alias("payload"))


AFFECTED = f"WITH RECURSIVE {REACH}, {CATALOG}, {ENDS}, aff AS (SELECT root_id, method, path, min(level) AS level FROM least JOIN ends USING (node) GROUP BY root_id, method, path)"


@query("endpoint_sources_summary", AFFECTED + " SELECT method, path, CAST(count(DISTINCT root_id) AS BIGINT) AS n_roots, CAST(min(level) AS INTEGER) AS level FROM aff GROUP BY method, path")
def endpoint_sources_summary(t: Relations) -> DataFrame:
    return impact.merge_endpoints(impact.affected_endpoints(t("v_refs"), roots(t), ends(t)))


@query("global_summary", AFFECTED + " SELECT CAST(count(DISTINCT root_id) AS BIGINT) AS roots, CAST(count(DISTINCT (method, path)) AS BIGINT) AS endpoints, CAST(count(*) AS BIGINT) AS pairs FROM aff")
def global_summary(t: Relations) -> DataFrame:
    own = t("v_routes").select("id", "group_id", "method", "local_path", "handler_symbol").where("handler_symbol is not null")
    keys = endpoints.keys(routes.resolved_paths(own, routes.group_prefixes(t("v_groups"))), t("v_annotations"))
    return impact.summary_of_keys(t.repeated("v_refs"), roots(t), keys)


@query("handler_to_annotation", "SELECT 'link:' || kind || ':' || from_id || ':' || to_id AS id, kind, from_id, to_id FROM (SELECT DISTINCT 'route_to_handler' AS kind, id AS from_id, handler_symbol AS to_id FROM {v_routes} WHERE handler_symbol IS NOT NULL UNION SELECT DISTINCT 'handler_to_annotation', a.handler_symbol, a.id FROM {v_annotations} a JOIN {v_routes} r ON a.handler_symbol = r.handler_symbol) x")
def handler_to_annotation(t: Relations) -> DataFrame:
    return links.handler_annotation_links(t("v_routes"), t("v_annotations")).select("id", "kind", "from_id", "to_id")


@query("root_dispatch", "SELECT id AS change_id, id AS target_id, CASE WHEN id LIKE 'route:%' THEN 'route' WHEN id LIKE 'group:%' THEN 'group' WHEN id LIKE 'mw:%' THEN 'middleware' WHEN id IN (SELECT id FROM {v_symbols}) THEN 'symbol' ELSE 'file' END AS root_kind FROM (SELECT id FROM {v_routes} UNION SELECT id FROM {v_groups} UNION SELECT id FROM {v_middleware} UNION SELECT id FROM {v_symbols} UNION SELECT file FROM {v_symbols}) x")
def root_dispatch(t: Relations) -> DataFrame:
    targets = t("v_routes").select("id").union(t("v_groups").select("id")).union(t("v_middleware").select("id")).union(t("v_symbols").select("id")).union(t("v_symbols").select("file")).distinct()
    tables = [("route", t("v_routes")), ("group", t("v_groups")), ("middleware", t("v_middleware")), ("symbol", t("v_symbols"))]
    return impact.root_dispatch(targets.select(F.col("id").alias("change_id"), F.col("id").alias("target_id")), tables)


@query("symbol_parts", "SELECT id, regexp_extract(id, '^[^:]*') AS kind_of, regexp_extract(id, '[^:]*$') AS name_of FROM {v_symbols}")
def symbol_parts(t: Relations) -> DataFrame:
    return t("v_symbols").select("id", S.symbol_kind(F.col("id")).alias("kind_of"), S.symbol_name(F.col("id")).alias("name_of"))
