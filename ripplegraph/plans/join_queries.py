"""Interval, as-of, prefix and anti joins, islands, unions and counts over the adapter relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S
from ripplegraph.operators import contracts, diffs, links, modules, spans
from ripplegraph.plans.adapters import Relations
from ripplegraph.plans.registry import query


@query("line_to_innermost_symbol", "SELECT file, line, id, sl, el FROM (SELECT l.file, l.line, s.id, s.sl, s.el, row_number() OVER (PARTITION BY l.file, l.line ORDER BY s.el - s.sl, s.id) AS n FROM {v_change_lines} l JOIN {v_spans} s ON s.file = l.file AND l.line BETWEEN s.sl AND s.el) x WHERE n = 1")
def line_to_innermost_symbol(t: Relations) -> DataFrame:
    return spans.innermost(t("v_change_lines"), t("v_spans"), []).select("file", "line", "id", "sl", "el")


FACTS = "facts AS (SELECT 'annotation' AS kind, id, sl, el, file, 1 AS ordinal FROM {v_spans} WHERE id LIKE 'span:2:%' UNION ALL SELECT 'route', id || 'r', sl, el, file, 2 FROM {v_spans} WHERE id LIKE 'span:3:%' UNION ALL SELECT 'dubbo_method', id || 'd', sl, el, file, 3 FROM {v_spans} WHERE id LIKE 'span:1:%')"
MAPPED = FACTS + ", c AS (SELECT file, sl, el, kind, id, CASE kind WHEN 'annotation' THEN 0 WHEN 'route' THEN 2 ELSE 5 END AS prio, CAST(ordinal AS BIGINT) AS ord FROM facts UNION ALL SELECT file, sl, el, 'symbol', id, 7, el - sl FROM {v_spans}), b AS (SELECT l.file, l.line, c.kind, c.id, row_number() OVER (PARTITION BY l.file, l.line ORDER BY prio, ord, id) AS n FROM {v_change_lines} l JOIN c ON c.file = l.file AND l.line BETWEEN c.sl AND c.el), mapped AS (SELECT l.file, l.line, coalesce(b.kind, 'file') AS kind, b.id AS target_id FROM {v_change_lines} l LEFT JOIN b ON b.file = l.file AND b.line = l.line AND b.n = 1)"


def mapped(t: Relations) -> DataFrame:
    own = lambda kind, line, tail, order: t("v_spans").where(f"id like 'span:{line}:%'").select(F.lit(kind).alias("kind"), F.concat("id", F.lit(tail)).alias("id"), "sl", "el", "file", F.lit(order).alias("ordinal"))
    facts = own("annotation", 2, "", 1).union(own("route", 3, "r", 2)).union(own("dubbo_method", 1, "d", 3))
    return diffs.map_lines(t("v_change_lines"), facts, t("v_spans"))


@query("change_priority_map", f"WITH {MAPPED} SELECT file, line, kind, target_id FROM mapped")
def change_priority_map(t: Relations) -> DataFrame:
    return mapped(t)


@query("change_roots", f"WITH {MAPPED}, r AS (SELECT *, line - row_number() OVER (PARTITION BY file, kind, target_id ORDER BY line) AS g FROM mapped) SELECT file, kind, target_id, min(line) AS start_line, max(line) AS end_line FROM r GROUP BY file, kind, target_id, g")
def change_roots(t: Relations) -> DataFrame:
    return diffs.changes(mapped(t))


@query("merge_adjacent_lines", "SELECT file, min(line) AS start_line, max(line) AS end_line FROM (SELECT file, line, line - row_number() OVER (PARTITION BY file ORDER BY line) AS g FROM {v_change_lines}) x GROUP BY file, g")
def merge_adjacent_lines(t: Relations) -> DataFrame:
    return spans.islands(t("v_change_lines"), ["file"])


@query("asof_group", "SELECT l.id AS route_id, g.id AS group_id FROM {v_routes} l ASOF LEFT JOIN (SELECT 'orders_' || CAST(CAST((sl - 1) // 10 AS BIGINT) % 97 AS VARCHAR) || '.go' AS file, sl, id FROM {v_groups} WHERE id LIKE 'group:o%') g ON l.file = g.file AND l.sl >= g.sl")
def asof_group(t: Relations) -> DataFrame:
    file = F.concat(F.lit("orders_"), (F.floor((F.col("sl") - 1) / 10) % 97).cast("string"), F.lit(".go"))
    groups = t("v_groups").where("id like 'group:o%'").select(file.alias("file"), F.col("sl").alias("since"), F.col("id").alias("group_id"))
    left = t("v_routes").select(F.col("id").alias("route_id"), "file", "sl")
    return spans.as_of(left, groups, ["file"], "sl", "since", ["group_id"], ["group_id"]).select("route_id", "group_id")


@query("nearest_decl", "SELECT e.event_id, d.event_id AS decl_id FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT max(event_id) AS event_id, user_id, ts FROM events WHERE event_type = 'signup' GROUP BY user_id, ts) d ON e.user_id = d.user_id AND e.ts >= d.ts")
def nearest_decl(t: Relations) -> DataFrame:
    e = t("events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    declared = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("decl_id"))
    return spans.as_of(clicks, declared, ["user_id"], "ts", "since", ["decl_id"], ["decl_id"]).select("event_id", "decl_id")


HANDLERS = "SELECT l_orderkey * 10 + l_linenumber AS id, 'customer' AS package_path, 'f' || CAST(l_orderkey % 5 AS VARCHAR) AS file, CASE l_linenumber % 5 WHEN 0 THEN 'C' || CAST(l_partkey AS VARCHAR) WHEN 1 THEN 'sup.S' || CAST(l_suppkey AS VARCHAR) WHEN 2 THEN 'sup.Api.M' || CAST(l_orderkey AS VARCHAR) WHEN 3 THEN 'api.M' || CAST(l_orderkey AS VARCHAR) ELSE 'hs[\"x\"]' END AS handler_raw FROM {v_lines}"


@query("route_to_handler", f"WITH h AS ({HANDLERS}), x AS (SELECT h.id, s.id AS symbol FROM h JOIN {{v_symbols}} s ON s.package_path = 'customer' AND s.name = h.handler_raw UNION ALL SELECT h.id, s.id FROM h JOIN {{v_symbols}} s ON s.package_path = 'supplier' AND h.handler_raw = 'sup.' || s.name AND h.file <> 'f4' UNION ALL SELECT h.id, s.id FROM h JOIN {{v_symbols}} s ON s.package_path = 'orders' AND (h.handler_raw = 'sup.Api.' || s.name AND h.file <> 'f4' OR h.handler_raw = 'api.' || s.name)) SELECT id, min(symbol) AS handler_symbol FROM x GROUP BY id")
def route_to_handler(t: Relations) -> DataFrame:
    n, key = F.col("l_linenumber") % 5, F.col("l_orderkey").cast("string")
    raw = F.when(n == 0, F.concat(F.lit("C"), F.col("l_partkey").cast("string"))).when(n == 1, F.concat(F.lit("sup.S"), F.col("l_suppkey").cast("string"))).when(n == 2, F.concat(F.lit("sup.Api.M"), key)).when(n == 3, F.concat(F.lit("api.M"), key)).otherwise('hs["x"]')
    routes = t("v_lines").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("customer").alias("package_path"), F.concat(F.lit("f"), (F.col("l_orderkey") % 5).cast("string")).alias("file"), raw.alias("handler_raw"))
    symbols = t("v_symbols").withColumn("receiver", F.when(F.col("kind") == "method", "O"))
    imports = t.spark.createDataFrame([(f"f{i}", "sup", "supplier") for i in range(4)], "file string, alias string, import_path string")
    fields = t.spark.createDataFrame([("supplier", "Api", "orders", "O"), ("customer", "api", "orders", "O")], "package_path string, var_name string, type_package string, type_name string")
    return links.handler_symbols(routes, symbols, imports, fields)


@query("middleware_symbols", "SELECT id, string_agg(symbol, ',' ORDER BY i) AS symbols FROM (SELECT m.id, s.id AS symbol, min(m.i) AS i FROM (SELECT l_orderkey * 10 + l_linenumber AS id, 'S' || CAST(l_suppkey AS VARCHAR) AS name, 0 AS i FROM {v_lines} UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'S' || CAST(l_suppkey // 2 AS VARCHAR), 1 FROM {v_lines} UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'S' || CAST(l_suppkey AS VARCHAR), 2 FROM {v_lines}) m JOIN {v_symbols} s ON s.package_path = 'supplier' AND s.name = m.name GROUP BY m.id, s.id) x GROUP BY id")
def middleware_symbols(t: Relations) -> DataFrame:
    one, half = F.col("l_suppkey").cast("string"), F.floor(F.col("l_suppkey") / 2).cast("string")
    raw = F.concat(F.lit("sup.S"), one, F.lit("(1), S"), half, F.lit(" , S"), one)
    own = t("v_lines").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("supplier").alias("package_path"), raw.alias("middleware_raw"))
    return links.middleware_symbols(own, t("v_symbols")).select("id", F.array_join("middleware_symbols", ",").alias("symbols"))


@query("interface_binding_unique", "SELECT o_custkey * 8 + o_orderkey % 8 AS variable, min(o_orderstatus) AS concrete_type FROM orders GROUP BY 1 HAVING count(DISTINCT CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE o_orderstatus END) = 1 AND NOT bool_or(o_orderkey % 21 = 0)")
def interface_binding_unique(t: Relations) -> DataFrame:
    own = t("orders").select((F.col("o_custkey") * 8 + F.col("o_orderkey") % 8).alias("variable"), F.when(F.col("o_orderkey") % 21 != 0, F.col("o_orderstatus")).alias("concrete_type"))
    return links.unique_bindings(own)


@query("unresolved_references", "SELECT id, CASE WHEN contains(to_raw, '[') THEN 'reference_unresolved_generic' WHEN candidates > 1 THEN 'reference_ambiguous_interface' ELSE 'reference_unresolved' END AS code FROM (SELECT l_orderkey * 10 + l_linenumber AS id, 'example.com/p/supplier.S' || CAST(l_suppkey AS VARCHAR) || CASE WHEN l_partkey % 3 = 0 THEN '[T]' ELSE '' END AS to_raw, l_partkey % 4 AS candidates, 'func:supplier::S' || CAST(l_suppkey * (1 + l_partkey % 2) AS VARCHAR) AS to_symbol FROM {v_lines}) x WHERE to_symbol NOT IN (SELECT id FROM {v_symbols})")
def unresolved_references(t: Relations) -> DataFrame:
    raw = F.concat(F.lit("example.com/p/supplier.S"), F.col("l_suppkey").cast("string"), F.when(F.col("l_partkey") % 3 == 0, "[T]").otherwise(""))
    target = F.concat(F.lit("func:supplier::S"), (F.col("l_suppkey") * (1 + F.col("l_partkey") % 2)).cast("string"))
    refs = t("v_lines").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), raw.alias("to_raw"), (F.col("l_partkey") % 4).alias("candidates"), target.alias("to_symbol"))
    return links.unresolved_references(refs, t("v_symbols"), "example.com/p").select("id", "code")


@query("prefix_import_join", "SELECT DISTINCT m.path AS module_path, i.file, i.import_path FROM {v_modules_new} m JOIN {v_imports} i ON i.import_path = m.path OR starts_with(i.import_path, m.path || '/')")
def prefix_import_join(t: Relations) -> DataFrame:
    return modules.module_imports(t("v_modules_new"), t("v_imports")).select("module_path", "file", "import_path").distinct()


USAGES = (
    "mi AS (SELECT DISTINCT m.path AS module_path, i.file, i.alias, i.import_path FROM {v_modules_new} m JOIN {v_imports} i ON i.import_path = m.path OR starts_with(i.import_path, m.path || '/')), "
    "pr AS (SELECT DISTINCT module_path, import_path, u.symbol_id, mi.file FROM mi JOIN {v_uses} u ON u.file = mi.file AND u.alias = mi.alias WHERE mi.alias NOT IN ('_', '.')), "
    "us AS (SELECT module_path, 'precise' AS basis, import_path, symbol_id, file FROM pr UNION ALL SELECT DISTINCT mi.module_path, 'file_fallback', mi.import_path, s.id, mi.file FROM mi LEFT JOIN {v_file_symbols} s ON s.file = mi.file WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.module_path = mi.module_path AND pr.import_path = mi.import_path AND pr.file = mi.file) "
    "UNION ALL SELECT DISTINCT path, 'unreferenced', NULL, NULL, NULL FROM {v_modules_new} WHERE path NOT IN (SELECT module_path FROM mi))"
)


def usages(t: Relations) -> DataFrame:
    return modules.usages(t("v_modules_new"), t("v_imports"), t("v_uses"), t("v_file_symbols"))


@query("module_usage_basis", f"WITH {USAGES} SELECT module_path, basis, import_path, symbol_id, file FROM us")
def module_usage_basis(t: Relations) -> DataFrame:
    return usages(t)


@query("module_strongest_basis", f"WITH {USAGES} SELECT module_path, CASE max(CASE basis WHEN 'precise' THEN 3 WHEN 'file_fallback' THEN 2 ELSE 1 END) WHEN 3 THEN 'precise' WHEN 2 THEN 'file_fallback' ELSE 'unreferenced' END AS basis FROM us GROUP BY module_path")
def module_strongest_basis(t: Relations) -> DataFrame:
    return modules.strongest_basis(usages(t))


@query("module_unreferenced", f"WITH {USAGES} SELECT module_path FROM us WHERE basis = 'unreferenced'")
def module_unreferenced(t: Relations) -> DataFrame:
    return usages(t).where("basis = 'unreferenced'").select("module_path")


@query("module_usage_roots", f"WITH {USAGES} SELECT DISTINCT CASE WHEN symbol_id IS NOT NULL THEN 'symbol_changed' ELSE 'file_changed' END AS kind, coalesce(symbol_id, file) AS target_id, file, module_path, 'go_mod_diff' AS source FROM us WHERE basis <> 'unreferenced'")
def module_usage_roots(t: Relations) -> DataFrame:
    return modules.roots(usages(t))


@query("module_diff", "SELECT path, kind, old_version, new_version, old_replace_path, new_replace_path, old_replace_version, new_replace_version FROM (SELECT coalesce(o.path, w.path) AS path, o.version AS old_version, w.version AS new_version, o.replace_path AS old_replace_path, w.replace_path AS new_replace_path, o.replace_version AS old_replace_version, w.replace_version AS new_replace_version, CASE WHEN o.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'removed' WHEN o.replace_path IS DISTINCT FROM w.replace_path THEN 'replaced' WHEN o.version <> w.version THEN CASE WHEN kw >= ko THEN 'upgraded' ELSE 'downgraded' END END AS kind FROM "
    + " FULL JOIN ".join(f"(SELECT *, [CAST(regexp_extract(version, '^v(\\d+)', 1) AS BIGINT), CAST(regexp_extract(version, '^v\\d+\\.(\\d+)', 1) AS BIGINT), CAST(regexp_extract(version, '^v\\d+\\.\\d+\\.(\\d+)', 1) AS BIGINT), CASE WHEN version LIKE '%-rc%' THEN CAST(regexp_extract(version, 'rc\\.(\\d+)', 1) AS BIGINT) ELSE 1000000 END] AS k{a} FROM {{v_modules_{n}}}) {a}" for a, n in (("o", "old"), ("w", "new")))
    + " ON o.path = w.path) x WHERE kind IS NOT NULL")
def module_diff(t: Relations) -> DataFrame:
    return modules.changes(t("v_modules_old"), t("v_modules_new"))


@query("owning_module", "SELECT directory, module_dir FROM (SELECT directory, module_dir, row_number() OVER (PARTITION BY directory ORDER BY length(module_dir) DESC) AS n FROM (SELECT DISTINCT 'r' || CAST(n_regionkey AS VARCHAR) || '/n' || CAST(n_nationkey AS VARCHAR) || '/s' || CAST(s_suppkey AS VARCHAR) AS directory FROM supplier JOIN nation ON s_nationkey = n_nationkey) d JOIN (SELECT '' AS module_dir UNION SELECT 'r' || CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey % 2 = 0 UNION SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '/n' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 3 = 0) m ON module_dir = '' OR module_dir = directory OR starts_with(directory, module_dir || '/')) x WHERE n = 1")
def owning_module(t: Relations) -> DataFrame:
    text = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nation = t("nation").select(F.concat_ws("/", text("r", "n_regionkey"), text("n", "n_nationkey")).alias("above"), "n_nationkey")
    directories = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "above", text("s", "s_suppkey")).alias("directory")).distinct()
    own = t("region").where("r_regionkey % 2 = 0").select(text("r", "r_regionkey").alias("module_dir")).union(nation.where("n_nationkey % 3 = 0").select("above")).union(t.spark.range(1).select(F.lit("")))
    return modules.owning_module(directories, own)


DIAGNOSTICS = "SELECT CASE event_type WHEN 'error' THEN 'route_dynamic_path' WHEN 'view' THEN 'reference_unresolved' ELSE 'package_load_failed' END AS code, 'f' || CAST(user_id % 20 AS STRING) AS file, event_id % 9 AS start_line, event_id % 9 + 1 AS end_line, event_type AS message, event_id FROM {events}"


def diagnostics(t: Relations) -> DataFrame:
    code = F.when(F.col("event_type") == "error", "route_dynamic_path").when(F.col("event_type") == "view", "reference_unresolved").otherwise("package_load_failed")
    return t("events").select(code.alias("code"), F.concat(F.lit("f"), (F.col("user_id") % 20).cast("string")).alias("file"), (F.col("event_id") % 9).alias("start_line"), (F.col("event_id") % 9 + 1).alias("end_line"), F.col("event_type").alias("message"), "event_id")


@query("diag_dedupe", f"SELECT code || ':' || file || ':' || CAST(start_line AS STRING) || ':' || CAST(end_line AS STRING) || ':' || message AS dedupe_key, min(event_id) AS first_id FROM ({DIAGNOSTICS}) d GROUP BY 1")
def diag_dedupe(t: Relations) -> DataFrame:
    key = S.diagnostic_key(F.col("code"), F.col("file"), F.col("start_line"), F.col("end_line"), F.col("message"))
    return links.first_wins(diagnostics(t).withColumn("dedupe_key", key), ["dedupe_key"], ["event_id"]).select("dedupe_key", F.col("event_id").alias("first_id"))


@query("diag_counts", f"SELECT code, CAST(count(DISTINCT file || ':' || CAST(start_line AS STRING) || ':' || message) AS BIGINT) AS n FROM ({DIAGNOSTICS}) d GROUP BY code")
def diag_counts(t: Relations) -> DataFrame:
    return diagnostics(t).select("code", "file", "start_line", "message").distinct().groupBy("code").agg(F.count("*").alias("n"))


COUNTED = ("v_symbols", "v_refs", "v_groups", "v_routes", "v_middleware", "v_annotations")


@query("facts_counts", " UNION ALL ".join(f"SELECT '{v[2:]}' AS relation, CAST(count(*) AS BIGINT) AS n FROM {{{v}}}" for v in COUNTED))
def facts_counts(t: Relations) -> DataFrame:
    out = None
    for v in COUNTED:
        one = t(v).groupBy().agg(F.count("*").alias("n")).select(F.lit(v[2:]).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("root_union", f"WITH {MAPPED}, {USAGES} SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT target) AS BIGINT) AS targets FROM (SELECT 'diff' AS source, coalesce(target_id, file) AS target FROM mapped UNION ALL SELECT 'go_mod_diff', coalesce(symbol_id, file) FROM us WHERE basis <> 'unreferenced') x GROUP BY source")
def root_union(t: Relations) -> DataFrame:
    lines = mapped(t).select(F.lit("diff").alias("source"), F.coalesce("target_id", "file").alias("target"))
    used = usages(t).where("basis <> 'unreferenced'").select(F.lit("go_mod_diff").alias("source"), F.coalesce("symbol_id", "file").alias("target"))
    return lines.unionByName(used).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"))


@query("fallback_root_except", f"WITH {MAPPED} SELECT m.file, m.line FROM mapped m WHERE kind = 'file' AND NOT EXISTS (SELECT 1 FROM {{v_change_lines}} l WHERE l.file = m.file AND l.line BETWEEN m.line + 1 AND m.line + 3)")
def fallback_root_except(t: Relations) -> DataFrame:
    own = mapped(t).where("kind = 'file'").select("file", "line", F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    recovered = t("v_change_lines").select("file", (F.col("line") - 3).alias("start_line"), (F.col("line") - 1).alias("end_line"))
    return diffs.without_overlapped(own, recovered).select("file", "line")


CONSUMED = (
    "o AS (SELECT l_orderkey AS function, l_orderkey * 100 + l_linenumber * 7 AS id, l_partkey % 40 AS position, l_returnflag = 'R' AS config FROM {v_lines}), "
    "p AS (SELECT function, id, position, row_number() OVER (PARTITION BY function ORDER BY position, id) AS n FROM o WHERE NOT config), "
    "c AS (SELECT function, id, position, row_number() OVER (PARTITION BY function ORDER BY position, id) AS i FROM o WHERE config), "
    "f AS (SELECT c.function, c.id, c.i, count(p.n) AS passed FROM c LEFT JOIN p ON p.function = c.function AND p.position <= c.position GROUP BY ALL), "
    "g(function, id, i, n) AS (SELECT function, id, i, passed + 1 FROM f WHERE i = 1 UNION ALL SELECT f.function, f.id, f.i, greatest(g.n, f.passed) + 1 FROM g JOIN f ON f.function = g.function AND f.i = g.i + 1)"
)


@query("ordered_consumption", f"WITH RECURSIVE {CONSUMED} SELECT g.function, g.id AS config_id, p.id AS provider_id FROM g JOIN p ON p.function = g.function AND p.n = g.n")
def ordered_consumption(t: Relations) -> DataFrame:
    """Configurations paired with providers in order; the SQL is the greedy loop."""
    own = t("v_lines").select(F.col("l_orderkey").alias("function"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 7).alias("id"), (F.col("l_partkey") % 40).alias("position"), "l_returnflag")
    return contracts.pair_configurations(own.where("l_returnflag = 'R'").drop("l_returnflag"), own.where("l_returnflag <> 'R'").drop("l_returnflag"))
