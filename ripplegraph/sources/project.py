"""A source project as fact relations: files are parsed one by one, names are resolved by joins.

Files are a DataFrame, so a fleet of projects loads as one does: each file is a row, parsed where it lies.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S
from ripplegraph.operators import closure, events, links, modules, routes
from ripplegraph.operators.budgets import BudgetExceeded, ProjectInvalid
from ripplegraph.operators.lineage import settle
from ripplegraph.sources import build

_SPAN = "sl int, sc int, el int, ec int"
_TYPE = "type_package string, type_name_of string, maker string"
_PARTS = "array<struct<text: string, pkg: string, name: string>>"
#: The rows that a file gives, by relation.
SCHEMAS = {
    "imports": f"file string, alias string, import_path string, {_SPAN}",
    "symbols": f"id string, kind string, package_path string, receiver string, name string, file string, {_SPAN}",
    "returns": f"id string, {_TYPE}",
    "fields": f"package_path string, type_name string, field string, {_TYPE}",
    "embeds": f"package_path string, type_name string, {_TYPE}",
    "elements": f"package_path string, var_name string, ordinal int, {_TYPE}",
    "values": f"package_path string, var_name string, {_TYPE}",
    "consts": f"package_path string, name string, parts {_PARTS}",
    "comments": f"handler_symbol string, ordinal int, raw string, file string, {_SPAN}",
    "mentions": "n int, from_symbol string, role string, owner string, package_path string, file string, imported string, parts array<string>, is_local boolean, types array<struct<type_package: string, type_name_of: string, maker: string>>, raw string, group int, "
    + _SPAN
    + ", wsl int, wsc int, wel int, wec int",
    "route_groups": f"id string, group_var string, parent_group_id string, prefix_parts {_PARTS}, prefix_raw string, route_func string, statement_index int, file string, {_SPAN}",
    "routes": f"id string, method string, path_parts {_PARTS}, path_raw string, group_id string, group_var string, handler_raw string, wrappers array<struct<name: string, raw: string, guessed: boolean>>, route_func string, statement_index int, file string, {_SPAN}",
    "middleware": f"id string, group_id string, group_var string, middleware_raw string, route_func string, statement_index int, file string, {_SPAN}",
    "route_parameters": "callee string, position int, group_id string",
    "route_arguments": "callee string, position int, group_id string, caller string",
    "route_returns": "callee string, group_id string",
    "route_receivers": "callee string, group_id string",
    "shapes": "id string, package_path string, receiver string, name string, unary boolean",
    "method_names": "package_path string, receiver string, go_method string, name string",
    "made": f"id string, {_TYPE}",
    "server_registrations": f"id string, service_package string, service string, register_function string, registration_symbol string, file string, {_SPAN}",
    "server_candidates": f"id string, {_TYPE}",
    "provider_setters": "function string, id string, position int",
    "setter_candidates": f"id string, {_TYPE}",
    "provider_configs": f"function string, id string, position int, interface string, version string, version_expression string, methods array<string>, file string, {_SPAN}",
    "job_registrations": f"id string, name string, registration_symbol string, file string, {_SPAN}",
    "interfaces": "id string",
    "event_anchors": "id string, scheme boolean, endpoint boolean",
    "event_calls": f"id string, function string, callee string, position int, args array<struct<parts: {events.PARTS}, deps: {events.NAMES}, params: array<int>, raw: string>>, event_at int, event_parts {events.PARTS}, event_raw string, controls {events.NAMES}, file string, {_SPAN}",
    "event_emits": f"function string, variable string, position int, parts {events.PARTS}, raw string, controls {events.NAMES}, file string, {_SPAN}",
    "event_bodies": f"function string, variable string, position int, deps {events.NAMES}, params array<int>",
    "diagnostics": "code string, severity string, message string, file string",
}
SKIPPED_FOLDERS = ("vendor", "node_modules", "testdata")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), and content of all files below root, but for hidden and skipped folders."""
    prefix = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    relative = F.substring(plain, F.lit(len(prefix) + 1), F.length(plain)) if prefix.startswith("/") else F.substring_index(F.col("path"), prefix, -1)
    files = raw.select(relative.alias("path"), "content")
    return files.where(~F.col("path").rlike(rf"(^|/)([._][^/]*|{'|'.join(SKIPPED_FOLDERS)})(/|$)"))


def source_files(files: DataFrame) -> DataFrame:
    """path, package_path and content of Go sources, tests left out, each in its nearest module's package."""
    mods = files.where(F.col("path").rlike(r"(^|/)go\.mod$")).select("path", F.col("content").cast("string").alias("content"))
    named = modules.module_paths(mods).select(F.regexp_replace("path", r"/?go\.mod$", "").alias("module_dir"), "module_path")
    go = files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).withColumn("directory", F.regexp_replace("path", "/?[^/]*$", ""))
    owner = modules.owning_module(go.select("directory").distinct(), named).join(named, "module_dir")
    inside = F.ltrim(F.substring(F.col("directory"), F.length("module_dir") + 1, F.length("directory")), F.lit("/"))
    package = F.when(inside == "", F.col("module_path")).otherwise(F.concat_ws("/", "module_path", inside))
    return go.join(owner, "directory").select("path", package.alias("package_path"), "content")


def parse(sources: DataFrame, tags: set[str]) -> dict[str, DataFrame]:
    """The relations of SCHEMAS of all sources(path, package_path, content) that belong to the build, parsed once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ripplegraph.sources.build import in_build
        from ripplegraph.sources.extract import facts_of

        for batch in batches:
            found = [(relation, json.dumps(fields)) for path, package, content in zip(batch.path, batch.package_path, map(bytes, batch.content)) if in_build(path, content.decode("utf-8", "replace"), tags) for relation, fields in facts_of(path, package, content)]
            yield pd.DataFrame(found, columns=["relation", "payload"])

    rows = settle(sources.select("path", "package_path", "content").mapInPandas(work, "relation string, payload string"))
    return {name: rows.where(F.col("relation") == name).select(F.from_json("payload", schema).alias("r")).select("r.*") for name, schema in SCHEMAS.items()}


def narrowed(returns: DataFrame, made: DataFrame, interfaces: DataFrame, symbols: DataFrame) -> DataFrame:
    """returns, an interface replaced by the one project type that all return statements make."""
    kinds = symbols.where("kind = 'type'").select(F.col("package_path").alias("type_package"), F.col("name").alias("type_name_of"), F.col("id").alias("_type"))
    own = made.where("maker is null").join(kinds, ["type_package", "type_name_of"], "left").unionByName(made.where("maker is not null").withColumn("_type", F.lit(None).cast("string")))
    single = links.unique_bindings(own.select(F.col("id").alias("variable"), F.col("_type").alias("concrete_type")))
    concrete_of = single.join(kinds, F.col("concrete_type") == F.col("_type")).select(F.col("variable").alias("id"), F.col("type_package").alias("_p"), F.col("type_name_of").alias("_n"))
    abstract = returns.join(kinds, ["type_package", "type_name_of"]).join(interfaces.select(F.col("id").alias("_type")), "_type").select("id", F.lit(True).alias("_abstract"))
    out = returns.join(abstract, "id", "left").join(concrete_of, "id", "left")
    use = F.col("_abstract") & F.col("_n").isNotNull()
    return out.select("id", F.when(use, F.col("_p")).otherwise(F.col("type_package")).alias("type_package"), F.when(use, F.col("_n")).otherwise(F.col("type_name_of")).alias("type_name_of"), "maker")


def concrete(rows: DataFrame, returns: DataFrame, symbols: DataFrame) -> DataFrame:
    """rows with tpkg and tname for their type: named, made by a project function, or converted to.

    A constructor of another project (`NewX`) is taken to make its package's X.
    """
    made = returns.where("maker is null").select(F.col("id").alias("maker"), F.col("type_package").alias("_rp"), F.col("type_name_of").alias("_rn"))
    types = symbols.where("kind = 'type'").select(F.col("package_path").alias("type_package"), F.col("name").alias("type_name_of"), F.lit(True).alias("_is_type"))
    out = rows.join(made, "maker", "left").join(types, ["type_package", "type_name_of"], "left")
    own = F.col("maker").isNull() | F.col("_is_type")
    inside = symbols.select(F.col("package_path").alias("type_package"), F.lit(True).alias("_inside")).distinct()
    out = out.join(inside, "type_package", "left")
    foreign = F.col("_inside").isNull() & F.col("type_name_of").rlike("^New[A-Z]")
    tpkg = F.coalesce("_rp", F.when(own | foreign, F.col("type_package")))
    tname = F.coalesce("_rn", F.when(own, F.col("type_name_of")).when(foreign, F.substring("type_name_of", 4, 1000)))
    return out.withColumn("tpkg", tpkg).withColumn("tname", tname).drop("_rp", "_rn", "_is_type", "_inside", "maker", "type_package", "type_name_of").where("tname is not null")


def embedded(embeds: DataFrame, returns: DataFrame, symbols: DataFrame) -> DataFrame | None:
    """tpkg, tname, _epkg, _ename and _level: the types that a struct embeds, itself or through others; None if none does."""
    key = lambda p, n: F.concat_ws("\n", p, n)
    edges = settle(concrete(embeds, returns, symbols).select(key("package_path", "type_name").alias("node"), key("tpkg", "tname").alias("next")))
    if edges.isEmpty():
        return None
    found = closure.reach(edges, edges.select(F.col("node").alias("root_id"), "node")).where("level > 0")
    part = lambda c, i: F.get(F.split(c, "\n"), F.lit(i))
    return found.select(part("root_id", 0).alias("tpkg"), part("root_id", 1).alias("tname"), part("node", 0).alias("_epkg"), part("node", 1).alias("_ename"), F.col("level").alias("_level"))


def with_promoted(members: DataFrame, inner: DataFrame | None, name: str) -> DataFrame:
    """members(tpkg, tname, name, …) with those of embedded types: the shallowest counts, and none if two are as shallow."""
    if inner is None:
        return members
    rest = [c for c in members.columns if c not in ("tpkg", "tname")]
    lifted = inner.join(members.withColumnsRenamed({"tpkg": "_epkg", "tname": "_ename"}), ["_epkg", "_ename"]).select("tpkg", "tname", *rest, "_level")
    each = members.withColumn("_level", F.lit(0)).unionByName(lifted)
    w = Window.partitionBy("tpkg", "tname", name)
    least = each.withColumn("_least", F.min("_level").over(w)).where("_level = _least")
    return least.withColumn("_n", F.count("*").over(w)).where("_n = 1 or _level = 0").select(*members.columns)


def ends_of(chains: DataFrame, fields: DataFrame) -> DataFrame:
    """key, tpkg, tname and method: chains(key, tpkg, tname, rest) followed field by field to the last name.

    fields: tpkg, tname, field, and the type (_p, _t) that it leads to.

    Each round takes a name off a chain, so there are as many as the longest chain has names.
    """
    hops = settle(fields)
    found, now = None, chains
    while True:
        last = now.where(F.size("rest") == 1).select("key", "tpkg", "tname", F.get("rest", F.lit(0)).alias("method"))
        found = last if found is None else found.unionByName(last)
        longer = now.where(F.size("rest") > 1).withColumn("field", F.get("rest", F.lit(0)))
        now = settle(longer.join(hops, ["tpkg", "tname", "field"]).select("key", F.col("_p").alias("tpkg"), F.col("_t").alias("tname"), F.slice("rest", 2, 1000).alias("rest")))
        if now.isEmpty():
            break
    return found.distinct()


def methods_of(ends: DataFrame, symbols: DataFrame, inner: DataFrame | None) -> DataFrame:
    """key and symbol of the ends that are methods of project types, their own or of what they embed."""
    own = symbols.where("kind = 'method'").select(F.col("id").alias("symbol"), F.col("package_path").alias("tpkg"), F.col("receiver").alias("tname"), F.col("name").alias("method"))
    own = with_promoted(own, inner, "method")
    return ends.join(own, ["tpkg", "tname", "method"]).select("key", "symbol").distinct()


def keyed(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("key", F.concat_ws("#", "file", F.col("n").cast("string")))


def dispatched(elements: DataFrame, returns: DataFrame, symbols: DataFrame, interfaces: DataFrame) -> DataFrame:
    """vpkg, vname, tpkg and tname: the types of the values of map variables of which each value's concrete type is known."""
    abstract = interfaces.select(F.col("id").alias("_type"))
    found = concrete(elements, returns, symbols).withColumn("_type", F.concat(F.lit("type:"), "tpkg", F.lit("::"), "tname")).join(abstract, "_type", "left_anti")
    known = found.groupBy("package_path", "var_name").agg(F.count_distinct("ordinal").alias("_known"), F.collect_set(F.struct("tpkg", "tname")).alias("t"))
    every = elements.groupBy("package_path", "var_name").agg(F.count_distinct("ordinal").alias("_n"))
    whole = known.join(every, ["package_path", "var_name"]).where("_known = _n")
    return whole.select(F.col("package_path").alias("vpkg"), F.col("var_name").alias("vname"), F.explode("t").alias("t")).select("vpkg", "vname", "t.*")


def chain_ends(m: DataFrame, symbols: DataFrame, values: DataFrame, fields: DataFrame, returns: DataFrame, elements: DataFrame, interfaces: DataFrame, inner: DataFrame | None) -> DataFrame:
    """Of mentions that start at a value of a known type, or at a map's element, the type and the method at the end."""
    part = lambda i: F.get("parts", F.lit(i))
    size, local, imported, own, role = F.size("parts"), F.col("is_local"), F.col("imported"), F.col("package_path"), F.col("role")
    scoped = m.where(role.isin("call", "handler", "middleware") & local & imported.isNull() & (size >= 2)).select("key", F.slice("parts", 2, 1000).alias("rest"), F.explode("types").alias("t")).select("key", "rest", "t.*")
    chains = concrete(scoped, returns, symbols).select("key", "tpkg", "tname", "rest")
    v = concrete(values, returns, symbols).select(F.col("package_path").alias("vpkg"), F.col("var_name").alias("vname"), "tpkg", "tname")
    through = m.where(role.isin("call", "value", "handler", "middleware") & (size >= 2))
    near = through.where(imported.isNull() & ~local & ((role != "value") | (size == 2))).select("key", own.alias("vpkg"), part(0).alias("vname"), F.slice("parts", 2, 1000).alias("rest"))
    away = through.where(imported.isNotNull() & (size >= 3)).select("key", imported.alias("vpkg"), part(1).alias("vname"), F.slice("parts", 3, 1000).alias("rest"))
    chains = chains.unionByName(near.unionByName(away).join(v, ["vpkg", "vname"]).select("key", "tpkg", "tname", "rest"))
    element = m.where((role == "call") & ~local & F.array_contains("parts", "[]"))
    near = element.where(imported.isNull() & (part(1) == "[]")).select("key", own.alias("vpkg"), part(0).alias("vname"), F.slice("parts", 3, 1000).alias("rest"))
    away = element.where(imported.isNotNull() & (part(2) == "[]")).select("key", imported.alias("vpkg"), part(1).alias("vname"), F.slice("parts", 4, 1000).alias("rest"))
    chains = chains.unionByName(near.unionByName(away).join(dispatched(elements, returns, symbols, interfaces), ["vpkg", "vname"]).select("key", "tpkg", "tname", "rest"))
    hops = concrete(fields, returns, symbols).select(F.col("package_path").alias("tpkg"), F.col("type_name").alias("tname"), "field", F.col("tpkg").alias("_p"), F.col("tname").alias("_t"))
    return settle(ends_of(chains, with_promoted(hops, inner, "field")))


def resolve(mentions: DataFrame, symbols: DataFrame, ends: DataFrame, inner: DataFrame | None) -> DataFrame:
    """Mentions (with keys) and the symbols they mean: a row for each, with `prio` of how it was found (0 type,
    1 function, 2 variable or constant, 3 method). Of calls and handlers only what comes first stays.
    """
    m = mentions
    part = lambda i: F.get("parts", F.lit(i))
    size, local, imported = F.size("parts"), F.col("is_local"), F.col("imported")
    plain = lambda kind, package, name: F.concat(F.lit(f"{kind}:"), package, F.lit("::"), name)
    own, far = F.col("package_path"), imported
    role = F.col("role")
    guess = lambda test, i, prio: F.when(test, F.struct(i.alias("symbol"), F.lit(prio).alias("prio")))
    one, two = size == 1, (size == 2) & imported.isNotNull()
    direct = role.isin("call", "handler", "middleware")
    typed = role.isin("type", "call")
    ways = [guess(typed & one, plain("type", own, part(0)), 0), guess(typed & two, plain("type", far, part(1)), 0)]
    ways += [guess((direct | ((role == "value") & ~local)) & one, plain("func", own, part(0)), 1), guess((direct | (role == "value")) & two, plain("func", far, part(1)), 1)]
    for kind in ("var", "const"):
        ways += [guess((direct | (role == "value")) & one & ~local, plain(kind, own, part(0)), 2), guess((role == "value") & two, plain(kind, far, part(1)), 2)]
    ways += [guess((role == "value") & (size >= 3) & imported.isNotNull(), plain("var", far, part(1)), 2), guess((role == "receiver") & (size == 3) & imported.isNotNull(), plain("var", far, part(1)), 2)]
    ways += [guess((role == "value") & (size == 2) & imported.isNull() & ~local, plain("var", own, part(0)), 2), guess((role == "receiver") & (size == 2), plain("var", own, part(0)), 2)]
    named = m.select("key", F.explode(F.filter(F.array(*ways), lambda w: w.isNotNull())).alias("w")).select("key", "w.symbol", "w.prio")
    named = named.join(symbols.select(F.col("id").alias("symbol")), "symbol").select("key", "symbol", "prio")
    methods = methods_of(ends, symbols, inner).withColumn("prio", F.lit(3))
    found = settle(named.unionByName(methods).distinct())
    best = found.groupBy("key").agg(F.min("prio").alias("_best"))
    rows = m.join(found, "key").join(best, "key")
    return rows.where((F.col("prio") == F.col("_best")) | F.col("role").isin("value", "receiver")).drop("_best")


def reference_rows(resolved: DataFrame) -> DataFrame:
    """References: id, kind, from_symbol, to_symbol, to_raw and span; a type expression names each type once."""
    r = resolved.where(F.col("role").isin("type", "call", "value", "receiver"))
    kind = F.when(F.col("prio") == 0, "type").when(F.col("role") == "call", "call").otherwise("value")
    r = r.withColumn("ref_kind", kind)
    call = F.col("ref_kind") == "call"
    span = [F.when(call, F.col(f"w{c}")).otherwise(F.col(c)).alias(c) for c in ("sl", "sc", "el", "ec")]
    rows = r.where("symbol <> from_symbol").select(F.col("ref_kind").alias("kind"), "from_symbol", F.col("symbol").alias("to_symbol"), F.when(call, F.array_join("parts", ".")).otherwise(F.col("raw")).alias("to_raw"), "file", *span, "group", "n")
    first = rows.groupBy("kind", "from_symbol", "to_symbol", "file", "group").agg(F.min_by(F.struct("to_raw", "sl", "sc", "el", "ec"), "n").alias("x")).select("kind", "from_symbol", "to_symbol", "file", "x.*")
    number = lambda c: F.col(c).cast("string")
    ref_id = F.concat_ws(":", F.lit("ref"), "kind", "from_symbol", "to_symbol", "file", number("sl"), number("sc"), number("el"), number("ec"))
    return first.withColumn("id", ref_id).dropDuplicates(["id"])


def folded(rows: DataFrame, column: str, consts: DataFrame, most: int = 256) -> DataFrame:
    """rows with `folded`: the column's parts with constants put in, as one text; null where one isn't known.

    Constants nested deeper than `most`, or made of themselves, raise BudgetExceeded.
    """
    table = settle(consts.where("parts is not null").groupBy("package_path", "name").agg(F.first("parts").alias("parts")))
    now = rows.withColumn("_row", F.monotonically_increasing_id())
    now = settle(now)
    parts = now.where(F.col(column).isNotNull()).select("_row", F.posexplode(column).alias("i", "p")).select("_row", F.array(F.col("i").cast("int")).alias("at"), "p.*")
    names = table.select(F.col("package_path").alias("pkg"), "name", F.col("parts").alias("_more"))
    for _ in range(most):
        opened = parts.where("text is null").join(names, ["pkg", "name"]).select("_row", "at", F.posexplode("_more").alias("j", "p")).select("_row", F.concat("at", F.array(F.col("j").cast("int"))).alias("at"), "p.*")
        stuck = parts.where("text is null").join(names.select("pkg", "name"), ["pkg", "name"], "left_anti").select("_row", "at", "text", F.lit(None).cast("string").alias("pkg"), F.lit(None).cast("string").alias("name"))
        parts = settle(parts.where("text is not null").unionByName(opened).unionByName(stuck))
        if parts.where("text is null and name is not null").isEmpty():
            break
    else:
        raise BudgetExceeded("constant depth", most + 1, most)
    texts = parts.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"), F.bool_and(F.col("text").isNotNull()).alias("_known"))
    text = F.when(F.col("_known"), F.array_join(F.transform("x", lambda y: y["text"]), ""))
    empty = F.when(F.col(column).isNotNull() & (F.size(column) == 0), F.lit(""))
    return now.join(texts.select("_row", text.alias("_text")), "_row", "left").withColumn("folded", F.coalesce(empty, "_text")).drop("_row", "_text")


@dataclass
class FactBase:
    """The relations of a project, each a DataFrame."""

    relations: dict[str, DataFrame] = field(default_factory=dict)
    module_path: str = ""

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["relations"][name]
        except KeyError:
            raise AttributeError(name) from None


#: A function that sends events: import path, name, and the places of event and payload among its arguments.
Sender = tuple[str, str, int, int]


def check_links(root: str) -> None:
    """A local project whose symbolic links lead out of it is refused."""
    real = os.path.realpath(root)
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f[:1] not in "._" and f not in SKIPPED_FOLDERS]
        for name in [*folders, *names]:
            path = os.path.join(folder, name)
            if os.path.islink(path) and os.path.commonpath([real, os.path.realpath(path)]) != real:
                raise ProjectInvalid(f"{os.path.relpath(path, root)} leads out of the project")


def event_rows(raw: dict[str, DataFrame], references: DataFrame, symbols: DataFrame, senders: DataFrame) -> dict[str, DataFrame]:
    """im_events (id, event, event_raw, sender_symbol, evidence, resolved) and im_dependencies (id, relation, symbol_id)."""
    reach = settle(events.protocol_reach(raw["event_anchors"], references))
    found = settle(events.fixpoint(events.direct(raw["event_calls"], raw["event_emits"], raw["event_bodies"], reach, senders), raw["event_calls"]))
    named = settle(events.identified(found))
    parts = named.withColumn("_parts", F.transform("event", lambda p: F.struct(p["text"].alias("text"), p["pkg"].alias("pkg"), p["name"].alias("name"))))
    value = folded(parts, "_parts", raw["consts"]).select("id", F.col("folded").alias("event"), "event_raw", F.col("function").alias("sender_symbol"), "evidence", F.col("folded").isNotNull().alias("resolved"))
    return {"im_events": settle(value), "im_dependencies": settle(events.dependencies(named, symbols))}


def diagnosed(raw: dict[str, DataFrame], found: DataFrame, mentions: DataFrame, resolved: DataFrame, module: str, senders: DataFrame) -> DataFrame:
    """code, severity, message and file of what could not be parsed, linked or understood, once each."""
    said = {"route_dynamic_path": "the path of a route isn't known", "route_unresolved_handler": "the handler of a route isn't known", "route_guessed_wrapper": "a call around a handler is taken for a wrapper"}
    text = F.coalesce(*[F.when(F.col("code") == c, F.lit(t)) for c, t in said.items()])
    of_routes = routes.route_diagnostics(found).join(found.select("id", "file", "sl"), "id").select("code", F.lit("warning").alias("severity"), F.concat_ws(":", "file", F.col("sl").cast("string"), text).alias("message"), "file")
    inside = mentions.where(F.col("role").isin("call", "value", "type") & S.in_project(F.col("imported"), F.lit(module)))
    missing = inside.join(resolved.select("key"), "key", "left_anti")
    code = F.when(F.col("raw").contains("["), "reference_unresolved_generic").otherwise("reference_unresolved")
    of_names = missing.select(code.alias("code"), F.lit("warning").alias("severity"), F.concat_ws(":", "file", F.col("sl").cast("string"), "raw").alias("message"), "file")
    few = events.too_few_arguments(raw["event_calls"], senders).select(F.lit("im_argument_mismatch").alias("code"), F.lit("warning").alias("severity"), F.concat_ws(":", "file", F.col("sl").cast("string"), "callee").alias("message"), "file")
    return settle(raw["diagnostics"].unionByName(of_routes).unionByName(of_names).unionByName(few).distinct())


def load(spark: SparkSession, root: str, goos: str = "linux", goarch: str = "amd64", tags: tuple[str, ...] = (), cgo: bool = False, senders: tuple[Sender, ...] = ()) -> FactBase:
    """All facts of the project below root."""
    if os.path.isdir(root):
        check_links(root)
    known = spark.createDataFrame([(f"func:{path}::{name}", event, payload) for path, name, event, payload in senders], "callee string, event_arg int, payload_arg int")
    files = settle(read_files(spark, root))
    top = files.where("path = 'go.mod'").select("path", F.col("content").cast("string").alias("content"))
    module = modules.module_paths(top).first()
    if module is None:
        raise ProjectInvalid(f"{root} has no go.mod with a module line")
    sources = source_files(files)
    raw = parse(sources, build.tags_of(goos, goarch, cgo, tags))
    symbols = settle(raw["symbols"].dropDuplicates(["id"]))
    mentions = settle(keyed(raw["mentions"]))
    returns = settle(narrowed(raw["returns"], raw["made"], raw["interfaces"], symbols))
    inner = embedded(raw["embeds"], returns, symbols)
    ends = chain_ends(mentions, symbols, raw["values"], raw["fields"], returns, raw["elements"], raw["interfaces"], inner)
    resolved = settle(resolve(mentions, symbols, ends, inner))
    references = settle(reference_rows(resolved))
    own = resolved.where("owner is not null").select("owner", "role", "symbol", "n")
    handlers = own.where("role = 'handler'").groupBy("owner").agg(F.min("symbol").alias("handler_symbol"))
    guards = own.where("role = 'middleware'").groupBy("owner").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("n", "symbol"))), lambda x: x["symbol"])).alias("middleware_symbols"))
    groups = folded(raw["route_groups"], "prefix_parts", raw["consts"]).withColumn("prefix", F.coalesce("folded", F.lit(""))).drop("folded")
    flows = routes.flow_edges(raw["route_arguments"], raw["route_parameters"], raw["route_returns"], raw["route_receivers"])
    found = folded(raw["routes"], "path_parts", raw["consts"]).withColumnRenamed("folded", "local_path")
    found = found.join(handlers.withColumnRenamed("owner", "id"), "id", "left")
    prefixes = flow_prefixes(raw, groups)
    found = settle(routes.resolved_paths(found.withColumn("guessed", F.exists("wrappers", lambda w: w["guessed"])), prefixes))
    guarded = raw["middleware"].join(guards.withColumnRenamed("owner", "id"), "id", "left")
    in_order = Window.partitionBy("handler_symbol").orderBy("ordinal")
    annotations = links.annotations(raw["comments"]).withColumn("ordinal", F.row_number().over(in_order) - 1)
    annotations = annotations.withColumn("raw", S.strip(F.regexp_replace("raw", r"^\s*//+", ""))).withColumn("id", F.concat_ws(":", F.lit("annotation"), "handler_symbol", "method", "path", F.col("ordinal").cast("string")))
    relations = {
        **raw, "mentions": mentions, "returns": returns, "ends": ends, "handlers": handlers, "files": files, "symbols": symbols, "references": references, "route_groups": settle(groups), "flows": settle(flows), "routes": found, "middleware": settle(guarded), "annotations": settle(annotations),
        "modules": modules.dependencies(top), "resolved": resolved, **event_rows(raw, references, symbols, known), "diagnostics": diagnosed(raw, found, mentions, resolved, module.module_path, known),
    }
    return FactBase(relations, module.module_path)


def flow_prefixes(raw: dict[str, DataFrame], groups: DataFrame) -> DataFrame:
    """id and full_prefix of all groups: down from parameters, whose own prefix is what every caller hands over, if one."""
    parameters = raw["route_parameters"].select("callee", "position", F.col("group_id").alias("id"))
    # A group's prefix below its function's parameter.
    roots = parameters.select("id", F.lit(None).cast("string").alias("parent_group_id"), F.lit("").alias("prefix"))
    inner = routes.group_prefixes(roots.unionByName(groups.select("id", "parent_group_id", "prefix")))
    below = settle(closure_roots(groups, parameters))
    handed = raw["route_arguments"].select("callee", "position", F.col("group_id").alias("_given")).join(parameters, ["callee", "position"])
    calls = handed.join(below.select(F.col("id").alias("_given"), F.col("root").alias("caller")), "_given").join(inner.select(F.col("id").alias("_given"), "full_prefix"), "_given")
    calls = calls.select("caller", F.col("id").alias("callee"), F.when(F.col("full_prefix") == "/", "").otherwise(F.col("full_prefix")).alias("prefix"))
    seeds = calls.select(F.col("caller").alias("node"), F.lit("").alias("prefix"))
    unique = routes.unique_prefixes(calls, seeds)
    context = below.join(unique.select(F.col("node").alias("root"), F.col("prefix").alias("_context")), "root", "left")
    return inner.join(context, "id", "left").select("id", S.join_context_prefix(F.coalesce("_context", F.lit("")), F.col("full_prefix")).alias("full_prefix"))


def closure_roots(groups: DataFrame, parameters: DataFrame) -> DataFrame:
    """id and root: the parameter's group that each group comes from; a ring of groups is followed once."""
    new = settle(parameters.select("id", F.col("id").alias("root")))
    done = new
    while True:
        step = groups.select("id", "parent_group_id").join(new.select(F.col("id").alias("parent_group_id"), "root"), "parent_group_id").select("id", "root").distinct()
        new = settle(step.join(done, ["id", "root"], "left_anti"))
        if new.isEmpty():
            return done
        done = done.unionByName(new)
