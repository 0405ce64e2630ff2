"""Linking routes, handlers, middleware and annotations to symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S


def parse_annotation(raw: Column) -> tuple[Column, Column]:
    """Method and path of a comment line `@Get /path`; nulls unless it names an HTTP method and has a path."""
    fields = F.split(S.strip(F.regexp_replace(raw, r"^\s*(//+|\*)?\s*", "")), r"\s+")
    name = F.get(fields, F.lit(0))
    method = F.upper(F.regexp_replace(name, "^@", ""))
    ok = name.startswith("@") & (F.size(fields) >= 2) & method.isin(*S.HTTP_METHODS)
    path = F.get(fields, F.lit(1))
    return F.when(ok, method), F.when(ok, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def annotations(comments: DataFrame) -> DataFrame:
    """Rows of comments(…, raw) that are endpoint annotations, with method and path."""
    method, path = parse_annotation(F.col("raw"))
    return comments.withColumn("method", method).withColumn("path", path).where("method is not null")


def handler_symbols(routes: DataFrame, symbols: DataFrame, imports: DataFrame, fields: DataFrame) -> DataFrame:
    """id and handler_symbol of routes(id, package_path, file, handler_raw) whose handler resolves.

    One segment is a function of the package, or a variable of it; two are an imported package's function, or a
    method of a package variable's type; three are a method of an imported package's variable. Among what
    resolves, functions come before variables, and those before methods.
    imports: file, alias, import_path. fields: package_path, var_name, type_package, type_name.
    """
    parts = S.selector_parts(F.col("handler_raw"))
    r = routes.select("id", "package_path", "file", parts.alias("p")).where("p is not null")
    own = symbols.select(F.col("id").alias("symbol"), "kind", F.col("package_path").alias("pkg"), F.coalesce("receiver", F.lit("")).alias("recv"), "name")
    one = r.where(F.size("p") == 1).join(own.where("recv = '' and kind in ('func', 'var')"), (F.col("pkg") == F.col("package_path")) & (F.col("name") == F.get("p", F.lit(0))))
    one = one.select("id", "symbol", F.when(F.col("kind") == "func", 0).otherwise(1).alias("prio"))
    imported = r.where(F.size("p") >= 2).join(imports, "file").where(F.col("alias") == F.get("p", F.lit(0)))
    two = imported.where(F.size("p") == 2).join(own.where("recv = '' and kind in ('func', 'var')"), (F.col("pkg") == F.col("import_path")) & (F.col("name") == F.get("p", F.lit(1))))
    two = two.select("id", "symbol", F.when(F.col("kind") == "func", 0).otherwise(1).alias("prio"))
    variables = fields.select(F.col("package_path").alias("var_pkg"), "var_name", "type_package", "type_name")
    local = r.where(F.size("p") == 2).join(variables, (F.col("var_pkg") == F.col("package_path")) & (F.col("var_name") == F.get("p", F.lit(0)))).select("id", "type_package", "type_name", F.get("p", F.lit(1)).alias("method"))
    far = imported.where(F.size("p") == 3).join(variables, (F.col("var_pkg") == F.col("import_path")) & (F.col("var_name") == F.get("p", F.lit(1)))).select("id", "type_package", "type_name", F.get("p", F.lit(2)).alias("method"))
    methods = local.unionByName(far).join(own.where("kind = 'method'"), (F.col("pkg") == F.col("type_package")) & (F.col("recv") == F.col("type_name")) & (F.col("name") == F.col("method")))
    found = one.unionByName(two).unionByName(methods.select("id", "symbol", F.lit(2).alias("prio")))
    return found.groupBy("id").agg(F.min_by("symbol", F.struct("prio", "symbol")).alias("handler_symbol"))


def handler_annotation_links(routes: DataFrame, noted: DataFrame) -> DataFrame:
    """id, kind, from_id and to_id: routes to handlers, and each handler with a route to its annotations, once."""
    to_handler = routes.where("handler_symbol is not null").select(F.lit("route_to_handler").alias("kind"), F.col("id").alias("from_id"), F.col("handler_symbol").alias("to_id"))
    handlers = routes.where("handler_symbol is not null").select("handler_symbol").distinct()
    to_annotation = noted.join(handlers, "handler_symbol").select(F.lit("handler_to_annotation").alias("kind"), F.col("handler_symbol").alias("from_id"), F.col("id").alias("to_id"))
    return to_handler.unionByName(to_annotation).distinct().withColumn("id", S.fact_id("link", F.col("kind"), F.col("from_id"), F.col("to_id")))


def middleware_symbols(middleware: DataFrame, symbols: DataFrame, package: str = "package_path") -> DataFrame:
    """id and middleware_symbols (in order, once each) of middleware whose listed names resolve."""
    names = middleware.select("id", package, F.posexplode(F.split("middleware_raw", r"\s*,\s*")).alias("i", "part"))
    base = names.withColumn("name", F.regexp_extract("part", r"([A-Za-z_]\w*)\s*(?:\([^)]*\))?$", 1))
    own = symbols.where("kind in ('func', 'method')").select(F.col("id").alias("symbol"), F.col("package_path").alias(package), "name")
    found = base.join(own, [package, "name"]).groupBy("id", "symbol").agg(F.min("i").alias("i"))
    return found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "symbol"))), lambda x: x["symbol"]).alias("middleware_symbols"))


def unresolved_references(references: DataFrame, symbols: DataFrame, module: str) -> DataFrame:
    """A diagnostic for each reference into the project without a target: generic, ambiguous or unknown."""
    missing = references.join(symbols.select(F.col("id").alias("to_symbol")), "to_symbol", "left_anti")
    package = F.substring_index(F.substring_index("to_raw", "/", -1), ".", 1)
    code = F.when(F.col("to_raw").contains("["), "reference_unresolved_generic").when(F.col("candidates") > 1, "reference_ambiguous_interface").otherwise("reference_unresolved")
    return missing.where(F.col("to_raw").startswith(module)).select("id", code.alias("code"), package.alias("package"), "to_raw")


def unique_bindings(assignments: DataFrame) -> DataFrame:
    """variable and concrete type of interface variables that are only ever given one known type.

    assignments: variable, concrete_type (null: unknown).
    """
    grouped = assignments.groupBy("variable").agg(F.count_distinct("concrete_type").alias("_n"), F.min("concrete_type").alias("concrete_type"), F.bool_or(F.col("concrete_type").isNull()).alias("_unknown"))
    return grouped.where("_n = 1 and not _unknown").select("variable", "concrete_type")


def first_wins(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
