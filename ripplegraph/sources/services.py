"""Remote operations, providers and jobs of a project, joined from what its files mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S
from ripplegraph.operators import contracts, dependency
from ripplegraph.operators.budgets import AnalysisError
from ripplegraph.sources.project import FactBase, concrete


class AmbiguousClient(AnalysisError):
    code = "grpc_ambiguous_client"


def client_calls(fb: FactBase, domains: list[str] | None = None, strict: bool = False) -> DataFrame:
    """caller_symbol, operation_id, identity and place of calls on generated clients (`XClient` of another module).

    domains: package prefixes that hold generated code; all but the project's own if none are given. strict: a call
    that may be on several clients is an error.
    """
    own = fb.ends.where(F.col("tname").rlike("^[A-Z].*Client$") & ~S.in_project(F.col("tpkg"), F.lit(fb.module_path)))
    if domains:
        own = own.where(F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: F.col("tpkg").startswith(d)))
    calls = own.join(fb.mentions.where("role = 'call'"), "key")
    identity = S.operation_identity(F.col("tpkg"), F.regexp_replace("tname", "Client$", ""), F.col("method"))
    out = calls.select("key", F.col("from_symbol").alias("caller_symbol"), F.concat(F.lit("grpc:"), identity).alias("operation_id"), identity.alias("identity"), "file", "wsl", "wsc")
    if strict:
        many = out.groupBy("key", "caller_symbol").agg(F.count_distinct("identity").alias("n")).where("n > 1").first()
        if many:
            raise AmbiguousClient(f"a call in {many.caller_symbol} may be on {many.n} clients")
    return out.drop("key").distinct()


def _types(rows: DataFrame, fb: FactBase) -> DataFrame:
    """id, tpkg and tname of candidates; a named value counts as what it holds, or as a constructor of that name."""
    v = fb.relations["values"].select(F.col("package_path").alias("type_package"), F.col("var_name").alias("type_name_of"), F.col("type_package").alias("_p"), F.col("type_name_of").alias("_n"), F.col("maker").alias("_m"))
    named = rows.where(F.col("maker").startswith("value:"))
    held = named.join(v, ["type_package", "type_name_of"]).select("id", F.col("_p").alias("type_package"), F.col("_n").alias("type_name_of"), F.col("_m").alias("maker"))
    function = named.withColumn("maker", F.regexp_replace("maker", "^value:", "func:"))
    plain = rows.where(F.col("maker").isNull() | ~F.col("maker").startswith("value:"))
    all_of = plain.unionByName(held.select(*plain.columns)).unionByName(function.select(*plain.columns))
    return concrete(all_of, fb.returns, fb.symbols).select("id", "tpkg", "tname").distinct()


def method_symbol(package: Column, receiver: Column, name: Column) -> Column:
    return S.symbol_id(F.lit("method"), package, receiver, name)


def grpc_providers(fb: FactBase) -> tuple[DataFrame, DataFrame]:
    """Providers (identity, handler, implementation and registration symbols), and diagnostics.

    A registration is bound to the one candidate type that has a method of a unary handler's shape; with none or
    several it gives a diagnostic and no provider.
    """
    unary = fb.shapes.where("unary").select(F.col("package_path").alias("tpkg"), F.col("receiver").alias("tname"), F.col("name").alias("method"))
    fits = _types(fb.server_candidates, fb).join(unary.select("tpkg", "tname").distinct(), ["tpkg", "tname"])
    counted = fb.server_registrations.join(fits.groupBy("id").agg(F.count("*").alias("n"), F.min("tpkg").alias("tpkg"), F.min("tname").alias("tname")), "id", "left")
    code = F.when(F.coalesce("n", F.lit(0)) == 0, "grpc_provider_unresolved").otherwise("grpc_provider_ambiguous")
    bad = counted.where("n is null or n > 1").select(code.alias("code"), F.col("registration_symbol").alias("symbol"), "file")
    rows = counted.where("n = 1").join(unary, ["tpkg", "tname"])
    identity = S.operation_identity(F.col("service_package"), F.col("service"), F.col("method"))
    found = rows.select(identity.alias("identity"), F.concat(F.lit("grpc:"), identity).alias("operation_id"), method_symbol(F.col("tpkg"), F.col("tname"), F.col("method")).alias("handler_symbol"), F.concat(F.lit("type:"), "tpkg", F.lit("::"), "tname").alias("implementation_symbol"), "registration_symbol", "register_function")
    return found, bad


def operations(fb: FactBase) -> DataFrame:
    """operation_id, symbol and source (client or server) of all remote operations; those also called are a client's."""
    client = client_calls(fb).select("operation_id", F.col("caller_symbol").alias("symbol")).distinct()
    served = grpc_providers(fb)[0].select("operation_id", F.col("handler_symbol").alias("symbol")).distinct()
    return dependency.merged_operations(client, served)


def diagnostics(fb: FactBase) -> DataFrame:
    """code, severity, message and file of registrations without a provider."""
    bad = grpc_providers(fb)[1]
    return bad.select("code", F.lit("warning").alias("severity"), F.concat_ws(":", "file", "symbol").alias("message"), "file").distinct()


def dubbo_providers(fb: FactBase) -> DataFrame:
    """interface, method, version, handler_symbol and registration_symbol of configured providers.

    A configuration takes the next provider set behind it in its function; its methods are those listed, by the
    provider's own names or else by a unique name that differs in case alone, or all exported ones.
    """
    pairs = contracts.pair_configurations(fb.provider_configs.select("function", "id", "position"), fb.provider_setters)
    single = _types(fb.setter_candidates, fb).groupBy("id").agg(F.count("*").alias("n"), F.min("tpkg").alias("tpkg"), F.min("tname").alias("tname")).where("n = 1")
    bound = pairs.join(single.select(F.col("id").alias("provider_id"), "tpkg", "tname"), "provider_id").join(fb.provider_configs.withColumnRenamed("id", "config_id"), ["config_id", "function"])
    exported = fb.shapes.where(F.col("name") != "MethodMapper").select(F.col("package_path").alias("tpkg"), F.col("receiver").alias("tname"), F.col("name").alias("go_method"))
    mapped = fb.method_names.select(F.col("package_path").alias("tpkg"), F.col("receiver").alias("tname"), "go_method", F.col("name").alias("_mapped"))
    methods = exported.join(mapped, ["tpkg", "tname", "go_method"], "left")
    rows = bound.join(methods, ["tpkg", "tname"])
    every = F.size("methods") == 0
    listed = rows.where(~every).withColumn("method", F.explode("methods"))
    exact = listed.where(F.col("_mapped") == F.col("method"))
    rest = listed.join(exact.select("config_id", "method").distinct(), ["config_id", "method"], "left_anti").where(F.lower("go_method") == F.lower("method"))
    one = Window.partitionBy("config_id", "method")
    rest = rest.withColumn("_n", F.count("*").over(one)).where("_n = 1").drop("_n")
    whole = rows.where(every).withColumn("method", F.coalesce("_mapped", "go_method"))
    out = exact.unionByName(rest.select(*exact.columns)).unionByName(whole.select(*exact.columns))
    return out.select("interface", "method", "version", "version_expression", method_symbol(F.col("tpkg"), F.col("tname"), F.col("go_method")).alias("handler_symbol"), F.col("function").alias("registration_symbol")).distinct()


def job_registrations(fb: FactBase) -> DataFrame:
    return fb.relations["job_registrations"].join(fb.handlers.withColumnRenamed("owner", "id"), "id").select("id", "name", "handler_symbol", "registration_symbol")


def all_contracts(fb: FactBase) -> DataFrame:
    """Contracts of the four protocols whose registration is live."""
    grpc, _ = grpc_providers(fb)
    dubbo, jobs = dubbo_providers(fb), job_registrations(fb)
    http = fb.routes.select("method", "resolved_path", F.coalesce("local_path", "path_raw").alias("path_raw"), "handler_symbol", "route_func")
    registered = grpc.select(F.col("registration_symbol").alias("symbol")).union(dubbo.select("registration_symbol")).union(http.select("route_func")).union(jobs.select("registration_symbol"))
    alive = contracts.live(registered, fb.references.select("to_symbol"))
    return contracts.contracts(grpc, dubbo, http, jobs, alive)
