"""Scalar functions over the adapter relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S
from ripplegraph.operators import links, modules, spans
from ripplegraph.plans.adapters import Relations
from ripplegraph.plans.registry import query


@query("span_contains", "SELECT a.id AS outer_id, b.id AS inner_id FROM {v_routes} a JOIN {v_routes} b ON a.file = b.file AND a.route_func = b.route_func WHERE (a.sl < b.sl OR (a.sl = b.sl AND a.sc <= b.sc)) AND (a.el > b.el OR (a.el = b.el AND a.ec >= b.ec))")
def span_contains(t: Relations) -> DataFrame:
    span = ("sl", "sc", "el", "ec")
    side = lambda p: t("v_routes").select(F.col("id").alias(f"{p}id"), "route_func", "file", *[F.col(c).alias(p + c) for c in span])
    return spans.contained(side("inner_"), side("outer_"), ["file", "route_func"]).select("outer_id", "inner_id")


@query("line_contains", "SELECT id, sl <= 20 AND el >= 22 AS holds FROM {v_spans}")
def line_contains(t: Relations) -> DataFrame:
    return t("v_spans").select("id", S.line_contains(F.col("sl"), F.col("el"), F.lit(20), F.lit(22)).alias("holds"))


@query("range_overlap", "SELECT event, sender_symbol, evidence_start, evidence_end, evidence_start <= 60 AND 50 <= CASE WHEN evidence_end = 0 THEN evidence_start ELSE evidence_end END AS touches FROM {v_events}")
def range_overlap(t: Relations) -> DataFrame:
    return t("v_events").select("event", "sender_symbol", "evidence_start", "evidence_end", S.ranges_overlap(F.col("evidence_start"), F.col("evidence_end"), F.lit(50), F.lit(60)).alias("touches"))


@query("any_range_overlap", "SELECT user_id, bool_or(event_id <= 400 AND 300 <= event_id + event_id % 5) AS touches FROM events GROUP BY user_id")
def any_range_overlap(t: Relations) -> DataFrame:
    ranges = t("events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_id").alias("start_line"), (F.col("event_id") + F.col("event_id") % 5).alias("end_line"))).alias("ranges"))
    return ranges.select("user_id", S.any_range_overlaps(F.col("ranges"), F.lit(300), F.lit(400)).alias("touches"))


@query("join_path", "SELECT prefix, local_path, CASE WHEN rtrim(j, '/') = '' THEN '/' ELSE rtrim(j, '/') END AS joined FROM (SELECT prefix, local_path, CASE WHEN starts_with(x, '/') THEN x ELSE '/' || x END AS j FROM (SELECT DISTINCT g.prefix, r.local_path, CASE WHEN ltrim(coalesce(r.local_path, ''), '/') = '' THEN rtrim(g.prefix, '/') ELSE rtrim(g.prefix, '/') || '/' || ltrim(r.local_path, '/') END AS x FROM {v_groups} g JOIN {v_routes} r ON g.id = r.group_id) y) z")
def join_path(t: Relations) -> DataFrame:
    both = t("v_groups").select(F.col("id").alias("group_id"), "prefix").join(t("v_routes").select("group_id", "local_path"), "group_id").select("prefix", "local_path").distinct()
    return both.select("prefix", "local_path", S.join_path(F.col("prefix"), F.col("local_path")).alias("joined"))


@query("join_context_prefix", "SELECT a, b, CASE WHEN b = a OR starts_with(b, a || '/') THEN b ELSE a || b END AS joined FROM (SELECT DISTINCT '/n' || CAST(n_nationkey % 5 AS VARCHAR) AS a, CASE WHEN n_nationkey % 2 = 0 THEN '/n' || CAST(n_nationkey % 3 AS VARCHAR) || '/x' ELSE '/n' || CAST(n_nationkey % 5 AS VARCHAR) END AS b FROM nation) q")
def join_context_prefix(t: Relations) -> DataFrame:
    k = F.col("n_nationkey")
    text = lambda m: F.concat(F.lit("/n"), (k % m).cast("string"))
    rows = t("nation").select(text(5).alias("a"), F.when(k % 2 == 0, F.concat(text(3), F.lit("/x"))).otherwise(text(5)).alias("b")).distinct()
    return rows.select("a", "b", S.join_context_prefix(F.col("a"), F.col("b")).alias("joined"))


@query("derive_prefix", "SELECT p_partkey, CASE WHEN ends_with(f, l) THEN CASE WHEN length(f) = length(l) THEN '/' ELSE left(f, length(f) - length(l)) END END AS prefix FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '/api' END || '/p' || CAST(p_partkey AS VARCHAR) AS f, '/p' || CAST(CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE p_partkey END AS VARCHAR) AS l FROM part) q")
def derive_prefix(t: Relations) -> DataFrame:
    k = F.col("p_partkey")
    full = F.concat(F.when(k % 3 == 0, "").otherwise("/api"), F.lit("/p"), k.cast("string"))
    local = F.concat(F.lit("/p"), F.when(k % 7 == 0, 1).otherwise(k).cast("string"))
    return t("part").select("p_partkey", S.derive_prefix(full, local).alias("prefix"))


@query("normalize_endpoint", "SELECT DISTINCT upper(trim(' ' || method || ' ')) AS method, trim(local_path || ' ') AS path FROM {v_routes}")
def normalize_endpoint(t: Relations) -> DataFrame:
    pad = lambda c: F.concat(c, F.lit(" "))
    return t("v_routes").select(S.endpoint_method(F.concat(F.lit(" "), pad(F.col("method")))).alias("method"), S.endpoint_path(pad(F.col("local_path"))).alias("path")).distinct()


@query("parse_identity", "SELECT raw, CASE WHEN ok THEN regexp_extract(raw, '^([^/].*)\\.([^./]+)/([^/]+)$', 1) END AS package, CASE WHEN ok THEN regexp_extract(raw, '^([^/].*)\\.([^./]+)/([^/]+)$', 2) END AS service, CASE WHEN ok THEN regexp_extract(raw, '^([^/].*)\\.([^./]+)/([^/]+)$', 3) END AS method FROM (SELECT raw, regexp_matches(raw, '^[^/].*\\.[^./]+/[^/]+$') AS ok FROM (SELECT DISTINCT CASE l_partkey % 4 WHEN 0 THEN '/pkg.Svc/M' ELSE 'example.com/api' || CAST(l_partkey % 9 AS VARCHAR) || '.Svc' || CAST(l_suppkey AS VARCHAR) || CASE l_partkey % 5 WHEN 0 THEN '' ELSE '/Get' END END AS raw FROM lineitem) a) b")
def parse_identity(t: Relations) -> DataFrame:
    k = F.col("l_partkey")
    raw = F.when(k % 4 == 0, "/pkg.Svc/M").otherwise(F.concat(F.lit("example.com/api"), (k % 9).cast("string"), F.lit(".Svc"), F.col("l_suppkey").cast("string"), F.when(k % 5 == 0, "").otherwise("/Get")))
    package, service, method = S.parse_operation(F.col("raw"))
    return t("lineitem").select(raw.alias("raw")).distinct().select("raw", package.alias("package"), service.alias("service"), method.alias("method"))


@query("parse_endpoint", "SELECT page_id, CASE WHEN ok THEN 'GET' END AS method, CASE WHEN ok THEN trim(regexp_extract(url, '^https?://[^/]+(/[^? ]*)', 1)) END AS path FROM (SELECT page_id, url, regexp_matches(url, '^https?://[^/]+/[^? ]*') AND page_id % 3 <> 0 AS ok FROM pages) x")
def parse_endpoint(t: Relations) -> DataFrame:
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^? ]*)", 1)
    method, parsed = S.parse_endpoint(F.concat(F.when(F.col("page_id") % 3 == 0, "").otherwise("get "), path))
    return t("pages").select("page_id", method.alias("method"), parsed.alias("path"))


@query("fact_ids", "SELECT 'route:' || route_func || ':' || method || ':' || coalesce(local_path, '') || ':' || CAST(statement_index AS VARCHAR) AS fact_id, CAST(count(*) AS BIGINT) AS n FROM {v_routes} GROUP BY 1")
def fact_ids(t: Relations) -> DataFrame:
    made = S.fact_id("route", F.col("route_func"), F.col("method"), F.col("local_path"), F.col("statement_index"))
    return t("v_routes").groupBy(made.alias("fact_id")).agg(F.count("*").alias("n"))


@query("symbol_ids", "SELECT s.kind || ':' || s.package_path || ':' || CASE WHEN s.kind = 'method' THEN 'O' ELSE '' END || ':' || s.name = s.id AS same, CAST(count(*) AS BIGINT) AS n FROM {v_symbols} s GROUP BY 1")
def symbol_ids(t: Relations) -> DataFrame:
    receiver = S.receiver_base(F.when(F.col("kind") == "method", F.lit("(*pkg.O[T])")))
    same = S.symbol_id(F.col("kind"), F.col("package_path"), receiver, F.col("name")) == F.col("id")
    return t("v_symbols").groupBy(same.alias("same")).agg(F.count("*").alias("n"))


@query("node_label", "SELECT id, trim('route ' || coalesce(nullif(local_path, ''), id)) AS label, trim(method || ' ' || coalesce(local_path, '')) AS endpoint_label FROM {v_routes} WHERE local_path IS NOT NULL")
def node_label(t: Relations) -> DataFrame:
    own = t("v_routes").where("local_path is not null")
    label = lambda kind: S.node_label(F.lit(kind), F.col("local_path"), F.col("id"), F.col("method"), F.col("local_path"))
    return own.select("id", label("route").alias("label"), label("endpoint").alias("endpoint_label"))


@query("glob_filter", "SELECT path FROM {v_modules_new} WHERE NOT (path = 'example.com/m7' OR regexp_full_match(path, 'example\\.com/m1[^/]*') OR regexp_full_match(path, '[^/]*/m[23]5[^/]'))")
def glob_filter(t: Relations) -> DataFrame:
    return modules.not_ignored(t("v_modules_new").select("path"), ["example.com/m7", "example.com/m1*", "*/m[23]5?", "example.com"])


@query("semver_compare", "SELECT path, CAST(CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS INTEGER) AS sign FROM (SELECT path, "
    + ", ".join(f"[CAST(regexp_extract({v}, '^v(\\d+)', 1) AS BIGINT), CAST(regexp_extract({v}, '^v\\d+\\.(\\d+)', 1) AS BIGINT), CAST(regexp_extract({v}, '^v\\d+\\.\\d+\\.(\\d+)', 1) AS BIGINT), CASE WHEN {v} LIKE '%-rc%' THEN CAST(regexp_extract({v}, 'rc\\.(\\d+)', 1) AS BIGINT) ELSE 1000000 END] AS {n}" for v, n in (("o.version", "a"), ("w.version", "b")))
    + " FROM {v_modules_old} o JOIN {v_modules_new} w USING (path)) x")
def semver_compare(t: Relations) -> DataFrame:
    both = t("v_modules_old").select("path", F.col("version").alias("a")).join(t("v_modules_new").select("path", F.col("version").alias("b")), "path")
    return both.select("path", S.compare_versions(F.col("a"), F.col("b")).alias("sign"))


@query("import_name", "SELECT DISTINCT import_path, CASE WHEN import_path LIKE '%/v2' THEN 'pkg' ELSE regexp_extract(import_path, '[^/]+$') END AS name FROM {v_imports}")
def import_name(t: Relations) -> DataFrame:
    return t("v_imports").select("import_path", S.import_name(F.col("import_path")).alias("name")).distinct()


@query("selector_parts", "SELECT DISTINCT p_name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 2 + p_partkey % 2 END AS n FROM (SELECT p_name, p_partkey, 1 AS one FROM part) x")
def selector_parts(t: Relations) -> DataFrame:
    k = F.col("p_partkey")
    chain = F.when(k % 4 == 0, F.lit("a.b(1)")).when(k % 2 == 1, F.lit("a.b.C")).otherwise(F.lit("a.B"))
    return t("part").select("p_name", F.when(k % 4 == 0, F.lit(None)).otherwise(F.size(S.selector_parts(chain))).cast("long").alias("n")).distinct()


@query("basis_max", "SELECT l_suppkey, CASE max(CASE WHEN l_returnflag = 'A' AND l_suppkey % 3 = 0 THEN 3 WHEN l_returnflag = 'N' AND l_suppkey % 3 < 2 THEN 2 ELSE 1 END) WHEN 3 THEN 'precise' WHEN 2 THEN 'file_fallback' ELSE 'unreferenced' END AS basis FROM lineitem GROUP BY l_suppkey")
def basis_max(t: Relations) -> DataFrame:
    basis = F.when((F.col("l_returnflag") == "A") & (F.col("l_suppkey") % 3 == 0), "precise").when((F.col("l_returnflag") == "N") & (F.col("l_suppkey") % 3 < 2), "file_fallback").otherwise("unreferenced")
    return modules.strongest_basis(t("lineitem").select(F.col("l_suppkey").alias("module_path"), basis.alias("basis"))).withColumnRenamed("module_path", "l_suppkey")


@query("annotation_parse", "SELECT id, method, path FROM {v_annotations}")
def annotation_parse(t: Relations) -> DataFrame:
    return links.annotations(t("v_comments")).select("id", "method", "path")


@query("glue_filter", "SELECT DISTINCT f, ends_with(lower(f), '_grpc.pb.go') OR ends_with(lower(f), '.grpc.pb.go') AS glue FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'a_GRPC.pb.go' WHEN 1 THEN 'x.grpc.pb.go' WHEN 2 THEN 'grpc.pb.go' ELSE 'y.go' END AS f FROM part) x")
def glue_filter(t: Relations) -> DataFrame:
    k = F.col("p_partkey") % 4
    f = F.when(k == 0, "a_GRPC.pb.go").when(k == 1, "x.grpc.pb.go").when(k == 2, "grpc.pb.go").otherwise("y.go")
    return t("part").select(f.alias("f")).distinct().select("f", S.is_generated_glue(F.col("f")).alias("glue"))


@query("project_package", "SELECT DISTINCT import_path, import_path = 'example.com/m2' OR starts_with(import_path, 'example.com/m2/') AS inside FROM {v_imports}")
def project_package(t: Relations) -> DataFrame:
    return t("v_imports").select("import_path", S.in_project(F.col("import_path"), F.lit("example.com/m2")).alias("inside")).distinct()
