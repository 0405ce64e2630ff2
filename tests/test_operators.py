"""Operators on small literal tables, properties on random ones, and budgets."""

import itertools
import random
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S
from ripplegraph.operators import budgets, closure, contracts, diffs, endpoints, impact, links, modules, routes, spans


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


ADDRESS = [  # who depends on whom, around a changed type
    ("CreateOrderRequest", "Address", "type"), ("OrderAPI.Create", "CreateOrderRequest", "type"), ("DefaultRequest", "CreateOrderRequest", "type"),
    ("Build", "DefaultRequest", "value"), ("Init", "OrderAPI.Create", "value"),
]


def references(spark, rows):
    return spark.createDataFrame([(f"{a}>{b}", a, b, k, "f.go", 1) for a, b, k in rows], "id string, from_symbol string, to_symbol string, kind string, file string, sl int")


def roots(spark, *names):
    return spark.createDataFrame([(n, n) for n in names], "root_id string, node string")


def test_reach_of_a_changed_type(spark):
    found = closure.reach(impact.reverse_edges(references(spark, ADDRESS)), roots(spark, "Address")).collect()
    assert {(r.node, r.level) for r in found} == {("Address", 0), ("CreateOrderRequest", 1), ("OrderAPI.Create", 2), ("DefaultRequest", 2), ("Build", 3), ("Init", 3)}


def test_paths_mark_cycles_and_keep_diamonds(spark):
    found = impact.trees(references(spark, [("a", "b", "call"), ("b", "a", "call")]), roots(spark, "a")).collect()
    assert sorted((tuple(r.path), r.cycle) for r in found) == [(("a",), False), (("a", "b"), False), (("a", "b", "a"), True)]
    diamond = impact.trees(references(spark, [("x", "r", "call"), ("y", "r", "call"), ("z", "x", "call"), ("z", "y", "call")]), roots(spark, "r")).collect()
    assert sum(r.node == "z" for r in diamond) == 2


def test_budgets_are_typed(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "node int, next int")
    start = spark.createDataFrame([(0, 0)], "root_id int, node int")
    for limits, resource in ((budgets.Limits(depth=3), "depth"), (budgets.Limits(total_nodes=4), "total nodes"), (budgets.Limits(nodes_per_root=4), "nodes per root")):
        with pytest.raises(budgets.BudgetExceeded) as e:
            closure.reach(edges, start, limits)
        assert e.value.resource == resource and e.value.code == "budget_exceeded"
    assert closure.reach(edges, start, budgets.Limits(depth=9)).count() == 10
    with pytest.raises(budgets.InvalidInput):
        budgets.Limits(depth=-1).normalised()
    assert budgets.Limits(depth=0).normalised().depth == 256
    with pytest.raises(budgets.BudgetExceeded):
        budgets.check_diff("x" * 100, budgets.Limits(line_bytes=10))


def test_stages_are_timed_and_cancelled(spark):
    def slow():
        return spark.range(1 << 42).selectExpr("sum(hash(id))").first()

    with budgets.stage_times() as times:
        assert budgets.within(spark, 60, "one", lambda: spark.range(3).count()) == 3
        stopper = threading.Timer(3, spark.interruptAll)
        stopper.start()
        with pytest.raises(budgets.Cancelled):
            budgets.within(spark, 60, "two", slow)
    assert [s for s, _ in times] == ["one", "two"] and all(t >= 0 for _, t in times)


def test_queries_over_a_fleet_have_no_ceiling(spark):
    """More pairs than one analysis may have: each of 1,100 roots leads to a ring of three, and that to 1,000 ends."""
    edges = spark.range(1100).selectExpr("concat('r', id) as node", "'a' as next").union(spark.sql("select * from values ('a', 'b'), ('b', 'c'), ('c', 'a') t(node, next)"))
    edges = edges.union(spark.range(1000).selectExpr("'c' as node", "concat('e', id) as next"))
    starts = spark.range(1100).selectExpr("concat('r', id) as root_id", "concat('r', id) as node")
    levels = {r.level: r.n for r in closure.reach(edges, starts).groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert levels == {0: 1100, 1: 1100, 2: 1100, 3: 1100, 4: 1_100_000}
    with pytest.raises(budgets.BudgetExceeded):
        closure.reach(edges, starts, budgets.Limits())


def test_reach_is_brute_force_on_random_graphs(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(45)}
    found = {(r.root_id, r.node): r.level for r in closure.reach(spark.createDataFrame(sorted(edges), "node int, next int"), spark.createDataFrame([(i, i) for i in range(25)], "root_id int, node int")).collect()}
    want = {}
    for root in range(25):
        level, frontier = 0, {root}
        while frontier:
            want |= {(root, n): level for n in frontier}
            frontier = {b for a, b in edges if a in frontier} - {n for r, n in want if r == root}
            level += 1
    assert found == want


def test_later_statements_only(spark):
    r = spark.createDataFrame([("r1", "g", "f", 1), ("r2", "g", "f", 3), ("r3", "child", "f", 5), ("r4", "child", "h", 1)], "id string, group_id string, route_func string, statement_index int")
    m = spark.createDataFrame([("m1", "g", "f", 2), ("m2", "g", "f", 4)], "id string, group_id string, route_func string, statement_index int")
    edges = spark.createDataFrame([("g", "child"), ("child", "g2"), ("g2", "child")], "parent string, child string")
    found = routes.middleware_routes(m, routes.group_routes(edges, r), r).collect()
    assert {(x.middleware_id, x.route_id) for x in found} == {("m1", "r2"), ("m1", "r3"), ("m1", "r4"), ("m2", "r3"), ("m2", "r4")}


def test_flows_merge_with_parents(spark):
    g = spark.createDataFrame([("a", None), ("b", "a")], "id string, parent_group_id string")
    f = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c")], "parent_group_id string, child_group_id string")
    assert {tuple(r) for r in routes.group_edges(g, f).collect()} == {("a", "b"), ("b", "c")}


def test_catalog_cases(spark):
    r = spark.createDataFrame([("r1", "h", "POST", "/checkIn", "/checkIn"), ("r2", "h", "POST", "/other", "/other"), ("r3", "x", "get", "/x", None), ("r4", None, "GET", "/n", "/n")], "id string, handler_symbol string, method string, local_path string, resolved_path string")
    a = spark.createDataFrame([("a1", "h", "GET", "/api/checkIn"), ("a2", "x", "", "/named")], "id string, handler_symbol string, method string, path string")
    resolved = endpoints.resolutions(r, a)
    got = {(e.method, e.path): (e.handlers, e.routes) for e in endpoints.catalog(resolved).collect()}
    assert got == {("GET", "/api/checkIn"): (["h"], ["r1", "r2"]), ("GET", "/named"): (["x"], ["r3"]), ("GET", "/n"): ([], ["r4"])}
    ask = lambda m, p, **k: endpoints.lookup(spark.createDataFrame([(m, p)], "method string, path string"), resolved, r, **k)
    assert [(x.method, x.path, x.match) for x in ask(" post ", "/checkIn").collect()] == [("GET", "/api/checkIn", "route")]
    with pytest.raises(budgets.EndpointNotFound):
        ask("GET", "/none", strict=True)


def test_shuffled_input_gives_the_same_catalog(spark):
    rng = random.Random(3)
    rows = [(f"r{i}", f"h{i % 7}", "GET", f"/p{i % 11}", None) for i in range(60)]
    a = spark.createDataFrame([("a", "h3", "PUT", "/z")], "id string, handler_symbol string, method string, path string")
    make = lambda x: endpoints.catalog(endpoints.resolutions(spark.createDataFrame(x, "id string, handler_symbol string, method string, local_path string, resolved_path string"), a)).orderBy("method", "path").collect()
    assert make(rows) == make(rng.sample(rows, 60))


VERSIONS = ["v1.0.0-1", "v1.0.0-alpha", "v1.0.0-beta.1", "v1.0.0-rc.2", "v1.0.0-rc.10", "v1.0.0-rc.10.x", "v1.0.0", "v1.0.1-0.20230101000000-abc", "v1.0.1-0.20240101000000-abc", "v1.2", "v1.10.0", "v2", "v123456789012345678901.0.0"]


def test_version_order(spark):
    df = spark.createDataFrame([(a, b) for a, b in itertools.product(VERSIONS, VERSIONS)], "a string, b string")
    for r in df.select("a", "b", S.compare_versions(F.col("a"), F.col("b")).alias("x")).collect():
        i, j = VERSIONS.index(r.a), VERSIONS.index(r.b)
        assert r.x == (i > j) - (i < j), r
    assert one(spark, S.compare_versions(F.col("a"), F.col("b")), a="v1.0.0+incompatible", b="1.0.0") == 0
    assert one(spark, S.compare_versions(F.col("a"), F.col("b")), a="main", b="v1.0.0") == -1


@pytest.mark.parametrize("prefix,path,want", [("/a", "b", "/a/b"), ("a/", "/b/", "/a/b"), ("", "", "/"), ("/", "/", "/"), ("/a", "", "/a"), (None, "x", "/x")])
def test_join_path(spark, prefix, path, want):
    assert one(spark, S.join_path(F.col("a").cast("string"), F.col("b")), a=prefix, b=path) == want


def test_identities(spark):
    parse = lambda raw: [one(spark, c, r=raw) for c in S.parse_operation(F.col("r"))]
    assert parse("example.com/api/v1.OrderService/Create") == ["example.com/api/v1", "OrderService", "Create"]
    assert parse("/pkg.Service/Method") == [None] * 3 and parse("a/b") == [None] * 3
    assert [one(spark, c, r="get /orders/:id") for c in S.parse_endpoint(F.col("r"))] == ["GET", "/orders/:id"]
    assert [one(spark, c, r="GET orders") for c in S.parse_endpoint(F.col("r"))] == [None, None]
    assert one(spark, S.receiver_base(F.col("r")), r="(*pkg.Repo[T])") == "Repo" and one(spark, S.import_name(F.col("r")), r="github.com/x/y/v3") == "y"


@pytest.mark.parametrize("raw,want", [("// @Get /a", ("GET", "/a")), ("//@Post api/b", ("POST", "/api/b")), ("// @Refactor /x", (None, None)), ("// @Get", (None, None)), ("// Get /a", (None, None))])
def test_annotations(spark, raw, want):
    assert tuple(one(spark, c, r=raw) for c in links.parse_annotation(F.col("r"))) == want


def test_unique_bindings(spark):
    df = spark.createDataFrame([("a", "T"), ("a", "T"), ("b", "T"), ("b", "U"), ("c", "T"), ("c", None)], "variable string, concrete_type string")
    assert [tuple(r) for r in links.unique_bindings(df).collect()] == [("a", "T")]


DIFF = """noise
diff --git a/x.go b/x.go
--- a/x.go
+++ b/x.go
@@ -1,4 +1,3 @@
 package x
-gone
-- also gone

 tail
@@ -9 +8,2 @@
-old
+new
+newer
diff --git "a/caf\\303\\251.txt" "b/caf\\303\\251.txt"
new file mode 100644
--- /dev/null
+++ "b/caf\\303\\251.txt"
@@ -0,0 +1 @@
+hello
\\ No newline at end of file
diff --git a/pic b/pic
GIT binary patch
+not a line
"""


def parsed(spark, text):
    lines = diffs.diff_lines(spark.createDataFrame([(1, text)], "diff_id int, content string"))
    return lines, diffs.diff_files(lines)


def test_diff(spark):
    lines, files = parsed(spark, DIFF)
    assert [(f.old_path, f.new_path, f.status) for f in files.orderBy("file_no").collect()] == [("x.go", "x.go", "modified"), ("", "café.txt", "added"), ("pic", "pic", "modified")]
    got = [(r.file_no, r.start_line, r.end_line, r.kind) for r in diffs.diff_ranges(lines, files).orderBy("file_no", "start_line").collect()]
    assert got == [(1, 2, 2, "deletion_anchor"), (1, 8, 9, "added"), (2, 1, 1, "added")]
    blocks = [(b.old_start, b.new_anchor, b.lines, b.replaced) for b in diffs.deleted_blocks(lines).orderBy("old_start").collect()]
    assert blocks == [(2, 2, ["gone", "- also gone"], False), (9, 8, ["old"], True)]
    want = [(1, 1, "package x"), (1, 2, ""), (1, 3, "tail"), (1, 8, "new"), (1, 9, "newer"), (2, 1, "hello")]
    assert [(r.file_no, r.line, r.text) for r in diffs.expected_lines(lines, files).orderBy("file_no", "line").collect()] == want
    diffs.check_parsed(lines)
    with pytest.raises(budgets.DiffInvalid):
        diffs.check_parsed(parsed(spark, "nothing here")[0])
    with pytest.raises(budgets.DiffInvalid):
        diffs.check_parsed(parsed(spark, "diff --git a/x b/x\n@@@ -1 -1 +1 @@@\n")[0])


def test_applied(spark):
    lines, files = parsed(spark, DIFF)
    expected, blocks = diffs.expected_lines(lines, files), diffs.deleted_blocks(lines)
    good = [("x.go", 1, "package x\r"), ("x.go", 2, ""), ("x.go", 3, "tail"), ("x.go", 8, "new"), ("x.go", 9, "newer"), ("café.txt", 1, "hello")]
    table = lambda rows: spark.createDataFrame(rows, "file string, line int, text string")
    diffs.check_applied(diffs.unapplied(expected, files, table(good), blocks))
    with pytest.raises(budgets.DiffNotApplied):
        diffs.check_applied(diffs.unapplied(expected, files, table([*good[:-1], ("café.txt", 1, "other")]), blocks))
    gone = parsed(spark, "diff --git a/d b/d\ndeleted file mode 1\n--- a/d\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n")
    with pytest.raises(budgets.DiffNotApplied):
        diffs.check_applied(diffs.unapplied(diffs.expected_lines(*gone), gone[1], table([("d", 1, "x")]), diffs.deleted_blocks(gone[0])))


def test_map_lines_priority(spark):
    lines = spark.createDataFrame([("f", i) for i in (1, 5, 6, 7, 50)], "file string, line int")
    facts = spark.createDataFrame([("annotation", "a", 0, "f", 5, 5), ("route", "r1", 1, "f", 5, 7), ("route", "r0", 2, "f", 6, 6)], "kind string, id string, ordinal int, file string, sl int, el int")
    symbols = spark.createDataFrame([("big", "f", 1, 20), ("small", "f", 1, 3)], "id string, file string, sl int, el int")
    mapped = diffs.map_lines(lines, facts, symbols)
    assert [(r.line, r.kind, r.target_id) for r in mapped.orderBy("line").collect()] == [(1, "symbol", "small"), (5, "annotation", "a"), (6, "route", "r1"), (7, "route", "r1"), (50, "file", None)]
    assert [(r.start_line, r.end_line) for r in diffs.changes(mapped).where("kind = 'route'").collect()] == [(6, 7)]


def test_usage_basis(spark):
    m = spark.createDataFrame([("u",), ("b",), ("n",)], "path string")
    i = spark.createDataFrame([("f1", "u", "u/pkg"), ("f2", "_", "b"), ("f3", "x", "uu")], "file string, alias string, import_path string")
    u = spark.createDataFrame([("f1", "u", "s1"), ("f2", "_", "s2")], "file string, alias string, symbol_id string")
    s = spark.createDataFrame([("s1", "f1"), ("s2", "f2"), ("s3", "f2")], "id string, file string")
    got = {(r.module_path, r.basis, r.symbol_id) for r in modules.usages(m, i, u, s).collect()}
    assert got == {("u", "precise", "s1"), ("b", "file_fallback", "s2"), ("b", "file_fallback", "s3"), ("n", "unreferenced", None)}


def test_ordered_consumption_is_the_greedy_loop(spark):
    rng, configs, providers, want = random.Random(9), [], [], set()
    for f in range(60):
        own = sorted(rng.sample(range(40), rng.randint(0, 6)))
        other = sorted(rng.sample(range(40, 80), rng.randint(0, 3)) + [p + 0 for p in rng.sample(range(40), rng.randint(0, 5))])
        configs += [(f, f"c{f}-{p}", p) for p in own]
        providers += [(f, f"p{f}-{p}", p) for p in other]
        taken = set()
        for p in own:
            q = next((x for x in other if x > p and x not in taken), None)
            if q is not None:
                taken.add(q)
                want.add((f"c{f}-{p}", f"p{f}-{q}"))
    ddl = "function int, id string, position int"
    got = contracts.pair_configurations(spark.createDataFrame(configs, ddl), spark.createDataFrame(providers, ddl)).collect()
    assert {(r.config_id, r.provider_id) for r in got} == want


def test_as_of_and_islands(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "j", 9)], "id int, k string, at int")
    right = spark.createDataFrame([("k", 2, "b"), ("k", 5, "a"), ("k", 5, "c"), ("k", 7, "d")], "k string, since int, v string")
    assert sorted((r.id, r.v) for r in spans.as_of(left, right, ["k"], "at", "since", ["v"], ["v"]).collect()) == [(1, "a"), (2, None), (3, None)]
    lines = spark.createDataFrame([("f", x) for x in (1, 2, 3, 5, 6, 9, 9)], "file string, line int")
    assert sorted((r.start_line, r.end_line) for r in spans.islands(lines, ["file"]).collect()) == [(1, 3), (5, 6), (9, 9)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=12), st.tuples(st.integers(0, 6), st.integers(0, 6)))
def test_an_edge_more_loses_no_endpoint(spark, edges, more):
    start = spark.createDataFrame([(0, 0), (3, 3)], "root_id int, node int")
    find = lambda e: {(r.root_id, r.node) for r in closure.reach(spark.createDataFrame(e, "node int, next int"), start).collect()}
    assert find(edges) <= find([*edges, more])
