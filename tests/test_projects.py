"""From Go sources and a diff to documents, on a small project of our own."""

import json
import textwrap

import pytest

from ripplegraph.operators import budgets
from ripplegraph.plans import documents
from ripplegraph.sources import extract, golang, project

FILES = {
    "go.mod": "module shop.test/app\n\ngo 1.22\n\nrequire (\n\tlib.test/money v1.1.0\n\tlib.test/idle v0.1.0 // indirect\n)\n",
    "model/order.go": """
        package model

        // Order is what customers send.
        type Order struct {
        \tPrice string `json:"price"`
        }

        type Basket struct {
        \tOrders []Order
        }

        type Unused struct{ X int }
        """,
    "service/basket.go": """
        package service

        import (
        \t"lib.test/money"
        \t"shop.test/app/model"
        )

        var DefaultBasket = model.Basket{}

        func Total(b *model.Basket) string {
        \treturn money.Sum(len(b.Orders))
        }
        """,
    "controller/shop.go": """
        package controller

        import "shop.test/app/service"

        type shopAPI struct{}

        var API = &shopAPI{}

        // @Get api/basket
        func (s *shopAPI) Basket() string { return service.Total(nil) }

        func (s *shopAPI) Health() string { return "ok" }

        func Auth() any { return nil }
        """,
    "router/router.go": """
        package router

        import ctl "shop.test/app/controller"

        const base = "/v1"

        type RouterGroup struct{}

        func (g *RouterGroup) Group(path string, m ...any) *RouterGroup { return g }
        func (g *RouterGroup) Use(m any)                                 {}
        func (g *RouterGroup) GET(path string, h any)                    {}

        func Init(root *RouterGroup) {
        \tv1 := root.Group(base + "/shop")
        \tv1.GET("/health", ctl.API.Health)
        \tv1.Use(ctl.Auth())
        \tv1.GET("/basket", Wrap(ctl.API.Basket))
        \tMore(v1)
        }

        func More(g *RouterGroup) {
        \tg.GET("/more/", ctl.API.Health)
        }

        func Wrap(h any) any { return h }
        """,
    "router/router_test.go": "package router\n\nfunc TestX() {}\n",
    "broken/bad.go": "package broken\n\nfunc {\n",
    "vendor/x/x.go": "package x\n",
    "only_windows.go": "package app\n",
}
DIFF = """diff --git a/model/order.go b/model/order.go
--- a/model/order.go
+++ b/model/order.go
@@ -4,3 +4,3 @@
 type Order struct {
-\tPrice string `json:"cost"`
+\tPrice string `json:"price"`
 }
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("shop")
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(textwrap.dedent(text).lstrip("\n"))
    return str(top)


@pytest.fixture(scope="module")
def base(spark, root):
    return project.load(spark, root)


def test_facts(base):
    symbols = {r.id for r in base.symbols.collect()}
    assert {"type:shop.test/app/model::Order", "method:shop.test/app/controller:shopAPI:Basket", "var:shop.test/app/controller::API", "const:shop.test/app/router::base"} <= symbols
    assert not any("TestX" in s or "vendor" in s for s in symbols)
    refs = {(r.kind, r.from_symbol.split("/")[-1], r.to_symbol.split("/")[-1]) for r in base.references.collect()}
    assert {
        ("type", "model::Basket", "model::Order"), ("type", "service::Total", "model::Basket"), ("type", "service::DefaultBasket", "model::Basket"), ("call", "controller:shopAPI:Basket", "service::Total"),
        ("value", "router::Init", "controller::API"), ("value", "router::Init", "controller:shopAPI:Basket"), ("call", "router::Init", "router::More"), ("call", "router::Init", "controller::Auth"),
    } <= refs
    assert [d.code for d in base.diagnostics.where("severity = 'error'").collect()] == ["package_load_failed"]


def test_routes(base):
    routes = {r.resolved_path: (r.method, (r.handler_symbol or "").split(":")[-1], r.guessed) for r in base.routes.collect()}
    assert routes == {"/v1/shop/health": ("GET", "Health", False), "/v1/shop/basket": ("GET", "Basket", True), "/v1/shop/more": ("GET", "Health", False)}
    assert [m.middleware_symbols for m in base.middleware.collect()] == [["func:shop.test/app/controller::Auth"]]
    assert [(a.method, a.path, a.raw) for a in base.annotations.collect()] == [("GET", "/api/basket", "@Get api/basket")]


def test_impact(spark, root):
    doc = documents.impact_document(spark, root, DIFF)
    assert [(e["method"], e["path"]) for e in doc["summary"]["impactedEndpoints"]] == [("GET", "/api/basket")]
    source = doc["fileSources"][0]
    assert source["diff"] == DIFF and list(source["symbols"]) == ["type:shop.test/app/model::Order"]
    chain = doc["endpointSourcesSummary"][0]["sources"][0]["chains"][0]
    assert chain == ["type Order", "type Basket", "func Total", "method Basket", "route GET /v1/shop/basket", "annotation GET /api/basket", "GET /api/basket"]
    assert json.loads(json.dumps(doc)) == doc


def test_middleware_and_deleted_routes(spark, root):
    diff = "diff --git a/controller/shop.go b/controller/shop.go\n--- a/controller/shop.go\n+++ b/controller/shop.go\n@@ -14,1 +14,1 @@\n-func Auth() any { return 1 }\n+func Auth() any { return nil }\n"
    diff += "diff --git a/router/router.go b/router/router.go\n--- a/router/router.go\n+++ b/router/router.go\n@@ -15,4 +15,2 @@\n \tv1.GET(\"/health\", ctl.API.Health)\n-\tv1.GET(\"/gone\",\n-\t\tctl.API.Health)\n \tv1.Use(ctl.Auth())\n"
    doc = documents.impact_document(spark, root, diff)
    found = {(e["method"], e["path"]): [s["sourceFile"] for s in e["sources"]] for e in doc["endpointSourcesSummary"]}
    assert "controller/shop.go" in found["GET", "/api/basket"] and "controller/shop.go" in found["GET", "/v1/shop/more"]
    assert "controller/shop.go" not in found.get(("GET", "/v1/shop/health"), [])
    assert found["GET", "/v1/shop/gone"] == ["router/router.go"]


def test_modules(spark, root, tmp_path):
    diff = "diff --git a/go.mod b/go.mod\n--- a/go.mod\n+++ b/go.mod\n@@ -6,2 +6,2 @@\n-\tlib.test/money v1.0.0\n-\tlib.test/idle v0.2.0 // indirect\n+\tlib.test/money v1.1.0\n+\tlib.test/idle v0.1.0 // indirect\n"
    doc = documents.impact_document(spark, root, diff)
    assert [(m["modulePath"], m["changeType"], m["basis"]) for m in doc["moduleSources"]] == [("lib.test/idle", "downgraded", "unreferenced"), ("lib.test/money", "upgraded", "precise")]
    assert doc["fileSources"] == [] and doc["endpointSourcesSummary"][0]["sources"][0]["chains"][0][:3] == ["module lib.test/money", "import service/basket.go", "func Total"]
    (tmp_path / "c.json").write_text('{"ignoredModuleChanges": ["lib.test/*"]}')
    ignored = documents.impact_document(spark, root, diff, documents.Config.read(str(tmp_path / "c.json")))
    assert "moduleSources" not in ignored and ignored["fileSources"] == []


def test_errors(spark, root, tmp_path):
    with pytest.raises(budgets.DiffNotApplied):
        documents.impact_document(spark, root, DIFF.replace('+\tPrice string `json:"price"`', "+\tOther string"))
    with pytest.raises(budgets.DiffInvalid):
        documents.impact_document(spark, root, "no diff")
    with pytest.raises(budgets.BudgetExceeded):
        documents.impact_document(spark, root, DIFF, limits=budgets.Limits(depth=2))
    with pytest.raises(budgets.ProjectInvalid):
        (tmp_path / "x.go").write_text("package x\n")
        project.load(spark, str(tmp_path))
    for text in ('{"other": 1}', '{"analyzeModuleChanges": 1}', "{} {}", '{"ignoredModuleChanges": ["a[" ]}'):
        (tmp_path / "c.json").write_text(text)
        with pytest.raises(budgets.ConfigInvalid):
            documents.Config.read(str(tmp_path / "c.json"))


def test_assets(spark, base):
    remote = spark.createDataFrame([("func:shop.test/app/service::Total", "grpc:lib.test/api.Sums/Add")], "caller_symbol string, operation_id string")
    got = documents.endpoint_assets(spark, base, ["GET /v1/shop/basket"], remote)
    assert got == {"endpoints": [{"method": "GET", "path": "/api/basket", "operations": ["grpc:lib.test/api.Sums/Add"]}]}
    with pytest.raises(budgets.EndpointNotFound):
        documents.endpoint_assets(spark, base, ["GET /none"], remote)
    with pytest.raises(budgets.InvalidInput):
        documents.endpoint_assets(spark, base, ["nonsense"], remote)


def test_facts_document(base):
    doc = documents.facts_document(base)
    for relation in ("symbols", "references", "routes", "annotations"):
        ids = [r["id"] for r in doc[relation]]
        assert ids == sorted(ids) and len(ids) == len(set(ids)) > 0
    assert doc["project"] == {"root": ".", "module_path": "shop.test/app"} and json.dumps(doc)


SOURCE = """package p

import (
	"a/b"
	x "c/d/v2"
	_ "side"
)

type G[T any, U comparable] struct {
	E[T]
	*b.Embedded
	f, g map[string][]func(int, ...string) (chan<- T, error)
}
type I interface {
	~int | ~string
	M(a, b int) (err error)
}
const (
	A = iota
	B
	C, D = 0x1F + 1, 'x'
)
var v, w = map[string]G[int, string]{"k": {f: nil}}, []I{}

func (r *G[T, U]) Do(n int) (out []T) {
	if s, ok := any(n).(interface{ M() }); ok && n < len(out) { _ = s }
	for i := range 10 { out[i]++ ; continue }
	for k, v := range w { _ = k; _ = v }
	for ; n > 0; n-- {}
	switch y := any(n).(type) { case int, *b.T: _ = y; default: }
	switch { case n > 1: fallthrough; case n < 0: goto end }
	select { case z := <-make(chan int): _ = z; default: }
	go func(a ...int) { defer x.Close() }(1, 2)
end:
	return append(out[1:n:cap(out)], Map[int, T](b.List{{1}, {X: &b.T{}}})...)
}
"""


def test_parser_follows_the_language():
    p, tree = golang.parse(SOURCE.encode())
    kinds = [d.kind for d in tree.decls]
    assert kinds == ["import"] * 3 + ["type"] * 2 + ["const"] * 3 + ["var", "func"]
    assert [golang.selector_parts(x) for x in tree.walk() if x.kind == "selector"].count(["b", "T"]) == 2
    rows = extract.facts_of("f.go", "q", SOURCE.encode())
    assert ("imports", {"file": "f.go", "alias": "x", "import_path": "c/d/v2", "sl": 5, "sc": 2, "el": 5, "ec": 12}) in rows
    assert not any(r == "mentions" and f["role"] == "value" and f["parts"][0] in ("s", "out", "y", "z") for r, f in rows)


@pytest.mark.parametrize("text", ["", "package", "package p\nfunc f( {", "package p\nvar x = `", "package p\n\x00"])
def test_parser_refuses_with_a_diagnostic(text):
    assert extract.facts_of("f.go", "p", text.encode())[0][0] == "diagnostics"
