"""Service contracts, remote calls, schemas, the command line and the stream, on a project of our own."""

import json
import textwrap

import pytest

from ripplegraph import __main__ as cli
from ripplegraph.operators import budgets
from ripplegraph.plans import documents
from ripplegraph.plans.schemas import SCHEMAS, violations
from ripplegraph.sources import project, services
from ripplegraph.streaming import diffs as stream

FILES = {
    "go.mod": "module svc.test/app\n",
    "core/core.go": "package core\n\nfunc Quote() string {\n\treturn \"q\"\n}\n\nfunc Other() string { return \"o\" }\n",
    "api/api_grpc.pb.go": "package api\n\nimport \"context\"\n\ntype QuotesServer interface {\n\tGet(ctx context.Context, r *Req) (*Res, error)\n}\n\ntype Req struct{}\ntype Res struct{}\n\nfunc RegisterQuotesServer(r any, s QuotesServer) {}\n",
    "grpcsrv/server.go": """
        package grpcsrv

        import (
        \t"context"

        \t"svc.test/app/api"
        \t"svc.test/app/core"
        )

        type server struct{}

        func NewServer() api.QuotesServer { return &server{} }

        func (s *server) Get(ctx context.Context, r *api.Req) (*api.Res, error) {
        \tcore.Quote()
        \treturn nil, nil
        }

        func (s *server) Ping(ctx context.Context, r *api.Req) (*api.Res, error) { return nil, nil }

        func RegisterAll(r any) { api.RegisterQuotesServer(r, NewServer()) }
        """,
    "dub/dub.go": """
        package dub

        import (
        \t"ext.test/dubbox"
        \t"svc.test/app/core"
        )

        type Impl struct{}

        func (i *Impl) Price() string { return core.Quote() }
        func (i *Impl) Name() string  { return core.Other() }

        func RegisterDub() {
        \timpl := &Impl{}
        \tdubbox.Put(&dubbox.ServiceConfig{Interface: "com.q.Quotes", Version: dubbox.V, Methods: []*dubbox.M{{Name: "price"}, {Name: "name"}}})
        \tdubbox.SetProviderService(impl)
        }
        """,
    "jobs/jobs.go": """
        package jobs

        import (
        \t"ext.test/jobx"
        \t"svc.test/app/core"
        )

        func refresh() { core.Quote() }

        func RegisterJobs(m map[string]jobx.TaskFunc) { m["refresh"] = refresh }
        """,
    "web/web.go": """
        package web

        import (
        \t"ext.test/pb"
        \t"svc.test/app/core"
        )

        type RouterGroup struct{}

        type handler struct{ orders pb.OrderClient }

        var users = pb.NewUserClient(nil)

        func (h *handler) Show() {
        \tcore.Quote()
        \th.orders.List(nil)
        \thelper()
        }

        func helper() { users.Find(nil) }

        func RegisterWeb(g *RouterGroup) {
        \th := &handler{}
        \tg.GET("/show", h.Show)
        }
        """,
}
DIFF = 'diff --git a/core/core.go b/core/core.go\n--- a/core/core.go\n+++ b/core/core.go\n@@ -3,3 +3,3 @@\n func Quote() string {\n-\treturn "p"\n+\treturn "q"\n }\n'


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("svc")
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(textwrap.dedent(text).lstrip("\n"))
    return str(top)


@pytest.fixture(scope="module")
def base(spark, root):
    return project.load(spark, root)


def test_service_impact(spark, root):
    doc = documents.service_document(spark, root, DIFF)
    assert {k: [c["identity"] for c in v] for k, v in doc["summary"].items()} == {"grpc": ["svc.test/app/api.Quotes/Get"], "dubbo": ["com.q.Quotes/price"], "http": ["GET /show"], "job": ["refresh"]}
    assert doc["summary"]["dubbo"][0]["identityResolution"] == "symbolic"
    assert {k: [c["id"] for c in v] for k, v in doc["summary"].items()} == {k: [c["id"] for c in v] for k, v in doc["entrySourcesSummary"].items()}
    assert violations(doc, SCHEMAS["grpc-impact"]) == []


def test_remote_calls_agree_both_ways(spark, root, base):
    remote = services.client_calls(base, strict=True)
    assert {(r.caller_symbol.split(":")[-1], r.identity) for r in remote.collect()} == {("Show", "ext.test/pb.Order/List"), ("helper", "ext.test/pb.User/Find")}
    assert services.client_calls(base, ["other.test"]).count() == 0
    forward = documents.endpoint_assets(spark, base, ["GET /show"], remote)
    assert forward["endpoints"][0]["operations"] == ["grpc:ext.test/pb.Order/List", "grpc:ext.test/pb.User/Find"] and violations(forward, SCHEMAS["endpoint-assets"]) == []
    for operation in ("ext.test/pb.Order/List", "ext.test/pb.User/Find"):
        assert documents.operation_sources(spark, base, [operation])[0]["impactedEndpoints"] == [{"method": "GET", "path": "/show"}]
    with pytest.raises(budgets.OperationNotFound):
        documents.operation_sources(spark, base, ["ext.test/pb.Order/None"])
    with pytest.raises(budgets.InvalidInput):
        documents.operation_sources(spark, base, ["/pb.Order/List"])


def test_documents_keep_their_schemas(spark, root, base):
    assert violations(documents.facts_document(base), SCHEMAS["facts"]) == []
    doc = documents.impact_document(spark, root, DIFF)
    assert violations(doc, SCHEMAS["impact"]) == [] and [e["path"] for e in doc["summary"]["impactedEndpoints"]] == ["/show"]
    assert violations({**doc, "more": 1}, SCHEMAS["impact"]) and violations({"summary": 1}, SCHEMAS["impact"])


def test_command_line(root, tmp_path, capsys):
    (tmp_path / "d.diff").write_text(DIFF)
    assert cli.main(["schema", "--type", "impact"]) == 0 and json.loads(capsys.readouterr().out) == SCHEMAS["impact"]
    assert cli.main(["impact", "--project", "relative", "--diff", "x"]) == 1 and "invalid_input" in capsys.readouterr().err
    sidecar = tmp_path / "errors.json"
    assert cli.main(["impact", "--project", root, "--diagnostics-output", str(sidecar)]) == 1
    assert json.loads(sidecar.read_text())["error"]["code"] == "invalid_input"
    with pytest.raises(SystemExit):
        cli.main(["unknown"])


def test_stream_of_diffs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.diff").write_text(DIFF)
    run = lambda: stream.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    assert run()
    (tmp_path / "in/b.diff").write_text(DIFF.replace("core/core.go", "x/y.go"))
    assert run()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("file").collect()
    assert [(r.file, r.kind, r.start_line, r.end_line) for r in rows] == [("core/core.go", "added", 4, 4), ("x/y.go", "added", 4, 4)]
