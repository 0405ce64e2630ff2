"""Outbound events from sources to documents, build constraints, links and diagnostics."""

import os
import textwrap

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import events
from ripplegraph.operators.budgets import BudgetExceeded, ProjectInvalid
from ripplegraph.plans import documents
from ripplegraph.sources import build, project

FILES = {
    "go.mod": "module talk.test/app\n\ngo 1.22\n",
    "model/model.go": """
        package model

        type Order struct {
        \tName string
        }

        const Prefix = "order"

        const Done = Prefix + ".done"

        type Message struct {
        \tEvent string
        \tBody any
        }
        """,
    "wire/wire.go": """
        package wire

        import "talk.test/app/model"

        var scheme = "broadcast://"

        func post(target string) { send(scheme+target, "/broadcast/send") }

        func send(a, b string) {}

        func Push(m model.Message, body any) { post(m.Event) }

        func Topic(name string, body any) {
        \tPush(model.Message{Event: "topic." + name}, body)
        }
        """,
    "use/use.go": """
        package use

        import (
        \t"talk.test/app/model"
        \t"talk.test/app/wire"
        \t"other.test/bus"
        )

        func Finish(o model.Order) {
        \tready := true
        \tif ready {
        \t\twire.Push(model.Message{Event: model.Done}, o)
        \t}
        }

        func Start(o *model.Order) {
        \tname := string("start")
        \twire.Topic(name, o)
        }

        func Relay(kind string) { wire.Topic("re."+kind, 1) }

        func Both() {
        \tRelay("a")
        \tRelay("b")
        }

        func Known(o model.Order) { bus.Send(1, "known", o) }

        func Short() { bus.Send(1) }

        func Unknown(pick func() string) { wire.Topic(pick(), 1) }
        """,
    "shape/shape.go": """
        package shape

        type Runner interface{ Run() int }

        type Base struct{ Inner *Core }

        type Core struct{}

        func (c *Core) Deep() int { return 1 }

        func (b *Base) Run() int { return 2 }

        func (b *Base) Name() string { return "b" }

        type First struct {
        \tBase
        \tx int
        }

        func (f First) Name() string { return "f" }

        type Second struct{ *First }

        type Other struct{}

        func (o Other) Run() int { return 3 }

        func NewOther() *Other { return &Other{} }

        var Runners = map[string]Runner{"first": First{}, "other": NewOther()}

        var Opaque = map[string]Runner{"first": First{}, "any": pick()}

        func pick() Runner { return nil }

        var second = Second{}
        """,
    "shape/use.go": """
        package shape

        func Embedded() int { return second.Run() }

        func Shadowed() string { return second.Name() }

        func Through() int { return second.Inner.Deep() }

        func Dispatch(k string) int { return Runners[k].Run() }

        func Undecided(k string) int { return Opaque[k].Run() }
        """,
    "far/far.go": """
        package far

        import "talk.test/app/shape"

        func Away(k string) int { return shape.Runners[k].Run() }
        """,
    "only_windows.go": "package app\n\nfunc Windows() {}\n",
    "tagged.go": "//go:build (extra && !old) || plan9\n\npackage app\n\nfunc Tagged() {}\n",
    "older.go": "// +build extra,!old plan9\n\npackage app\n\nfunc Older() {}\n",
    "native.go": 'package app\n\nimport "C"\n\nfunc Native() {}\n',
}
SENDERS = (("other.test/bus", "Send", 1, 2),)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("talk")
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(textwrap.dedent(text).lstrip("\n"))
    return str(top)


@pytest.fixture(scope="module")
def base(spark, root):
    return project.load(spark, root, senders=SENDERS)


def test_events(base):
    found = {(r.sender_symbol.split("::")[-1], r.event, r.resolved) for r in base.im_events.collect()}
    assert {("Finish", "order.done", True), ("Start", "topic.start", True), ("Both", "topic.re.a", True), ("Both", "topic.re.b", True), ("Known", "known", True)} <= found
    assert ("Unknown", None, False) in found and not any(s in ("Relay", "Topic", "Short") for s, _, _ in found)
    needs = {(r.relation, r.symbol_id.split("/")[-1]) for r in base.im_dependencies.join(base.im_events.where("event = 'order.done'").select("id"), "id").collect()}
    assert ("event_value", "model::Done") in needs
    assert [d.code for d in base.diagnostics.where("code like 'im%'").collect()] == ["im_argument_mismatch"]


def test_a_project_without_the_protocol_has_no_reach(spark):
    anchors = spark.createDataFrame([("f", True, False)], "id string, scheme boolean, endpoint boolean")
    refs = spark.createDataFrame([("call", "g", "f")], "kind string, from_symbol string, to_symbol string")
    assert events.protocol_reach(anchors, refs).count() == 0
    both = anchors.union(spark.createDataFrame([("h", False, True)], anchors.schema))
    refs = refs.union(spark.createDataFrame([("call", "g", "h"), ("call", "k", "g"), ("type", "t", "f"), ("call", "f", "k")], refs.schema))
    got = {r.symbol: (r.scheme, r.endpoint) for r in events.protocol_reach(both, refs).collect()}
    assert got == {"f": (True, True), "g": (True, True), "h": (False, True), "k": (True, True)}


def test_the_body_set_last_before_the_event_counts(spark):
    schema = project.SCHEMAS
    name = lambda n: [("p", n)]
    text = lambda t: [(t, None, None, None)]
    bodies = spark.createDataFrame([("f", "m", 5, name("Old"), []), ("f", "m", 9, name("New"), []), ("f", "m", 30, name("Late"), []), ("f", "x", 11, name("Other"), [])], schema["event_bodies"])
    emits = spark.createDataFrame([("f", "m", 12, text("e"), '"e"', [], "a.go", 3, 1, 3, 9), ("f", "m", 40, text("later"), '"later"', [], "a.go", 9, 1, 9, 9), ("g", "m", 12, text("e"), '"e"', [], "a.go", 3, 1, 3, 9)], schema["event_emits"])
    reach = spark.createDataFrame([("f", False, True)], "symbol string, scheme boolean, endpoint boolean")
    senders = spark.createDataFrame([], "callee string, event_arg int, payload_arg int")
    found = events.direct(spark.createDataFrame([], schema["event_calls"]), emits, bodies, reach, senders).collect()
    assert [(r.function, r.event[0].text, [d.name for d in r.payload]) for r in found] == [("f", "e", ["New"])]


def test_a_growing_ring_of_calls_raises(spark):
    schema = project.SCHEMAS
    part = lambda text, param: (text, None, None, param)
    calls = spark.createDataFrame([("1", "f", "f", 1, [([part("x", None), part(None, 0)], [], [], "raw")], None, None, None, [], "a.go", 1, 1, 1, 2)], schema["event_calls"])
    start = spark.createDataFrame([("f", [part(None, 0)], "p", [], [], [], [])], f"function string, event {events.PARTS}, event_raw string, payload {events.NAMES}, params array<int>, controls {events.NAMES}, evidence array<struct<file: string, sl: int, sc: int, el: int, ec: int>>")
    with pytest.raises(BudgetExceeded):
        events.fixpoint(start, calls, most=4)
    same = calls.withColumn("args", F.transform("args", lambda a: F.struct(F.slice(a["parts"], 2, 1).alias("parts"), a["deps"].alias("deps"), a["params"].alias("params"), a["raw"].alias("raw"))))
    assert events.fixpoint(start, same).count() == 1


def test_events_in_the_document(spark, root):
    change = "diff --git a/model/model.go b/model/model.go\n--- a/model/model.go\n+++ b/model/model.go\n@@ -4,1 +4,1 @@\n-\tName int\n+\tName string\n"
    doc = documents.impact_document(spark, root, change, build={"senders": SENDERS})
    assert doc["summary"]["impactedIMEvents"] == ["known", "order.done", "topic.start"] and doc["summary"]["impactedIMCount"] == 3
    assert doc["fileSources"][0]["impactedIMEvents"] == ["known", "order.done", "topic.start"]
    change = "diff --git a/use/use.go b/use/use.go\n--- a/use/use.go\n+++ b/use/use.go\n@@ -12,1 +12,1 @@\n-\t\twire.Push(model.Message{Event: \"old\"}, o)\n+\t\twire.Push(model.Message{Event: model.Done}, o)\n"
    assert documents.impact_document(spark, root, change)["summary"]["impactedIMEvents"] == ["order.done"]


def test_build_constraints(spark, root, base):
    names = lambda fb: {r.name for r in fb.symbols.where("package_path = 'talk.test/app'").collect()}
    assert names(base) == set()
    assert names(project.load(spark, root, tags=("extra",))) == {"Tagged", "Older"}
    assert names(project.load(spark, root, goos="windows", cgo=True)) == {"Windows", "Native"}


@pytest.mark.parametrize("text, want", [("linux", True), ("!linux", False), ("linux && amd64", True), ("linux && (arm64 || !cgo)", True), ("windows || darwin", False), ("unix && go1.18", True), ("go1.99", False), ("a b", True), ("(linux", True)])
def test_build_expressions(text, want):
    assert build.holds(text, build.tags_of("linux", "amd64", False)) is want


def test_links_out_of_the_project_are_refused(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out.go").write_text("package x\n")
    (tmp_path / "in" / "go.mod").write_text("module m.test/x\n")
    os.symlink(tmp_path / "in" / "go.mod", tmp_path / "in" / "same.mod")
    project.check_links(str(tmp_path / "in"))
    os.symlink(tmp_path / "out.go", tmp_path / "in" / "far.go")
    with pytest.raises(ProjectInvalid):
        project.check_links(str(tmp_path / "in"))


def test_embedded_methods_and_map_dispatch(base):
    calls = {}
    for r in base.references.where("kind = 'call'").collect():
        calls.setdefault(r.from_symbol.split("::")[-1], set()).add(r.to_symbol.split("shape")[-1])
    assert calls["Embedded"] == {":Base:Run"} and calls["Shadowed"] == {":First:Name"} and calls["Through"] == {":Core:Deep"}
    assert calls["Dispatch"] == calls["Away"] == {":Base:Run", ":Other:Run"} and "Undecided" not in calls


def test_diagnostics_of_names(base):
    codes = {(d.code, d.file) for d in base.diagnostics.collect()}
    assert not any(c == "package_load_failed" for c, _ in codes)
