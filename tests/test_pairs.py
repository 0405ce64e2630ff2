"""Summaries that count or list pairs by groups, against the operators that make each pair."""

import random

import pytest
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S
from ripplegraph.operators import closure, contracts, endpoints, impact


@pytest.fixture(scope="module")
def graph(spark):
    """References among 12 symbols, on rings too, and to 30 that lead nowhere; some repeat, some are glue or null."""
    pick = random.Random(5)
    rows = [(f"s{pick.randrange(12)}", f"s{pick.randrange(12)}", "call", "a.go") for _ in range(14)]
    rows += [(f"s{i % 12}", f"leaf{i}", "call", "a.go") for i in range(30)]
    rows += rows[:5] + [("s1", "s2", "call", "a_grpc.pb.go"), (None, "s1", "call", "a.go")]
    refs = spark.createDataFrame(rows, "to_symbol string, from_symbol string, kind string, file string")
    roots = spark.createDataFrame([(f"s{i}",) * 2 for i in range(0, 12, 2)] + [("s0", "s0"), ("x", "x")], "root_id string, node string")
    return refs, roots


@pytest.fixture(scope="module")
def entries(spark):
    """Contracts of one entry and of several, one with an entry that nothing reaches."""
    rows = [("http", f"GET /p{i % 9}", "exact", f"s{i * 5 % 12}") for i in range(20)] + [("job", "j", "exact", "s3"), ("job", "j", "exact", "s3"), ("grpc", "g", "exact", "none"), ("http", "GET /leaf", "exact", "leaf7")]
    return spark.createDataFrame(rows, "kind string, identity string, resolution string, entry_symbol string")


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def whole(entries):
    return entries.select(S.fact_id(F.col("kind"), F.col("identity")).alias("id"), "*").distinct()


def test_edges_toward_targets(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("b", "a"), ("b", "lost"), ("lost", "end"), (None, "c"), ("c", "d")], "node string, next string")
    targets = spark.createDataFrame([("c",), ("elsewhere",), (None,)], "node string")
    assert {(r.node, r.next) for r in closure.toward(edges, targets).collect()} == {("a", "b"), ("b", "a"), ("b", "c")}
    assert closure.toward(edges, targets.where("node = 'elsewhere'")).isEmpty()


def test_impact_by_entries_is_impact(graph, entries):
    own, every = contracts.impact_by_entries(*graph, entries), contracts.impact(*graph, whole(entries))
    assert own.count() > 15 and rows(own) == rows(every)


def test_agreement_counts_pairs(graph, entries):
    up = {(r.root_id, r.id, r.kind) for r in contracts.impact(*graph, whole(entries)).collect()}
    down = {(r.root_id, r.id, r.kind) for r in contracts.sources(*graph, whole(entries)).collect()}
    want = {k: tuple(sum(p[2] == k for p in pairs) for pairs in (up, down, up & down)) for k in {p[2] for p in up | down}}
    assert {r.kind: (r.summary, r.reverse_summary, r.agreed) for r in contracts.agreement(*graph, entries).collect()} == want


def test_summary_of_keys_is_global_summary(spark, graph):
    routes = spark.createDataFrame([(f"r{i}", f"s{i * 5 % 12}" if i % 6 else None, " get" if i % 2 else "GET ", f"/p{i % 7}\n" if i % 4 else "", f" /p{i % 3}") for i in range(40)], "id string, handler_symbol string, method string, resolved_path string, local_path string")
    notes = spark.createDataFrame([("n1", "s5", "POST", "/n"), ("n2", "s5", "", "/m"), ("n3", "s10", "put", None), ("n4", "s4", "PUT", "/n"), ("n5", "none", "", "")], "id string, handler_symbol string, method string, path string")
    resolved = endpoints.resolutions(routes, notes)
    keys = endpoints.keys(routes, notes)
    assert rows(keys.distinct()) == rows(impact.terminals(resolved))
    want = impact.global_summary(impact.affected_endpoints(*graph, impact.terminals(resolved)))
    assert rows(impact.summary_of_keys(*graph, keys)) == rows(want)
    none = rows(impact.summary_of_keys(*graph, keys.where("path = 'no'")))
    assert none == [(0, 0, 0)]


def test_join_path_at_line_ends(spark):
    parts = spark.createDataFrame([("a//", "//b/"), ("", ""), (None, None), ("//a", "/"), ("/a", "b/\n"), ("a/\n", "b")], "p string, q string")
    assert [r[0] for r in parts.select(S.join_path(F.col("p"), F.col("q"))).collect()] == ["/a/b", "/", "/", "//a", "/a/b/\n", "/a/\n/b"]


def test_protocol_lists_are_by_protocol(spark, graph, entries):
    more = spark.createDataFrame([("http", None, "exact", "s3"), ("http", "", "exact", "s3"), ("other", "o", "exact", "s3"), ("job", "j", "exact", "s4"), ("dubbo", "d;é/" + "m" * 5000, "exact", "s5"), ("dubbo", "d", "exact", "s5")], entries.schema)
    every = entries.unionByName(more)
    want = contracts.by_protocol(contracts.impact(*graph, whole(every)))
    assert want.count() > 4
    own = contracts.protocol_lists(*graph, every)
    assert rows(own) == rows(want.select("root_id", *[F.array_join(k, ";").alias(k) for k in contracts.PROTOCOLS]))


@pytest.mark.parametrize("held", [1, 60, 1 << 20])
def test_pieces_make_whole_lists(monkeypatch, held):
    """Contracts that repeat over batches and tables, in groups of their own, shared and large ones; long and empty names."""
    pa = pytest.importorskip("pyarrow")
    monkeypatch.setattr(contracts, "HELD", held)
    monkeypatch.setattr(contracts, "LONG", 30)
    pick = random.Random(7)
    given = sorted((pick.choice((1, 3)), pick.choice(("", "é;", "x" * 40, *"abcdefgh")), sorted(pick.sample(range(6), pick.randrange(1, 5)))) for _ in range(80))
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part]), pa.array([r[2] for r in part], pa.list_(pa.int64()))], ["part", "identity", "groups"])
    given.sort(key=lambda r: (r[0], r[1].encode()))
    made = [r for b in contracts._pieces(batch(given[i : i + 7]) for i in range(0, len(given), 7)) for r in b.to_pylist()]
    assert any(r["size"] for r in made) and (held > 1 or len(made) > 60)
    made += [{"group": g, "part": 0, "first": f"root{g}{n}", "size": 0, "text": None} for g in range(7) for n in "ab"]
    made.sort(key=lambda r: (r["group"], r["part"], r["first"].encode()))
    fields = pa.schema([("group", pa.int64()), ("part", pa.int32()), ("first", pa.string()), ("size", pa.int64()), ("text", pa.binary())])
    out = [r for b in contracts._lists(pa.RecordBatch.from_pylist(made[i : i + 9], fields) for i in range(0, len(made), 9)) for r in b.to_pylist()]
    names = lambda g, part: ";".join(sorted({r[1] for r in given if r[0] == part and g in r[2]}, key=str.encode))
    assert out == [{"root_id": f"root{g}{n}", **{k: names(g, i) for i, k in enumerate(contracts.PROTOCOLS, 1)}} for g in range(7) for n in "ab"]
