"""Service contracts of four protocols, and their impact."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S
from ripplegraph.operators import closure
from ripplegraph.operators.budgets import Limits
from ripplegraph.operators.lineage import broadcast_few, settle

if TYPE_CHECKING:
    import pyarrow as pa

PROTOCOLS = ("grpc", "dubbo", "http", "job")

#: Bytes of text that a Python worker makes before it hands them over; a longer text goes alone.
HELD = 1 << 25
#: Bytes from which a piece of a list is compressed on its way to where the list is put together.
LONG = 1 << 12


def live(registrations: DataFrame, references: DataFrame) -> DataFrame:
    """symbol and is_live of registration functions: referenced by any, or named like an entry point."""
    used = references.where("to_symbol is not null").select(F.col("to_symbol").alias("symbol"), F.lit(True).alias("_used")).distinct()
    return registrations.select("symbol").distinct().join(used, "symbol", "left").select("symbol", (F.coalesce("_used", F.lit(False)) | S.is_registration_name(S.symbol_name(F.col("symbol")))).alias("is_live"))


def contract_entries(grpc: DataFrame, dubbo: DataFrame, http: DataFrame, jobs: DataFrame, alive: DataFrame) -> DataFrame:
    """kind, identity, resolution and entry_symbol of all contracts whose registration is live; rows may repeat.

    A grpc provider is entered by its handler, its implementation and its registration; the others by their handler.
    """
    g = grpc.select(F.lit("grpc").alias("kind"), F.col("identity"), F.lit("exact").alias("resolution"), "registration_symbol", F.explode(F.array_distinct(F.array("handler_symbol", "implementation_symbol", "registration_symbol"))).alias("entry_symbol"))
    d = dubbo.select(F.lit("dubbo").alias("kind"), F.concat_ws("/", "interface", "method").alias("identity"), F.when(F.col("version").isNull(), "symbolic").otherwise("exact").alias("resolution"), "registration_symbol", F.col("handler_symbol").alias("entry_symbol"))
    h = http.select(F.lit("http").alias("kind"), F.concat_ws(" ", "method", F.coalesce("resolved_path", "path_raw")).alias("identity"), F.when(F.col("resolved_path").isNull(), "symbolic").otherwise("exact").alias("resolution"), F.col("route_func").alias("registration_symbol"), F.col("handler_symbol").alias("entry_symbol"))
    j = jobs.select(F.lit("job").alias("kind"), F.col("name").alias("identity"), F.lit("exact").alias("resolution"), "registration_symbol", F.col("handler_symbol").alias("entry_symbol"))
    all_of = g.unionByName(d).unionByName(h).unionByName(j).where("entry_symbol is not null")
    ok = broadcast_few(alive.where("is_live").select(F.col("symbol").alias("registration_symbol")).distinct(), 1 << 19)
    return all_of.join(ok, "registration_symbol").select("kind", "identity", "resolution", "entry_symbol")


def contracts(grpc: DataFrame, dubbo: DataFrame, http: DataFrame, jobs: DataFrame, alive: DataFrame) -> DataFrame:
    """id, kind, identity, resolution and entry_symbol of all contracts whose registration is live, once each."""
    return contract_entries(grpc, dubbo, http, jobs, alive).select(S.fact_id(F.col("kind"), F.col("identity")).alias("id"), "kind", "identity", "resolution", "entry_symbol").distinct()


def with_entries(entries: DataFrame) -> DataFrame:
    """kind and identity of each contract, once, and the sorted set of its entries (symbols)."""
    own = entries.select("kind", "identity", "entry_symbol").repartition("kind", "identity")
    return own.groupBy("kind", "identity").agg(F.array_sort(F.collect_set("entry_symbol")).alias("entries"))


def walked(references: DataFrame) -> DataFrame:
    """node and next: who depends on a symbol; symbols in generated glue are not walked through."""
    return references.where(~S.is_generated_glue(F.col("file"))).select(F.col("to_symbol").alias("node"), F.col("from_symbol").alias("next"))


def impact(references: DataFrame, roots: DataFrame, contract: DataFrame, limits: Limits | None = None) -> DataFrame:
    """root_id, contract id, kind, identity and level of the contracts that each changed symbol reaches.

    Symbols in generated glue are not walked through. A contract reached by several symbols counts once, at its least level.
    """
    found = closure.reach(walked(references), roots, limits)
    hit = found.join(contract.select("id", "kind", "identity", F.col("entry_symbol").alias("node")), "node")
    return hit.groupBy("root_id", "id", "kind", "identity").agg(F.min("level").alias("level"))


def reached_entries(references: DataFrame, roots: DataFrame, entries: DataFrame) -> DataFrame:
    """root_id, node and level of the entries (node) that each changed symbol reaches; only what leads to one is walked."""
    edges = closure.toward(walked(references), entries)
    return settle(closure.reach(edges, roots).join(entries.select("node").distinct(), "node", "left_semi").select("root_id", "node", "level"))


def impact_by_entries(references: DataFrame, roots: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of impact(), of contract_entries().

    Contracts go to tasks by identity, once; their many pairs with roots are made there and never dealt out. Those of
    one entry, nearly all, need no least level.
    """
    contract = settle(with_entries(entries))
    symbols = settle(contract.select(F.explode("entries").alias("node")).distinct())
    found = reached_entries(references, roots, symbols)
    lists = found.groupBy("node").agg(F.collect_list(F.struct("root_id", "level")).alias("_roots"))
    lists = F.broadcast(lists) if found.count() <= 1 << 20 else settle(lists)
    one = contract.where("size(entries) = 1").withColumn("node", F.col("entries")[0]).join(lists, "node").select("kind", "identity", F.explode("_roots").alias("_r"))
    more = contract.where("size(entries) > 1").select("kind", "identity", F.explode("entries").alias("node")).join(lists, "node").select("kind", "identity", F.explode("_roots").alias("_r"))
    least = more.groupBy("kind", "identity", F.col("_r.root_id").alias("root_id")).agg(F.min("_r.level").alias("level"))
    hit = one.select("kind", "identity", "_r.root_id", "_r.level").unionByName(least)
    return hit.select("root_id", S.fact_id(F.col("kind"), F.col("identity")).alias("id"), "kind", "identity", "level")


def sources(references: DataFrame, roots: DataFrame, contract: DataFrame, limits: Limits | None = None) -> DataFrame:
    """root_id, contract id and kind: the pairs of impact(), found from the contracts' entries down to the changed symbols."""
    edges = walked(references).select(F.col("next").alias("node"), F.col("node").alias("next"))
    entries = contract.select(F.col("entry_symbol").alias("root_id"), F.col("entry_symbol").alias("node")).distinct()
    below = closure.reach(edges, entries, limits).select(F.col("root_id").alias("entry_symbol"), "node")
    hit = below.join(roots.select("root_id", "node").distinct(), "node").select("entry_symbol", "root_id")
    return hit.join(contract.select("entry_symbol", "id", "kind"), "entry_symbol").select("root_id", "id", "kind").distinct()


def agreement(references: DataFrame, roots: DataFrame, entries: DataFrame) -> DataFrame:
    """kind and the numbers of pairs of impact(), of sources() and of both, of contract_entries().

    Contracts of one kind and the same entries have the same roots; pairs are found once for such a group, by each
    direction's own walk, and counted for all its contracts.
    """
    group = settle(with_entries(entries).groupBy("kind", "entries").agg(F.count("*").alias("_n")))
    sets = settle(group.select("entries").distinct().select("entries", F.explode("entries").alias("node")))
    symbols, own = sets.select("node").distinct(), settle(roots.select("root_id", "node").distinct())
    edges = settle(closure.toward(walked(references), symbols))  # what leads to an entry is what lies below one
    up = closure.reach(edges, own).select("root_id", "node").join(sets, "node")
    below = closure.reach(edges.select(F.col("next").alias("node"), F.col("node").alias("next")), symbols.select(F.col("node").alias("root_id"), "node"))
    down = below.join(own.withColumnRenamed("root_id", "_own"), "node").select(F.col("_own").alias("root_id"), F.col("root_id").alias("node")).join(sets, "node")
    marked = up.select("entries", "root_id", F.lit(1).alias("f"), F.lit(0).alias("b")).unionByName(down.select("entries", "root_id", F.lit(0).alias("f"), F.lit(1).alias("b")))
    each = marked.groupBy("entries", "root_id").agg(F.max("f").alias("f"), F.max("b").alias("b"))
    each = each.groupBy("entries").agg(F.sum("f").alias("f"), F.sum("b").alias("b"), F.sum(F.col("f") * F.col("b")).alias("both"))
    counted = group.join(each, "entries").groupBy("kind")
    return counted.agg(F.sum(F.col("_n") * F.col("f")).alias("summary"), F.sum(F.col("_n") * F.col("b")).alias("reverse_summary"), F.sum(F.col("_n") * F.col("both")).alias("agreed"))


def by_protocol(hit: DataFrame) -> DataFrame:
    """root_id and, for each protocol, the sorted distinct identities; empty where there are none."""
    lists = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("identity")))).alias(k) for k in PROTOCOLS]
    return hit.groupBy("root_id").agg(*lists)


def protocol_lists(references: DataFrame, roots: DataFrame, entries: DataFrame, keep: Callable[[DataFrame], DataFrame] = settle) -> DataFrame:
    """root_id and the lists of by_protocol() of impact(), each joined by semicolons; of contract_entries().

    Roots that reach the same entries have the same lists, which are made once. Contracts are dealt out and sorted
    once, by ranges of identities; a range gives each group of roots a piece of its list, and pieces are put together
    in order of their first identities, a group at a time, so that no list is sorted or held as pairs. keep settles
    what the result is read from, where the rest goes before.
    """
    part = F.array_position(F.array(*map(F.lit, PROTOCOLS)), F.col("kind")).cast("int")
    own = keep(entries.select(part.alias("part"), "identity", F.col("entry_symbol").alias("node")))
    found = reached_entries(references, roots, settle(own.select("node").distinct()))
    alike = found.groupBy("root_id").agg(F.array_sort(F.collect_set("node")).alias("nodes")).groupBy("nodes").agg(F.collect_list("root_id").alias("roots"))
    groups = keep(alike.withColumn("group", F.monotonically_increasing_id()))
    pairs = keep(groups.select("group", F.explode("nodes").alias("node")))
    member = pairs.groupBy("node").agg(F.collect_list("group").alias("groups"))
    listed = own.where("part > 0 and identity is not null")
    if pairs.count() <= 1 << 20:  # groups are joined where contracts lie, and not dealt out with them
        dealt = listed.repartitionByRange("part", "identity").join(F.broadcast(member), "node")
    else:
        dealt = listed.join(member, "node").repartitionByRange("part", "identity")
    dealt = dealt.select("part", "identity", "groups").sortWithinPartitions("part", "identity")
    pieces = dealt.mapInArrow(_pieces, "group bigint, part int, first string, size bigint, text binary")
    named = groups.select("group", F.lit(0).alias("part"), F.explode("roots").alias("first"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("binary").alias("text"))
    ordered = pieces.unionByName(named).repartition("group").sortWithinPartitions("group", "part", "first")
    return ordered.mapInArrow(_lists, "root_id string, " + ", ".join(f"{k} string" for k in PROTOCOLS))


def _weighed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (part, identity, groups) in tables of one part each, whose pieces have some HELD bytes or that are one row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in chain(batches, [None]):
        if held and (batch is None or size >= HELD):
            rows = pa.Table.from_batches(held).combine_chunks()
            weight = np.cumsum(pc.list_value_length(rows["groups"]).to_numpy().astype("int64") * (16 + pc.binary_length(rows["identity"]).to_numpy()))
            part, start = rows["part"].to_numpy(), 0
            while start < len(part):
                end = max(start + 1, int(np.searchsorted(weight, (weight[start - 1] if start else 0) + HELD, "right")))
                end = min(end, int(np.searchsorted(part, part[start], "right")))
                yield rows.slice(start, end - start).combine_chunks()
                start = end
            held, size = [], 0
        if batch is not None and len(batch):
            held.append(batch)
            size += len(pc.list_flatten(batch["groups"])) * (16 + batch["identity"].nbytes // len(batch))


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contracts (part, identity, groups) in order: for each group the different identities, joined, and the first of them.

    text is compressed where size, its bytes, is not 0.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    last, given = None, np.empty(0, "int64")  # the contract that came last, and the groups that have it
    for rows in _weighed(batches):
        part, identity, groups = rows["part"][0].as_py(), rows["identity"].chunk(0), rows["groups"].chunk(0)
        number = np.zeros(len(rows), "int64")
        number[1:] = np.cumsum(pc.not_equal(identity[1:], identity[:-1]).to_numpy(zero_copy_only=False))
        row = np.repeat(np.arange(len(rows)), pc.list_value_length(groups).to_numpy(zero_copy_only=False))
        group = groups.flatten().to_numpy(zero_copy_only=False)
        if (part, identity[0].as_py()) == last:
            fresh = (number[row] > 0) | ~np.isin(group, given)
        else:
            fresh, given = np.ones(len(row), bool), given[:0]
        ended = np.unique(group[number[row] == number[-1]])
        given = ended if number[-1] else np.union1d(given, ended)
        last = part, identity[len(rows) - 1].as_py()
        row, group = row[fresh], group[fresh]
        order = np.argsort(group, kind="stable")
        row, group = row[order], group[order]
        first = np.ones(len(row), bool)
        first[1:] = (group[1:] != group[:-1]) | (number[row[1:]] != number[row[:-1]])
        row, group = row[first], group[first]
        if not len(row):
            continue
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        values = identity.take(pa.array(row))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), values), ";")
        size = pc.binary_length(text).to_numpy().astype("int64")
        size[size < LONG] = 0
        text = pa.array([pa.compress(x.as_buffer(), "zstd", asbytes=True) if n else x.as_buffer().to_pybytes() for n, x in zip(size, text)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(group[starts]), pa.array(np.full(len(starts), part, "int32")), values.take(pa.array(starts)), pa.array(size), text], ["group", "part", "first", "size", "text"])


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (group, part, first, text) in order, part 0 naming a root: each root with its group's texts joined by part."""
    import pyarrow as pa

    names = ["root_id", *PROTOCOLS]

    def whole() -> Iterator[list]:
        group, roots, texts = None, [], [[] for _ in PROTOCOLS]
        for batch in batches:
            for g, part, first, size, text in zip(*(batch[c].to_pylist() for c in ("group", "part", "first", "size", "text"))):
                if g != group:
                    yield from joined(roots, texts)
                    group, roots = g, []
                if part:
                    texts[part - 1].append((size, text))
                else:
                    roots.append(first)
        yield from joined(roots, texts)

    def joined(roots: list, texts: list[list[tuple[int, bytes]]]) -> Iterator[list]:
        cells = []
        for pieces in texts:
            cell = bytearray()
            for i, (size, text) in enumerate(pieces):
                cell += b";" if i else b""
                cell += pa.decompress(text, size, "zstd") if size else text
            pieces.clear()
            cells.append(cell)
        for root in roots:
            yield [root, *cells]

    held, size = [], 0
    for row in chain(whole(), [None]):
        more = sum(map(len, row[1:])) if row else 0
        if held and (row is None or size + more > HELD):
            made, held, size = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names), [], 0
            yield made
            del made
        if row:
            held.append(row)
            size += more


def pair_configurations(configs: DataFrame, providers: DataFrame) -> DataFrame:
    """config_id and provider_id: each configuration takes the first provider behind it that none before it took.

    configs and providers: function, id, position. Going through a function's configurations in order, the i-th
    takes provider i + max over j <= i of (first_j - j) + 1, where first_j is the number of providers up to the j-th
    configuration's end: one running count over both sides and a running maximum instead of a loop.
    """
    order = Window.partitionBy("function").orderBy("position", "id")
    p = providers.select("function", F.col("id").alias("provider_id"), F.row_number().over(order).alias("_n"))
    sides = providers.select("function", "id", "position", F.lit(0).alias("_side")).unionByName(configs.select("function", "id", "position", F.lit(1).alias("_side")))
    before = Window.partitionBy("function").orderBy("position", "_side", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = sides.withColumn("_first", F.sum(1 - F.col("_side")).over(before)).withColumn("_i", F.sum("_side").over(before)).where("_side = 1")
    numbered = numbered.withColumn("_n", F.col("_i") + F.max(F.col("_first") - F.col("_i") + 1).over(before))
    return numbered.select("function", F.col("id").alias("config_id"), "_n").join(p, ["function", "_n"]).select("function", "config_id", "provider_id")
