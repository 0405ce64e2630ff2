"""Outbound events: which functions send what, carried from callees to callers by relational fixpoints.

A summary says that a function sends an event: its name as parts (texts, constants, the function's own parameters) and
the names that its payload and the conditions around it are made of. Summaries that hang on parameters go to every
caller, whose arguments take the parameters' place, until nothing new comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.operators import closure
from ripplegraph.operators.budgets import BudgetExceeded
from ripplegraph.operators.lineage import settle

NAMES = "array<struct<pkg: string, name: string>>"
PARTS = "array<struct<text: string, pkg: string, name: string, param: int>>"
SUMMARY = ("function", "event", "event_raw", "payload", "params", "controls", "evidence")


def protocol_reach(anchors: DataFrame, references: DataFrame) -> DataFrame:
    """symbol, scheme and endpoint: whether a symbol leads to either literal, itself or through what it refers to.

    anchors: id, scheme, endpoint. A project without both literals has no protocol and no rows.
    """
    roots = anchors.select("id", F.explode(F.filter(F.array(F.when(F.col("scheme"), "scheme"), F.when(F.col("endpoint"), "endpoint")), lambda k: k.isNotNull())).alias("root_id"))
    roots = settle(roots.select("root_id", F.col("id").alias("node")))
    if roots.select("root_id").distinct().count() < 2:
        return roots.select(F.col("node").alias("symbol"), F.lit(False).alias("scheme"), F.lit(False).alias("endpoint")).where("false")
    edges = references.where("kind in ('call', 'value')").select(F.col("to_symbol").alias("node"), F.col("from_symbol").alias("next"))
    found = closure.reach(edges, roots)
    return found.groupBy(F.col("node").alias("symbol")).agg(F.bool_or(F.col("root_id") == "scheme").alias("scheme"), F.bool_or(F.col("root_id") == "endpoint").alias("endpoint"))


def _evidence() -> Column:
    return F.array(F.struct("file", "sl", "sc", "el", "ec"))


def direct(calls: DataFrame, emits: DataFrame, bodies: DataFrame, reach: DataFrame, senders: DataFrame) -> DataFrame:
    """Summaries of functions that send themselves: by a known sender, by a project function that speaks the protocol
    and is given a literal with an event field, or by naming a message's event after its body was set.

    senders: callee, event_arg and payload_arg (from 0).
    """
    arg = lambda i: F.get("args", F.col(i))
    known = calls.join(F.broadcast(senders), "callee").where(F.size("args") > F.greatest("event_arg", "payload_arg"))  # a row for each configured function
    known = known.select("function", arg("event_arg")["parts"].alias("event"), arg("event_arg")["raw"].alias("event_raw"), arg("payload_arg")["deps"].alias("payload"), arg("payload_arg")["params"].alias("params"), "controls", _evidence().alias("evidence"))
    speaks = reach.where("scheme and endpoint").select(F.col("symbol").alias("callee"))
    after = F.get("args", F.col("event_at") + 1)
    spoken = calls.where("event_at is not null").join(speaks, "callee").select("function", F.col("event_parts").alias("event"), "event_raw", after["deps"].alias("payload"), after["params"].alias("params"), "controls", _evidence().alias("evidence"))
    near = reach.where("endpoint").select(F.col("symbol").alias("function"))
    earlier = emits.join(near, "function").join(bodies.select("function", "variable", F.col("position").alias("_at"), "deps", F.col("params").alias("_params")), ["function", "variable"]).where("_at < position")
    latest = earlier.groupBy("function", "position").agg(F.max_by(F.struct("deps", "_params", "parts", "raw", "controls", "file", "sl", "sc", "el", "ec"), "_at").alias("x"))
    first = latest.groupBy("function").agg(F.min_by("x", "position").alias("x")).select("function", "x.*")
    told = first.select("function", F.col("parts").alias("event"), F.col("raw").alias("event_raw"), F.col("deps").alias("payload"), F.col("_params").alias("params"), "controls", _evidence().alias("evidence"))
    return known.unionByName(spoken).unionByName(told).select("function", "event", "event_raw", *[_sorted(c) for c in ("payload", "params", "controls")], "evidence")


def _sorted(name: str) -> Column:
    kind = "array<int>" if name == "params" else NAMES
    return F.array_sort(F.array_distinct(F.coalesce(F.col(name), F.array()).cast(kind))).alias(name)


def too_few_arguments(calls: DataFrame, senders: DataFrame) -> DataFrame:
    """Calls of a known sender that lack an argument."""
    own = calls.join(F.broadcast(senders), "callee")
    return own.where(F.size("args") <= F.greatest("event_arg", "payload_arg")).select("callee", "function", "file", "sl")


def is_open(event: Column, params: Column) -> Column:
    """Whether a summary hangs on a parameter of its function."""
    return F.coalesce(F.exists(event, lambda p: p["param"].isNotNull()), F.lit(False)) | (F.size(params) > 0)


def fixpoint(summaries: DataFrame, calls: DataFrame, most: int = 1000) -> DataFrame:
    """All summaries that follow: open ones at every call of their function, with the arguments put in.

    Two are the same if function, event, payload, parameters and conditions are. More than `most` rounds, as by a ring
    of calls that adds to a name forever, raise BudgetExceeded.
    """
    key = F.xxhash64(F.to_json(F.struct("function", "event", "event_raw", "payload", "params", "controls")))
    once = lambda df: df.withColumn("key", key).groupBy("key").agg(F.min_by(F.struct(*SUMMARY), F.to_json("evidence")).alias("s")).select("key", "s.*")
    sites = settle(calls.select(F.col("callee").alias("_callee"), F.col("function").alias("_caller"), "args", F.col("controls").alias("_controls"), F.struct("file", "sl", "sc", "el", "ec").alias("_site")))
    new = settle(once(summaries.select(*SUMMARY)))
    seen = new
    for _ in range(most):
        given = new.where(is_open(F.col("event"), F.col("params"))).join(sites, F.col("function") == F.col("_callee"))
        part = lambda p: F.when(p["param"].isNull(), F.array(p)).otherwise(F.get("args", p["param"])["parts"])
        unknown = F.exists("event", lambda p: p["param"].isNotNull() & F.get("args", p["param"])["parts"].isNull())
        event = F.when(unknown, F.lit(None).cast(PARTS)).otherwise(F.flatten(F.transform("event", part)))
        from_args = lambda field: F.flatten(F.transform("params", lambda i: F.coalesce(F.get("args", i)[field], F.array())))
        raw = F.when(F.coalesce(unknown, F.lit(False)), F.get("args", F.filter("event", lambda p: p["param"].isNotNull())[0]["param"])["raw"]).otherwise(F.col("event_raw"))
        step = given.select(
            F.col("_caller").alias("function"), event.alias("event"), raw.alias("event_raw"), F.array_sort(F.array_distinct(F.concat("payload", from_args("deps").cast(NAMES)))).alias("payload"),
            F.array_sort(F.array_distinct(from_args("params").cast("array<int>"))).alias("params"), F.array_sort(F.array_distinct(F.concat("controls", "_controls"))).alias("controls"), F.array_distinct(F.concat("evidence", F.array("_site"))).alias("evidence"),
        )
        new = settle(once(step).join(seen.select("key"), "key", "left_anti"))
        if new.isEmpty():
            return seen.drop("key")
        seen = seen.unionByName(new)
    raise BudgetExceeded("event rounds", most + 1, most)


def dependencies(events: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, relation and symbol_id of what an event hangs on: its payload, the names in its own name, its conditions."""
    names = lambda c, relation: events.select("id", F.lit(relation).alias("relation"), F.explode(c).alias("n")).select("id", "relation", "n.pkg", "n.name")
    text = F.transform(F.filter(F.coalesce("event", F.array().cast(PARTS)), lambda p: p["name"].isNotNull()), lambda p: F.struct(p["pkg"].alias("pkg"), p["name"].alias("name")))
    all_of = names(F.col("payload"), "payload").unionByName(names(text, "event_value")).unionByName(names(F.col("controls"), "control"))
    own = symbols.where("receiver is null").select(F.col("id").alias("symbol_id"), F.col("package_path").alias("pkg"), "name")
    return all_of.join(own, ["pkg", "name"]).select("id", "relation", "symbol_id").distinct()


def identified(summaries: DataFrame) -> DataFrame:
    """Summaries whose event's name hangs on no parameter, with an id of function, name and place."""
    ordered = Window.partitionBy("function").orderBy(F.to_json(F.struct("event", "event_raw", "payload", "controls", "evidence")))
    closed = summaries.where(~is_open(F.col("event"), F.array()))
    return closed.withColumn("id", F.concat_ws(":", F.lit("event"), "function", F.col("event_raw"), F.row_number().over(ordered).cast("string")))
