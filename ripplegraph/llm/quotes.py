"""Chat formatting by quotation linking, in DataFrame functions alone.

A message's lines have a quote level, the number of `>` they begin with. Neighbouring lines of one level above
zero are a quoted passage. Passages and their single lines are normalised (quote marks off, lower case, white
space collapsed) and hashed; so are each message's own words: whole, by paragraph and by line. A quoted unit's
original is the earliest message of its conversation that holds it, if that came before. A message replies to
the original of its least deeply quoted, longest unit. Messages stand under their thread's root, replies after
what they reply to, and give up their quotes and the lines that introduce them (`... wrote:`).

Originals are aggregated to the earliest message before they are joined, so a line that stands in a large part
of all messages is one row by then. Threads are followed by doubling: a round joins each message with the one
it has reached so far. Places within a conversation come from one range sort of all messages; no conversation
is brought to one task.

Defined results: a null text is an empty message. A null conv_id or turn links with nothing; such messages
stand first in the null conversation, or in theirs. Rows that repeat a turn link alike. A message quoting only
itself or later ones has no parent. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.base import ranked, settle

_QUOTE = r"^(?:[\x20\t]*>)+"


def lines_of(text: Column) -> Column:
    """level and words of each line."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1),
        lambda line: F.struct(F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 0), "[^>]", "")).alias("level"), F.regexp_replace(line, _QUOTE + r"[\x20\t]?", "").alias("words")),
    )


def passages(lines: Column) -> Column:
    """level and lines of each run of lines of one level."""
    level = lambda i: F.get(lines, i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    whole = lambda s: F.transform(s, lambda a, i: F.struct(level(a).alias("level"), F.transform(F.slice(lines, a + 1, F.coalesce(F.get(s, i + 1), F.size(lines)) - a), lambda x: x["words"]).alias("lines")))
    return F.element_at(F.transform(F.array(starts), whole), 1)


def normal(words: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(words), r"\s+", " "))


def body_of(lines: Column) -> Column:
    """The lines without a quote mark, but for those that introduce a quotation."""
    introduces = lambda x, i: x["words"].rlike(r"wrote:\s*$") & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)
    own = F.filter(lines, lambda x, i: (x["level"] == 0) & ~introduces(x, i))
    return F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["words"]), "\n"), r"^\s+|\s+$", ""))


def units(parts: Column) -> Column:
    """hash and length of each part that holds words."""
    named = F.transform(parts, lambda p: F.struct(F.md5(normal(p).cast("binary")).alias("hash"), F.length(normal(p)).alias("n")))
    return F.array_distinct(F.filter(named, lambda u: u["n"] > 0))


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, root_turn, parent_turn, depth, n_quoted, n_linked, body and chat, a row each."""
    lined = messages.select(F.col("conv_id"), F.col("turn"), F.col("role"), lines_of(F.col("text")).alias("lines"))
    parted = lined.select("conv_id", "turn", "role", body_of(F.col("lines")).alias("body"), F.filter(passages(F.col("lines")), lambda p: p["level"] > 0).alias("quoted"))
    rows = settle(parted.withColumn("_row", F.monotonically_increasing_id()))
    quoting = rows.where(F.size("quoted") > 0).select("_row", "conv_id", "turn", F.posexplode("quoted").alias("passage", "q"))
    # A passage is looked up whole, and by its lines.
    whole = F.transform(units(F.array(F.array_join("q.lines", " "))), lambda u: F.struct(u["hash"].alias("hash"), u["n"].alias("n")))
    asked = quoting.select("_row", "conv_id", "turn", "passage", "q.level", F.explode(F.array_distinct(F.concat(whole, units(F.col("q.lines"))))).alias("u")).select("_row", "conv_id", "turn", "passage", "level", "u.hash", "u.n")
    own = units(F.concat(F.array("body"), F.split("body", r"\n[\x20\t]*\n"), F.split("body", r"\n")))
    held = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", F.explode(own).alias("u")).select("conv_id", "turn", "u.hash")
    originals = held.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    found = asked.join(originals, ["conv_id", "hash"]).where(F.col("origin") < F.col("turn"))
    parents = settle(found.groupBy("_row").agg(F.max_by("origin", F.struct(-F.col("level"), F.col("n"), F.col("origin"))).alias("parent_turn"), F.count_distinct("passage").alias("n_linked")))
    with_parent = rows.withColumn("n_quoted", F.size("quoted").cast("long")).drop("quoted").join(parents, "_row", "left")
    roots = threads(with_parent.where(F.col("parent_turn").isNotNull()).groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("parent")))
    whole_rows = with_parent.join(roots, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.coalesce("root", "turn").alias("root_turn"), "parent_turn", F.coalesce("hops", F.lit(0)).alias("depth"), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "body", "_row"
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "root_turn", "turn", "_row")]
    placed = settle(ranked(whole_rows, order, "_rank"))
    first = placed.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_rank").alias("_first"))
    return placed.join(first, placed.conv_id.eqNullSafe(F.col("_conv"))).select(
        "conv_id", "turn", "role", (F.col("_rank") - F.col("_first")).alias("position"), "root_turn", "parent_turn", "depth", "n_quoted", "n_linked", "body",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body")).alias("chat"),
    )


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, root and hops of each (conv_id, turn, parent). A parent came earlier, so there are no rings."""
    reached = settle(links.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("hops")))
    while True:
        further = reached.select(F.col("conv_id"), F.col("turn").alias("root"), F.col("root").alias("_next"), F.col("hops").alias("_more"))
        joined = settle(reached.join(further, ["conv_id", "root"], "left"))
        if joined.where(F.col("_next").isNotNull()).isEmpty():
            return reached
        reached = joined.select("conv_id", "turn", F.coalesce("_next", "root").alias("root"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"))


def op10(conversations: DataFrame) -> DataFrame:
    """All messages in reply order, without quotes."""
    return linked(conversations)
