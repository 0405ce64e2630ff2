"""Mixing sources to target weights by a time-varying curriculum.

Sources in code point order (null last) weigh 3, 1, 2, repeating, and share `ratio` times all sizes; a target
stops at `cap` times its source's size, the excess being shared by weight among the others until none is
above. Over training time t from 0 to 1 a source's weight follows a straight line of its own slope around its
target; the integral of that line is its cumulative demand. A source's documents queue in the order of an id
and text digest, pass after pass; the curriculum takes words from the queue's head until the demand at t = 1,
its target, is met, so the last document may be taken in part. A document has a training position for each
pass that takes of it: the time at which the demand reaches its first word there, the inverse of the integral,
a quadratic root.

Cumulative sizes are sums over digest slices of a source, so a source with a third of all rows is cut into
`slices` parts and never meets in one task. Sizes are written once; texts are read once. Sources are ranked
and capped as tables, not on the driver.

Defined results: a null text has size 0 and takes nothing; it stands at its queue's place. Rows that repeat an
id queue by their texts' digests; rows that repeat both are alike and queue one after the other. A source whose
texts are all empty has target 0. Other columns are ignored, unless `keep` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm.base import ranked, settle

WEIGHTS = (3, 1, 2)
#: Slopes of the weight schedules, by the source's rank: the first sources fade, later ones grow.
SLOPES = (-0.6, 0.0, 0.6)
SLICES = 4096


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, ratio: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """source, n (rank from 0), source_size, weight and target, a row for each source of sizes(source, size).

    Capped sources keep their caps; the rest share what is left by weight. A round caps those above; it ends
    when a round caps none, after as many rounds at most as there are sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.col("n") % len(WEIGHTS) + 1).cast("int"))
    own = settle(ranked(totals, order, "n").withColumn("weight", weight))
    full = own.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped, level = None, None
    above = F.lit(False)
    while True:
        caps, rest, n = own.agg(
            F.coalesce(F.sum(F.when(above, cap * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.lit(0)), F.count(F.when(above, 1))
        ).first()
        if n == capped or not rest:
            break
        capped, level = n, (full * ratio[0] - ratio[1] * caps) / (ratio[1] * rest)
        above = F.lit(level) * F.col("weight") > cap * F.col("source_size")
    target = F.least(F.lit(level or 0.0) * F.col("weight"), (cap * F.col("source_size")).cast("double")) if level is not None else F.lit(0.0)
    return own.withColumn("target", target)


def demand_time(share: Column, slope: Column) -> Column:
    """The time t in 0..1 at which t + slope * (t^2 - t), a schedule's integral, reaches the given share."""
    root = F.sqrt(F.pow(1 - slope, 2) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise(F.least(F.greatest((root - (1 - slope)) / (2 * slope), F.lit(0.0)), F.lit(1.0)))


def curriculum(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes and position, a row each.

    passes: position and words of each pass that takes words of the document. position: of the first of these, or
    null. keep: further columns to carry, whose names must differ from these.
    """
    digest = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    sized = docs.select("doc_id", "source", *(keep or []), size_of(F.col(text)).alias("size"), digest.alias("_digest"))
    sizes = settle(sized.drop(*(keep or [])))
    # Carried columns, texts among them, aren't written along: their rows come from docs again and are shuffled once.
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))  # a null equals a null
    sliced = lambda df: df.withColumn("_key", key).withColumn("_slice", F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int") % SLICES)
    of_slice = sliced(sizes).groupBy("_key", "_slice").agg(F.sum("size").alias("_in"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most SLICES rows a source
    goal = targets(sizes).withColumn("_key", key).drop("source")
    starts = of_slice.withColumn("_before", before).drop("_in")
    starts = starts.join(F.broadcast(goal) if _few(goal) else goal, "_key")
    queue = Window.partitionBy("_key", "_slice").orderBy("_digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced(sized if keep else sizes).withColumn("_own", F.coalesce(F.sum("size").over(queue), F.lit(0)))
    placed = placed.join(starts, ["_key", "_slice"])
    words = F.round("target").cast("long")  # whole words that the source gives
    slope = F.element_at(F.array(*[F.lit(x) for x in SLOPES]), (F.col("n") % len(SLOPES) + 1).cast("int"))
    first = F.col("_before") + F.col("_own")

    def taken_in(n: Column) -> Column:
        begins = first + n * F.col("source_size")
        part = F.greatest(F.lit(0), F.least(F.col("size"), words - begins)).cast("long")
        return F.struct(F.round(demand_time(begins / words, slope), 9).alias("position"), part.alias("words"))

    laps = F.when((words > 0) & (F.col("size") > 0), F.sequence(F.lit(0).cast("long"), F.floor((words - 1) / F.col("source_size")).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    placed = placed.withColumn("_passes", F.filter(F.transform(laps, taken_in), lambda p: p["words"] > 0))
    taken = F.aggregate("_passes", F.lit(0).cast("long"), lambda total, p: total + p["words"])
    return placed.select(
        "doc_id", "source", *(keep or []), "size", "source_size", "target", taken.alias("taken"), F.col("_passes").alias("passes"), F.get("_passes", F.lit(0))["position"].alias("position")
    )


def schedule(mixed: DataFrame) -> DataFrame:
    """The rows of curriculum() once for each pass, with its own position and words, in training order."""
    kept = [c for c in mixed.columns if c not in ("passes", "position")]
    return mixed.select(*kept, F.explode("passes").alias("_pass")).select(*kept, "_pass.position", "_pass.words").orderBy("position", "doc_id")


def _few(df: DataFrame, most: int = 10_000) -> bool:
    return df.limit(most + 1).count() <= most


def op6(docs: DataFrame) -> DataFrame:
    """The mix of all documents, range-sorted by training position; a second pass stands in columns of its own."""
    mixed = curriculum(docs)
    again = F.get("passes", F.lit(1))
    words = F.coalesce(again["words"], F.lit(0).cast("long"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", again["position"].alias("again_position"), words.alias("again_words")).orderBy(F.col("position").asc_nulls_last(), "doc_id")
