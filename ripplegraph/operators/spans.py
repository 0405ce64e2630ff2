"""Interval joins and islands over (file, line) spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S

#: Lines of a bucket. An interval stands in each bucket it touches, so a point meets it in exactly one.
BUCKET = 64


def bucketed(spans: DataFrame, start: str, end: str, bucket: int = BUCKET) -> DataFrame:
    first, last = F.floor(F.col(start) / bucket), F.floor(F.greatest(F.col(end), F.col(start)) / bucket)
    return spans.withColumn("_bucket", F.explode(F.sequence(first, last)))


def containing(lines: DataFrame, spans: DataFrame, line: str = "line", start: str = "sl", end: str = "el", file: str = "file") -> DataFrame:
    """Each line with each span of its file that contains it: an equi join on file and bucket with a residual."""
    points = lines.withColumn("_bucket", F.floor(F.col(line) / BUCKET))
    joined = points.join(bucketed(spans, start, end), [file, "_bucket"])
    return joined.where(F.col(line).between(F.col(start), F.col(end))).drop("_bucket")


def innermost(lines: DataFrame, spans: DataFrame, keys: list[str], line: str = "line", span_id: str = "id", start: str = "sl", end: str = "el", file: str = "file") -> DataFrame:
    """Each line's narrowest span; of equally narrow ones that of the least id.

    An aggregate rather than a window, so the narrowest is found before the shuffle within each task.
    """
    found = containing(lines, spans, line, start, end, file)
    order = F.struct(F.col(end) - F.col(start), F.col(span_id))
    rest = [c for c in spans.columns if c not in (file, span_id)]
    return found.groupBy(*dict.fromkeys([file, line, *keys])).agg(F.min_by(F.struct(span_id, *rest), order).alias("_best")).select(*dict.fromkeys([file, line, *keys]), "_best.*")


def islands(rows: DataFrame, by: list[str], line: str = "line", same: list[str] | None = None, gap: int = 1) -> DataFrame:
    """start_line and end_line of runs of lines at most `gap` apart that agree on `same`."""
    same = same or []
    order = Window.partitionBy(*by, *same).orderBy(line)
    marked = rows.select(*by, *same, line).distinct().withColumn("_new", (F.col(line) - F.coalesce(F.lag(line).over(order), F.col(line) - gap - 1) > gap).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(order))
    return numbered.groupBy(*by, *same, "_island").agg(F.min(line).alias("start_line"), F.max(line).alias("end_line")).drop("_island")


def runs_in_order(rows: DataFrame, by: list[str], order: str, same: list[str]) -> DataFrame:
    """Runs of rows, neighbours in `order`, that agree on `same`: their first and last order values and size."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.lit(False)
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    numbered = rows.withColumn("_run", F.sum(F.when(F.row_number().over(w) == 1, 1).otherwise(change.cast("int"))).over(w))
    return numbered.groupBy(*by, "_run", *same).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, since: str, pick: list[str], tie: list[str]) -> DataFrame:
    """left with the columns of the latest right row of the same key whose `since` is not after `at` (nulls if none).

    One pass over both sides in key order: rows of the right carry forward to the left rows behind them.
    """
    r = right.select(*by, F.col(since).alias("_at"), F.lit(0).alias("_side"), F.struct(*tie).alias("_tie"), F.struct(*pick).alias("_pick"))
    body = F.struct(*[c for c in left.columns])
    kind, tie_type = r.schema["_pick"].dataType, r.schema["_tie"].dataType
    both = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"), F.lit(None).cast(kind).alias("_pick"), body.alias("_left"))
    both = both.unionByName(r.withColumn("_left", F.lit(None).cast(both.schema["_left"].dataType)))
    w = Window.partitionBy(*by).orderBy("_at", "_side", F.col("_tie").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_pick", F.last("_pick", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select("_left.*", "_pick.*")


def contained(inner: DataFrame, outer: DataFrame, on: list[str]) -> DataFrame:
    """Each inner span (inner_sl, _sc, _el, _ec) with each outer one (outer_…) of the same keys, the file among them, that contains it.

    An outer span stands in the buckets of lines that it touches, an inner one in that of its first line.
    """
    points = inner.withColumn("_bucket", F.floor(F.col("inner_sl") / BUCKET))
    joined = points.join(bucketed(outer, "outer_sl", "outer_el"), [*on, "_bucket"]).withColumns({"outer_file": F.col("file"), "inner_file": F.col("file")})
    return joined.where(S.span_contains("outer_", "inner_")).drop("_bucket", "outer_file", "inner_file")
