"""Unified diffs as tables, by windows over their lines, and their mapping to facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.operators import spans
from ripplegraph.operators.budgets import DiffInvalid, DiffNotApplied

_HUNK = r"^@@ -([0-9]+)(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@"


def unquote(path: Column) -> Column:
    """A path as written, or the text of one in double quotes with C escapes; octal ones are bytes of UTF-8."""
    named = F.create_map(*[F.lit(x) for pair in {"\\n": "0A", "\\t": "09", "\\r": "0D", "\\a": "07", "\\b": "08", "\\f": "0C", "\\v": "0B", '\\"': "22", "\\\\": "5C"}.items() for x in pair])
    parts = F.regexp_extract_all(F.substring(path, F.lit(2), F.length(path) - 2), F.lit(r"(\\[0-7]{3}|\\.|[^\\])"), F.lit(1))
    hexed = F.transform(parts, lambda p: F.when(p.rlike(r"^\\[0-7]{3}$"), F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0")).otherwise(F.coalesce(F.get(F.array(named[p]), F.lit(0)), F.hex(p))))
    return F.when(path.rlike(r'^".*"$') & (F.length(path) > 1), F.decode(F.unhex(F.array_join(hexed, "")), "UTF-8")).otherwise(path)


def normal_path(path: Column) -> Column:
    """Unquoted, without the a/ or b/ in front; empty for /dev/null."""
    p = unquote(path)
    return F.when(p == "/dev/null", F.lit("")).when(p.rlike("^[ab]/"), F.substring(p, 3, 1 << 30)).otherwise(p)


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, file_no, pos, line, hunk_no, kind (add, del, ctx or null), old_line and new_line of diffs(diff_id, content).

    old_line and new_line are the counters before the line. A hunk lasts to the next header, binary patch or file.
    """
    raw = diffs.select("diff_id", F.posexplode(F.split(F.regexp_replace("content", r"\n$", ""), r"\n")).alias("pos", "line"))
    raw = raw.withColumn("line", F.regexp_replace("line", r"\r$", ""))
    in_diff = Window.partitionBy("diff_id").orderBy("pos")
    rows = raw.withColumn("file_no", F.sum(F.col("line").startswith("diff --git ").cast("int")).over(in_diff)).where("file_no > 0")
    in_file = Window.partitionBy("diff_id", "file_no").orderBy("pos")
    opens = F.col("line").startswith("@@ ")
    closes = F.col("line").startswith("GIT binary patch") | F.col("line").startswith("Binary files ")
    state = F.when(opens, True).when(closes, False)
    rows = rows.withColumn("active", F.coalesce(F.last(state, ignorenulls=True).over(in_file), F.lit(False))).withColumn("hunk_no", F.sum(opens.cast("int")).over(in_file))
    plain = ~F.col("line").rlike("^(@@|diff --git |new file mode|deleted file mode|GIT binary patch|Binary files )")
    kind = F.when(F.col("active") & plain, F.when(F.col("line").startswith("+"), "add").when(F.col("line").startswith("-"), "del").when(F.col("line").startswith(" ") | (F.col("line") == ""), "ctx"))
    rows = rows.withColumn("kind", kind)
    in_hunk = Window.partitionBy("diff_id", "file_no", "hunk_no").orderBy("pos")
    start = lambda i: F.first(F.when(opens, F.regexp_extract("line", _HUNK, i).try_cast("int")), ignorenulls=True).over(in_hunk)
    count = lambda kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(in_hunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("old_line", start(1) + count(("del", "ctx"))).withColumn("new_line", start(2) + count(("add", "ctx")))


def diff_files(lines: DataFrame) -> DataFrame:
    """diff_id, file_no, old_path, new_path, status and raw."""
    line = F.col("line")
    token = r'("(?:[^"\\]|\\.)*"|[^ \t]+)'
    head = rf"^diff --git\s+{token}\s+{token}"
    first = lambda test, value: F.min_by(F.when(test, value), F.when(test, F.col("pos")))
    last = lambda test, value: F.max_by(F.when(test, value), F.when(test, F.col("pos")))
    is_head = line.startswith("diff --git ")
    path = lambda mark, i: F.coalesce(last(~F.col("active") & line.startswith(mark), F.trim(F.substring(line, 5, 1 << 30))), first(is_head, F.regexp_extract(line, head, i)))
    status = F.coalesce(last(line.rlike("^(new|deleted) file mode"), F.when(line.startswith("new"), "added").otherwise("deleted")), F.lit("modified"))
    files = lines.groupBy("diff_id", "file_no").agg(path("--- ", 1).alias("old_path"), path("+++ ", 2).alias("new_path"), status.alias("status"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_raw"))
    raw = F.concat(F.array_join(F.transform("_raw", lambda x: x["line"]), "\n"), F.lit("\n"))
    return files.select("diff_id", "file_no", normal_path(F.col("old_path")).alias("old_path"), normal_path(F.col("new_path")).alias("new_path"), "status", raw.alias("raw"))


def deleted_blocks(lines: DataFrame) -> DataFrame:
    """diff_id, file_no, pos (of what ends the block), old_start, new_anchor, lines and replaced, for each run of deletions."""
    w = Window.partitionBy("diff_id", "file_no", "hunk_no").orderBy("pos")
    rows = lines.where("kind is not null").withColumn("_last", F.lag("kind").over(w)).withColumn("_next", F.lead("kind").over(w)).withColumn("_next_pos", F.lead("pos").over(w))
    gone = rows.where("kind = 'del'").withColumn("_run", F.sum(F.when(F.col("_last") == "del", 0).otherwise(1)).over(w))
    blocks = gone.groupBy("diff_id", "file_no", "hunk_no", "_run").agg(
        F.max(F.coalesce("_next_pos", F.col("pos") + 1)).alias("pos"),
        F.min("old_line").alias("old_start"),
        F.greatest(F.min("new_line"), F.lit(1)).alias("new_anchor"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.substring("line", 2, 1 << 30).alias("text")))), lambda x: x["text"]).alias("lines"),
        F.max_by(F.coalesce("_next", F.lit("end")), "pos").alias("_after"),
    )
    return blocks.select("diff_id", "file_no", "pos", "old_start", "new_anchor", "lines", (F.col("_after") == "add").alias("replaced"))


def diff_ranges(lines: DataFrame, files: DataFrame) -> DataFrame:
    """diff_id, file_no, start_line, end_line and kind (added or deletion_anchor): runs of neighbouring lines of one kind."""
    kept = files.where("status <> 'deleted'").select("diff_id", "file_no")
    added = lines.where("kind = 'add' and new_line > 0").join(kept, ["diff_id", "file_no"]).select("diff_id", "file_no", "pos", F.col("new_line").alias("line"), F.lit("added").alias("kind"))
    anchors = deleted_blocks(lines).where("not replaced").select("diff_id", "file_no", (F.col("pos") - 0.5).alias("pos"), F.col("new_anchor").alias("line"), F.lit("deletion_anchor").alias("kind"))
    rows = added.withColumn("pos", F.col("pos").cast("double")).unionByName(anchors.withColumn("pos", F.col("pos").cast("double")))
    w = Window.partitionBy("diff_id", "file_no").orderBy("pos")
    joins = (F.lag("kind").over(w) == F.col("kind")) & (F.lag("line").over(w) + 1 == F.col("line"))
    numbered = rows.withColumn("_run", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_run").over(w))
    return numbered.groupBy("diff_id", "file_no", "_run", "kind").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("_run")


def expected_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """diff_id, file_no, line and text that the changed file must hold."""
    kept = files.where("status <> 'deleted'").select("diff_id", "file_no")
    return lines.where("kind in ('add', 'ctx')").join(kept, ["diff_id", "file_no"]).select("diff_id", "file_no", F.col("new_line").alias("line"), F.when(F.col("line") == "", "").otherwise(F.substring("line", 2, 1 << 30)).alias("text"))


def check_parsed(lines: DataFrame) -> None:
    """Refuse diffs without a file, combined ones, and malformed hunk headers."""
    if lines.isEmpty():
        raise DiffInvalid("the diff has no file changes")
    bad = lines.where(F.col("line").startswith("@@") & ~F.col("line").rlike(_HUNK)).select("line").first()
    if bad:
        raise DiffInvalid(f"unsupported hunk header: {bad.line!r}")


def unapplied(expected: DataFrame, files: DataFrame, file_lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """file, line and reason of what shows that the diff isn't applied to file_lines(file, line, text).

    Lines that differ, deleted files that are still there, and deleted blocks still standing whole at their old
    place (unless the anchor line is itself an expected one).
    """
    named = files.select("diff_id", "file_no", F.when(F.col("new_path") == "", F.col("old_path")).otherwise(F.col("new_path")).alias("file"), "status")
    own = file_lines.select("file", "line", F.regexp_replace("text", r"\r$", "").alias("found"))
    want = expected.join(named, ["diff_id", "file_no"]).join(own, ["file", "line"], "left")
    differ = want.where(~F.col("text").eqNullSafe(F.col("found"))).select("file", "line", F.lit("line differs").alias("reason"))
    there = named.where("status = 'deleted'").join(own.select("file").distinct(), "file").select("file", F.lit(0).alias("line"), F.lit("deleted file exists").alias("reason"))
    free = blocks.join(expected.select("diff_id", "file_no", F.col("line").alias("new_anchor")), ["diff_id", "file_no", "new_anchor"], "left_anti")
    placed = free.join(named, ["diff_id", "file_no"]).select("file", "old_start", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "text"))
    stands = placed.withColumn("line", F.col("old_start") + F.col("i")).join(own, ["file", "line"], "left").groupBy("file", "old_start", "n").agg(F.count_if(F.col("text").eqNullSafe(F.col("found"))).alias("_same"))
    still = stands.where("_same = n").select("file", F.col("old_start").alias("line"), F.lit("deleted block still stands").alias("reason"))
    return differ.unionByName(there).unionByName(still)


def check_applied(problems: DataFrame) -> None:
    bad = problems.orderBy("file", "line").first()
    if bad:
        raise DiffNotApplied(f"{bad.file}:{bad.line}: {bad.reason}")


#: Facts that a changed line is tried on, in this order; then the narrowest symbol, then the file.
PRIORITY = ("annotation", "route_group", "route", "middleware", "job", "dubbo_method", "dubbo_service")


def map_lines(lines: DataFrame, facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """file, line, kind and target_id of lines(file, line).

    facts: kind (of PRIORITY), id, ordinal, file, sl, el. Of one kind the first in order wins; of symbols the one
    of fewest lines, then of least id.
    """
    rank = F.lit(len(PRIORITY))
    for i, kind in enumerate(PRIORITY):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    own = facts.select("file", "sl", "el", "kind", "id", rank.alias("_rank"), F.col("ordinal").cast("long").alias("_order"))
    sym = symbols.select("file", "sl", "el", F.lit("symbol").alias("kind"), "id", F.lit(len(PRIORITY)).alias("_rank"), (F.col("el") - F.col("sl")).cast("long").alias("_order"))
    hits = spans.containing(lines.select("file", "line").distinct(), own.unionByName(sym))
    best = hits.groupBy("file", "line").agg(F.min(F.struct("_rank", "_order", "id", "kind")).alias("b")).select("file", "line", "b.kind", F.col("b.id").alias("target_id"))
    return lines.select("file", "line").distinct().join(best, ["file", "line"], "left").select("file", "line", F.coalesce("kind", F.lit("file")).alias("kind"), "target_id")


def changes(mapped: DataFrame) -> DataFrame:
    """file, kind, target_id, start_line and end_line: neighbouring lines of one target together."""
    w = Window.partitionBy("file").orderBy("line")
    same = (F.lag("kind").over(w) == F.col("kind")) & F.lag("target_id").over(w).eqNullSafe(F.col("target_id")) & (F.lag("line").over(w) + 1 == F.col("line"))
    numbered = mapped.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return numbered.groupBy("file", "kind", "target_id", "_run").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("_run")


def without_overlapped(file_roots: DataFrame, recovered: DataFrame) -> DataFrame:
    """File roots (id, file, start_line, end_line) but for those that a recovered handler's lines overlap."""
    hit = recovered.select(F.col("file").alias("_file"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    touch = (F.col("file") == F.col("_file")) & (F.col("start_line") <= F.col("_e")) & (F.col("_s") <= F.col("end_line"))
    return file_roots.join(hit, touch, "left_anti")
