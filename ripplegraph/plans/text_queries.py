"""Unified diffs and module files, made of the conversation and part tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators import diffs, modules
from ripplegraph.plans.adapters import Relations
from ripplegraph.plans.registry import query

#: What stands before the i-th word of a message, as a diff line; the seventh is an empty context line.
MARKS = (" ", " ", "-", "-", "+", " ", "")


def diff_texts(t: Relations) -> DataFrame:
    """diff_id and content: a message's words as lines of one hunk, and its first three as a deleted file."""
    source = t("v_diff_text")
    words = F.split(F.regexp_replace("text", r"[\n\r]", " "), " ", -1)
    mark = lambda i: F.get(F.array(*[F.lit(m) for m in MARKS]), (i % 7).cast("int"))
    lines = F.transform(words, lambda w, i: F.when(i % 7 == 6, "").otherwise(F.concat(mark(i), w)))
    turn = F.col("turn").cast("string")
    at = (F.col("turn") + 5).cast("string")
    one = F.concat(F.lit("diff --git a/t"), turn, F.lit('.txt "b/t'), turn, F.lit('.txt"\n--- a/t'), turn, F.lit('.txt\n+++ "b/t'), turn, F.lit('\\303\\251.txt"\n@@ -'), at, F.lit(" +"), at, F.lit(" @@ x\n"), F.array_join(lines, "\n"))
    two = F.concat(F.lit("\ndiff --git a/gone b/gone\ndeleted file mode 100644\n--- a/gone\n+++ /dev/null\n@@ -1,3 +0,0 @@\n"), F.array_join(F.transform(F.slice(words, 1, 3), lambda w: F.concat(F.lit("-"), w)), "\n"), F.lit("\n"))
    # The header `@@ -5 +5 @@` has no counts, as single lines have.
    return source.select((F.col("diff_id") * 100 + F.col("turn")).alias("diff_id"), F.concat(one, two).alias("content"))


LINES = (
    "w AS (SELECT diff_id * 100 + turn AS diff_id, turn + 5 AS base, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM {v_diff_text}), "
    "x AS (SELECT diff_id, base, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w), "
    "k AS (SELECT diff_id, base, i, CASE WHEN i % 7 = 6 THEN '' ELSE word END AS word, CASE WHEN i % 7 IN (2, 3) THEN 'del' WHEN i % 7 = 4 THEN 'add' ELSE 'ctx' END AS kind FROM x), "
    "c AS (SELECT *, base + coalesce(sum(CASE WHEN kind <> 'add' THEN 1 ELSE 0 END) OVER v, 0) AS old_line, base + coalesce(sum(CASE WHEN kind <> 'del' THEN 1 ELSE 0 END) OVER v, 0) AS new_line FROM k WINDOW v AS (PARTITION BY diff_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
)


def first_files(t: Relations) -> tuple[DataFrame, DataFrame]:
    lines = diffs.diff_lines(diff_texts(t))
    return lines, diffs.diff_files(lines)


@query("hunk_line_numbers", f"WITH {LINES} SELECT diff_id, word, kind, CAST(old_line AS BIGINT) AS old_line, CAST(new_line AS BIGINT) AS new_line FROM c")
def hunk_line_numbers(t: Relations) -> DataFrame:
    lines, _ = first_files(t)
    own = lines.where("file_no = 1 and kind is not null")
    return own.select("diff_id", F.when(F.col("line") == "", "").otherwise(F.substring("line", 2, 1 << 30)).alias("word"), "kind", F.col("old_line").cast("long").alias("old_line"), F.col("new_line").cast("long").alias("new_line"))


@query("diff_files", "SELECT diff_id * 100 + turn AS diff_id, CAST(1 AS BIGINT) AS file_no, 't' || CAST(turn AS VARCHAR) || '.txt' AS old_path, 't' || CAST(turn AS VARCHAR) || 'é.txt' AS new_path, 'modified' AS status FROM {v_diff_text} UNION ALL SELECT diff_id * 100 + turn, 2, 'gone', '', 'deleted' FROM {v_diff_text}")
def diff_files(t: Relations) -> DataFrame:
    return first_files(t)[1].select("diff_id", "file_no", "old_path", "new_path", "status")


@query("deletion_blocks", f"WITH {LINES}, b AS (SELECT *, i - row_number() OVER (PARTITION BY diff_id ORDER BY i) AS g, max(i) OVER (PARTITION BY diff_id) AS last FROM (SELECT *, lead(kind) OVER (PARTITION BY diff_id ORDER BY i) AS after FROM c) z WHERE kind = 'del') SELECT diff_id, CAST(min(old_line) AS BIGINT) AS old_start, CAST(min(new_line) AS BIGINT) AS new_anchor, string_agg(word, '|' ORDER BY i) AS lines, coalesce(max_by(coalesce(after, 'end'), i), 'end') = 'add' AS replaced FROM b GROUP BY diff_id, g")
def deletion_blocks(t: Relations) -> DataFrame:
    own = diffs.deleted_blocks(first_files(t)[0]).where("file_no = 1")
    return own.select("diff_id", F.col("old_start").cast("long").alias("old_start"), F.col("new_anchor").cast("long").alias("new_anchor"), F.array_join("lines", "|").alias("lines"), "replaced")


@query("diff_ranges", f"WITH {LINES}, e AS (SELECT diff_id, CAST(new_line AS BIGINT) AS start_line, CAST(new_line AS BIGINT) AS end_line, 'added' AS kind FROM c WHERE kind = 'add' UNION ALL SELECT diff_id, CAST(new_line AS BIGINT), CAST(new_line AS BIGINT), 'deletion_anchor' FROM (SELECT *, lead(kind) OVER (PARTITION BY diff_id ORDER BY i) AS after, lag(kind) OVER (PARTITION BY diff_id ORDER BY i) AS prev FROM c) z WHERE kind = 'del' AND coalesce(prev, '') <> 'del' AND i % 7 = 2 AND NOT EXISTS (SELECT 1 FROM c c2 WHERE c2.diff_id = z.diff_id AND c2.kind = 'add' AND c2.i = z.i + 2)) SELECT diff_id, CAST(1 AS BIGINT) AS file_no, start_line, end_line, kind FROM e UNION ALL SELECT DISTINCT diff_id, CAST(2 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT), 'deletion_anchor' FROM w")
def diff_ranges(t: Relations) -> DataFrame:
    lines, files = first_files(t)
    own = diffs.diff_ranges(lines, files)
    return own.select("diff_id", "file_no", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "kind")


@query("diff_validate", f"WITH {LINES} SELECT CAST(count(*) AS BIGINT) AS n, 'line differs' AS reason FROM c WHERE kind <> 'del' AND diff_id % 100 = 1 AND new_line % 4 = 0 HAVING count(*) > 0")
def diff_validate(t: Relations) -> DataFrame:
    """Every fourth line of the second messages' files was tampered with."""
    lines, files = first_files(t)
    files = files.withColumn("new_path", F.concat("new_path", F.lit("#"), F.col("diff_id").cast("string")))
    expected = diffs.expected_lines(lines, files)
    named = expected.join(files.select("diff_id", "file_no", F.col("new_path").alias("file")), ["diff_id", "file_no"])
    bad = (F.col("diff_id") % 100 == 1) & (F.col("line") % 4 == 0)
    own = named.select("file", "line", F.when(bad, F.concat("text", F.lit("!"))).otherwise(F.concat("text", F.lit("\r"))).alias("text"))
    problems = diffs.unapplied(expected, files, own, diffs.deleted_blocks(lines))
    return problems.where("reason = 'line differs'").groupBy("reason").agg(F.count("*").alias("n"))


def module_texts(t: Relations) -> DataFrame:
    """path and content of module files made of parts: a single require, a block, comments and replacements."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("example.com/m"), k.cast("string"), F.lit(" v1."), (k % 7).cast("string"), F.lit(".0"))
    line = F.when(k % 5 == 0, F.concat(F.lit("\t"), name, F.lit(" // indirect"))).when(k % 5 == 1, F.concat(F.lit("\t// "), name)).otherwise(F.concat(F.lit("\t"), name))
    rows = t("part").groupBy((k % 20).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"), F.min("p_partkey").alias("first"))
    first = F.concat(F.lit("example.com/m"), F.col("first").cast("string"))
    return rows.select(
        F.concat(F.lit("d"), F.col("file").cast("string"), F.lit("/go.mod")).alias("path"),
        F.concat(F.lit("module example.com/top"), F.col("file").cast("string"), F.lit(" // here\n\ngo 1.22\n\nrequire single.org/x/v2 v2.0.1+incompatible\n\nrequire (\n"), F.col("block"), F.lit("\n)\n\nreplace ("), F.lit("\n\t"), first, F.lit(" => ../near\n)\nreplace single.org/x/v2 v2.0.1+incompatible => fork.org/x v3.1.0\nexclude (\n\tbad.org/y v1.0.0\n)\n")).alias("content"),
    )


@query("gomod_lines", "SELECT path, module, version, indirect, replace_path, replace_version FROM (SELECT 'd' || CAST(p_partkey % 20 AS VARCHAR) || '/go.mod' AS path, 'example.com/m' || CAST(p_partkey AS VARCHAR) AS module, 'v1.' || CAST(p_partkey % 7 AS VARCHAR) || '.0' AS version, p_partkey % 5 = 0 AS indirect, CASE WHEN p_partkey < 20 THEN '../near' END AS replace_path, CAST(NULL AS VARCHAR) AS replace_version FROM part WHERE p_partkey % 5 <> 1 UNION ALL SELECT DISTINCT 'd' || CAST(p_partkey % 20 AS VARCHAR) || '/go.mod', 'single.org/x/v2', 'v2.0.1+incompatible', false, 'fork.org/x', 'v3.1.0' FROM part) x")
def gomod_lines(t: Relations) -> DataFrame:
    return modules.dependencies(module_texts(t))


@query("gomod_module_path", "SELECT DISTINCT 'd' || CAST(p_partkey % 20 AS VARCHAR) || '/go.mod' AS path, 'example.com/top' || CAST(p_partkey % 20 AS VARCHAR) AS module_path FROM part")
def gomod_module_path(t: Relations) -> DataFrame:
    return modules.module_paths(module_texts(t))
