"""Module files, version changes and module use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.functions import scalar as S


def module_lines(files: DataFrame) -> DataFrame:
    """path, line_no, directive and text of the require and replace lines of module files(path, content)."""
    lines = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "text"))
    bare = lines.withColumn("bare", S.strip(F.regexp_replace("text", r"(?<!:)//(?!\s*indirect).*$", "")))
    opens = F.regexp_extract("bare", r"^(\w+)\s*\($", 1)
    mark = F.when(opens != "", opens).when(F.col("bare") == ")", "")
    w = Window.partitionBy("path").orderBy("line_no")
    stated = bare.withColumn("_block", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(""))).withColumn("_mark", mark.isNotNull())
    single = F.regexp_extract("bare", r"^(require|replace)\s+(?!\()", 1)
    directive = F.when(single != "", single).when(~F.col("_mark") & F.col("_block").isin("require", "replace"), F.col("_block"))
    body = F.when(single != "", F.regexp_replace("bare", r"^\w+\s+", "")).otherwise(F.col("bare"))
    return stated.select("path", "line_no", directive.alias("directive"), body.alias("text")).where("directive is not null and text <> ''")


def parsed_requires(lines: DataFrame) -> DataFrame:
    fields = F.split(S.strip(F.regexp_replace("text", r"//.*$", "")), r"\s+")
    own = lines.where("directive = 'require'").select("path", "line_no", fields.alias("f"), F.col("text").rlike(r"//\s*indirect").alias("indirect")).where("size(f) >= 2")
    return own.select("path", "line_no", F.get("f", F.lit(0)).alias("module"), F.get("f", F.lit(1)).alias("version"), "indirect")


def parsed_replaces(lines: DataFrame) -> DataFrame:
    """path, module, old_version, replace_path and replace_version; a local path has no version."""
    sides = F.split(S.strip(F.regexp_replace("text", r"\s//.*$", "")), r"\s*=>\s*")
    own = lines.where("directive = 'replace'").select("path", "line_no", sides.alias("s")).where("size(s) = 2")
    left, right = F.split(F.get("s", F.lit(0)), r"\s+"), F.split(F.get("s", F.lit(1)), r"\s+")
    return own.select("path", "line_no", F.get(left, F.lit(0)).alias("module"), F.get(left, F.lit(1)).alias("old_version"), F.get(right, F.lit(0)).alias("replace_path"), F.get(right, F.lit(1)).alias("replace_version"))


def dependencies(files: DataFrame) -> DataFrame:
    """path, module, version, indirect, replace_path and replace_version of module files(path, content)."""
    lines = module_lines(files)
    replaced = parsed_replaces(lines).groupBy("path", "module").agg(F.max_by(F.struct("replace_path", "replace_version"), "line_no").alias("r"))
    return parsed_requires(lines).join(replaced, ["path", "module"], "left").select("path", "module", "version", "indirect", "r.replace_path", "r.replace_version")


def module_paths(files: DataFrame) -> DataFrame:
    """path and module_path, of the `module` line."""
    return files.select("path", F.regexp_extract("content", r"(?m)^\s*module\s+\"?([^\s\"]+)", 1).alias("module_path")).where("module_path <> ''")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, kind and the versions and replacements before and after, of modules that differ.

    old and new: path, version (null without a require), replace_path, replace_version.
    """
    columns = ("version", "replace_path", "replace_version")
    o = old.select("path", *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("_old"))
    n = new.select("path", *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("_new"))
    both = o.join(n, "path", "full")
    had, has = F.col("old_version").isNotNull(), F.col("new_version").isNotNull()
    same = lambda c: F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    kind = (
        F.when(F.col("_old").isNull() & has, "added")
        .when(F.col("_new").isNull() & had, "removed")
        .when(~same("replace_path") | ~same("replace_version"), "replaced")
        .when(had & has & ~same("version"), F.when(S.compare_versions(F.col("new_version"), F.col("old_version")) >= 0, "upgraded").otherwise("downgraded"))
    )
    return both.select("path", kind.alias("kind"), *[f"{side}_{c}" for c in columns for side in ("old", "new")]).where("kind is not null")


def not_ignored(found: DataFrame, globs: list[str]) -> DataFrame:
    return found.where(~S.matches_glob(F.col("path"), globs))


def prefixes(path: str) -> Column:
    """All leading parts of a slashed path, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def module_imports(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """Imports of each module's packages: equal paths or those below it, by an equi join on path prefixes."""
    exploded = imports.withColumn("module_path", F.explode(prefixes("import_path")))
    return exploded.join(modules.select(F.col("path").alias("module_path")).distinct(), "module_path")


def usages(modules: DataFrame, imports: DataFrame, uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """module_path, basis, import_path, symbol_id and file.

    Precise where a symbol's body uses the import's alias; else all symbols of the importing file, or the file
    alone; `unreferenced` for a module without an import. Blank and dot aliases are never precise.
    imports: file, alias, import_path. uses: file, alias, symbol_id. symbols: id, file.
    """
    own = module_imports(modules, imports)
    named = own.where(~F.col("alias").isin("_", "."))
    precise = named.join(uses, ["file", "alias"]).select("module_path", F.lit("precise").alias("basis"), "import_path", "symbol_id", "file").distinct()
    rest = own.join(precise.select("module_path", "import_path", "file"), ["module_path", "import_path", "file"], "left_anti")
    fallback = rest.join(symbols.select(F.col("id").alias("symbol_id"), "file"), "file", "left").select("module_path", F.lit("file_fallback").alias("basis"), "import_path", "symbol_id", "file").distinct()
    none = lambda: F.lit(None).cast("string")
    unused = modules.select(F.col("path").alias("module_path")).distinct().join(own.select("module_path"), "module_path", "left_anti")
    unused = unused.select("module_path", F.lit("unreferenced").alias("basis"), none().alias("import_path"), none().alias("symbol_id"), none().alias("file"))
    return precise.unionByName(fallback).unionByName(unused)


def strongest_basis(found: DataFrame) -> DataFrame:
    return found.groupBy("module_path").agg(F.max_by("basis", S.basis_rank(F.col("basis"))).alias("basis"))


def roots(found: DataFrame) -> DataFrame:
    """Changed symbols, and files where no symbol is known; unreferenced modules give none."""
    kind = F.when(F.col("symbol_id").isNotNull(), "symbol_changed").otherwise("file_changed")
    return found.where("basis <> 'unreferenced'").select(kind.alias("kind"), F.coalesce("symbol_id", "file").alias("target_id"), "file", "module_path", F.lit("go_mod_diff").alias("source")).distinct()


def owning_module(directories: DataFrame, modules: DataFrame) -> DataFrame:
    """directory and the module_dir of its nearest ancestor with a module file ('' is the project's root)."""
    up = directories.withColumn("module_dir", F.explode(F.array_union(prefixes("directory"), F.array(F.lit("")))))
    return up.join(modules.select("module_dir").distinct(), "module_dir").groupBy("directory").agg(F.max_by("module_dir", F.length("module_dir")).alias("module_dir"))
