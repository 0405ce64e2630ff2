"""Scalar expressions over fact columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def span_contains(outer: str, inner: str) -> Column:
    """Column-precise containment of flat spans (file, sl, sc, el, ec) by their prefixes."""
    o, i = (lambda n: F.col(f"{outer}{n}")), (lambda n: F.col(f"{inner}{n}"))
    start = (o("sl") < i("sl")) | ((o("sl") == i("sl")) & (o("sc") <= i("sc")))
    end = (o("el") > i("el")) | ((o("el") == i("el")) & (o("ec") >= i("ec")))
    return (o("file") == i("file")) & (o("file") != "") & start & end


def line_contains(start: Column, end: Column, line_start: Column, line_end: Column) -> Column:
    return (start <= line_start) & (end >= line_end)


def ranges_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """An end of zero (or none) means a single line."""
    end = lambda s, e: F.coalesce(F.nullif(e, F.lit(0)), s)
    return (a_start <= end(b_start, b_end)) & (b_start <= end(a_start, a_end))


def any_range_overlaps(ranges: Column, start: Column, end: Column) -> Column:
    return F.exists(ranges, lambda r: ranges_overlap(r["start_line"], r["end_line"], start, end))


def join_path(prefix: Column, path: Column) -> Column:
    """One leading slash, one slash between the parts, none at the end."""
    slash = F.lit("/")
    left, right = F.rtrim(F.coalesce(prefix, F.lit("")), slash), F.ltrim(F.coalesce(path, F.lit("")), slash)
    rooted = F.concat(F.when((left == "") | left.startswith("/"), "").otherwise("/"), left, slash, right)
    return F.coalesce(blank_to_null(F.rtrim(rooted, slash)), slash)


def join_context_prefix(context: Column, prefix: Column) -> Column:
    """join_path that leaves a prefix alone which has the context already."""
    root = join_path(context, F.lit(""))
    path = join_path(F.lit(""), prefix)
    has = (root == "/") | (path == root) | path.startswith(F.concat(root, F.lit("/")))
    return F.when(has, path).otherwise(join_path(context, prefix))


def collapse_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "/{2,}", "/")


def derive_prefix(full: Column, local: Column) -> Column:
    """What stands before the local path in the full one; a slash if nothing does, null if it isn't a suffix."""
    rest = F.substring(full, F.lit(1), F.length(full) - F.length(local))
    return F.when(full.endswith(local), F.when(rest == "", F.lit("/")).otherwise(rest))


def endpoint_method(c: Column) -> Column:
    return F.upper(strip(c))


def endpoint_path(c: Column) -> Column:
    return strip(c)


def parse_endpoint(c: Column) -> tuple[Column, Column]:
    """Method and path of `METHOD /path`, nulls for anything else."""
    pattern = r"^\s*(\S+)\s+(/\S*)\s*$"
    ok = c.rlike(pattern)
    return F.when(ok, F.upper(F.regexp_extract(c, pattern, 1))), F.when(ok, F.regexp_extract(c, pattern, 2))


def parse_operation(c: Column) -> tuple[Column, Column, Column]:
    """Package, service and method of `<import path>.<Service>/<Method>`; a leading slash is refused."""
    pattern = r"^([^/\s][^\s]*)\.([^./\s]+)/([^/\s]+)$"
    ok = c.rlike(pattern)
    return tuple(F.when(ok, F.regexp_extract(c, pattern, i)) for i in (1, 2, 3))


def fact_id(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def operation_identity(package: Column, service: Column, method: Column) -> Column:
    return F.concat(package, F.lit("."), service, F.lit("/"), method)


def symbol_id(kind: Column, package: Column, receiver: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, package, F.coalesce(receiver, F.lit("")), name)


def symbol_kind(symbol: Column) -> Column:
    return F.substring_index(symbol, ":", 1)


def symbol_name(symbol: Column) -> Column:
    return F.substring_index(symbol, ":", -1)


def receiver_base(c: Column) -> Column:
    """A receiver's type without pointer, parentheses, package and type arguments."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[*()\s]", ""), r"\[.*$", "")
    return F.substring_index(bare, ".", -1)


def selector_parts(c: Column) -> Column:
    """A dotted chain of identifiers as an array, null for anything else."""
    return F.when(c.rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*$"), F.split(c, r"\."))


def import_name(path: Column) -> Column:
    """The last segment of an import path, or the one before a version segment."""
    parts = F.split(path, "/")
    last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    return F.when(last.rlike(r"^v[0-9]+$"), F.coalesce(before, last)).otherwise(last)


def is_generated_glue(file: Column) -> Column:
    return F.lower(file).rlike(r"[_.]grpc\.pb\.go$")


def is_registration_name(name: Column) -> Column:
    return (name == "main") | name.startswith("Register") | name.startswith("Initialize")


def reference_relation(kind: Column) -> Column:
    return F.when(kind == "type", "type_ref").when(kind == "value", "value_ref").otherwise("call")


BASIS_RANKS = {"precise": 3, "file_fallback": 2, "unreferenced": 1}


def basis_rank(basis: Column) -> Column:
    out = F.lit(0)
    for name, rank in BASIS_RANKS.items():
        out = F.when(basis == name, rank).otherwise(out)
    return out


def node_label(kind: Column, name: Column, node_id: Column, method: Column, path: Column) -> Column:
    shown = F.coalesce(blank_to_null(name), node_id)
    return F.trim(F.when(kind == "endpoint", F.concat_ws(" ", method, path)).otherwise(F.concat_ws(" ", kind, shown)))


def diagnostic_key(code: Column, file: Column, start: Column, end: Column, message: Column) -> Column:
    return fact_id(code, file, start, end, message)


def in_project(package: Column, module: Column) -> Column:
    return (package == module) | package.startswith(F.concat(module, F.lit("/")))


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: `*` and `?` stay within a segment, brackets are sets."""
    import re

    out, i = "^", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out += "[" + body + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out + "$"


def matches_glob(value: Column, globs: list[str]) -> Column:
    """Equal to one of them, or matched by one that has a wild card."""
    out = F.lit(False)
    for g in globs:
        out = out | (value == g)
        if any(c in g for c in "*?["):
            out = out | value.rlike(glob_pattern(g))
    return out


def semver_key(version: Column) -> Column:
    """An array that orders versions: three numbers, then release over pre-release, then its segments.

    A number is its length and digits, so numbers of any length compare. Build metadata is ignored. Null where
    the core is not one to three numbers.
    """
    core = r"^v?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]*)?$"
    number = lambda digits: F.concat(F.lpad(F.length(d := F.regexp_replace(F.when(digits == "", "0").otherwise(digits), "^0+(?=.)", "")).cast("string"), 4, "0"), F.lit(":"), d)
    pre = F.regexp_extract(version, core, 4)
    segment = lambda s: F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("0"), number(s))).otherwise(F.concat(F.lit("1"), s))
    tail = F.when(pre == "", F.array(F.lit("1"))).otherwise(F.concat(F.array(F.lit("0")), F.transform(F.split(pre, r"\."), segment)))
    return F.when(version.rlike(core), F.concat(F.array(*[number(F.regexp_extract(version, core, i)) for i in (1, 2, 3)]), tail))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; versions that are not semantic compare as text."""
    x, y = semver_key(a), semver_key(b)
    sign = lambda p, q: F.when(p < q, -1).when(p > q, 1).otherwise(0)
    return F.when(x.isNull() | y.isNull(), sign(a, b)).otherwise(sign(x, y))
