"""Fact relations made of the driver's tables, by SQL text that Spark and DuckDB both run.

Views name tables and other views in braces. Text columns are cast to STRING and numbers to BIGINT, which both
engines know; nothing depends on the order of rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplegraph.operators.lineage import settle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {}

VIEWS["v_symbols"] = """
SELECT 'type:region::R' || CAST(r_regionkey AS STRING) AS id, 'type' AS kind, 'region' AS package_path, 'R' || CAST(r_regionkey AS STRING) AS name, 'region.go' AS file, CAST(r_regionkey * 10 + 1 AS BIGINT) AS sl, CAST(r_regionkey * 10 + 8 AS BIGINT) AS el FROM {region}
UNION ALL SELECT 'type:nation::N' || CAST(n_nationkey AS STRING), 'type', 'nation', 'N' || CAST(n_nationkey AS STRING), 'nation.go', CAST(n_nationkey * 10 + 1 AS BIGINT), CAST(n_nationkey * 10 + 8 AS BIGINT) FROM {nation}
UNION ALL SELECT 'func:customer::C' || CAST(c_custkey AS STRING), 'func', 'customer', 'C' || CAST(c_custkey AS STRING), 'customer_' || CAST(c_custkey % 50 AS STRING) || '.go', CAST(c_custkey * 3 + 1 AS BIGINT), CAST(c_custkey * 3 + 20 AS BIGINT) FROM {customer}
UNION ALL SELECT 'func:supplier::S' || CAST(s_suppkey AS STRING), 'func', 'supplier', 'S' || CAST(s_suppkey AS STRING), 'supplier.go', CAST(s_suppkey * 20 + 1 AS BIGINT), CAST(s_suppkey * 20 + 15 AS BIGINT) FROM {supplier}
UNION ALL SELECT 'method:orders:O:M' || CAST(o_orderkey AS STRING), 'method', 'orders', 'M' || CAST(o_orderkey AS STRING), 'orders_' || CAST(o_orderkey % 97 AS STRING) || '.go', CAST(o_orderkey + 1 AS BIGINT), CAST(o_orderkey + 30 AS BIGINT) FROM {orders}
"""

VIEWS["v_refs"] = """
SELECT DISTINCT to_symbol, from_symbol, kind, file, sl, kind || ':' || from_symbol || '>' || to_symbol AS id FROM (
SELECT 'type:region::R' || CAST(n_regionkey AS STRING) AS to_symbol, 'type:nation::N' || CAST(n_nationkey AS STRING) AS from_symbol, 'type' AS kind, 'nation.go' AS file, CAST(n_nationkey * 10 + 2 AS BIGINT) AS sl FROM {nation}
UNION ALL SELECT 'type:nation::N' || CAST(c_nationkey AS STRING), 'func:customer::C' || CAST(c_custkey AS STRING), 'type', 'customer_' || CAST(c_custkey % 50 AS STRING) || '.go', CAST(c_custkey * 3 + 2 AS BIGINT) FROM {customer}
UNION ALL SELECT 'type:nation::N' || CAST(s_nationkey AS STRING), 'func:supplier::S' || CAST(s_suppkey AS STRING), 'type', 'supplier.go', CAST(s_suppkey * 20 + 2 AS BIGINT) FROM {supplier}
UNION ALL SELECT 'func:supplier::S' || CAST(CASE WHEN s_suppkey % 5 = 4 THEN s_suppkey - 4 ELSE s_suppkey + 1 END AS STRING), 'func:supplier::S' || CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 5 = 4 THEN 'value' ELSE 'call' END, 'supplier.go', CAST(s_suppkey * 20 + 3 AS BIGINT) FROM {supplier}
UNION ALL SELECT 'func:customer::C' || CAST(o_custkey AS STRING), 'method:orders:O:M' || CAST(o_orderkey AS STRING), 'call', 'orders_' || CAST(o_orderkey % 97 AS STRING) || '.go', CAST(o_orderkey + 3 AS BIGINT) FROM {orders}
UNION ALL SELECT 'func:supplier::S' || CAST(l_suppkey AS STRING), 'method:orders:O:M' || CAST(l_orderkey AS STRING), 'call', 'orders_' || CAST(l_orderkey % 97 AS STRING) || '.go', CAST(l_orderkey + 4 AS BIGINT) FROM {lineitem}
) x
"""

VIEWS["v_groups"] = """
SELECT 'group:r' || CAST(r_regionkey AS STRING) AS id, CAST(NULL AS STRING) AS parent_group_id, '/r' || CAST(r_regionkey AS STRING) AS prefix, 'func:region::R' AS route_func, CAST(r_regionkey * 100 + 1 AS BIGINT) AS sl, CAST(r_regionkey * 100 + 90 AS BIGINT) AS el FROM {region}
UNION ALL SELECT 'group:n' || CAST(n_nationkey AS STRING), 'group:r' || CAST(n_regionkey AS STRING), 'n' || CAST(n_nationkey AS STRING) || '/', 'func:nation::N', CAST(n_nationkey * 100 + 1 AS BIGINT), CAST(n_nationkey * 100 + 50 AS BIGINT) FROM {nation}
UNION ALL SELECT 'group:c' || CAST(c_custkey AS STRING), 'group:n' || CAST(c_nationkey AS STRING), '/c' || CAST(c_custkey AS STRING), 'func:customer::C' || CAST(c_custkey AS STRING), CAST(c_custkey * 3 + 1 AS BIGINT), CAST(c_custkey * 3 + 10 AS BIGINT) FROM {customer}
UNION ALL SELECT 'group:o' || CAST(o_orderkey AS STRING), 'group:c' || CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '/o' || CAST(o_orderkey AS STRING) || '//' END, 'func:orders::F' || CAST(o_orderkey % 500 AS STRING), CAST(o_orderkey * 10 + 1 AS BIGINT), CAST(o_orderkey * 10 + 9 AS BIGINT) FROM {orders}
"""

VIEWS["v_lines"] = """
SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(CAST(l_quantity AS BIGINT)) AS quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

VIEWS["v_routes"] = """
SELECT 'route:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS id, CASE l_linenumber % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'put' ELSE 'DELETE' END AS method,
    CASE WHEN l_partkey % 11 = 0 THEN CAST(NULL AS STRING) WHEN l_partkey % 3 = 0 THEN 'p' || CAST(l_partkey % 50 AS STRING) ELSE '/p' || CAST(l_partkey % 50 AS STRING) || '/' END AS local_path,
    'group:o' || CAST(l_orderkey AS STRING) AS group_id, 'func:orders::F' || CAST(l_orderkey % 500 AS STRING) AS route_func, CAST(l_linenumber AS BIGINT) AS statement_index,
    CASE WHEN l_suppkey % 7 = 0 THEN CAST(NULL AS STRING) ELSE 'func:supplier::S' || CAST(l_suppkey AS STRING) END AS handler_symbol, l_partkey % 13 = 0 AS guessed,
    'orders_' || CAST(l_orderkey % 97 AS STRING) || '.go' AS file, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS sl, CAST(l_linenumber AS BIGINT) AS sc, CAST(l_orderkey * 10 + l_linenumber + l_partkey % 3 AS BIGINT) AS el, CAST(40 AS BIGINT) AS ec
FROM {v_lines} WHERE l_returnflag <> 'R'
"""

VIEWS["v_middleware"] = """
SELECT 'mw:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'group:c' || CAST(o_custkey AS STRING) ELSE 'group:o' || CAST(l_orderkey AS STRING) END AS group_id,
    CASE WHEN l_linenumber % 2 = 0 THEN 'func:customer::C' || CAST(o_custkey AS STRING) ELSE 'func:orders::F' || CAST(l_orderkey % 500 AS STRING) END AS route_func, CAST(l_linenumber AS BIGINT) AS statement_index, 'func:supplier::S' || CAST(l_suppkey AS STRING) AS symbol
FROM {v_lines} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'
"""

VIEWS["v_comments"] = """
SELECT 'annotation:' || CAST(s_suppkey AS STRING) AS id, 'func:supplier::S' || CAST(s_suppkey AS STRING) AS handler_symbol, CASE s_suppkey % 6 WHEN 1 THEN '// @Get /s/' || CAST(s_suppkey AS STRING) WHEN 2 THEN '//@post s/' || CAST(s_suppkey AS STRING) || '  trailing' WHEN 4 THEN '// @Refactor /x' WHEN 5 THEN '  @DELETE   /d/' || CAST(s_suppkey AS STRING) ELSE '@Put' END AS raw,
    'supplier.go' AS file, CAST(s_suppkey * 20 AS BIGINT) AS sl, CAST(s_suppkey * 20 AS BIGINT) AS el
FROM {supplier}
"""

VIEWS["v_annotations"] = """
SELECT id, handler_symbol, raw, CASE WHEN raw LIKE '%Get%' THEN 'GET' WHEN raw LIKE '%post%' THEN 'POST' ELSE 'DELETE' END AS method, '/' || CASE WHEN raw LIKE '%Get%' THEN 's' WHEN raw LIKE '%post%' THEN 's' ELSE 'd' END || '/' || substr(id, 12) AS path, file, sl, el
FROM {v_comments} WHERE raw LIKE '%Get%' OR raw LIKE '%post%' OR raw LIKE '%DELETE%'
"""

VIEWS["v_spans"] = """
SELECT DISTINCT 'f' || CAST(l_orderkey AS STRING) AS file, 'span:' || CAST(l_linenumber AS STRING) || ':' || CAST(l_quantity AS STRING) AS id, CAST((l_linenumber - 1) * 10 + 1 AS BIGINT) AS sl, CAST((l_linenumber - 1) * 10 + 1 + floor(l_quantity) AS BIGINT) AS el FROM {lineitem}
"""

VIEWS["v_change_lines"] = """
SELECT DISTINCT 'f' || CAST(o_orderkey AS STRING) AS file, CAST(o_custkey % 70 + 1 AS BIGINT) AS line FROM {orders}
UNION SELECT DISTINCT 'f' || CAST(o_orderkey AS STRING), CAST(o_custkey % 70 + 2 + o_orderkey % 3 AS BIGINT) FROM {orders}
"""

VIEWS["v_calls"] = """
SELECT from_symbol AS caller, to_symbol AS callee FROM {v_refs} WHERE kind = 'call'
"""

VIEWS["v_remote"] = """
SELECT DISTINCT 'func:supplier::S' || CAST(l_suppkey AS STRING) AS caller_symbol, 'grpc:example.com/api.Part' || CAST(l_suppkey % 7 AS STRING) || '/Get' || CAST(l_linenumber % 3 AS STRING) AS operation_id FROM {lineitem}
"""

VIEWS["v_events"] = """
SELECT DISTINCT event_type || CAST(event_id % 7 AS STRING) AS event, 'func:customer::C' || CAST(user_id AS STRING) AS sender_symbol, CASE event_id % 3 WHEN 0 THEN 'payload' WHEN 1 THEN 'event_value' ELSE 'control' END AS relation,
    'type:nation::N' || CAST(event_id % 25 AS STRING) AS symbol_id, 'customer_' || CAST(user_id % 50 AS STRING) || '.go' AS evidence_file, CAST(user_id * 3 + event_id % 4 AS BIGINT) AS evidence_start, CASE WHEN event_id % 2 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(user_id * 3 + event_id % 4 + 2 AS BIGINT) END AS evidence_end
FROM {events}
"""

VIEWS["v_anchors"] = """
SELECT 'func:supplier::S' || CAST(s_suppkey AS STRING) AS id, s_suppkey % 10 = 0 AS scheme, s_suppkey % 10 = 3 AS endpoint FROM {supplier}
"""

VIEWS["v_event_calls"] = """
SELECT 'func:supplier::S' || CAST(s_suppkey AS STRING) AS function, 'func:supplier::S' || CAST(CASE WHEN s_suppkey % 5 = 4 THEN s_suppkey - 4 ELSE s_suppkey + 1 END AS STRING) AS callee, CASE WHEN s_suppkey % 3 = 0 THEN 'l' || CAST(s_suppkey AS STRING) ELSE CAST(NULL AS STRING) END AS given, 'N' || CAST(s_nationkey AS STRING) AS payload, 'e' || CAST(s_suppkey % 2 AS STRING) || '.' AS prefix FROM {supplier}
"""

VIEWS["v_served"] = """
SELECT DISTINCT 'grpc:example.com/api.Part' || CAST(s_suppkey % 9 AS STRING) || '/Get' || CAST(s_suppkey % 4 AS STRING) AS operation_id, 'func:supplier::S' || CAST(s_suppkey AS STRING) AS handler_symbol FROM {supplier}
"""

VIEWS["v_modules_old"] = """
SELECT CASE WHEN p_partkey % 10 = 1 THEN 'example.com/old' ELSE 'example.com/m' END || CAST(p_partkey AS STRING) AS path, 'v' || CAST(p_size % 3 AS STRING) || '.' || CAST(p_partkey % 11 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) AS version, CASE WHEN p_partkey % 17 = 0 THEN 'example.com/fork' ELSE CAST(NULL AS STRING) END AS replace_path, CAST(NULL AS STRING) AS replace_version FROM {part}
"""

VIEWS["v_modules_new"] = """
SELECT CASE WHEN p_partkey % 10 = 2 THEN 'example.com/new' ELSE 'example.com/m' END || CAST(p_partkey AS STRING) AS path, CASE WHEN p_partkey % 5 = 0 THEN 'v' || CAST((p_size + p_partkey) % 3 AS STRING) || '.' || CAST(p_partkey % 13 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) || CASE WHEN p_partkey % 4 = 0 THEN '-rc.' || CAST(p_partkey % 12 AS STRING) ELSE '' END ELSE 'v' || CAST(p_size % 3 AS STRING) || '.' || CAST(p_partkey % 11 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) END AS version,
    CASE WHEN p_partkey % 17 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'example.com/fork' ELSE '../local' END ELSE CAST(NULL AS STRING) END AS replace_path, CAST(NULL AS STRING) AS replace_version FROM {part}
"""

VIEWS["v_imports"] = """
SELECT DISTINCT 'file' || CAST(l_orderkey % 400 AS STRING) || '.go' AS file, CASE WHEN l_linenumber = 1 THEN '_' WHEN l_linenumber = 2 THEN '.' ELSE 'm' || CAST(l_partkey % 300 AS STRING) END AS alias,
    'example.com/m' || CAST(l_partkey % 300 AS STRING) || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '/pkg' ELSE '/pkg/v2' END AS import_path FROM {lineitem}
"""

VIEWS["v_uses"] = """
SELECT DISTINCT 'file' || CAST(l_orderkey % 400 AS STRING) || '.go' AS file, CASE WHEN l_suppkey % 2 = 0 THEN 'm' ELSE 'x' END || CAST(l_partkey % 300 AS STRING) AS alias, 'func:file' || CAST(l_orderkey % 400 AS STRING) || '::F' || CAST(l_suppkey % 4 AS STRING) AS symbol_id FROM {lineitem}
"""

VIEWS["v_file_symbols"] = """
SELECT DISTINCT 'func:file' || CAST(l_orderkey % 400 AS STRING) || '::F' || CAST(l_suppkey % 4 AS STRING) AS id, CASE WHEN l_orderkey % 400 > 20 THEN 'file' ELSE 'other' END || CAST(l_orderkey % 400 AS STRING) || '.go' AS file FROM {lineitem}
"""

VIEWS["v_diff_text"] = """
SELECT conv_id AS diff_id, CAST(turn AS BIGINT) AS turn, role, coalesce(replace(text, chr(13), ''), '') AS text FROM {conversations}
"""

NAMES = re.compile(r"\{(\w+)\}")


def needed(sql: str) -> list[str]:
    """The views that a text names, in an order in which each stands behind what it needs."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in NAMES.findall(text):
            if name in VIEWS and name not in out:
                visit(VIEWS[name])
                out.append(name)

    visit(sql)
    return out


class Relations:
    """DataFrames of tables and views by name, each made once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What build() gives, worked out and written the first time that it is asked for."""
        if name not in self.made:
            self.made[name] = settle(build())
        return self.made[name]

    def repeated(self, name: str) -> DataFrame:
        """The view without its outermost DISTINCT, for operators to which repeated rows are one."""
        sql = VIEWS[name].strip()
        if not sql.startswith("SELECT DISTINCT "):
            raise ValueError(f"{name} is not SELECT DISTINCT")
        parts = {n: self(n) for n in dict.fromkeys(NAMES.findall(sql))}
        return self.spark.sql(sql.replace("SELECT DISTINCT ", "SELECT ", 1), **parts)

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                parts = {n: self(n) for n in dict.fromkeys(NAMES.findall(VIEWS[name]))}
                self.made[name] = self.spark.sql(VIEWS[name], **parts)
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]


def for_duckdb(sql: str, recursive: bool = False) -> str:
    """The text with its views as common table expressions in front."""
    plain = lambda text: NAMES.sub(r"\1", text)
    own = [f"{n} AS ({plain(VIEWS[n]).strip()})" for n in needed(sql)]
    body = plain(sql).strip()
    starts = re.match(r"(?i)WITH\s+(RECURSIVE\s+)?", body)
    recursive = recursive or bool(starts and starts[1])
    if starts:
        own.append(body[starts.end() :])
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(own)
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(own) + "\n" if own else "") + body
