"""Queries with SQL against DuckDB on the smallest tables, and quotations on messages that hold some."""

import os

import duckdb
import pandas as pd
import pytest

from ripplegraph.llm import queries, quotes
from tests.llm.test_rows import MESSAGES

SF = "/root/testdata/sf0.001"


def rows(frame):
    show = lambda v: "null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.execute(queries.SQL[name]).df())


def test_quotations_equal_sql(spark):
    messages = [m for m in MESSAGES if m != (3, 1, "f", "later words")] + [(3, 1, "f", "later words"), (3, 2, None, "> later words\n> hm\nok")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", messages)
    own = quotes.op10(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).toPandas()
    assert rows(own) == rows(con.execute(queries.SQL["op10_quotation"]).df())
