"""Queries with SQL: on edge cases here, on the smallest tables as far as they are mounted."""

from __future__ import annotations

import os

import duckdb
import pytest

from pulsegate.llm.queries import RUNS
from pulsegate.llm.sql import SQL
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# Rows that repeat a doc_id are one document to op5, which its SQL does not know.
EDGES = [n for n in SQL if not n.startswith("op5_")]


@pytest.mark.parametrize("name", EDGES)
def test_edge_cases(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    status, _, _, note = compare(spark, con, name, RUNS[name], SQL[name], tables)
    assert (status, note) == ("ok", "")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not mounted")
@pytest.mark.parametrize("name", list(SQL))
def test_smallest_tables(spark, name):
    status, _, _, note = compare(spark, connect(SF_DIR), name, RUNS[name], SQL[name], SF_DIR)
    assert (status, note) == ("ok", "")


@pytest.mark.parametrize("name", list(RUNS))
def test_empty_tables(spark, empty, tmp_path, name):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    # The conversation of control strings is there without a table.
    assert RUNS[name](spark, str(tmp_path)).count() == (1 if name == "op11_chat_format" else 0)


@pytest.mark.parametrize("name", [n for n in RUNS if n not in ("op11_chat_format", "op12_phrases")])
def test_one_row_per_document(spark, tables, rows, name):
    got = RUNS[name](spark, tables).select("doc_id").collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r[0] for r in got), key=key) == sorted((r[0] for r in rows), key=key)
