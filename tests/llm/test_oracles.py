"""Corpus queries that SQL can express, against DuckDB on the small tables."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from equitylake.llm.queries import ORACLE_SQL, QUERIES
from oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES + ["documents", "embeddings", "labels"]:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    found = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    expected = found.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert len(rows) == len(expected)
    assert digest(df.columns, rows)[0] == digest(columns, expected)[0]


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
