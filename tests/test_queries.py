"""Every registered query with SQL, against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from watttrail import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        path = f"{SF}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{SF}/{t}.parquet") else "")
        con.sql(f"create view {t} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, duck, name):
    found = plans.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    assert len(set(columns)) == len(columns)
    rows = sorted(repr(tuple(r)) for r in found.select(columns).collect())
    assert rows
    want = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted(map(repr, duck.sql(f"select {picked} from ({plans.ORACLE_SQL[name]})").fetchall()))
