"""Every query of the subpackage that has SQL gives the same rows as DuckDB on given tables."""

import glob
import os

import duckdb
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    order = sorted(names)
    assert sorted(got.columns) == order
    rows = lambda cols, found: sorted(tuple(str(r[cols.index(c)]) for c in order) for r in found)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
