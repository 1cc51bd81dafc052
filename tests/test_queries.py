"""Every query with SQL gives the same rows in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gridloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal_those_of_sql(spark, db, name):
    result = QUERIES[name](spark, SF)
    columns = sorted(result.columns)
    got = sorted(map(repr, (tuple(r) for r in result.select(*columns).collect())))
    assert got
    if name in ORACLE_SQL:
        found = db.execute(ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())
        a, b = [x.replace("-0.0,", "0.0,").replace("-0.0)", "0.0)") for x in got], [x.replace("-0.0,", "0.0,").replace("-0.0)", "0.0)") for x in want]
        assert sorted(a) == sorted(b), sorted(set(a) ^ set(b))[:6]
