"""Every registered query of the library against its SQL."""

import duckdb
import pytest

from brindle.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert got
    if name in ORACLE_SQL:
        sql = duck.sql(ORACLE_SQL[name])
        assert sorted(sql.columns) == columns
        assert got == sorted(map(repr, sql.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
