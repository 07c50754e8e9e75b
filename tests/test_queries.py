"""Every relational query against its DuckDB text, on the driver's tables."""

import os

import duckdb
import pytest

from larkspur import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_same_keys():
    assert set(queries.QUERIES) == set(queries.ORACLE)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("key", sorted(queries.QUERIES))
def test_query(spark, duck, key):
    df = queries.QUERIES[key](spark, SF)
    want = duck.execute(queries.ORACLE[key])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r) for r in df.select(*names).collect()) == order(want.fetchall())
