"""Every query with SQL, against an independent engine, on the whole smallest tables."""

import duckdb
import pytest

from reviewloom.plans import catalog, oracle

TABLES = "customer documents embeddings lineitem orders part".split()
STATEMENTS = oracle.statements()


@pytest.fixture(scope="module")
def duck(root):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def test_names():
    assert set(STATEMENTS) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_same_rows(spark, root, duck, name):
    df = catalog.QUERIES[name](spark, root)
    cursor = duck.execute(STATEMENTS[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(repr(row[columns.index(c)]) for c in order) for row in cursor.fetchall())
    got = sorted(tuple(repr(row[c]) for c in order) for row in df.collect())
    assert got == want
