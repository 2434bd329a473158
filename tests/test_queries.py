"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from trovex.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = sorted(tuple(_norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(_norm(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    assert got == want
