"""Every registered query with an oracle agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from dossier import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

catalog.load_all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(value):
    if isinstance(value, bool):
        return str(int(value))
    if value is None or isinstance(value, (int, str)):
        return str(value)
    return f"{float(value):.6f}" if float(value) % 1 else str(int(value))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cur = duck.execute(catalog.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(shown(v) for v in r) for r in cur.fetchall())
    got = sorted(tuple(shown(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
