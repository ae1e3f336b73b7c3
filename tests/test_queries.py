"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tallyrank.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    told = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in told.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in got.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
