"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import numpy as np
import pytest

from ledgerlane.plans import registry

registry.load()
SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    return v.item() if isinstance(v, np.generic) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    expected = rows(names, result.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert g == e
