"""Each query of the store against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from docstrata.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings", "pages", "benchmark", "conversations", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalog.ORACLE:
        want = duck.sql(catalog.ORACLE[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert _rows(df.columns, [tuple(r) for r in got]) == _rows(want.columns, want.fetchall())
    else:
        assert df.columns
