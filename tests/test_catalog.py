from __future__ import annotations

import duckdb
import pytest

from docloom import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, values):
    order = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted(([plain(r[i]) for i in order] for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, DATA), db.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
