"""Every core query beside its SQL on the smallest tables."""

import os

import pytest

from codestrata.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, bool)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=str)
    if name not in registry.SQL:
        return
    rel = con.sql(registry.SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted([tuple(plain(r[i]) for i in at) for r in rel.fetchall()], key=str)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 1e-6, (a, b)
