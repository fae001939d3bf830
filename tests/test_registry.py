"""Every core query against its SQL on the smallest data, where the data are there."""

from __future__ import annotations

import math
import os

import pytest

from casework.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = duck.execute(registry.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    want = [tuple(norm(r[have.index(c)]) for c in cols) for r in cur.fetchall()]
    assert sorted(have) == cols
    key = lambda x: tuple((y is None, str(y)) for y in x)
    assert sorted(got, key=key) == sorted(want, key=key)
