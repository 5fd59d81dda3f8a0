"""Every registered query of the library against its SQL, on the smallest tables."""

import collections
import math
import os

import duckdb
import pytest

from docketry import oracles, registered

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, duck, name):
    df = registered.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert rows or name in ("t8_extract_identifiers",)
    want = duck.sql(oracles.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in want.fetchall()]
    assert collections.Counter(map(repr, rows)) == collections.Counter(map(repr, want))
