"""Every registered query of the modelling operators runs on the small tables and, where it has SQL, gives the same rows."""

import math
import os

import duckdb
import pytest

from tabforge import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the small tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    assert rows
    if name in catalog.ORACLES:
        got = con.sql(catalog.ORACLES[name])
        assert sorted(got.columns) == cols
        assert sorted(str([plain(dict(zip(got.columns, x, strict=True))[c]) for c in cols]) for x in got.fetchall()) == rows
