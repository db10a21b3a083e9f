"""Order keys beyond those at which the line items' combined key leaves 64 bits."""

import duckdb
import pytest

from tabforge import catalog

DATA = "/root/testdata/sf0.001"
SHIFT = 50_000_000


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    """The small line items and orders with shifted keys, and SQL views of them."""
    d, c = str(tmp_path_factory.mktemp("big")), duckdb.connect()
    for t, k in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        c.sql(f"COPY (SELECT * REPLACE ({k} + {SHIFT} AS {k}) FROM '{DATA}/{t}.parquet') TO '{d}/{t}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return d, c


def plain(k, v):
    return int(v) if k == "id" else round(v, 9) + 0.0 if isinstance(v, float) else v


KEYED = [n for n, sql in catalog.ORACLES.items() if catalog._KEY in sql and n not in ("score_bucket_counts", "bin_avg_score", "feature_importance_points", "sensitivity_linear")]


@pytest.mark.parametrize("name", KEYED)
def test_rows_are_those_of_sql_in_128_bits(spark, big, name):
    path, con = big
    df = catalog.QUERIES[name](spark, path)
    cols = sorted(df.columns)
    got = con.sql(catalog.ORACLES[name].replace("(l_orderkey * 10", "(l_orderkey::HUGEINT * 10"))
    want = sorted(str([plain(c, dict(zip(got.columns, x, strict=True))[c]) for c in cols]) for x in got.fetchall())
    assert sorted(str([plain(c, r[c]) for c in cols]) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["train_nn", "train_rf", "tree_encode", "project_steps"])
def test_models_take_wide_keys(spark, big, name):
    """Ids are told from the small tables' by the shift alone; features don't depend on keys."""
    rows = catalog.QUERIES[name](spark, big[0]).collect()
    small = catalog.QUERIES[name](spark, DATA).collect()
    assert len(rows) == len(small)
    if "id" in rows[0]:
        assert {int(r.id) for r in rows} == {r.id + SHIFT * 10 * 10**12 for r in small}


def test_small_keys_stay_bigint(spark, big):
    assert dict(catalog.QUERIES["tree_fixed"](spark, DATA).dtypes)["id"] == "bigint"
    assert dict(catalog.QUERIES["tree_fixed"](spark, big[0]).dtypes)["id"] == "decimal(38,0)"


def test_the_last_bigint_fits(spark, tmp_path):
    for cents, kind in ((14775807, "bigint"), (14775808, "decimal(38,0)")):
        path = str(tmp_path / str(cents))
        duckdb.sql(f"CREATE OR REPLACE TABLE last AS SELECT 922337::BIGINT AS l_orderkey, 2::INT AS l_linenumber, 1842::BIGINT AS l_partkey, {cents} / 100 AS l_extendedprice")
        (tmp_path / str(cents)).mkdir()
        duckdb.sql(f"COPY last TO '{path}/lineitem.parquet' (FORMAT parquet)")
        df = catalog.with_id(spark, path, catalog.read(spark, path, "lineitem"))
        assert dict(df.dtypes)["id"] == kind and int(df.head().id) == 9223372036840000000 + cents
