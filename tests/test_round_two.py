"""Keys that leave 64 bits in what the models read, keys whose parts leave them too, and one join for every normalisation."""

import math

import duckdb
import pytest

from tabforge import catalog

DATA = "/root/testdata/sf0.001"


def copied(path, shifts: dict[str, int]) -> str:
    """The small line items and orders under path, with keys shifted by so much."""
    for t in ("lineitem", "orders"):
        cols = [k for k in shifts if k.startswith(t[0] + "_")]
        new = f"REPLACE ({', '.join(f'{k} + {shifts[k]} AS {k}' for k in cols)})" if cols else ""
        duckdb.sql(f"COPY (SELECT * {new} FROM '{DATA}/{t}.parquet') TO '{path}/{t}.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["train_lr", "grid_search", "sensitivity_model", "stacked_models"])
def test_training_takes_wide_keys(spark, tmp_path, name):
    path = copied(tmp_path, {"l_orderkey": 50_000_000, "o_orderkey": 50_000_000})
    rows = catalog.QUERIES[name](spark, path).collect()
    assert len(rows) == len(catalog.QUERIES[name](spark, DATA).collect())
    assert all(math.isfinite(v) for r in rows for v in r if isinstance(v, float))


@pytest.mark.parametrize("shifts", [{"l_orderkey": 2 * 10**18}, {"l_partkey": 10**12}, {"l_orderkey": 9 * 10**17 - 3000, "l_partkey": 4 * 10**11 - 1000}])
def test_parts_of_a_key_beyond_64_bits(spark, tmp_path, shifts):
    path = copied(tmp_path, shifts)
    got = sorted(int(r.id) for r in catalog.with_id(spark, path, catalog.read(spark, path, "lineitem")).select("id").collect())
    rows = duckdb.sql(f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) FROM '{path}/lineitem.parquet'").fetchall()
    assert got == sorted((o * 10 + n) * 10**12 + p * 20_000_000 + c for o, n, p, c in rows)


@pytest.mark.parametrize("kind", [k for k in catalog._NORM_SQL if k not in ("ZSCALE", "WOE")])
def test_normalising_joins_once(spark, tmp_path, kind):
    path = copied(tmp_path, {})
    df = catalog.QUERIES[f"norm_{kind.lower()}"](spark, path)
    assert not [f for f in df.inputFiles() if path in f]
