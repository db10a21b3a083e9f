"""Converted scores next to a tie of the last digit."""

import duckdb

from tabforge import catalog


def test_converted_scores_round_as_sql(spark, tmp_path):
    """Scores around a half, whose sigmoids lie next to ties: 0.500017 gives 500.00425 less 1e-13."""
    con = duckdb.connect()
    con.sql("CREATE TABLE lineitem AS SELECT i AS l_orderkey, 1 AS l_linenumber, i AS l_partkey, 10.0::DOUBLE AS l_quantity, (45000 + i * 0.75)::DOUBLE AS l_extendedprice, 0.1::DOUBLE AS l_discount, 0.05::DOUBLE AS l_tax, 'R' AS l_returnflag FROM range(200) t(i)")
    con.sql(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    df = catalog.QUERIES["gbt_score_convert"](spark, str(tmp_path))
    got = con.sql(catalog.ORACLES["gbt_score_convert"])
    want = [tuple(dict(zip(got.columns, x, strict=True))[c] for c in df.columns) for x in got.fetchall()]
    assert len(want) == 200 and sorted(tuple(r) for r in df.collect()) == sorted(want)
