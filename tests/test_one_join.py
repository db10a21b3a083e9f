"""Line items are joined with their orders once, however many passes a query makes over them."""

import duckdb
import pytest

from tabforge import catalog
from tabforge.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["norm_zscale", "norm_woe", "one_vs_all", "bins_categorical", "train_rf"])
def test_later_passes_read_what_was_joined(spark, tmp_path, name):
    """Once the query has its frame, the tables it was joined from aren't read for it any more."""
    for t in ("lineitem", "orders"):
        duckdb.sql(f"COPY (FROM '{DATA}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert not [f for f in df.inputFiles() if str(tmp_path) in f]
    (tmp_path / "lineitem.parquet").unlink()
    (tmp_path / "orders.parquet").unlink()
    assert df.count()


def test_kept_tables_are_deleted(spark):
    tables.drop_kept(spark)
    df = tables.kept(spark.range(5), "five")
    (path,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    assert df.count() == 5 and "tabforge-work" in path
    assert tables.drop_kept(spark) == 1
    with pytest.raises(Exception, match="(?i)not.exist"):
        spark.read.parquet(path)


@pytest.mark.parametrize("kind", list(catalog._NORM_SQL))
def test_weights_are_not_joined_beside_quantities(spark, kind):
    """The weight is l_quantity, so what normalisations join and write holds it once."""
    (path,) = {f.rsplit("/", 1)[0] for f in catalog.QUERIES[f"norm_{kind.lower()}"](spark, DATA).inputFiles()}
    assert sorted(spark.read.parquet(path).columns) == ["l_discount", "l_linenumber", "l_orderkey", "l_quantity", "o_orderpriority", "tag"]


def test_weights_after_the_join_are_those_before(spark, tmp_path):
    """Missing and negative quantities count 1, as where tags and weights are made."""
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN -l_quantity WHEN 3 THEN 'nan'::DOUBLE ELSE l_quantity END AS l_quantity) FROM '{DATA}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    duckdb.sql(f"COPY (FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    cols = ["l_orderkey", "l_linenumber", "weight", "l_quantity"]
    df = catalog.items_orders(spark, str(tmp_path), cols)
    assert df.columns == cols and dict(df.dtypes)["weight"] == "double"
    orders = catalog.read(spark, str(tmp_path), "orders").selectExpr("o_orderkey AS l_orderkey")
    assert sorted(map(str, df.collect())) == sorted(map(str, catalog.items(spark, str(tmp_path)).join(orders, "l_orderkey").select(*cols).collect()))
    assert sorted(map(str, catalog.items_orders(spark, str(tmp_path), ["weight"]).collect())) == sorted(map(str, df.select("weight").collect()))
