import os

from pyspark.sql import functions as F

from tabforge.llm import common


def test_words_are_split_as_the_contract_has_it(spark):
    texts = ["", " ", "a", " a\tb\x0bc\x0c\r\nd ", "é😀 x y", "a  b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(common.words(F.col("t"))).collect()]
    assert got == [[w for w in t.replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").split(" ") if w] for t in texts]


def test_work_tables_are_written_and_cleared(spark):
    common.clear_work(spark)
    df = common.written(spark.range(5), "t")
    path = common._scopes[0][-1].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    assert common.clear_work(spark) == 1 and not os.path.exists(path)


def test_scratch_keeps_outer_tables_only(spark):
    with common.scratch(spark):
        common.written(spark.range(5), "inner")
        inner = common._scopes[-1][-1].removeprefix("file://")
        df = common.written(spark.range(6), "outer", outer=True)
        assert os.path.isdir(inner)
    assert not os.path.exists(inner) and df.count() == 6
    common.clear_work(spark)


def test_batches_are_bounded_and_put_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with common.small_batches(spark, 7):
        assert spark.conf.get(name) == "7"
        common.bound_batches(spark, 100)
        assert spark.conf.get(name) == "7"
    assert spark.conf.get(name) == before


def test_sub_batches():
    assert list(common.sub_batches(["a" * 5, "b" * 5, "c" * 20, "", "d"], 10)) == [(0, 2), (2, 3), (3, 5)] or list(common.sub_batches([], 3)) == []
    assert list(common.sub_batches(["", ""], 3)) == [(0, 2)]
