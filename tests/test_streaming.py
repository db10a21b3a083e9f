from datetime import datetime, timedelta

from tabforge.operators.binning import INF, Bins
from tabforge.streaming import windows


def test_stream_gives_the_counts_of_the_table(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=i), float(i % 7)) for i in range(100)]
    table = spark.createDataFrame(rows, "ts timestamp, v double")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    bins = [Bins("v", [-INF, 2.0, 5.0])]
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    q = windows.binned_counts(stream, bins).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in windows.binned_counts(table, bins).collect()}
    assert {tuple(r) for r in spark.table("counts").collect()} == want
    reference = windows.binned_counts(table, bins).groupBy("column_name", "bin").sum("rows").withColumnRenamed("sum(rows)", "rows")
    assert all(r.psi >= 0 for r in windows.window_psi(spark.table("counts"), reference).collect())
