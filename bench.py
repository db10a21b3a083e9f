"""Times the headline queries: python bench.py prints one JSON line.

BENCH_SF_DIR: folder of the tables (default sf0.1); BENCH_CPUS: threads; each query is run once to warm up code paths it
shares with others and then timed, with its whole result written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from tabforge import catalog, session

HEADLINE = [
    "ks_iv_equal_interval", "column_moments", "bins_equal_total", "woe_table", "psi_total", "correlation_matrix", "norm_zscale", "norm_woe", "norm_onehot",
    "confusion_cumulative", "roc_points", "auc", "feature_importance_points", "reason_codes", "keyed_merge", "train_lr", "train_rf",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = session.build(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    catalog.QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    cells = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() * len(catalog.NUMERIC)
    print(json.dumps({
        "metric": "modelling queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "cells_per_sec": {k: round(cells / times[k]) for k in ("ks_iv_equal_interval", "auc")}, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
