"""Sensitivity of a score to each input: what changes when the input is set to its mean."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neutralised(df: DataFrame, neutral: dict[str, float], score: Callable[[dict[str, Column]], Column], target: Column | None = None) -> DataFrame:
    """column_name, d: score - score with the column at its neutral value (or target - that score), as expressions."""
    cols = {c: F.col(c).cast("double") for c in neutral}
    whole = target if target is not None else score(cols)
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), (whole - score(cols | {c: F.lit(float(v))})).alias("d")) for c, v in neutral.items()])).alias("x")).select("x.*")


def of_model(df: DataFrame, columns: list[str], predict: Callable[[np.ndarray], np.ndarray], neutral: list[float], target: str | None = None) -> DataFrame:
    """column_name, n, sum_abs, sum_sq of a model's differences: each batch is scored once whole and once per column, and
    gives one row of partial sums for each column."""

    def run(batches):
        for pdf in batches:
            x = pdf[columns].to_numpy(float)
            base = pdf[target].to_numpy(float) if target else predict(x)
            rows = []
            for j, c in enumerate(columns):
                z = x.copy()
                z[:, j] = neutral[j]
                d = base - predict(z)
                rows.append((c, len(d), float(np.abs(d).sum()), float((d * d).sum())))
            yield pd.DataFrame(rows, columns=["column_name", "n", "sum_abs", "sum_sq"])

    part = df.select(*columns, *([target] if target else [])).mapInPandas(run, "column_name string, n long, sum_abs double, sum_sq double")
    s = part.groupBy("column_name").agg(F.sum("n").alias("n"), F.sum("sum_abs").alias("a"), F.sum("sum_sq").alias("q"))
    m, q = F.col("a") / F.col("n"), F.col("q") / F.col("n")
    return s.select("column_name", m.alias("mean_abs"), F.sqrt(q).alias("rms"), (q - m * m).alias("variance"))
