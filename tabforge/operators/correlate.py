"""Pearson correlation matrix over pairwise complete rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(df: DataFrame, columns: dict[str, Column], batch: int = 40) -> DataFrame:
    """column_a, column_b, n and r of every ordered pair; r is 0 where a column doesn't vary.

    The upper triangle's sums are taken in single passes of batch * batch pairs and then mirrored.  columns: name ->
    number, null where missing (bins' positive rates for categories, 1 and 0 for the target).
    """
    names = list(columns)
    base = df.select(*[columns[n].cast("double").alias(n) for n in names])
    parts = None
    blocks = [names[i : i + batch] for i in range(0, len(names), batch)]
    for x, left in enumerate(blocks):
        for right in blocks[x:]:
            pairs = [(a, b) for a in left for b in right if names.index(a) <= names.index(b)]
            aggs = []
            for k, (a, b) in enumerate(pairs):
                p, q = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
                aggs += [F.count(p * q).alias(f"n{k}"), F.sum(p).alias(f"x{k}"), F.sum(q).alias(f"y{k}"), F.sum(p * q).alias(f"xy{k}"), F.sum(p * p).alias(f"xx{k}"), F.sum(q * q).alias(f"yy{k}")]
            row = base.agg(*aggs)
            r = row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), *[F.col(f"{s}{k}").cast("double").alias(s) for s in ("n", "x", "y", "xy", "xx", "yy")]) for k, (a, b) in enumerate(pairs)])))
            parts = r if parts is None else parts.unionByName(r)
    den = F.sqrt(F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * F.sqrt(F.col("n") * F.col("yy") - F.col("y") * F.col("y"))
    r = F.coalesce(F.when((den > 0) & ~F.isnan(den), (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / den), F.lit(0.0))
    upper = parts.select("column_a", "column_b", F.col("n").cast("bigint").alias("n"), r.alias("r"))
    return upper.unionByName(upper.filter("column_a != column_b").select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "n", "r"))


def vectors(df: DataFrame, column: str, size: int) -> np.ndarray:
    """Correlation matrix of an array column without missing values: partial cross products of each Arrow batch are summed."""
    import pandas as pd

    def sums(batches):
        acc = np.zeros((size + 1, size + 1))
        for pdf in batches:
            x = np.stack(pdf[column].to_numpy()).astype(float) if len(pdf) else np.zeros((0, size))
            x = np.hstack([np.ones((len(x), 1)), x])
            acc += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(size + 1), size + 1), "j": np.tile(np.arange(size + 1), size + 1), "v": acc.ravel()})

    total = df.select(column).mapInPandas(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((size + 1, size + 1))
    for r in total:
        m[r["i"], r["j"]] = r["v"]
    n, s = m[0, 0], m[0, 1:]
    cov = n * m[1:, 1:] - np.outer(s, s)
    d = np.sqrt(np.clip(np.diag(cov), 0, None))
    return np.divide(cov, np.outer(d, d), out=np.zeros_like(cov), where=np.outer(d, d) > 0)
