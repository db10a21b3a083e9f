"""Merging tables by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def selected(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """The key as uid and the columns under their new names."""
    return df.select(F.col(key).alias("uid"), *[F.col(a).alias(b) for a, b in columns.items()])


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each key, the first by order; ties are settled by all columns so the result is the same each time."""
    w = W.partitionBy(key).orderBy(*order)
    return df.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def keyed(inputs: list[tuple[DataFrame, str, dict[str, str]]]) -> DataFrame:
    """Rows of all inputs joined on keys that every input has, one row of each key: inputs are cut to their columns and
    reduced to a row for each key before they meet, so one exchange by key serves reduction and join."""
    parts = [first_of_each(s, "uid", [c for c in s.columns if c != "uid"]) for s in (selected(*i) for i in inputs)]
    return reduce(lambda a, b: a.join(b, "uid"), parts)


def with_side(df: DataFrame, side: DataFrame, on: str, limit_rows: int = 100_000) -> DataFrame:
    """Inner join with a small side: broadcast if it has at most limit_rows rows, else by shuffle."""
    small = side.limit(limit_rows + 1).count() <= limit_rows
    return df.join(F.broadcast(side) if small else side.hint("merge"), on)
