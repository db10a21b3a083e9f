"""Per-column profiles: counts, moments, quantiles, distinct values, type inference.

All columns are aggregated in one pass over the data, in batches so that plans stay small on very wide tables; only the
one row of results is turned into a row for each column.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.config import MISSING_TOKENS
from tabforge.functions.scalar import as_float, category, column, is_missing, number

#: Added to the variance's numerator, as the profile's definition has it.
EPS = 1e-6
BATCH = 100
#: Types of which a value is the same number by way of its text and without.
PLAIN = ("double", "bigint", "int", "smallint", "tinyint")


def _stacked(df: DataFrame, columns: list[str], aggregates) -> DataFrame:
    """One aggregation over each batch of columns, then a row for each column."""
    parts = []
    for i in range(0, len(columns), BATCH):
        own = columns[i : i + BATCH]
        aggs = {c: aggregates(c) for c in own}
        row = df.agg(*[x.alias(f"{j}_{k}") for j, c in enumerate(own) for k, x in aggs[c].items()])
        parts.append(row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{j}_{k}").alias(k) for k in aggs[c]]) for j, c in enumerate(own)]))))
    return reduce(DataFrame.unionByName, parts)


def valid_number(c: str, missing: tuple[str, ...] = MISSING_TOKENS, threshold: float | None = None) -> Column:
    """A column's value as a number; null where missing, unparsable, or above the threshold."""
    v = F.when(~is_missing(c, missing), number(c))
    if all(math.isnan(as_float(t)) for t in missing):  # no number counts as missing, so columns that hold numbers need no look at their text
        v = F.when(F.typeof(column(c)).isin(*PLAIN), number(c)).otherwise(v)  # the type is known when the plan is made: one branch is left of it
    return v if threshold is None else F.when(v <= threshold, v)


def numeric(df: DataFrame, columns: list[str], missing: tuple[str, ...] = MISSING_TOKENS, threshold: float | None = None) -> DataFrame:
    """column_name, total, missing, valid, missing_rate, sum, min, max, mean, std_dev, skewness, kurtosis (not excess).

    std_dev = sqrt(|sum(x^2) - sum(x)^2/n + EPS| / (n - 1)); skewness and kurtosis are standardised central moments with
    the population variance plus EPS.  Power sums are merged map-side; the maximum is the true one, negative values too.
    """

    def aggregates(c):
        x = valid_number(c, missing, threshold)
        return {"total": F.count(F.lit(1)), "valid": F.count(x), "min": F.min(x), "max": F.max(x), "sum": F.sum(x), "s2": F.sum(x * x), "s3": F.sum(x * x * x), "s4": F.sum(x * x * x * x)}

    n = F.col("valid").cast("double")
    m = F.col("sum") / n
    var = (F.col("s2") / n - m * m) + EPS / n
    third = F.col("s3") / n - 3 * m * F.col("s2") / n + 2 * m * m * m
    fourth = F.col("s4") / n - 4 * m * F.col("s3") / n + 6 * m * m * F.col("s2") / n - 3 * m * m * m * m
    got = _stacked(df, columns, aggregates)
    some = lambda x: F.when(F.col("valid") > 0, x)
    return got.select(
        "column_name", "total", (F.col("total") - F.col("valid")).alias("missing"), "valid", ((F.col("total") - F.col("valid")) / F.greatest(F.col("total"), F.lit(1))).alias("missing_rate"), "sum", "min", "max",
        some(m).alias("mean"),
        F.when(F.col("valid") > 1, F.sqrt(F.abs((F.col("s2") - F.col("sum") * F.col("sum") / n + EPS) / (n - 1)))).alias("std_dev"),
        some(third / F.pow(F.abs(var), F.lit(1.5))).alias("skewness"),
        some(fourth / (var * var)).alias("kurtosis"),
    )


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float] = (0.25, 0.5, 0.75), exact: bool = False, accuracy: int = 10_000, missing: tuple[str, ...] = MISSING_TOKENS) -> DataFrame:
    """column_name and q (array in the order of the probabilities): a mergeable sketch by default, exact on demand.

    Exact ones are found by counting and ranking distinct values, whatever their number (see binning.exact_quantiles).
    """
    if exact:
        from tabforge.operators.binning import exact_quantiles

        found = exact_quantiles(df, {c: valid_number(c, missing) for c in columns}, list(probabilities))
        return df.sparkSession.createDataFrame(list(found.items()), "column_name string, q array<double>")
    probs = F.array(*[F.lit(float(p)) for p in probabilities])

    def aggregates(c):
        x = valid_number(c, missing)
        return {"q": F.percentile_approx(x, probs, accuracy)}

    return _stacked(df, columns, aggregates)


def distinct(df: DataFrame, columns: list[str], rsd: float = 0.05) -> DataFrame:
    """column_name, approximate number of distinct values that aren't missing (HyperLogLog++, merged across tasks)."""
    return _stacked(df, columns, lambda c: {"distinct": F.approx_count_distinct(category(c), rsd)})


def missing_counts(df: DataFrame, columns: list[str], missing: tuple[str, ...] = MISSING_TOKENS) -> DataFrame:
    """column_name, total, missing (null or a missing token) and not_numeric (neither missing nor a number)."""

    def aggregates(c):
        gone = is_missing(c, missing)
        return {"total": F.count(F.lit(1)), "missing": F.sum(gone.cast("bigint")), "not_numeric": F.sum((~gone & number(c).isNull()).cast("bigint"))}

    return _stacked(df, columns, aggregates)


def samples(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """column_name and its k smallest distinct values; partial results hold k values of a column, whatever its size."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), category(c).alias("value")) for c in columns])).alias("c")).select("c.*").filter("value IS NOT NULL").distinct()
    from pyspark.sql import Window as W

    ranked = long.withColumn("r", F.row_number().over(W.partitionBy("column_name").orderBy("value"))).filter(F.col("r") <= k)
    return ranked.groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("samples"))


def infer_types(df: DataFrame, columns: list[str], numeric_ratio: float = 0.95, distinct_threshold: int = 0) -> DataFrame:
    """column_name, total, distinct_values, numeric_rate, zero_one and column_type.

    N if the column holds only 0 and 1 or if enough of its values are numbers, else C; with a threshold, a numeric column
    of no more distinct values is C.
    """

    def aggregates(c):
        v = category(c)
        x = number(v)
        return {"total": F.count(F.lit(1)), "present": F.count(v), "numbers": F.count(x), "distinct_values": F.approx_count_distinct(v, 0.02), "zero_one": F.coalesce(F.every(F.when(v.isNotNull(), F.coalesce(x.isin(0.0, 1.0), F.lit(False)))), F.lit(False))}

    rate = F.coalesce(F.try_divide(F.col("numbers").cast("double"), F.col("present").cast("double")), F.lit(0.0))
    kind = F.when(F.col("zero_one") & (F.col("present") > 0), "N").when((rate >= numeric_ratio) & (F.col("distinct_values") > distinct_threshold), "N").otherwise("C")
    return _stacked(df, columns, aggregates).select("column_name", "total", "distinct_values", rate.alias("numeric_rate"), "zero_one", kind.alias("column_type"))


def categorical(bin_table: DataFrame) -> DataFrame:
    """Moments of categorical columns, each bin's positive rate counted as often as the bin has rows (see binning.bin_counts)."""
    n = F.col("pos") + F.col("neg")
    rate = F.coalesce(F.try_divide(F.col("pos").cast("double"), n.cast("double")), F.lit(0.0))
    t = bin_table.withColumn("n", n.cast("double")).withColumn("r", rate).filter("n > 0")
    s, q, c = F.sum(F.col("r") * F.col("n")), F.sum(F.col("r") * F.col("r") * F.col("n")), F.sum("n")
    return t.groupBy("column_name").agg(F.min("r").alias("min"), F.max("r").alias("max"), (s / c).alias("mean"), F.sqrt(F.abs((q - s * s / c + EPS) / F.nullif(c - 1, F.lit(0.0)))).alias("std_dev"))
