"""Sampling and splitting by hashes of a key, so that a row's fate doesn't depend on partitions or retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a row's key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") / F.lit(float(2**53))


def rows(df: DataFrame, rate: float, key: Column, seed: int = 0, negatives_only: str | None = None, draw=unit) -> DataFrame:
    """Rows with probability rate; with negatives_only (a tag column) the positives all stay.  draw: (key, seed) to [0, 1)."""
    keep = draw(key, seed) < rate
    return df.filter(keep | (F.col(negatives_only) == 1) if negatives_only else keep)


def stratified(df: DataFrame, rates: dict[object, float], stratum: str, key: Column, seed: int = 0, draw=unit) -> DataFrame:
    """Rows with the probability of their stratum; strata without a rate go."""
    rate = F.coalesce(*[F.when(F.col(stratum) == v, F.lit(float(r))) for v, r in rates.items()], F.lit(0.0))
    return df.filter(draw(key, seed) < rate)


def poisson(mean: float, u: Column, most: int | None = None) -> Column:
    """A Poisson number from a uniform one, by inversion up to `most`: by default ten standard deviations above the mean and
    more, beyond which lies less than a double can tell from 1.  Means up to 700."""
    import math

    if mean > 700:
        raise ValueError("means above 700 underflow")
    most = math.ceil(mean + 10 * math.sqrt(mean) + 20) if most is None else most
    p, total, sums = math.exp(-mean), 0.0, []
    for k in range(most):
        total += p
        sums.append(total)
        p *= mean / (k + 1)
    return F.get(F.transform(F.array(u), lambda v: F.size(F.filter(F.array(*[F.lit(x) for x in sums]), lambda s: v >= s))), F.lit(0))


def with_bags(df: DataFrame, bags: int, rate: float, key: Column, replacement: bool = False, seed: int = 0, draw=unit) -> DataFrame:
    """df with array column bags: how often each row is in each bag.  draw: (key, seed) to [0, 1)."""
    return df.withColumn("bags", F.array(*[poisson(rate, draw(key, seed + b)) if replacement else F.when(draw(key, seed + b) < rate, 1).otherwise(0) for b in range(bags)]))


def exploded_bags(df: DataFrame, bags: int, rate: float, key: Column, seed: int = 0, draw=unit) -> DataFrame:
    """A row for each bag that accepts it, with its number in column bag."""
    marks = F.array(*[F.when(draw(key, seed + b) < rate, F.lit(b)) for b in range(bags)])
    return df.withColumn("bag", F.explode(F.filter(marks, lambda x: x.isNotNull())))


def up_sampled(df: DataFrame, weight: str, tag: str, factor: float, key: Column, seed: int = 0) -> DataFrame:
    """Weights of positives raised by a Poisson number of mean factor - 1."""
    return df.withColumn(weight, F.when(F.col(tag) == 1, F.col(weight) * (1 + poisson(factor - 1, unit(key, seed)))).otherwise(F.col(weight)))


def fold(key: Column, k: int, hashed=F.xxhash64) -> Column:
    """Fold of a row, 0 to k - 1.  hashed: key to a whole number."""
    return F.pmod(hashed(key), F.lit(k)).cast("int")


def split(df: DataFrame, validation: float, key: Column, seed: int = 0, window: tuple[int, int] | None = None) -> DataFrame:
    """df with is_validation: by a uniform number, or by a fixed window of percentiles of the key's hash."""
    mark = fold(key, 100).between(window[0], window[1] - 1) if window else unit(key, seed) < validation
    return df.withColumn("is_validation", mark)


def column_subset(columns: list[str], strategy: str, seed: int = 0) -> list[str]:
    """Random columns of a tree or net: ALL, HALF, ONETHIRD, TWOTHIRDS, SQRT, LOG2 or AUTO (half), or a share as text."""
    import math
    import random

    n = len(columns)
    size = {"ALL": n, "HALF": n / 2, "AUTO": n / 2, "ONETHIRD": n / 3, "TWOTHIRDS": 2 * n / 3, "SQRT": math.sqrt(n), "LOG2": math.log2(max(2, n))}.get(strategy.upper())
    size = max(1, min(n, round(size if size is not None else float(strategy) * n)))
    return sorted(random.Random(seed).sample(columns, size), key=columns.index)
