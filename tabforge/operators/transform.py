"""Normalisation of columns for training: z-scores, weights of evidence, indicators, indexes and their mixtures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.scalar import precision
from tabforge.operators.binning import Bins
from tabforge.operators.metrics import with_woe
from tabforge.operators.profile import valid_number

#: kind -> (numeric columns, categorical columns); the part before the slash is what a value becomes.
NORM_TYPES = {
    "ZSCALE": ("z", "z_rate"), "ZSCORE": ("z", "z_rate"), "OLD_ZSCALE": ("z", "rate"), "OLD_ZSCORE": ("z", "rate"),
    "WOE": ("woe", "woe"), "WEIGHT_WOE": ("weighted_woe", "weighted_woe"), "HYBRID": ("z", "woe"), "WEIGHT_HYBRID": ("z", "weighted_woe"),
    "WOE_ZSCORE": ("z_woe", "z_woe"), "WOE_ZSCALE": ("z_woe", "z_woe"), "WEIGHT_WOE_ZSCORE": ("z_weighted_woe", "z_weighted_woe"), "WEIGHT_WOE_ZSCALE": ("z_weighted_woe", "z_weighted_woe"),
    "ONEHOT": ("onehot", "onehot"), "ZSCALE_ONEHOT": ("z", "onehot"), "ASIS_WOE": ("asis", "woe"), "ASIS_PR": ("asis", "rate"),
    "DISCRETE_ZSCORE": ("z_bound", "z_rate"), "DISCRETE_ZSCALE": ("z_bound", "z_rate"), "ZSCALE_INDEX": ("z", "index"), "ZSCORE_INDEX": ("z", "index"),
    "WOE_INDEX": ("woe", "index"), "WOE_ZSCALE_INDEX": ("z_woe", "index"), "MAXMIN": ("maxmin", "rate"),
}


@dataclass
class ColumnStats:
    """What normalising a column needs: bins, moments and per-bin values with the missing bin last."""

    bins: Bins
    mean: float = 0.0
    std_dev: float = 0.0
    min: float = 0.0
    max: float = 0.0
    rates: tuple[float, ...] = ()
    woe: tuple[float, ...] = ()
    weighted_woe: tuple[float, ...] = ()
    rows: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


def column_stats(bins: list[Bins], table: DataFrame, moments: DataFrame) -> dict[str, ColumnStats]:
    """Statistics of the bins (columns * bins rows reach the driver).  Categorical columns get the moments of their rates."""
    m = {r["column_name"]: r for r in moments.collect()}
    per: dict[str, dict[int, object]] = {}
    for r in with_woe(table).collect():
        per.setdefault(r["column_name"], {})[r["bin"]] = r
    out = {}
    for b in bins:
        got = per.get(b.name, {})
        pick = lambda f, got=got, n=b.size: tuple(float(f(got[i]) or 0.0) if i in got else 0.0 for i in range(n + 1))
        s = ColumnStats(b, rates=pick(lambda r: r["pos_rate"]), woe=pick(lambda r: r["woe"]), weighted_woe=pick(lambda r: r["weighted_woe"]), rows=pick(lambda r: r["pos"] + r["neg"]), weights=pick(lambda r: r["weighted_pos"] + r["weighted_neg"]))
        if b.kind == "C":
            s.mean, s.std_dev = _moments(s.rates, s.rows, 1e-6)
            s.min, s.max = min(s.rates), max(s.rates)
        elif b.name in m:
            s.mean, s.std_dev, s.min, s.max = (float(m[b.name][k] or 0.0) for k in ("mean", "std_dev", "min", "max"))
        out[b.name] = s
    return out


def _moments(values, counts, eps: float = 0.0) -> tuple[float, float]:
    """Mean and sample standard deviation of values that occur so many times."""
    n = sum(counts)
    if n <= 0:
        return 0.0, 0.0
    s, q = sum(v * c for v, c in zip(values, counts, strict=True)), sum(v * v * c for v, c in zip(values, counts, strict=True))
    return s / n, (abs((q - s * s / n + eps) / (n - 1)) ** 0.5 if n > 1 else 0.0)


def z_score(x: Column, mean: float, std_dev: float, cutoff: float) -> Column:
    """(clamped x - mean) / std_dev; 0 where the column doesn't vary or the value is null."""
    if std_dev is None or std_dev <= 1e-5:
        return F.lit(0.0)
    return F.coalesce((F.greatest(F.least(x, F.lit(mean + cutoff * std_dev)), F.lit(mean - cutoff * std_dev)) - mean) / std_dev, F.lit(0.0))


def _at(values: tuple[float, ...], i: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), i)


def normalized(s: ColumnStats, kind: str, cutoff: float = 6.0, missing_category: str = "POSRATE") -> list[tuple[str, Column]]:
    """Output columns (name, expression) of one input column under a normalisation kind."""
    b, i = s.bins, s.bins.index()
    how = NORM_TYPES[kind.upper()][1 if b.kind == "C" else 0]
    rates = (*s.rates[:-1], s.mean) if missing_category == "MEAN" else s.rates
    x = valid_number(b.name)
    if how == "onehot":
        return [(f"{b.name}_{k}", F.when(i == k, 1.0).otherwise(0.0)) for k in range(b.size + 1)]
    if how == "z":
        out = z_score(x, s.mean, s.std_dev, cutoff)
    elif how == "z_rate":
        out = z_score(_at(rates, i), s.mean, s.std_dev, cutoff)
    elif how == "rate":
        out = _at(rates, i)
    elif how in ("woe", "weighted_woe"):
        out = _at(getattr(s, how), i)
    elif how in ("z_woe", "z_weighted_woe"):
        values = getattr(s, how[2:])
        out = z_score(_at(values, i), *_moments(values, s.rows if how == "z_woe" else s.weights), cutoff)
    elif how == "asis":
        out = F.coalesce(x, F.lit(s.mean))
    elif how == "index":
        out = i.cast("double")
    elif how == "z_bound":
        lows = (s.min, *b.bounds[1:], s.mean)
        out = z_score(_at(lows, i), s.mean, s.std_dev, cutoff)
    else:  # maxmin
        out = F.coalesce((x - s.min) / (s.max - s.min), F.lit(0.0)) if s.max > s.min else F.lit(0.0)
    return [(b.name, out)]


def normalize(df: DataFrame, stats: dict[str, ColumnStats], kind: str = "ZSCALE", cutoff: float = 6.0, keep: list[str] | None = None, missing_category: str = "POSRATE", output: str = "DOUBLE64") -> DataFrame:
    """keep columns (target, meta, weight) and the normalised columns: a projection, without a shuffle."""
    cols = [(n, precision(e, output)) for s in stats.values() for n, e in normalized(s, kind, cutoff, missing_category)]
    return df.select(*(keep or []), *[e.alias(f"n_{n}" if keep and n in keep else n) for n, e in cols])


def clean(df: DataFrame, stats: dict[str, ColumnStats], keep: list[str] | None = None) -> DataFrame:
    """Columns for tree models: known categories (else empty text), numbers (else the mean)."""
    out = []
    for s in stats.values():
        c = s.bins.name
        out.append((F.when(s.bins.index() < s.bins.size, F.trim(F.col(c).cast("string"))).otherwise("") if s.bins.kind == "C" else F.coalesce(valid_number(c), F.lit(s.mean))).alias(c))
    return df.select(*(keep or []), *out)


def shuffled(df: DataFrame, parts: int, seed: int = 1, most: int = 500_000) -> DataFrame:
    """Rows in random order over so many partitions, or over more where these would hold above `most` rows each, which bounds
    what a task sorts: by a hash of all columns, so a task that is run again deals them alike.
    Equal rows stay together, which is no matter as they can't be told apart."""
    key = F.xxhash64(F.to_json(F.struct(*df.columns)), F.lit(seed))
    parts = max(parts, -(-df.count() // most))
    return df.withColumn("__r", key).repartition(parts, "__r").sortWithinPartitions("__r").drop("__r")
