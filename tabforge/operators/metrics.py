"""Separation measures of binned columns: KS, information value and weight of evidence, from counts and from weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Added to shares in logarithms.
EPS = 1e-10


def with_woe(table: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Bin table with pos_rate, woe, weighted_woe per bin.

    woe = ln((n + EPS) / (p + EPS)) of the bin's share n of negatives and p of positives; null where a class is empty.
    """
    w = W.partitionBy(*(group or []), "column_name")
    out = table.withColumn("pos_rate", F.coalesce(F.try_divide(F.col("pos").cast("double"), (F.col("pos") + F.col("neg")).cast("double")), F.lit(0.0)))
    for p, n, name in (("pos", "neg", "woe"), ("weighted_pos", "weighted_neg", "weighted_woe")):
        tp, tn = F.sum(F.col(p).cast("double")).over(w), F.sum(F.col(n).cast("double")).over(w)
        out = out.withColumn(name, F.when((tp > 0) & (tn > 0), F.log((F.col(n) / tn + EPS) / (F.col(p) / tp + EPS))))
    return out


def separation(table: DataFrame, group: list[str] | None = None) -> DataFrame:
    """column_name, bins, ks (0 to 100), iv, woe (of the totals) and the same of weights; null where a class is empty."""
    group = group or []
    part, order = W.partitionBy(*group, "column_name"), W.partitionBy(*group, "column_name").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    t = table
    for p, n, pre in (("pos", "neg", ""), ("weighted_pos", "weighted_neg", "weighted_")):
        tp, tn = F.sum(F.col(p).cast("double")).over(part), F.sum(F.col(n).cast("double")).over(part)
        share_p, share_n = F.try_divide(F.col(p).cast("double"), tp), F.try_divide(F.col(n).cast("double"), tn)
        t = t.withColumn(f"__{pre}gap", F.abs(F.try_divide(F.sum(F.col(p).cast("double")).over(order), tp) - F.try_divide(F.sum(F.col(n).cast("double")).over(order), tn)))
        t = t.withColumn(f"__{pre}iv", (share_n - share_p) * F.log((share_n + EPS) / (share_p + EPS)))
    some = lambda p, n, x: F.when((F.sum(p) > 0) & (F.sum(n) > 0), x)
    return t.groupBy(*group, "column_name").agg(
        F.count("*").alias("bins"),
        some("pos", "neg", 100 * F.max("__gap")).alias("ks"), some("pos", "neg", F.sum("__iv")).alias("iv"), some("pos", "neg", F.log((F.sum("neg") + EPS) / (F.sum("pos") + EPS))).alias("woe"),
        some("weighted_pos", "weighted_neg", 100 * F.max("__weighted_gap")).alias("weighted_ks"), some("weighted_pos", "weighted_neg", F.sum("__weighted_iv")).alias("weighted_iv"), some("weighted_pos", "weighted_neg", F.log((F.sum("weighted_neg") + EPS) / (F.sum("weighted_pos") + EPS))).alias("weighted_woe"),
    )


def binned_quantiles(table: DataFrame, bounds: DataFrame, extremes: DataFrame, quarters: int = 4) -> DataFrame:
    """column_name and quantiles 1..quarters-1 by linear interpolation inside bins; missing rows don't count.

    bounds: column_name, bin, low, high (infinite ends are replaced by the column's min and max from extremes).
    """
    t = table.join(bounds, ["column_name", "bin"]).join(extremes.select("column_name", "min", "max"), "column_name")
    n = (F.col("pos") + F.col("neg")).cast("double")
    part, order = W.partitionBy("column_name"), W.partitionBy("column_name").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    t = t.select("column_name", n.alias("n"), F.greatest("low", "min").alias("low"), F.least("high", "max").alias("high"), F.sum(n).over(order).alias("upto"), F.sum(n).over(part).alias("total"))
    rank = lambda k: F.floor(F.col("total") / quarters * k)
    hit = t.select("column_name", F.explode(F.transform(F.sequence(F.lit(1), F.lit(quarters - 1)), lambda k: F.when((F.col("upto") >= rank(k)) & (F.col("upto") - F.col("n") < rank(k)), F.struct(k.alias("quarter"), (F.col("low") + (F.col("high") - F.col("low")) * (rank(k) - F.col("upto") + F.col("n")) / F.col("n")).alias("value"))))).alias("x"))
    return hit.filter("x IS NOT NULL").select("column_name", "x.quarter", "x.value")
