"""Population drift of binned columns over units (months, files, regions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.operators.binning import Bins, indexed, name_of
from tabforge.operators.profile import valid_number


def population(df: DataFrame, bins: list[Bins], unit: str) -> DataFrame:
    """unit, column_name, bin, rows: one aggregation that shuffles units * columns * bins rows."""
    counts = indexed(df, bins, [F.col(unit).cast("string").alias("unit")]).groupBy("unit", "k", "bin").agg(F.count("*").alias("rows"))
    return counts.select("unit", name_of(bins).alias("column_name"), "bin", "rows")


def unit_stats(df: DataFrame, columns: list[str], unit: str) -> DataFrame:
    """unit, column_name, total, missing_rate and mean of every column in every unit."""
    long = df.select(F.col(unit).cast("string").alias("unit"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), valid_number(c).alias("v")) for c in columns])).alias("x"))
    return long.groupBy("unit", "x.column_name").agg(F.count("*").alias("total"), (1 - F.count("x.v") / F.count("*")).alias("missing_rate"), F.avg("x.v").alias("mean"))


def psi(counts: DataFrame, expected: DataFrame | None = None, per_unit: bool = False) -> DataFrame:
    """column_name, psi: sum over units and bins of (a - e) ln(a / e), bins matched by their index, terms with a zero skipped.

    counts: of population().  expected: column_name, bin, rows; by default all units together.
    """
    whole = expected if expected is not None else counts.groupBy("column_name", "bin").agg(F.sum("rows").alias("rows"))
    e = whole.select("column_name", "bin", (F.col("rows") / F.sum("rows").over(W.partitionBy("column_name"))).alias("e"))
    a = counts.select("unit", "column_name", "bin", (F.col("rows") / F.sum("rows").over(W.partitionBy("unit", "column_name"))).alias("a"))
    term = F.when((F.col("a") > 0) & (F.col("e") > 0), (F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).otherwise(0.0)
    return a.join(e, ["column_name", "bin"]).groupBy(*(["unit"] if per_unit else []), "column_name").agg(F.sum(term).alias("psi"))
