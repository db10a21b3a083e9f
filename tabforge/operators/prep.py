"""Rows ready for statistics: tags, weights, filters, segments and the long form of cells."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions import expression
from tabforge.functions.scalar import column, is_missing, number, trim_tag


def tag(target: Column | str, positive: list[str], negative: list[str]) -> Column:
    """1 for a positive tag, 0 for a negative one, null for any other; tags are trimmed and numeric ones stripped of .0."""
    t = _compared(target, [*positive, *negative])
    return F.when(t.isin(*[_plain(p) for p in positive]), F.lit(1)).when(t.isin(*[_plain(n) for n in negative]), F.lit(0))


def _compared(target: Column | str, tags: list[str]) -> Column:
    """What tags are compared with: only where one of them is a number, zeros of a value's fraction matter."""
    return trim_tag(target) if any(re.fullmatch(r"[-+]?[0-9]*\.?[0-9]*", _plain(t)) for t in tags) else F.trim(column(target).cast("string"))


def _plain(t: str) -> str:
    t = str(t).strip()
    try:
        return str(int(float(t))) if float(t) == int(float(t)) and "e" not in t.lower() else t
    except ValueError:
        return t


def tagged(df: DataFrame, target: str, positive: list[str], negative: list[str], weight: str | None = None, out: str = "tag", weight_out: str = "weight") -> DataFrame:
    """df with tag and weight; rows of other tags go.  weight is an expression; missing or negative weights count 1."""
    return df.withColumn(out, tag(target, positive, negative)).filter(F.col(out).isNotNull()).withColumn(weight_out, expression.weight_of(df, weight).cast("double"))


def tag_index(target: Column | str, tags: list[str]) -> Column:
    """Index of a tag of several, null for any other."""
    t = _compared(target, tags)
    return reduce(lambda acc, it: acc.when(t == it[1], it[0]), list(enumerate(map(_plain, tags)))[1:], F.when(t == _plain(tags[0]), 0))


def counters(df: DataFrame, target: str, positive: list[str], negative: list[str], weight: str | None = None) -> DataFrame:
    """One row: rows, pos, neg, invalid tags, weighted pos and neg, weights that can't be used."""
    t, w = tag(target, positive, negative), number(weight) if weight else F.lit(1.0)
    bad = w.isNull() | (w < 0)
    used = F.when(bad, 1.0).otherwise(w)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return df.agg(
        F.count("*").alias("rows"), n(t == 1).alias("pos"), n(t == 0).alias("neg"), n(t.isNull()).alias("invalid_tags"),
        F.coalesce(F.sum(F.when(t == 1, used)), F.lit(0.0)).alias("weighted_pos"), F.coalesce(F.sum(F.when(t == 0, used)), F.lit(0.0)).alias("weighted_neg"), n(bad).alias("weight_exceptions"),
    )


def segmented(df: DataFrame, segments: list[str], out: str = "segment") -> DataFrame:
    """Every row once for the whole data (segment 0) and once for each segment expression k = 1.. that it satisfies."""
    marks = [F.lit(0), *[F.when(F.expr(expression.condition_sql(s, df.columns)), F.lit(k)) for k, s in enumerate(segments, 1)]]
    return df.withColumn(out, F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())))


def cells(df: DataFrame, columns: list[str], keep: list[str], salt: int = 0) -> DataFrame:
    """Long form: keep columns, column_name, value (text) and, with salt, a number below it for two-step aggregation."""
    long = df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("c")).select(*keep, "c.*")
    return long.withColumn("salt", F.floor(F.rand(7) * salt).cast("int")) if salt else long


def bin_eligible(method: str, tag_col: Column | str = "tag") -> Column:
    """Whether a row's numeric value takes part in finding bins: by its tag for the positive and negative methods."""
    return column(tag_col) == 1 if "Positive" in method else column(tag_col) == 0 if "Neg" in method else F.lit(True)


def hybrid_parts(c: Column | str, threshold: float) -> tuple[Column, Column]:
    """A hybrid column's value as number (at or above the threshold) or as category (anything else that isn't missing)."""
    v = number(c)
    as_number = F.when(v >= threshold, v)
    return as_number, F.when(as_number.isNull() & ~is_missing(c), F.trim(column(c).cast("string")))


def dry_run(df: DataFrame, text: str, rows: int = 100) -> dict[str, int]:
    """How many of the first rows a filter keeps; raises if the expression can't be read."""
    head = df.limit(rows)
    return {"read": head.count(), "kept": expression.keep_rows(head, text, strict=True).count()}
