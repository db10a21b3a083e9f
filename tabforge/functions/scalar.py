"""Scalar column functions: parsing, tags, names, dates, scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.config import MISSING_TOKENS


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parsed(c: Column | str) -> Column:
    """Double of a text, NaN and infinities included, null where it isn't a number."""
    return column(c).try_cast("double") if hasattr(Column, "try_cast") else column(c).cast("double")


def number(c: Column | str) -> Column:
    """Double of a text, null where it isn't a finite number (NaN counts as missing)."""
    v = parsed(c)
    return F.when(F.abs(v) < float("inf"), v)  # NaN is above infinity


def as_float(text: str) -> float:
    """Number of a Python text, NaN where it is none."""
    try:
        return float(text)
    except ValueError:
        return float("nan")


def is_missing(c: Column | str, tokens: tuple[str, ...] = MISSING_TOKENS) -> Column:
    text = F.lower(F.trim(column(c).cast("string")))
    return text.isNull() | text.isin(*[t.lower() for t in tokens])


def category(c: Column | str, tokens: tuple[str, ...] = MISSING_TOKENS) -> Column:
    """Trimmed text, null where missing."""
    return F.when(~is_missing(c, tokens), F.trim(column(c).cast("string")))


def trim_tag(c: Column | str) -> Column:
    """Trimmed tag; a number's trailing fractional zeros go: 1.0 and 1 are one tag."""
    text = F.trim(column(c).cast("string"))
    return F.when(F.rlike(text, F.lit(r"^[-+]?[0-9]+\.0*$")), F.regexp_replace(text, r"\.0*$", "")).when(F.rlike(text, F.lit(r"^[-+]?[0-9]*\.[0-9]+$")), F.regexp_replace(text, "0+$", "")).otherwise(text)


def clean_name(name: str) -> str:
    """Column name with dots, spaces, slashes and dashes as underscores."""
    return re.sub(r"[. /-]", "_", name)


def same_name(a: str, b: str) -> bool:
    """Whether namespaced names (parts parted by ::) agree in their shared suffix."""
    x, y = a.split("::"), b.split("::")
    n = min(len(x), len(y))
    return x[-n:] == y[-n:]


def resolve(name: str, columns: list[str]) -> str:
    """The column a name means: an exact match, or the one whose namespaced suffix agrees."""
    if name in columns:
        return name
    found = [c for c in columns if same_name(name, c)]
    if len(found) != 1:
        raise KeyError(f"{name} names {len(found)} columns")
    return found[0]


def to_unix_time(c: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Seconds since the epoch of a date text, 0 where it can't be parsed."""
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(column(c).cast("string"), F.lit(fmt))), F.lit(0).cast("bigint"))


def split_literal(c: Column | str, delimiter: str) -> Column:
    """Parts between a literal delimiter, empty ones at the end included."""
    return F.split(column(c), re.escape(delimiter), -1)


def concat_log(c: Column | str, order: Column | str) -> tuple[Column, Column]:
    """Aggregates over a group: number of comma-parted items in all values taken in order, and the items."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(column(order).alias("o"), column(c).cast("string").alias("v")))), lambda x: x["v"]), ",")
    items = F.split(joined, ",", -1)
    return F.size(items), items


def parse_list(c: Column | str, kind: str = "double") -> Column:
    """[a,b,c] as an array; items that don't parse are null."""
    inner = F.regexp_replace(F.trim(column(c)), r"^\[|\]$", "")
    item = (lambda x: F.trim(x)) if kind == "string" else (lambda x: F.trim(x).try_cast(kind))
    return F.when(F.trim(inner) == "", F.array().cast(f"array<{kind}>")).otherwise(F.transform(F.split(inner, ","), item))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.least(F.lit(1e19), F.exp(-column(x))))


def sigmoid20(x: Column | str) -> Column:
    """The steeper sigmoid of raw boosted scores."""
    return 1 / (1 + F.least(F.lit(1e19), F.exp(-20 * column(x))))


def clamp01(x: Column | str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), column(x)))


def min_max_scale(x: Column | str, low: Column, high: Column, scale: float) -> Column:
    return F.coalesce(F.try_divide((column(x) - low) * scale, high - low), F.lit(0.0))


def half_cutoff(x: Column | str, high: Column, scale: float) -> Column:
    return F.coalesce(F.try_divide(F.greatest(column(x), F.lit(0.0)) * scale, high), F.lit(0.0))


def bucket_of(key: Column, n: int) -> Column:
    """A row's stable bucket of n, by a hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def to_float16(c: Column | str) -> Column:
    """Value rounded to half precision, in arithmetic: 11 significant bits, steps of 2^-24 below 2^-14, infinity above 65504."""
    x = column(c).cast("double")
    mag = F.abs(x)
    exponent = F.when(mag >= 2.0**-14, F.floor(F.log2(mag))).otherwise(F.lit(-14))
    exponent = exponent + F.when(mag >= F.pow(F.lit(2.0), exponent + 1), 1).otherwise(0) - F.when((mag >= 2.0**-14) & (mag < F.pow(F.lit(2.0), exponent)), 1).otherwise(0)
    unit = F.pow(F.lit(2.0), exponent - 10)
    rounded = F.rint(x / unit) * unit
    return F.when(F.abs(rounded) >= 65520, F.signum(x) * float("inf")).otherwise(rounded)


def precision(c: Column | str, kind: str) -> Column:
    """A normalised value at an output precision: FLOAT7 (seven decimals), FLOAT16, FLOAT32 or DOUBLE64."""
    x = column(c).cast("double")
    if kind == "FLOAT7":
        return F.round(x, 7)
    if kind == "FLOAT16":
        return to_float16(x).cast("float")
    return x.cast("float") if kind == "FLOAT32" else x


def encode_base64(c: Column | str) -> Column:
    return F.base64(column(c).cast(T.BinaryType()))


def decode_base64(c: Column | str) -> Column:
    return F.unbase64(column(c)).cast("string")
