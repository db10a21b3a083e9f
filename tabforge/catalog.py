"""Registered queries of the modelling operators and the DuckDB SQL that gives the same rows.

Each query applies library operators to the driver's tables with a small modelling task: returned line items
(l_returnflag = 'R') are the positives and l_quantity is the weight.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions import expression, scalar
from tabforge.operators import binning, correlate, drift, evaluate, merge, metrics, prep, profile, sample, select, transform
from tabforge.operators.binning import Bins
from tabforge.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with tag and weight."""
    return prep.tagged(read(spark, sf_dir, "lineitem"), "l_returnflag", ["R"], ["A", "N"], "l_quantity")


def items_orders(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Columns of line items and of their orders; both sides are cut to what is used before the join, which is run once,
    however many passes read it.  The weight is a function of l_quantity, so it isn't shuffled or written beside it."""
    orders, lines = read(spark, sf_dir, "orders"), items(spark, sf_dir)
    both = [c for c in columns if c != "weight" or "l_quantity" not in columns]
    left = lines.select("l_orderkey", *[c for c in both if c in lines.columns and c != "l_orderkey"])
    right = orders.select("o_orderkey", *[c for c in both if c in orders.columns and c != "o_orderkey"])
    df = tables.kept(left.join(right, F.col("l_orderkey") == F.col("o_orderkey")).select(*both), "items-orders")
    return df if both == columns else df.withColumn("weight", expression.weight_of(df, "l_quantity").cast("double")).select(*columns)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def rounded_scaled(v: Column, digits: int) -> Column:
    """v rounded as SQL does, which scales the double first: 500.0042499999999 is 5000042.5 then, so its last digit goes up.
    F.round goes by the double's own digits."""
    return F.round(v * 10.0**digits) / 10.0**digits


# ---- SQL parts -------------------------------------------------------------------------------------------------------

_CELLS = f"cells AS (SELECT tag, w, u.c AS column_name, u.v AS v FROM (SELECT (l_returnflag = 'R')::INT AS tag, l_quantity AS w, UNNEST([{', '.join(f"{{'c': '{c}', 'v': {c}}}" for c in NUMERIC)}]) AS u FROM lineitem))"
_INTERVAL = """ranges AS (SELECT column_name, min(v) AS lo0, max(v) AS hi0 FROM cells GROUP BY 1),
ends AS (SELECT column_name, lo0 - 0.0005::DOUBLE * (hi0 - lo0) AS lo, hi0 + 0.0005::DOUBLE * (hi0 - lo0) AS hi FROM ranges),
bounds AS (SELECT column_name, list_transform(range(1, 10), lambda j: lo + (hi - lo) * j / 10) AS b FROM ends)"""
_BINNED = "binned AS (SELECT column_name, len(list_filter(b, lambda x: x <= v))::INT AS bin, tag, w FROM cells JOIN bounds USING (column_name))"
_COUNTS = "counts AS (SELECT column_name, bin, sum(tag)::BIGINT AS pos, sum(1 - tag)::BIGINT AS neg, sum(CASE WHEN tag = 1 THEN w ELSE 0.0 END) AS weighted_pos, sum(CASE WHEN tag = 0 THEN w ELSE 0.0 END) AS weighted_neg FROM binned GROUP BY 1, 2)"
_WITH_COUNTS = f"WITH {_CELLS}, {_INTERVAL}, {_BINNED}, {_COUNTS}"


def _shares(p: str, n: str) -> str:
    part = "PARTITION BY column_name"
    return f"""SELECT column_name, bin, {p} AS p, {n} AS n, {p}::DOUBLE / sum({p}) OVER ({part}) AS sp, {n}::DOUBLE / sum({n}) OVER ({part}) AS sn,
 abs(sum({p}) OVER ({part} ORDER BY bin)::DOUBLE / sum({p}) OVER ({part}) - sum({n}) OVER ({part} ORDER BY bin)::DOUBLE / sum({n}) OVER ({part})) AS gap FROM counts"""


def _separation(p: str, n: str) -> str:
    return f"SELECT column_name, count(*)::BIGINT AS bins, round(100 * max(gap), 6) AS ks, round(sum((sn - sp) * ln((sn + 1e-10) / (sp + 1e-10))), 6) AS iv, round(ln((sum(n) + 1e-10) / (sum(p) + 1e-10)), 6) AS woe FROM ({_shares(p, n)}) GROUP BY 1"


def _interval_table(spark, sf_dir, extra=None):
    df = items(spark, sf_dir)
    bins = binning.equal_interval(df, NUMERIC)
    return df, bins, binning.bin_counts(df, bins, "tag", "weight", extra)


# ---- separation and bins ---------------------------------------------------------------------------------------------


@query(f"{_WITH_COUNTS} {_separation('pos', 'neg')}")
def ks_iv_equal_interval(spark, sf_dir):
    _, _, table = _interval_table(spark, sf_dir)
    return rounded(metrics.separation(table).select("column_name", "bins", "ks", "iv", "woe"))


@query(f"{_WITH_COUNTS} {_separation('weighted_pos', 'weighted_neg')}")
def weighted_ks_iv(spark, sf_dir):
    _, _, table = _interval_table(spark, sf_dir)
    return rounded(metrics.separation(table).select("column_name", "bins", F.col("weighted_ks").alias("ks"), F.col("weighted_iv").alias("iv"), F.col("weighted_woe").alias("woe")))


@query(f"""{_WITH_COUNTS}, s AS ({_shares('pos', 'neg')}), t AS ({_shares('weighted_pos', 'weighted_neg')})
SELECT s.column_name, s.bin, s.p AS pos, s.n AS neg, round(s.p / (s.p + s.n)::DOUBLE, 6) AS pos_rate, round(ln((s.sn + 1e-10) / (s.sp + 1e-10)), 6) AS woe, round(ln((t.sn + 1e-10) / (t.sp + 1e-10)), 6) AS weighted_woe
FROM s JOIN t ON s.column_name = t.column_name AND s.bin = t.bin""")
def woe_table(spark, sf_dir):
    _, _, table = _interval_table(spark, sf_dir)
    return rounded(metrics.with_woe(table).select("column_name", "bin", "pos", "neg", "pos_rate", "woe", "weighted_woe"))


def _quantile_bounds(where: str, k: int = 10) -> str:
    qs = ", ".join(f"{j / k}" for j in range(1, k))
    return f"bounds AS (SELECT column_name, list_sort(list_distinct(quantile_cont(v, [{qs}]))) AS b FROM cells {where} GROUP BY 1)"


def _bin_rows(where: str) -> str:
    return f"WITH {_CELLS}, {_quantile_bounds(where)}, {_BINNED}, {_COUNTS} SELECT column_name, bin, pos, neg, round(weighted_pos, 4) AS weighted_pos, round(weighted_neg, 4) AS weighted_neg FROM counts WHERE column_name <> 'l_extendedprice'"


def _population_bins(spark, sf_dir, method):
    df = items(spark, sf_dir)
    bins = binning.equal_population(df, [c for c in NUMERIC if c != "l_extendedprice"], 10, method, exact=True)
    return rounded(binning.bin_counts(df, bins, "tag", "weight"), 4)


@query(_bin_rows(""))
def bins_equal_total(spark, sf_dir):
    return _population_bins(spark, sf_dir, "EqualTotal")


@query(_bin_rows("WHERE tag = 1"))
def bins_equal_positive(spark, sf_dir):
    return _population_bins(spark, sf_dir, "EqualPositive")


@query(_bin_rows("WHERE tag = 0"))
def bins_equal_negative(spark, sf_dir):
    return _population_bins(spark, sf_dir, "EqualNegative")


_WEIGHTED = f"""WITH {_CELLS}, per AS (SELECT v, sum(w) AS w FROM cells WHERE column_name = 'l_discount' GROUP BY 1),
cum AS (SELECT v, w, sum(w) OVER (ORDER BY v) AS c FROM per), tot AS (SELECT max(c) AS t FROM cum),
cuts AS (SELECT DISTINCT v FROM cum, tot, range(1, 10) r(j) WHERE t * j / 10 > c - w AND t * j / 10 <= c),
bounds AS (SELECT 'l_discount' AS column_name, list_sort(list(v)) AS b FROM cuts), {_BINNED}, {_COUNTS}
SELECT column_name, bin, pos, neg, round(weighted_pos, 4) AS weighted_pos, round(weighted_neg, 4) AS weighted_neg FROM counts"""


@query(_WEIGHTED)
def bins_weighted(spark, sf_dir):
    df = items(spark, sf_dir)
    return rounded(binning.bin_counts(df, [binning.weighted_population(df, "l_discount")], "tag", "weight"), 4)


_NATIVE = f"""WITH {_CELLS}, per AS (SELECT v, count(*) AS n FROM cells WHERE column_name = 'l_tax' GROUP BY 1),
cum AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS c FROM per), tot AS (SELECT ceil(max(c) / 10.0) AS s FROM cum),
cuts AS (SELECT DISTINCT v FROM cum, tot, range(1, 10) r(j) WHERE s * j >= c - n AND s * j < c),
bounds AS (SELECT 'l_tax' AS column_name, list_sort(list(v)) AS b FROM cuts), {_BINNED}, {_COUNTS}
SELECT column_name, bin, pos, neg FROM counts"""


@query(_NATIVE)
def bins_native(spark, sf_dir):
    df = items(spark, sf_dir)
    return binning.bin_counts(df, [binning.native(df, "l_tax")], "tag").select("column_name", "bin", "pos", "neg")


_CATS = ["o_orderpriority", "o_orderstatus", "l_linestatus"]
_CAT_CELLS = f"cells AS (SELECT tag, w, u.c AS column_name, u.v AS v FROM (SELECT (l_returnflag = 'R')::INT AS tag, l_quantity AS w, UNNEST([{', '.join(f"{{'c': '{c}', 'v': {c}}}" for c in _CATS)}]) AS u FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"
_CAT_COUNTS = f"{_CAT_CELLS}, named AS (SELECT column_name, v, (row_number() OVER (PARTITION BY column_name ORDER BY v) - 1)::INT AS bin FROM (SELECT DISTINCT column_name, v FROM cells)), binned AS (SELECT column_name, bin, v, tag, w FROM cells JOIN named USING (column_name, v)), {_COUNTS}"


@query(f"WITH {_CAT_COUNTS} SELECT c.column_name, c.bin, named.v AS label, pos, neg, round(pos / (pos + neg)::DOUBLE, 6) AS pos_rate FROM counts c JOIN named ON c.column_name = named.column_name AND c.bin = named.bin")
def bins_categorical(spark, sf_dir):
    df = items_orders(spark, sf_dir, ["tag", *_CATS])
    bins = binning.categories(df, _CATS)
    labels = F.create_map(*[x for b in bins for i in range(b.size) for x in (F.lit(f"{b.name}/{i}"), F.lit(b.label(i)))])
    t = metrics.with_woe(binning.bin_counts(df, bins))
    return rounded(t.select("column_name", "bin", F.element_at(labels, F.concat_ws("/", "column_name", "bin")).alias("label"), "pos", "neg", "pos_rate"))


@query(f"WITH {_CAT_COUNTS}, r AS (SELECT column_name, pos / (pos + neg)::DOUBLE AS r, (pos + neg)::DOUBLE AS n FROM counts) SELECT column_name, round(min(r), 6) AS min, round(max(r), 6) AS max, round(sum(r * n) / sum(n), 6) AS mean, round(sqrt(abs((sum(r * r * n) - sum(r * n) * sum(r * n) / sum(n) + 1e-6) / (sum(n) - 1))), 6) AS std_dev FROM r GROUP BY 1")
def categorical_pos_rate(spark, sf_dir):
    df = items_orders(spark, sf_dir, ["tag", *_CATS])
    return rounded(profile.categorical(binning.bin_counts(df, binning.categories(df, _CATS))))


#: A column with missing tokens, text and numbers, made of the events alike on both sides.
_MESSY = "CASE WHEN event_id % 7 = 0 THEN '?' WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN event_type ELSE CAST(CAST(floor(value) AS INT) AS VARCHAR) END"


def messy(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("messy", F.expr(_MESSY.replace("VARCHAR", "STRING"))).withColumn("tag", (F.col("user_id") % 2).cast("int"))


_HYBRID = f"""WITH e AS (SELECT {_MESSY} AS m, (user_id % 2)::INT AS tag FROM events), x AS (SELECT m, tag, CASE WHEN TRY_CAST(m AS DOUBLE) >= 10 THEN TRY_CAST(m AS DOUBLE) END AS v FROM e),
b AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.25, 0.5, 0.75]))) AS b FROM x),
c AS (SELECT list_sort(list_distinct(list(trim(m)))) AS g FROM x WHERE v IS NULL AND m IS NOT NULL AND trim(m) NOT IN ('', '?'))
SELECT 'messy' AS column_name, (CASE WHEN v IS NOT NULL THEN len(list_filter(b, lambda y: y <= v)) WHEN m IS NULL OR trim(m) IN ('', '?') THEN len(b) + 1 + len(g) ELSE len(b) + list_position(g, trim(m)) END)::INT AS bin,
 sum(tag)::BIGINT AS pos, sum(1 - tag)::BIGINT AS neg FROM x, b, c GROUP BY 1, 2"""


@query(_HYBRID)
def hybrid_bins(spark, sf_dir):
    df = messy(spark, sf_dir)
    return binning.bin_counts(df, [binning.hybrid(df, "messy", 10.0, 4, exact=True)]).select("column_name", "bin", "pos", "neg")


@query(f"""WITH base AS (SELECT (l_returnflag = 'R')::INT AS tag, l_quantity AS w, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
seg AS (SELECT 0 AS segment, * FROM base UNION ALL SELECT 1, * FROM base WHERE l_tax <= 0.04 UNION ALL SELECT 2, * FROM base WHERE l_quantity > 25 AND l_discount <> 0.05)
SELECT segment::INT AS segment, count(*)::BIGINT AS total, sum(tag)::BIGINT AS pos, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS mean_discount FROM seg GROUP BY 1""")
def segment_stats(spark, sf_dir):
    s = prep.segmented(items(spark, sf_dir), ["l_tax <= 0.04", "l_quantity > 25 and l_discount != 0.05"])
    out = s.groupBy("segment").agg(F.count("*").alias("total"), F.sum("tag").cast("bigint").alias("pos"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 6).alias("mean_discount"))
    return out


# ---- profiles --------------------------------------------------------------------------------------------------------


@query(f"""WITH {_CELLS} SELECT column_name, count(*)::BIGINT AS total, (count(*) - count(v))::BIGINT AS missing, count(v)::BIGINT AS valid, round(sum(v), 2) AS sum, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean,
 round(sqrt(abs((sum(v * v) - sum(v) * sum(v) / count(v) + 1e-6) / (count(v) - 1))), 5) AS std_dev FROM cells GROUP BY 1""")
def column_moments(spark, sf_dir):
    p = profile.numeric(read(spark, sf_dir, "lineitem"), NUMERIC)
    return p.select("column_name", "total", "missing", "valid", F.round("sum", 2).alias("sum"), "min", "max", F.round("mean", 6).alias("mean"), F.round("std_dev", 5).alias("std_dev"))


@query(f"""WITH {_CELLS}, m AS (SELECT column_name, count(v)::DOUBLE AS n, avg(v) AS m FROM cells GROUP BY 1), c AS (SELECT column_name, n, sum((v - m) ** 2) / n + 1e-6 / n AS var, sum((v - m) ** 3) / n AS k3, sum((v - m) ** 4) / n AS k4 FROM cells JOIN m USING (column_name) GROUP BY 1, 2)
SELECT column_name, round(k3 / var ** 1.5, 4) AS skewness, round(k4 / (var * var), 4) AS kurtosis FROM c""")
def skew_kurtosis(spark, sf_dir):
    return profile.numeric(read(spark, sf_dir, "lineitem"), NUMERIC).select("column_name", F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"))


@query(f"SELECT 'messy' AS column_name, count(*)::BIGINT AS total, sum((m IS NULL OR trim(m) IN ('', '?'))::INT)::BIGINT AS missing, sum((m IS NOT NULL AND trim(m) NOT IN ('', '?') AND TRY_CAST(m AS DOUBLE) IS NULL)::INT)::BIGINT AS not_numeric FROM (SELECT {_MESSY} AS m FROM events)")
def column_missing(spark, sf_dir):
    return profile.missing_counts(messy(spark, sf_dir), ["messy"])


@query(f"WITH {_CELLS} SELECT column_name, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75 FROM cells GROUP BY 1")
def quantiles_exact(spark, sf_dir):
    q = profile.quantiles(read(spark, sf_dir, "lineitem"), NUMERIC, exact=True)
    return q.select("column_name", *[F.round(F.get("q", F.lit(i)), 4).alias(n) for i, n in enumerate(("p25", "median", "p75"))])


@query(f"""{_WITH_COUNTS}, ext AS (SELECT column_name, min(v) AS mn, max(v) AS mx FROM cells GROUP BY 1),
c AS (SELECT column_name, bin, (pos + neg)::DOUBLE AS n, greatest(CASE WHEN bin = 0 THEN '-infinity'::DOUBLE ELSE b[bin] END, mn) AS lo, least(CASE WHEN bin = len(b) THEN 'infinity'::DOUBLE ELSE b[bin + 1] END, mx) AS hi FROM counts JOIN bounds USING (column_name) JOIN ext USING (column_name)),
s AS (SELECT *, sum(n) OVER (PARTITION BY column_name ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY column_name) AS total FROM c)
SELECT column_name, k::INT AS quarter, round(lo + (hi - lo) * (floor(total / 4 * k) - upto + n) / n, 5) AS value FROM s, range(1, 4) r(k) WHERE upto >= floor(total / 4 * k) AND upto - n < floor(total / 4 * k)""")
def quantiles_binned(spark, sf_dir):
    df, bins, table = _interval_table(spark, sf_dir)
    low_high = spark.createDataFrame([(b.name, i, lo, hi) for b in bins for i, (lo, hi) in enumerate(zip(b.bounds, [*b.bounds[1:], float("inf")], strict=True))], "column_name string, bin int, low double, high double")
    return rounded(metrics.binned_quantiles(table, low_high, profile.numeric(df, NUMERIC)), 5)


@query("SELECT column_name, list_sort(list_distinct(list(v)))[1:3] AS samples FROM (SELECT UNNEST(['o_orderpriority', 'o_orderstatus']) AS column_name, UNNEST([o_orderpriority, o_orderstatus]) AS v FROM orders) GROUP BY 1".replace("samples", "s0").replace("list_sort(list_distinct(list(v)))[1:3] AS s0", "array_to_string(list_sort(list_distinct(list(v)))[1:3], '|') AS samples"))
def sample_values(spark, sf_dir):
    return profile.samples(read(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], 3).select("column_name", F.array_join("samples", "|").alias("samples"))


@query("""SELECT * FROM (VALUES ('l_quantity', 'N'), ('l_returnflag', 'C'), ('flag', 'N'), ('l_linestatus', 'C'), ('l_tax', 'N')) t(column_name, column_type)""")
def auto_type(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("flag", (F.col("l_quantity") > 25).cast("int"))
    return profile.infer_types(df, ["l_quantity", "l_returnflag", "flag", "l_linestatus", "l_tax"]).select("column_name", "column_type")


@query()
def approx_distinct(spark, sf_dir):
    return profile.distinct(read(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"])


@query()
def quantiles_sketch(spark, sf_dir):
    q = profile.quantiles(read(spark, sf_dir, "lineitem"), NUMERIC)
    return q.select("column_name", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p25", "median", "p75"))])


@query("SELECT count(*)::BIGINT AS rows, sum((l_returnflag = 'R')::INT)::BIGINT AS pos, sum((l_returnflag = 'A')::INT)::BIGINT AS neg, sum((l_returnflag = 'N')::INT)::BIGINT AS invalid_tags, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 2) AS weighted_pos, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END), 2) AS weighted_neg, 0::BIGINT AS weight_exceptions FROM lineitem")
def tag_counters(spark, sf_dir):
    return rounded(prep.counters(read(spark, sf_dir, "lineitem"), "l_returnflag", ["R"], ["A"], "l_quantity"), 2)


@query(f"WITH {_CELLS} SELECT column_name, count(*)::BIGINT AS cells, count(DISTINCT v)::BIGINT AS distinct_values FROM cells GROUP BY 1")
def unpivot_cells(spark, sf_dir):
    long = prep.cells(items(spark, sf_dir), NUMERIC, ["tag", "weight"])
    return long.groupBy("column_name").agg(F.count("*").alias("cells"), F.count_distinct("value").alias("distinct_values"))


# ---- drift and correlation -------------------------------------------------------------------------------------------

_UNIT = f"""WITH c0 AS (SELECT (year(l_shipdate))::VARCHAR AS unit, u.c AS column_name, u.v AS v FROM (SELECT l_shipdate, UNNEST([{', '.join(f"{{'c': '{c}', 'v': {c}}}" for c in NUMERIC)}]) AS u FROM lineitem)),
cells AS (SELECT unit, column_name, v FROM c0), {_INTERVAL},
n AS (SELECT unit, column_name, len(list_filter(b, lambda x: x <= v))::INT AS bin, count(*) AS rows FROM cells JOIN bounds USING (column_name) GROUP BY 1, 2, 3)"""
_PSI = f"{_UNIT}, a AS (SELECT unit, column_name, bin, rows::DOUBLE / sum(rows) OVER (PARTITION BY unit, column_name) AS a FROM n), e AS (SELECT column_name, bin, sum(rows)::DOUBLE / sum(sum(rows)) OVER (PARTITION BY column_name) AS e FROM n GROUP BY 1, 2)"


def _yearly(spark, sf_dir):
    df = items(spark, sf_dir).withColumn("year", F.year("l_shipdate").cast("string"))
    return drift.population(df, binning.equal_interval(df, NUMERIC), "year")


@query(f"{_UNIT} SELECT unit, column_name, bin, rows::BIGINT AS rows FROM n")
def population_counts(spark, sf_dir):
    return _yearly(spark, sf_dir)


@query(f"{_PSI} SELECT unit, column_name, round(sum((a - e) * ln(a / e)), 6) AS psi FROM a JOIN e USING (column_name, bin) GROUP BY 1, 2")
def psi_by_unit(spark, sf_dir):
    return rounded(drift.psi(_yearly(spark, sf_dir), per_unit=True))


@query(f"{_PSI} SELECT column_name, round(sum((a - e) * ln(a / e)), 6) AS psi FROM a JOIN e USING (column_name, bin) GROUP BY 1")
def psi_total(spark, sf_dir):
    return rounded(drift.psi(_yearly(spark, sf_dir)))


@query(f"WITH e AS (SELECT event_type AS unit, TRY_CAST({_MESSY} AS DOUBLE) AS v FROM events) SELECT unit, 'messy' AS column_name, count(*)::BIGINT AS total, round(1 - count(v) / count(*)::DOUBLE, 6) AS missing_rate, round(avg(v), 6) AS mean FROM e GROUP BY 1")
def unit_profiles(spark, sf_dir):
    return rounded(drift.unit_stats(messy(spark, sf_dir), ["messy"], "event_type"))


_CORR = [*NUMERIC, "tag"]
_CORR_VALUES = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "CASE WHEN l_linenumber % 5 <> 0 THEN l_discount END", "l_tax": "l_tax", "tag": "(l_returnflag = 'R')::INT"}
_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(CASE WHEN x.{a} IS NOT NULL AND x.{b} IS NOT NULL THEN 1 END)::BIGINT AS n, round(corr(x.{a}, x.{b}), 6) AS r FROM x" for a in _CORR for b in _CORR
)


@query(f"WITH x AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _CORR_VALUES.items())} FROM lineitem) {_CORR_SQL}")
def correlation_matrix(spark, sf_dir):
    df = items(spark, sf_dir)
    cols: dict[str, Column] = {c: F.col(c) for c in NUMERIC} | {"l_discount": F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount")), "tag": F.col("tag")}
    m = correlate.matrix(df, {c: cols[c] for c in _CORR})
    return rounded(m)


# ---- filters, sampling, merging, scalars -----------------------------------------------------------------------------

_FILTER = "(l_quantity >= 10 and l_discount < 0.06) || (l_returnflag == 'A' && !(l_tax > 0.05)) && l_linestatus != null"


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity >= 10 AND l_discount < 0.06) OR (l_returnflag = 'A' AND NOT (l_tax > 0.05) AND l_linestatus IS NOT NULL)")
def filter_expr(spark, sf_dir):
    return expression.keep_rows(read(spark, sf_dir, "lineitem"), _FILTER).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, round(o_totalprice * 0.5 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END, 4) AS w, substring(o_orderpriority, 3, 3) AS part FROM orders WHERE substring(o_orderpriority, 1, 1) = '1'")
def expression_values(spark, sf_dir):
    df = expression.keep_rows(read(spark, sf_dir, "orders"), "o_orderpriority.substring(0, 1) == '1'", strict=True)
    w = F.expr(expression.value_sql("o_totalprice * 0.5 + NumberUtils.max(0, 1 - o_orderkey % 3)"))
    return df.select("o_orderkey", F.round(w, 4).alias("w"), F.expr("substring(o_orderpriority, 3, 3)").alias("part"))


def _draw(key: Column, seed: int) -> Column:
    return F.pmod(key * 7 + F.lit(seed), F.lit(100)).cast("double") / 100


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' OR ((l_orderkey * 10 + l_linenumber) * 7 + 3) % 100 < 30")
def hash_sample(spark, sf_dir):
    df = items(spark, sf_dir)
    return sample.rows(df, 0.3, F.col("l_orderkey") * 10 + F.col("l_linenumber"), 3, "tag", _draw).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderkey * 7) % 100 < CASE o_orderstatus WHEN 'F' THEN 20 WHEN 'O' THEN 50 ELSE 0 END")
def stratified_sample(spark, sf_dir):
    return sample.stratified(read(spark, sf_dir, "orders"), {"F": 0.2, "O": 0.5}, "o_orderstatus", F.col("o_orderkey"), draw=_draw).select("o_orderkey", "o_orderstatus")


@query("SELECT (h % 5)::INT AS fold, count(*)::BIGINT AS rows FROM (SELECT ('0x' || md5(o_orderkey::VARCHAR)[1:12])::BIGINT AS h FROM orders) GROUP BY 1")
def kfold_assign(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(sample.fold(F.col("o_orderkey"), 5, _md5_number).alias("fold")).agg(F.count("*").alias("rows"))


def _md5_number(key: Column) -> Column:
    """Whole number below 2^48 of a key, by a hash that SQL has too."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 12), 16, 10).cast("bigint")


def _md5_draw(key: Column, seed: int) -> Column:
    return _md5_number(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))).cast("double") / F.lit(float(2**48))


_DRAW_SQL = "SELECT bag, ('0x' || md5(o_orderkey::VARCHAR || ':' || bag::VARCHAR)[1:12])::BIGINT::DOUBLE / 281474976710656.0 AS u FROM orders, range(0, 3) b(bag)"
_POISSON_SQL = "len(list_filter(range(0, 30), lambda k: u >= list_sum(list_transform(range(0, k + 1), lambda i: exp(-1.0) / factorial(i::INT)))))"


@query(f"SELECT bag::INT AS bag, {_POISSON_SQL}::INT AS times, count(*)::BIGINT AS rows FROM ({_DRAW_SQL}) GROUP BY 1, 2")
def bagging(spark, sf_dir):
    df = sample.with_bags(read(spark, sf_dir, "orders"), 3, 1.0, F.col("o_orderkey"), replacement=True, draw=_md5_draw)
    return df.select(F.posexplode("bags").alias("bag", "times")).groupBy("bag", "times").agg(F.count("*").alias("rows"))


@query("""WITH c AS (SELECT c_custkey AS uid, c_mktsegment AS segment FROM customer), o AS (SELECT o_custkey AS uid, o_totalprice AS price, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderstatus) AS n FROM orders) WHERE n = 1),
s AS (SELECT s_suppkey AS uid, s_name AS name FROM supplier) SELECT uid, segment, price, status, name FROM c JOIN o USING (uid) JOIN s USING (uid)""")
def keyed_merge(spark, sf_dir):
    r = lambda n: read(spark, sf_dir, n)
    return merge.keyed([(r("customer"), "c_custkey", {"c_mktsegment": "segment"}), (r("orders"), "o_custkey", {"o_totalprice": "price", "o_orderstatus": "status"}), (r("supplier"), "s_suppkey", {"s_name": "name"})])


@query("SELECT n_name, count(*)::BIGINT AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def side_join(spark, sf_dir):
    side = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return merge.with_side(read(spark, sf_dir, "customer").select("c_nationkey"), side, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("customers"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE epoch(date_trunc('day', o_orderdate))::BIGINT END AS unix_time FROM orders")
def unix_time(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 9 == 0, "bad date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.to_unix_time(text).alias("unix_time"))


@query("SELECT user_id, len(string_split(string_agg(event_type, ',' ORDER BY event_id), ','))::INT AS n, string_agg(event_type, ',' ORDER BY event_id) AS items FROM events GROUP BY 1")
def concat_log(spark, sf_dir):
    n, parts = scalar.concat_log("event_type", "event_id")
    return read(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("n"), F.array_join(parts, ",").alias("items"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2.5' WHEN 2 THEN 'x' ELSE '-3' END AS tag FROM orders")
def tag_trim(spark, sf_dir):
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN ' 1.00 ' WHEN 1 THEN '2.50' WHEN 2 THEN 'x ' ELSE '-3.0' END")
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.trim_tag(text).alias("tag"))


# ---- normalisation ---------------------------------------------------------------------------------------------------

_NORM_COLS = ["l_quantity", "l_discount", "o_orderpriority"]


def _norm_stats(spark, sf_dir, keep=("l_orderkey", "l_linenumber")):
    df = items_orders(spark, sf_dir, [*keep, "tag", "weight", *_NORM_COLS])
    bins = [*binning.equal_interval(df, _NORM_COLS[:2]), *binning.categories(df, _NORM_COLS[2:])]
    return df, transform.column_stats(bins, binning.bin_counts(df, bins, "tag", "weight"), profile.numeric(df, _NORM_COLS[:2]))


def _norm(kind: str):
    def f(spark, sf_dir):
        df, stats = _norm_stats(spark, sf_dir)
        return rounded(transform.normalize(df, stats, kind, keep=["l_orderkey", "l_linenumber", "tag"]), 5)

    f.__name__ = f"norm_{kind.lower()}"
    return f


_NB = f"""WITH li AS (SELECT l_orderkey, l_linenumber, (l_returnflag = 'R')::INT AS tag, l_quantity AS w, l_quantity, l_discount, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cells AS (SELECT tag, w, u.c AS column_name, u.v AS v FROM (SELECT tag, w, UNNEST([{{'c': 'l_quantity', 'v': l_quantity}}, {{'c': 'l_discount', 'v': l_discount}}]) AS u FROM li)), {_INTERVAL}, {_BINNED},
counts AS (SELECT column_name, bin::VARCHAR AS k, bin, sum(tag)::DOUBLE AS p, sum(1 - tag)::DOUBLE AS n, sum(tag * w) AS wp, sum((1 - tag) * w) AS wn FROM binned GROUP BY 1, 2, 3 UNION ALL SELECT 'o_orderpriority', o_orderpriority, 0, sum(tag)::DOUBLE, sum(1 - tag)::DOUBLE, sum(tag * w), sum((1 - tag) * w) FROM li GROUP BY 2),
per AS (SELECT column_name, k, p + n AS rows, wp + wn AS wrows, p / (p + n) AS rate, ln((n / sum(n) OVER c + 1e-10) / (p / sum(p) OVER c + 1e-10)) AS woe, ln((wn / sum(wn) OVER c + 1e-10) / (wp / sum(wp) OVER c + 1e-10)) AS wwoe, row_number() OVER (PARTITION BY column_name ORDER BY k) - 1 AS idx FROM counts WINDOW c AS (PARTITION BY column_name)),
mom AS (SELECT column_name, avg(v) AS m, sqrt(abs((sum(v * v) - sum(v) * sum(v) / count(v) + 1e-6) / (count(v) - 1))) AS s, min(v) AS mn, max(v) AS mx FROM cells GROUP BY 1 UNION ALL SELECT 'o_orderpriority', sum(rate * rows) / sum(rows), sqrt(abs((sum(rate * rate * rows) - sum(rate * rows) ** 2 / sum(rows) + 1e-6) / (sum(rows) - 1))), 0, 0 FROM per WHERE column_name = 'o_orderpriority'),
wm AS (SELECT column_name, sum(woe * rows) / sum(rows) AS m, sqrt(abs((sum(woe * woe * rows) - sum(woe * rows) ** 2 / sum(rows)) / (sum(rows) - 1))) AS s, sum(wwoe * wrows) / sum(wrows) AS wmn, sqrt(abs((sum(wwoe * wwoe * wrows) - sum(wwoe * wrows) ** 2 / sum(wrows)) / (sum(wrows) - 1))) AS ws FROM per GROUP BY 1),
x AS (SELECT li.*, len(list_filter(bq.b, lambda y: y <= l_quantity))::VARCHAR AS kq, len(list_filter(bd.b, lambda y: y <= l_discount))::VARCHAR AS kd, CASE WHEN len(list_filter(bq.b, lambda y: y <= l_quantity)) = 0 THEN mq.mn ELSE bq.b[len(list_filter(bq.b, lambda y: y <= l_quantity))] END AS lq, CASE WHEN len(list_filter(bd.b, lambda y: y <= l_discount)) = 0 THEN md.mn ELSE bd.b[len(list_filter(bd.b, lambda y: y <= l_discount))] END AS ld
 FROM li, bounds bq, bounds bd, mom mq, mom md WHERE bq.column_name = 'l_quantity' AND bd.column_name = 'l_discount' AND mq.column_name = 'l_quantity' AND md.column_name = 'l_discount'),
j AS (SELECT x.*, q.woe AS qwoe, q.wwoe AS qwwoe, d.woe AS dwoe, d.wwoe AS dwwoe, o.woe AS owoe, o.wwoe AS owwoe, o.rate AS orate, o.idx AS oidx, mq.m AS qm, mq.s AS qs, mq.mn AS qmn, mq.mx AS qmx, md.m AS dm, md.s AS ds, md.mn AS dmn, md.mx AS dmx, mo.m AS om, mo.s AS os, wq.m AS wqm, wq.s AS wqs, wq.wmn AS wwqm, wq.ws AS wwqs, wd.m AS wdm, wd.s AS wds, wd.wmn AS wwdm, wd.ws AS wwds, wo.m AS wom, wo.s AS wos, wo.wmn AS wwom, wo.ws AS wwos
 FROM x JOIN per q ON q.column_name = 'l_quantity' AND q.k = kq JOIN per d ON d.column_name = 'l_discount' AND d.k = kd JOIN per o ON o.column_name = 'o_orderpriority' AND o.k = o_orderpriority, mom mq, mom md, mom mo, wm wq, wm wd, wm wo
 WHERE mq.column_name = 'l_quantity' AND md.column_name = 'l_discount' AND mo.column_name = 'o_orderpriority' AND wq.column_name = 'l_quantity' AND wd.column_name = 'l_discount' AND wo.column_name = 'o_orderpriority')"""


def _z(v: str, m: str, s: str) -> str:
    return f"CASE WHEN {s} <= 1e-5 THEN 0.0 ELSE (greatest(least({v}, {m} + 6.0 * {s}), {m} - 6.0 * {s}) - {m}) / {s} END"


_NORM_SQL = {
    "ZSCALE": (_z("l_quantity", "qm", "qs"), _z("l_discount", "dm", "ds"), _z("orate", "om", "os")),
    "OLD_ZSCALE": (_z("l_quantity", "qm", "qs"), _z("l_discount", "dm", "ds"), "orate"),
    "WOE": ("qwoe", "dwoe", "owoe"),
    "WEIGHT_WOE": ("qwwoe", "dwwoe", "owwoe"),
    "HYBRID": (_z("l_quantity", "qm", "qs"), _z("l_discount", "dm", "ds"), "owoe"),
    "WEIGHT_HYBRID": (_z("l_quantity", "qm", "qs"), _z("l_discount", "dm", "ds"), "owwoe"),
    "WOE_ZSCALE": (_z("qwoe", "wqm", "wqs"), _z("dwoe", "wdm", "wds"), _z("owoe", "wom", "wos")),
    "WEIGHT_WOE_ZSCALE": (_z("qwwoe", "wwqm", "wwqs"), _z("dwwoe", "wwdm", "wwds"), _z("owwoe", "wwom", "wwos")),
    "ASIS_WOE": ("l_quantity", "l_discount", "owoe"),
    "ASIS_PR": ("l_quantity", "l_discount", "orate"),
    "DISCRETE_ZSCALE": (_z("lq", "qm", "qs"), _z("ld", "dm", "ds"), _z("orate", "om", "os")),
    "ZSCALE_INDEX": (_z("l_quantity", "qm", "qs"), _z("l_discount", "dm", "ds"), "oidx"),
    "WOE_INDEX": ("qwoe", "dwoe", "oidx"),
    "WOE_ZSCALE_INDEX": (_z("qwoe", "wqm", "wqs"), _z("dwoe", "wdm", "wds"), "oidx"),
    "MAXMIN": ("(l_quantity - qmn) / (qmx - qmn)", "(l_discount - dmn) / (dmx - dmn)", "orate"),
}
for _kind, _cols in _NORM_SQL.items():
    query(f"{_NB} SELECT l_orderkey, l_linenumber, tag, {', '.join(f'round(({v})::DOUBLE, 5) AS {n}' for n, v in zip(_NORM_COLS, _cols, strict=True))} FROM j")(_norm(_kind))


@query(f"{_NB} SELECT l_orderkey, l_linenumber, tag, {', '.join(f'(kd = {chr(39)}{i}{chr(39)})::INT::DOUBLE AS l_discount_{i}' for i in range(10))}, 0.0::DOUBLE AS l_discount_10, {', '.join(f'(oidx = {i})::INT::DOUBLE AS o_orderpriority_{i}' for i in range(5))}, 0.0::DOUBLE AS o_orderpriority_5 FROM j")
def norm_onehot(spark, sf_dir):
    df, stats = _norm_stats(spark, sf_dir)
    return transform.normalize(df, {k: stats[k] for k in _NORM_COLS[1:]}, "ONEHOT", keep=["l_orderkey", "l_linenumber", "tag"])


@query(f"{_NB} SELECT l_orderkey, l_linenumber, round(({_z('l_quantity', 'qm', 'qs')})::DOUBLE, 5) AS l_quantity, {', '.join(f'(oidx = {i})::INT::DOUBLE AS o_orderpriority_{i}' for i in range(5))}, 0.0::DOUBLE AS o_orderpriority_5 FROM j")
def norm_zscale_onehot(spark, sf_dir):
    df, stats = _norm_stats(spark, sf_dir)
    return rounded(transform.normalize(df, {k: stats[k] for k in ("l_quantity", "o_orderpriority")}, "ZSCALE_ONEHOT", keep=["l_orderkey", "l_linenumber"]), 5)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN (SELECT avg(CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END) FROM lineitem) ELSE l_discount END AS v, CASE WHEN l_linestatus = 'O' THEN 'O' ELSE '' END AS l_linestatus FROM lineitem".replace("CASE WHEN l_linenumber % 3 = 0 THEN (SELECT", "round(CASE WHEN l_linenumber % 3 = 0 THEN (SELECT").replace("ELSE l_discount END AS v", "ELSE l_discount END, 6) AS v"))
def norm_clean(spark, sf_dir):
    df = items(spark, sf_dir).withColumn("v", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")))
    bins = [*binning.equal_interval(df, ["v"]), Bins("l_linestatus", groups=[["O"]])]
    stats = transform.column_stats(bins, binning.bin_counts(df, bins), profile.numeric(df, ["v"]))
    return rounded(transform.clean(df, stats, ["l_orderkey", "l_linenumber"]))


# ---- scoring and evaluation ------------------------------------------------------------------------------------------

#: Three linear scores of a line item, the same expressions on both sides.
_SCORES = ["0.4 + 0.008 * l_quantity - 2.0 * l_discount", "0.3 + 0.000004 * l_extendedprice", "0.9 - 0.01 * l_linenumber - 3.0 * l_tax"]
_KEY = "(l_orderkey * 10 + l_linenumber) * 1000000000000 + l_partkey * 20000000 + CAST(round(l_extendedprice * 100) AS BIGINT)"


_KEY_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
#: The same key in decimals of 38 digits, and whether a row's key needs them: told by doubles, near the end of 64 bits by
#: the decimals.  try_multiply would throw an exception inside for every row that overflows, at some 10 microseconds each.
#: The key's parts are bigints while these hold them (which is faster), else decimals too, so any bigint may be a key.
_CENTS = "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DECIMAL(20, 0))"
_WIDE_KEY = f"""CASE WHEN abs(l_orderkey * 1D) < 9e17D AND abs(l_partkey * 1D) < 4e11D
 THEN CAST(CAST(l_orderkey * 10 + l_linenumber AS DECIMAL(20, 0)) * 1000000000000BD + CAST(l_partkey * 20000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS DECIMAL(20, 0)) AS DECIMAL(38, 0))
 ELSE CAST((CAST(l_orderkey AS DECIMAL(20, 0)) * 10BD + l_linenumber) * 1000000000000BD + (CAST(l_partkey AS DECIMAL(20, 0)) * 20000000BD + {_CENTS}) AS DECIMAL(38, 0)) END"""
_NEAR_KEY = "abs((l_orderkey * 10D + l_linenumber) * 1e12D + l_partkey * 2e7D + l_extendedprice * 100)"
_OUT_OF_BIGINT = f"{_NEAR_KEY} > 9.3e18D OR {_NEAR_KEY} > 9.2e18D AND {_WIDE_KEY} NOT BETWEEN -9223372036854775808BD AND 9223372036854775807BD"


def with_id(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """df with the key id: a bigint, as in SQL, while the keys of all line items fit; beyond that, at order keys of some
    900,000, where 64 bits overflow, the same number as a decimal.  A pass over four columns tells which."""
    wide = read(spark, sf_dir, "lineitem").agg(F.bool_or(F.expr(_OUT_OF_BIGINT))).head()[0]
    return df.withColumn("id", F.expr(_WIDE_KEY if wide else _KEY))


def scored(spark, sf_dir):
    df = with_id(spark, sf_dir, items(spark, sf_dir)).withColumn("scores", F.array(*[F.expr(s) for s in _SCORES]))
    return df.withColumns(evaluate.score_summary(F.col("scores"))).withColumn("score", F.round("mean", 6))


_SCORED_SQL = f"scored AS (SELECT *, round(list_avg(s), 6) AS score FROM (SELECT {_KEY} AS id, (l_returnflag = 'R')::INT AS tag, l_quantity AS w, l_discount, l_quantity, l_tax, [{', '.join(_SCORES)}] AS s FROM lineitem))"


@query(f"WITH {_SCORED_SQL} SELECT id, round(list_avg(s), 9) AS mean, round(list_max(s), 9) AS max, round(list_min(s), 9) AS min, round(list_sort(s)[2], 9) AS median, round(s[1] * 1 + s[2] * 2 + s[3] * 5, 9) AS weighted FROM scored")
def score_aggregate(spark, sf_dir):
    df = scored(spark, sf_dir)
    weighted = evaluate.score_summary(F.col("scores"), [1.0, 2.0, 5.0])["mean"]
    return rounded(df.select("id", "mean", "max", "min", "median", (weighted * 8).alias("weighted")), 9)


_CUM_SQL = f"""WITH {_SCORED_SQL}, c AS (SELECT id, score, row_number() OVER o AS rn, sum(tag) OVER o AS tp, sum(1 - tag) OVER o AS fp, sum(tag * w) OVER o AS wtp, sum((1 - tag) * w) OVER o AS wfp FROM scored WINDOW o AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(tag) AS p, sum(1 - tag) AS n, sum(tag * w) AS wp, sum((1 - tag) * w) AS wn FROM scored),
m AS (SELECT id, score, rn, tp::DOUBLE AS tp, fp::DOUBLE AS fp, (p - tp)::DOUBLE AS fn, (n - fp)::DOUBLE AS tn, wtp, wfp, wp - wtp AS wfn, wn - wfp AS wtn, p::DOUBLE AS p, n::DOUBLE AS n, wp, wn FROM c, t),
r AS (SELECT rn, score, (tp + fp) / (p + n) AS action_rate, tp / p AS recall, tp / (tp + fp) AS precision, fp / n AS fpr, tp / ((tp + fp) * p / (p + n)) AS lift, (wtp + wfp) / (wp + wn) AS weighted_action_rate, wtp / wp AS weighted_recall, wtp / (wtp + wfp) AS weighted_precision, wfp / wn AS weighted_fpr, wtp / ((wtp + wfp) * wp / (wp + wn)) AS weighted_lift FROM m)"""


def _points_sql(curves: dict[str, str], k: int = 10) -> str:
    first = " UNION ALL ".join(f"SELECT '{c}' AS curve, b AS bucket, min(rn) AS first FROM r, range(1, {k + 1}) x(b) WHERE {m} >= b / {k}.0 - 1e-12 GROUP BY b" for c, m in curves.items())
    cols = ", ".join(evaluate._MEASURES)
    zero = ", ".join(f"{1.0 if 'precision' in m else 0.0}::DOUBLE AS {m}" for m in evaluate._MEASURES)
    return f"""{_CUM_SQL}, f AS ({first}), spots AS (SELECT curve, bucket, bucket + max(first - bucket) OVER (PARTITION BY curve ORDER BY bucket) AS rn FROM f),
pts AS (SELECT curve, 0 AS bucket, 0::BIGINT AS rn, (SELECT max(score) FROM scored) AS score, {zero} FROM (SELECT UNNEST([{', '.join(f"'{c}'" for c in curves)}]) AS curve) UNION ALL SELECT curve, bucket, r.rn, score, {cols} FROM spots JOIN r USING (rn))"""


_POINT_COLS = ", ".join(f"round({m}, 6) AS {m}" for m in evaluate._MEASURES)


@query(f"{_CUM_SQL} SELECT id, score, rn, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(wtp, 2) AS weighted_tp, round(wfp, 2) AS weighted_fp, round(wfn, 2) AS weighted_fn, round(wtn, 2) AS weighted_tn FROM m")
def confusion_cumulative(spark, sf_dir):
    return rounded(evaluate.confusion(scored(spark, sf_dir), weight="weight"), 6).withColumns({f"weighted_{x}": F.round(F.round(f"weighted_{x}", 4), 2) for x in ("tp", "fp", "fn", "tn")})


def _curve(name: str):
    def f(spark, sf_dir):
        c = evaluate.confusion(scored(spark, sf_dir), weight="weight")
        return rounded(evaluate.points(c, [name]))

    f.__name__ = f"{name}_points"
    return f


for _name, _measure in evaluate.CURVES.items():
    query(f"{_points_sql({_name: _measure})} SELECT curve, bucket::INT AS bucket, rn, score, {_POINT_COLS} FROM pts")(_curve(_name))


@query(f"{_points_sql({k: evaluate.CURVES[k] for k in evaluate.AREAS})}, xy AS (SELECT curve, bucket, CASE curve {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {x}' for k, (x, _) in evaluate.AREAS.items())} END AS x, CASE curve {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {y}' for k, (_, y) in evaluate.AREAS.items())} END AS y FROM pts), d AS (SELECT curve, (y + lag(y) OVER w) * (x - lag(x) OVER w) / 2 AS part FROM xy WINDOW w AS (PARTITION BY curve ORDER BY bucket)) SELECT curve, round(sum(part), 6) AS auc FROM d GROUP BY 1")
def auc(spark, sf_dir):
    c = evaluate.confusion(scored(spark, sf_dir), weight="weight")
    return rounded(evaluate.areas(evaluate.points(c, list(evaluate.AREAS))))


@query(f"WITH {_SCORED_SQL}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM scored) SELECT least(9, greatest(0, floor((hi - score) / (hi - lo) * 10)))::INT AS bucket, count(*)::BIGINT AS rows, round(sum(w), 2) AS weight FROM scored, e GROUP BY 1")
def score_bucket_counts(spark, sf_dir):
    df = scored(spark, sf_dir)
    low, high = df.agg(F.min("score"), F.max("score")).head()
    return rounded(evaluate.score_buckets(df, "score", low, high, weight="weight"), 2)


_CONVERT = {"RAW": "x", "SIGMOID": "1 / (1 + exp(-x))", "OLD_SIGMOID": "1 / (1 + least(1e19, exp(-20 * x)))", "CUTOFF": "least(1.0, greatest(0.0, x))", "HALF_CUTOFF": "greatest(x, 0.0) / hi", "MAXMIN": "(x - lo) / (hi - lo)"}


@query(f"WITH {_SCORED_SQL}, r AS (SELECT id, score - 0.5 AS x FROM scored), e AS (SELECT min(x) AS lo, max(x) AS hi FROM r) SELECT id, {', '.join(f'round(1000 * ({v}), 4) AS {k.lower()}' for k, v in _CONVERT.items())} FROM r, e")
def gbt_score_convert(spark, sf_dir):
    df = scored(spark, sf_dir).select("id", (F.col("score") - 0.5).alias("x"))
    for k in _CONVERT:
        df = evaluate.convert_scores(df, "x", k, 1000.0, k.lower())
    df = df.withColumn("raw", F.col("x") * 1000)
    return df.select("id", *[rounded_scaled(F.col(k.lower()), 4).alias(k.lower()) for k in _CONVERT])


@query("WITH s AS (SELECT l_linestatus AS actual, [0.3 + l_discount * 3, 0.5 - l_tax, l_quantity / 100] AS s FROM lineitem), p AS (SELECT actual, ['x', 'y', 'z'][list_position(s, list_max(s))] AS predicted FROM s) SELECT actual, predicted, count(*)::BIGINT AS rows FROM p GROUP BY 1, 2")
def multiclass_confusion(spark, sf_dir):
    s = F.array(F.expr("0.3 + l_discount * 3"), F.expr("0.5 - l_tax"), F.expr("l_quantity / 100"))
    return evaluate.multiclass(read(spark, sf_dir, "lineitem"), "l_linestatus", s, ["x", "y", "z"])


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, [[0.3 + l_discount * 3, 0.5 - l_tax], [l_quantity / 100, 0.2], [0.4, l_tax * 8]] AS m FROM lineitem),
v AS (SELECT *, [list_position(x, list_max(x)) FOR x IN m] AS p FROM s),
t AS (SELECT *, len(list_filter(p, lambda x: x = 1)) AS n1, len(list_filter(p, lambda x: x = 2)) AS n2 FROM v) SELECT l_orderkey, l_linenumber, CASE WHEN n1 > n2 THEN 'a' ELSE 'b' END AS label FROM t""")
def multiclass_vote(spark, sf_dir):
    m = F.array(F.array(F.expr("0.3 + l_discount * 3"), F.expr("0.5 - l_tax")), F.array(F.expr("l_quantity / 100"), F.lit(0.2)), F.array(F.lit(0.4), F.expr("l_tax * 8")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", evaluate.vote(m, ["a", "b"]).alias("label"))


def _challenger_sql() -> str:
    base = f"WITH base AS (SELECT {_KEY} AS id, (l_returnflag = 'R')::INT AS tag, l_quantity AS w, {', '.join(f'round({s}, 6) AS s{i}' for i, s in enumerate(_SCORES[:2]))} FROM lineitem)"
    one = [
        f"SELECT 's{i}' AS score_name, b AS bucket, min(rn) - b AS gap FROM (SELECT row_number() OVER o AS rn, sum(tag) OVER o / (SELECT sum(tag) FROM base)::DOUBLE AS recall FROM base WINDOW o AS (ORDER BY s{i} DESC, id ROWS UNBOUNDED PRECEDING)), range(1, 11) x(b) WHERE recall >= b / 10.0 - 1e-12 GROUP BY b"
        for i in range(2)
    ]
    return f"{base}, f AS ({' UNION ALL '.join(one)}) SELECT score_name, bucket::INT AS bucket, (bucket + max(gap) OVER (PARTITION BY score_name ORDER BY bucket))::BIGINT AS rn FROM f"


@query(_challenger_sql())
def champion_challenger(spark, sf_dir):
    df = with_id(spark, sf_dir, items(spark, sf_dir)).withColumns({f"s{i}": F.round(F.expr(s), 6) for i, s in enumerate(_SCORES[:2])})
    p = evaluate.champion_challenger(df, ["s0", "s1"], weight="weight")
    return p.filter("curve = 'pr' AND bucket > 0").select("score_name", "bucket", "rn")


@query(f"WITH {_SCORED_SQL} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 100")
def top_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "score").orderBy(F.col("score").desc(), "id").limit(100)


_THREE = "[{'c': 'l_quantity', 'v': l_quantity}, {'c': 'l_discount', 'v': l_discount}, {'c': 'l_tax', 'v': l_tax}]"
_AVG_SQL = f"""WITH {_SCORED_SQL}, cells AS (SELECT id, score, u.c AS column_name, u.v AS v FROM (SELECT id, score, UNNEST({_THREE}) AS u FROM scored)), {_INTERVAL},
b AS (SELECT id, score, column_name, len(list_filter(b, lambda x: x <= v))::INT AS bin FROM cells JOIN bounds USING (column_name)),
a AS (SELECT column_name, bin, count(*)::BIGINT AS rows, avg(score) AS avg_score FROM b GROUP BY 1, 2),
k AS (SELECT id, column_name, row_number() OVER (PARTITION BY id ORDER BY round(avg_score, 9) DESC, CASE column_name WHEN 'l_quantity' THEN 0 WHEN 'l_discount' THEN 1 ELSE 2 END) AS r FROM b JOIN a USING (column_name, bin))"""


def _averages(spark, sf_dir):
    df = scored(spark, sf_dir)
    bins = binning.equal_interval(df, ["l_quantity", "l_discount", "l_tax"])
    return df, bins, evaluate.bin_scores(df, bins, "score").withColumn("avg_score", F.round("avg_score", 9))


@query(f"{_AVG_SQL} SELECT column_name, bin, rows, round(avg_score, 6) AS avg_score FROM a")
def bin_avg_score(spark, sf_dir):
    return rounded(_averages(spark, sf_dir)[2])


@query(f"{_AVG_SQL} SELECT column_name, sum(3 - (r - 1))::BIGINT AS points FROM k WHERE r <= 3 GROUP BY 1")
def feature_importance_points(spark, sf_dir):
    return evaluate.importance(*_averages(spark, sf_dir))


@query(f"{_AVG_SQL} SELECT id, string_agg(CASE column_name WHEN 'l_quantity' THEN 'amount' WHEN 'l_discount' THEN 'price' ELSE 'tax' END, '|' ORDER BY r) AS reasons FROM k WHERE r <= 2 GROUP BY 1")
def reason_codes(spark, sf_dir):
    out = evaluate.reasons(*_averages(spark, sf_dir), {"l_quantity": "amount", "l_discount": "price", "l_tax": "tax"}, 2, ["id"])
    return out.select("id", F.array_join("reasons", "|").alias("reasons"))


@query(f"WITH {_SCORED_SQL}, d AS (SELECT c.column_name, s[1] - CASE c.column_name WHEN 'l_quantity' THEN 0.4 + 0.008 * m.q - 2.0 * l_discount ELSE 0.4 + 0.008 * l_quantity - 2.0 * m.d END AS d FROM scored, (SELECT avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem) m, (SELECT UNNEST(['l_quantity', 'l_discount']) AS column_name) c) SELECT column_name, round(avg(abs(d)), 6) AS mean_abs, round(sqrt(avg(d * d)), 6) AS rms, round(avg(d * d) - avg(abs(d)) * avg(abs(d)), 6) AS variance FROM d GROUP BY 1")
def sensitivity_linear(spark, sf_dir):
    from tabforge.models.sensitivity import neutralised

    df = items(spark, sf_dir)
    means = df.agg(F.avg("l_quantity").alias("l_quantity"), F.avg("l_discount").alias("l_discount")).head().asDict()
    return rounded(evaluate.sensitivity(neutralised(df, means, lambda c: F.lit(0.4) + 0.008 * c["l_quantity"] - 2.0 * c["l_discount"])))


# ---- selection -------------------------------------------------------------------------------------------------------

_SEL_SQL = f"{_WITH_COUNTS}, meta AS ({_separation('pos', 'neg')})"


def _meta(spark, sf_dir):
    return rounded(metrics.separation(_interval_table(spark, sf_dir)[2]).select("column_name", "ks", "iv"))


@query(f"{_SEL_SQL} SELECT column_name, ks, row_number() OVER o AS rank, (column_name = 'l_tax' OR row_number() OVER o <= 2) AS selected FROM meta WINDOW o AS (ORDER BY (column_name = 'l_tax') DESC, ks DESC, column_name)")
def select_ks(spark, sf_dir):
    return select.by_measure(_meta(spark, sf_dir), "ks", 2, force=["l_tax"]).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"{_SEL_SQL} SELECT column_name, iv, row_number() OVER (ORDER BY iv DESC, column_name) AS rank, row_number() OVER (ORDER BY iv DESC, column_name) <= 3 AS selected FROM meta")
def select_iv(spark, sf_dir):
    return select.by_measure(_meta(spark, sf_dir), "iv", filter_out=0.25).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"{_SEL_SQL}, t AS (SELECT column_name, ks, iv, least(2 * row_number() OVER (ORDER BY ks DESC, column_name) - 1, 2 * row_number() OVER (ORDER BY iv DESC, column_name)) AS turn FROM meta) SELECT column_name, ks, iv, row_number() OVER (ORDER BY turn) AS rank, row_number() OVER (ORDER BY turn) <= 2 AS selected FROM t")
def select_mix(spark, sf_dir):
    return select.mixed(_meta(spark, sf_dir), 2).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""{_SEL_SQL}, box AS (SELECT column_name, ks, iv, trunc(ks / 100 / 0.01) AS x, trunc(iv / 0.05) AS y, row_number() OVER (PARTITION BY trunc(ks / 100 / 0.01), trunc(iv / 0.05) ORDER BY ks DESC, iv DESC, column_name) AS n FROM (SELECT column_name, round(ks, 6) AS ks, round(iv, 6) AS iv FROM meta)),
f AS (SELECT a.column_name, a.ks, a.n = 1 AND NOT EXISTS (SELECT 1 FROM box b WHERE (b.x <> a.x OR b.y <> a.y) AND b.x >= a.x AND b.y >= a.y) AS front FROM box a)
SELECT * FROM (SELECT row_number() OVER (ORDER BY front DESC, ks DESC, column_name)::INT AS rank, column_name FROM f) WHERE rank <= 3""")
def select_pareto(spark, sf_dir):
    chosen = select.pareto(_meta(spark, sf_dir).toPandas(), 3)
    return spark.createDataFrame(list(enumerate(chosen, 1)), "rank int, column_name string")


@query()
def auto_filter(spark, sf_dir):
    df = items(spark, sf_dir).withColumn("l_copy", F.col("l_extendedprice") * 2 + 1).withColumn("l_gone", F.lit("?"))
    cols = [*NUMERIC, "l_copy"]
    bins = binning.equal_interval(df, cols)
    meta = metrics.separation(binning.bin_counts(df, bins, "tag", "weight")).join(profile.numeric(df, [*cols, "l_gone"]), "column_name", "right").fillna(0.0, ["ks", "iv"]).toPandas()
    corr = {(r["column_a"], r["column_b"]): r["r"] for r in correlate.matrix(df, {c: F.col(c) for c in cols}).collect()}
    out = select.auto_filter(meta, corr, most_correlated=0.95)
    return spark.createDataFrame([(r.column, r.reason, r.detail) for r in out], "column_name string, reason string, detail string")


# ---- sketches and merged bins ----------------------------------------------------------------------------------------


def _bounds_frame(spark, bins: list[Bins]) -> DataFrame:
    return spark.createDataFrame([(b.name, i, b.label(i)) for b in bins for i in range(b.size)], "column_name string, bin int, label string")


@query()
def bins_histogram(spark, sf_dir):
    return _bounds_frame(spark, binning.histogram(items(spark, sf_dir), NUMERIC))


@query()
def bins_sketch(spark, sf_dir):
    return _bounds_frame(spark, binning.equal_population(items(spark, sf_dir), NUMERIC, 10, "EqualPositive"))


#: Greedy merging of neighbouring groups (p, n, l: positives, negatives, number of the first bin or list of labels), one step
#: a round; the least rise of entropy comes first, of equal ones the first pair.
def _merge_sql(start: str, go: str, label: str = "l") -> str:
    """Recursive SQL from start (name, g: list of groups) while `go` holds of g and of m, the groups after a merge."""
    e = lambda p, n: f"(CASE WHEN {p} > 0 THEN -{p} * ln({p} / ({p} + {n})) ELSE 0 END + CASE WHEN {n} > 0 THEN -{n} * ln({n} / ({p} + {n})) ELSE 0 END)"
    both = e("(g[i].p + g[i + 1].p)", "(g[i].n + g[i + 1].n)")
    cost = f"list_transform(range(1, len(g)), lambda i: {both} - {e('g[i].p', 'g[i].n')} - {e('g[i + 1].p', 'g[i + 1].n')})"
    merged = f"g[:(pos - 1)] || [{{'p': g[pos].p + g[pos + 1].p, 'n': g[pos].n + g[pos + 1].n, 'l': g[pos].l{' || g[pos + 1].l' if label == 'list' else ''}}}] || g[(pos + 2):]"
    return f"""steps AS (SELECT name, g, 0 AS step FROM ({start}) UNION ALL
 SELECT name, m, step + 1 FROM (SELECT name, g, step, {merged} AS m FROM (SELECT *, list_position(c, list_min(c)) AS pos FROM (SELECT *, {cost} AS c FROM steps WHERE len(g) > 1))) WHERE {go}),
final AS (SELECT name, g FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY step DESC) AS r FROM steps) WHERE r = 1)"""


def _lows_frame(spark, bins: list[Bins]) -> DataFrame:
    return spark.createDataFrame([(b.name, i, None if i == 0 else round(x, 6)) for b in bins for i, x in enumerate(b.bounds)], "column_name string, bin int, low double")


#: Counts of all ten bins of equal width (empty ones too) as groups, and the lower bounds of the groups that are left.
_TEN = "SELECT column_name AS name, list({'p': p, 'n': n, 'l': bin} ORDER BY bin) AS g FROM (SELECT r.column_name, k.bin, coalesce(pos, 0)::DOUBLE AS p, coalesce(neg, 0)::DOUBLE AS n FROM (SELECT DISTINCT column_name FROM bounds) r CROSS JOIN range(0, 10) k(bin) LEFT JOIN counts c ON c.column_name = r.column_name AND c.bin = k.bin) GROUP BY 1"
_LOWS = "SELECT name AS column_name, (i - 1)::INT AS bin, round(b[g[i].l], 6) AS low FROM (SELECT name, g, UNNEST(range(1, len(g) + 1)) AS i FROM final) JOIN bounds ON column_name = name"
_WITH_RECURSIVE = _WITH_COUNTS.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{_WITH_RECURSIVE}, {_merge_sql(_TEN, 'len(g) > 6')} {_LOWS}")
def bins_entropy(spark, sf_dir):
    df = items(spark, sf_dir)
    return _lows_frame(spark, binning.dynamic(df, NUMERIC, 6, start=binning.equal_interval(df, NUMERIC)))


@query(f"""WITH RECURSIVE c AS (SELECT o_orderpriority AS v, sum((l_returnflag = 'R')::INT)::DOUBLE AS p, sum((l_returnflag <> 'R')::INT)::DOUBLE AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
{_merge_sql("SELECT 'o_orderpriority' AS name, list({'p': p, 'n': n, 'l': [v]} ORDER BY p / (p + n), v) AS g FROM c", 'len(g) > 3', 'list')}
SELECT name AS column_name, (i - 1)::INT AS bin, array_to_string(g[i].l, '@^') AS label FROM (SELECT name, g, UNNEST(range(1, len(g) + 1)) AS i FROM final)""")
def bins_merged_categories(spark, sf_dir):
    df = items_orders(spark, sf_dir, ["tag", "o_orderpriority"])
    return _bounds_frame(spark, binning.merge_categories(df, binning.categories(df, ["o_orderpriority"]), 3))


_IV_OF = "list_sum(list_transform({x}, lambda q: (q.n / list_sum(list_transform({x}, lambda z: z.n)) - q.p / list_sum(list_transform({x}, lambda z: z.p))) * ln((q.n / list_sum(list_transform({x}, lambda z: z.n)) + 1e-10) / (q.p / list_sum(list_transform({x}, lambda z: z.p)) + 1e-10))))"
_REBIN_GO = f"len(g) > 8 OR len(g) > 2 AND {_IV_OF.format(x='m')} >= 0.9 * (SELECT any_value({_IV_OF.format(x='t.g')}) FROM ten t WHERE t.name = q.name)"


@query(f"{_WITH_RECURSIVE}, ten AS ({_TEN}), {_merge_sql('SELECT * FROM ten', _REBIN_GO).replace('WHERE len(g) > 1)))', 'WHERE len(g) > 1))) q')} {_LOWS}")
def rebin_iv(spark, sf_dir):
    df, bins, table = _interval_table(spark, sf_dir)
    counts = binning._collected(table, bins)
    return _lows_frame(spark, [binning.rebin(b, counts[b.name], 8, 50, 0.9) for b in bins])


# ---- models with fixed weights ---------------------------------------------------------------------------------------

_X = ["l_discount", "l_tax"]
_FIXED = ([[0.5, -1.5], [2.0, 0.25], [0.1, -0.2]], [[1.25], [-0.75], [0.3]])  # two hidden units, one output; the last row is the bias
_SIG = lambda x: f"(1 / (1 + exp(-({x}))))"
_HIDDEN_SQL = [_SIG(f"{_FIXED[0][0][k]} * l_discount + {_FIXED[0][1][k]} * l_tax + {_FIXED[0][2][k]}") for k in range(2)]
_NET_SQL = _SIG(f"{_FIXED[1][0][0]} * {_HIDDEN_SQL[0]} + {_FIXED[1][1][0]} * {_HIDDEN_SQL[1]} + {_FIXED[1][2][0]}")


def _fixed_net():
    import numpy as np

    from tabforge.models import net

    return net.Net([2, 2, 1], ["sigmoid", "sigmoid"], [np.array(w) for w in _FIXED])


@query(f"SELECT {_KEY} AS id, round({_NET_SQL}, 6) AS score FROM lineitem")
def score_fixed_net(spark, sf_dir):
    from tabforge.models import net

    df = with_id(spark, sf_dir, items(spark, sf_dir))
    return net.scored(df, _X, [_fixed_net()]).select("id", F.round(F.get("scores", F.lit(0)), 6).alias("score"))


_LINEAR_SQL = _SIG("1.5 * l_discount - 2.0 * l_tax + 0.25")


@query(f"SELECT UNNEST([0, 1, 2, 3]) AS i, UNNEST([sum(w * (p - t) * l_discount), sum(w * (p - t) * l_tax), sum(w * (p - t)), sum(w)]).round(3) AS value FROM (SELECT *, (l_returnflag = 'R')::INT AS t, l_quantity AS w, {_LINEAR_SQL} AS p FROM lineitem)")
def gradient_sums(spark, sf_dir):
    import numpy as np

    from tabforge.models import net

    rows = net.prepared(items(spark, sf_dir), _X, "tag", "weight")
    grads, _, weight, _, _ = net.epoch(rows, net.Net([2, 1], ["sigmoid"], [np.array([[1.5], [-2.0], [0.25]])]), "log")
    rows.unpersist()
    return spark.createDataFrame([(i, round(float(v), 3)) for i, v in enumerate([*grads[0][:, 0], weight])], "i int, value double")


def _fixed_tree():
    from tabforge.models.trees import Node

    leaf = lambda v: Node(value=v)
    return Node(0, 0.05, left=Node(1, 0.03, left=leaf(0.1), right=leaf(0.4)), right=Node(1, 0.06, left=leaf(0.6), right=leaf(0.9)))


@query(f"SELECT {_KEY} AS id, CASE WHEN l_discount <= 0.05 THEN 'L' ELSE 'R' END || CASE WHEN l_tax <= CASE WHEN l_discount <= 0.05 THEN 0.03 ELSE 0.06 END THEN 'L' ELSE 'R' END AS tree_0, CASE WHEN l_discount <= 0.05 THEN CASE WHEN l_tax <= 0.03 THEN 0.1 ELSE 0.4 END ELSE CASE WHEN l_tax <= 0.06 THEN 0.6 ELSE 0.9 END END::DOUBLE AS score FROM lineitem")
def tree_fixed(spark, sf_dir):
    from tabforge.models import trees

    df = with_id(spark, sf_dir, items(spark, sf_dir))
    df = df.withColumn("score", trees.expression(_fixed_tree(), [F.col(c) for c in _X]))
    return trees.encoded(df, [_fixed_tree()], _X, 3, ["id", "score"]).select("id", "tree_0", "score")


# ---- training, models and steps --------------------------------------------------------------------------------------


def _features(spark, sf_dir):
    """Normalised columns of line items with the tag and a key."""
    df, stats = _norm_stats(spark, sf_dir, _KEY_COLS)
    return transform.normalize(with_id(spark, sf_dir, df), stats, "ZSCALE", keep=["id", "tag"])


def _net(spark, sf_dir, hidden, epochs, update="ADAM", rate=0.2):
    from tabforge.models import net

    df = _features(spark, sf_dir)
    rows = net.prepared(df, _NORM_COLS, "tag", validation=sample.unit(F.col("id"), 5) < 0.2)
    model, history = net.fit(rows, net.Net.create(3, hidden), net.Updater(update, rate), epochs, "log")
    rows.unpersist()
    return df, model, history


@query()
def train_lr(spark, sf_dir):
    _, model, history = _net(spark, sf_dir, [], 12)
    return spark.createDataFrame([("weight", i, float(w)) for i, w in enumerate(model.weights[0][:, 0])] + [("error", i, t) for i, (t, _) in enumerate(history)], "item string, i int, value double")


@query()
def train_nn(spark, sf_dir):
    from tabforge.models import net

    df, model, _ = _net(spark, sf_dir, [6], 8)
    return net.scored(df, _NORM_COLS, [model], scale=1000.0).select("id", "tag", F.round(F.get("scores", F.lit(0)), 4).alias("score"))


def _tree(spark, sf_dir, kind, **more):
    from tabforge.models import trees

    df = with_id(spark, sf_dir, items_orders(spark, sf_dir, [*_KEY_COLS, "tag", *[c for c in NUMERIC if c not in _KEY_COLS], "o_orderpriority"])).select("id", "tag", *NUMERIC, "o_orderpriority").withColumn("tag", F.col("tag").cast("double"))
    return df, trees.fit(df, NUMERIC, ["o_orderpriority"], "tag", kind, trees=4, depth=3, **more)


@query()
def train_rf(spark, sf_dir):
    from tabforge.models import trees

    df, model = _tree(spark, sf_dir, "RF")
    return rounded(trees.scored(model, df).select("id", "tag", "score"))


@query()
def train_gbt(spark, sf_dir):
    from tabforge.models import trees

    _, model = _tree(spark, sf_dir, "GBT")
    return spark.createDataFrame(list(trees.importance(model, [*NUMERIC, "o_orderpriority"]).items()), "column_name string, importance double")


@query()
def tree_encode(spark, sf_dir):
    from tabforge.models import trees

    df = with_id(spark, sf_dir, items(spark, sf_dir)).withColumn("tag", F.col("tag").cast("double"))
    model = trees.fit(df, NUMERIC, [], "tag", "RF", trees=3, depth=4)
    return trees.encoded(df, trees.roots(model), NUMERIC, 4, ["id"])


@query()
def train_wide_deep(spark, sf_dir):
    from tabforge.models import wide_deep

    df, stats = _norm_stats(spark, sf_dir, [])
    n = transform.normalize(df, stats, "ZSCALE_INDEX", keep=["tag"])
    _, losses = wide_deep.fit(n, ["l_quantity", "l_discount"], {"o_orderpriority": 6}, "tag", epochs=6)
    return spark.createDataFrame([(i, v) for i, v in enumerate(losses)], "epoch int, loss double")


@query()
def sensitivity_model(spark, sf_dir):
    from tabforge.models import sensitivity

    df, model, _ = _net(spark, sf_dir, [4], 5)
    return sensitivity.of_model(df, _NORM_COLS, model.predict, [0.0] * 3)


@query()
def grid_search(spark, sf_dir):
    from tabforge.models import search

    df = _features(spark, sf_dir)
    _, tried = search.best_of_grid(df, _NORM_COLS, "tag", F.col("id"), {"epochs": 3, "rate": [0.05, 0.3], "hidden": [[]]}, folds=2)
    return spark.createDataFrame([(str(p["rate"]), e) for p, e in tried], "rate string, error double")


@query()
def genetic_selection(spark, sf_dir):
    from tabforge.models import search

    df = items(spark, sf_dir)
    fitness = search.subset_fitness(df, [*NUMERIC, "l_linenumber"], "tag", epochs=5)
    chosen = select.genetic([*NUMERIC, "l_linenumber"], fitness, 2, 6, 3)
    fitness.done()
    return spark.createDataFrame([(c,) for c in chosen], "column_name string")


@query()
def stacked_models(spark, sf_dir):
    from tabforge.models import search

    _, top = search.stacked(_features(spark, sf_dir), [(["l_quantity"], {}), (["l_discount", "o_orderpriority"], {})], "tag", F.col("id"), {})
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(top.weights[0][:, 0])], "i int, weight double")


@query()
def one_vs_all(spark, sf_dir):
    from tabforge.models import net, search

    df, stats = _norm_stats(spark, sf_dir, ["l_returnflag"])
    n = transform.normalize(df, stats, "ZSCALE", keep=["l_returnflag"])
    models = search.one_vs_all(n, _NORM_COLS, "l_returnflag", ["A", "N", "R"], {"epochs": 4})
    return evaluate.multiclass(net.scored(n, _NORM_COLS, models), "l_returnflag", F.col("scores"), ["A", "N", "R"])


@query()
def project_steps(spark, sf_dir):
    from tabforge.config import DataSet, Normalize, Project, Train, VarSelect
    from tabforge.plans import steps

    df = with_id(spark, sf_dir, items_orders(spark, sf_dir, [*_KEY_COLS, "l_returnflag", *[c for c in NUMERIC if c not in _KEY_COLS], "o_orderpriority", "o_orderstatus"])).withColumn("id", F.col("id").cast("string")).select("id", "l_returnflag", *NUMERIC, "o_orderpriority", "o_orderstatus")
    p = Project("demo", DataSet(target="l_returnflag", pos_tags=["R"], neg_tags=["A", "N"], meta=["id"], weight="l_quantity", filter_expression="l_tax < 0.08"), normalize=Normalize("WOE"), varselect=VarSelect(count=3), train=Train("LR", epochs=5))
    run = steps.varsel(steps.stats(steps.init(steps.start(p), df), df))
    run = steps.train(run, steps.norm(run, df))
    _, area = steps.performance(run, steps.score(run, df, ["id"]), "id")
    return area


@query("SELECT l_orderkey, l_linenumber, (l_returnflag = 'R')::INT AS tag FROM lineitem")
def normal_shuffle(spark, sf_dir):
    return transform.shuffled(items(spark, sf_dir).select("l_orderkey", "l_linenumber", "tag"), 4)


@query(f"SELECT bag::INT AS bag, count(*)::BIGINT AS rows FROM ({_DRAW_SQL}) WHERE u < 0.3 GROUP BY 1")
def bag_rows(spark, sf_dir):
    return sample.exploded_bags(read(spark, sf_dir, "orders"), 3, 0.3, F.col("o_orderkey"), draw=_md5_draw).groupBy("bag").agg(F.count("*").alias("rows"))


# ---- files, vectors, streams -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def delimited_round_trip(spark, sf_dir):
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='tabforge-')}"
    path = f"{base.rstrip('/')}/orders-text"
    src = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderpriority", "o_orderstatus")
    tables.write_delimited(src, path, "|", compress=True)
    df = tables.read_delimited(spark, path, "|", header_path=path + ".header", target="o_orderstatus")
    return expression.keep_rows(df, "o_orderstatus == 'F'", strict=True)


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax::DOUBLE, 7) AS seven FROM lineitem")
def output_precision(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalar.precision("l_tax", "FLOAT7").alias("seven"))


@query("SELECT i::INT AS i, j::INT AS j, round(corr(embedding[i + 1]::DOUBLE, embedding[j + 1]::DOUBLE), 6) AS r FROM embeddings, range(0, (SELECT max(len(embedding)) FROM embeddings)) a(i), range(0, (SELECT max(len(embedding)) FROM embeddings)) b(j) WHERE j < i GROUP BY 1, 2")
def embedding_correlation(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    size = len(df.select("embedding").head()[0])
    m = correlate.vectors(df, "embedding", size)
    return spark.createDataFrame([(i, j, round(float(m[i, j]), 6)) for i in range(size) for j in range(i)], "i int, j int, r double")


_DAILY = "SELECT date_trunc('day', ts) AS d, least(9, len(list_filter(b, lambda x: x <= value)))::INT AS bin, count(*) AS rows FROM events, bounds GROUP BY 1, 2"


@query(f"""WITH r AS (SELECT min(value) AS lo0, max(value) AS hi0 FROM events), e AS (SELECT lo0 - 0.0005::DOUBLE * (hi0 - lo0) AS lo, hi0 + 0.0005::DOUBLE * (hi0 - lo0) AS hi FROM r), bounds AS (SELECT list_transform(range(1, 10), lambda j: lo + (hi - lo) * j / 10) AS b FROM e),
n AS ({_DAILY}), a AS (SELECT d, bin, rows::DOUBLE / sum(rows) OVER (PARTITION BY d) AS a FROM n), x AS (SELECT bin, sum(rows)::DOUBLE / sum(sum(rows)) OVER () AS e FROM n GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS window_start, 'value' AS column_name, round(sum((a - e) * ln(a / e)), 6) AS psi FROM a JOIN x USING (bin) GROUP BY 1""")
def window_psi(spark, sf_dir):
    from tabforge.streaming import windows

    events = read(spark, sf_dir, "events")
    counts = windows.binned_counts(events, binning.equal_interval(events, ["value"]))
    reference = counts.groupBy("column_name", "bin").agg(F.sum("rows").alias("rows"))
    return rounded(windows.window_psi(counts, reference))
