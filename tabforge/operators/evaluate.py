"""Evaluation of scores: cumulative confusion, curves, areas, multi-class confusion, bin scores, importance, reasons.

Running sums over a global order are taken in two steps (binning.running), so no task sorts all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.operators.binning import Bins, indexed, name_of, running


def score_summary(scores: Column, weights: list[float] | None = None) -> dict[str, Column]:
    """mean (weighted), max, min and median (the upper middle) of an array of model scores."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    if weights:
        w = F.array(*[F.lit(float(v)) for v in weights])
        mean = add(F.zip_with(scores, w, lambda a, b: a * b)) / F.lit(float(sum(weights)))
    else:
        mean = add(scores) / F.size(scores)
    return {"mean": mean, "max": F.array_max(scores), "min": F.array_min(scores), "median": F.element_at(F.sort_array(scores), (F.floor(F.size(scores) / 2) + 1).cast("int"))}


def confusion(df: DataFrame, score: str = "score", tag: str = "tag", weight: str | None = None, key: str = "id") -> DataFrame:
    """key, score, rn and tp, fp, fn, tn (and weighted) if this row and all before it in descending score are called
    positive; ties are ordered by key."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pos = F.col(tag) == 1
    base = df.select(F.col(key), F.col(score).cast("double").alias("score"), F.lit(1).cast("bigint").alias("rn"), F.when(pos, 1).otherwise(0).cast("bigint").alias("tp"), F.when(pos, 0).otherwise(1).cast("bigint").alias("fp"), F.when(pos, w).otherwise(0.0).alias("wtp"), F.when(pos, 0.0).otherwise(w).alias("wfp"))
    sums = ["rn", "tp", "fp", "wtp", "wfp"]
    cum = running(base, "score", sums, descending=True, tie=[key])
    total = base.agg(*[F.sum(s).alias(f"t_{s}") for s in sums[1:]])
    c = cum.join(F.broadcast(total))  # one row
    return c.select(
        key, "score", F.col("rn_cum").alias("rn"), F.col("tp_cum").alias("tp"), F.col("fp_cum").alias("fp"), (F.col("t_tp") - F.col("tp_cum")).alias("fn"), (F.col("t_fp") - F.col("fp_cum")).alias("tn"),
        F.col("wtp_cum").alias("weighted_tp"), F.col("wfp_cum").alias("weighted_fp"), (F.col("t_wtp") - F.col("wtp_cum")).alias("weighted_fn"), (F.col("t_wfp") - F.col("wfp_cum")).alias("weighted_tn"),
    )


def rates(c: DataFrame) -> DataFrame:
    """Confusion rows with action_rate, recall, precision, fpr and lift, each also weighted."""
    for p in ("", "weighted_"):
        tp, fp, fn, tn = (F.col(f"{p}{x}").cast("double") for x in ("tp", "fp", "fn", "tn"))
        div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
        c = c.withColumns({
            f"{p}action_rate": div(tp + fp, tp + fp + fn + tn), f"{p}recall": div(tp, tp + fn), f"{p}precision": div(tp, tp + fp), f"{p}fpr": div(fp, fp + tn),
            f"{p}lift": div(tp, div((tp + fp) * (tp + fn), tp + fp + fn + tn)),
        })
    return c


#: Curve -> the measure whose steps its points are taken at.
CURVES = {"roc": "fpr", "pr": "recall", "gain": "action_rate", "weighted_roc": "weighted_fpr", "weighted_pr": "weighted_recall", "weighted_gain": "weighted_action_rate"}


def points(c: DataFrame, curves: list[str] | None = None, buckets: int = 10) -> DataFrame:
    """curve, bucket and the row's measures: point b is at the first row whose measure reaches b / buckets, but each row
    gives one point at most, so a point is at least one row after the one before.

    first(b): least row number reaching b / buckets, by one aggregation for all curves; then row(b) = b + max over j <= b
    of (first(j) - j).
    """
    r = rates(c)
    curves = curves or list(CURVES)
    steps = [(k, b) for k in curves for b in range(1, buckets + 1)]
    # One row: the places of all points and the highest score, which is that of the point before all rows.
    first = r.agg(*[F.min(F.when(F.col(CURVES[k]) >= b / buckets - 1e-12, F.col("rn"))).alias(f"p{i}") for i, (k, b) in enumerate(steps)], F.max("rn").alias("n"), F.max("score").alias("top"))
    places = F.array(*[F.struct(F.lit(k).alias("curve"), F.lit(b).alias("bucket"), F.col(f"p{i}").alias("first")) for i, (k, b) in enumerate(steps)], *[F.struct(F.lit(k).alias("curve"), F.lit(0).alias("bucket"), F.lit(0).cast("bigint").alias("first")) for k in curves])
    long = first.filter("n IS NOT NULL").select("n", "top", F.inline(places))
    at = (F.col("bucket") + F.max(F.col("first") - F.col("bucket")).over(W.partitionBy("curve").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))).alias("rn")
    wanted = long.filter("first IS NOT NULL").select("curve", "bucket", at, "n", "top").filter("rn <= n")
    wanted = wanted.withColumnRenamed("rn", "at").withColumn("rn", F.greatest("at", F.lit(1)))
    rows = r.join(F.broadcast(wanted), "rn")  # curves * buckets rows
    zero = F.col("bucket") == 0
    made = [F.when(zero, F.lit(1.0 if "precision" in x else 0.0)).otherwise(F.col(x)).alias(x) for x in _MEASURES]
    return rows.select("curve", "bucket", F.col("at").alias("rn"), F.when(zero, F.col("top")).otherwise(F.col("score")).alias("score"), *made)


_MEASURES = [f"{p}{m}" for p in ("", "weighted_") for m in ("action_rate", "recall", "precision", "fpr", "lift")]
#: Curve -> (x, y) of its area.
AREAS = {"roc": ("fpr", "recall"), "pr": ("recall", "precision"), "weighted_roc": ("weighted_fpr", "weighted_recall"), "weighted_pr": ("weighted_recall", "weighted_precision")}


def areas(p: DataFrame) -> DataFrame:
    """curve, auc: trapezoids over the points of roc and pr."""
    x = F.coalesce(*[F.when(F.col("curve") == k, F.col(a)) for k, (a, _) in AREAS.items()])
    y = F.coalesce(*[F.when(F.col("curve") == k, F.col(b)) for k, (_, b) in AREAS.items()])
    w = W.partitionBy("curve").orderBy("bucket")
    t = p.filter(F.col("curve").isin(*AREAS)).select("curve", "bucket", x.alias("x"), y.alias("y"))
    t = t.withColumn("part", (F.col("y") + F.lag("y").over(w)) * (F.col("x") - F.lag("x").over(w)) / 2)
    return t.groupBy("curve").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("auc"))


def score_buckets(df: DataFrame, score: str, low: float, high: float, buckets: int = 10, weight: str | None = None) -> DataFrame:
    """bucket (0 is the highest), rows and weight by equal parts of the score range."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    b = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((high - F.col(score)) / ((high - low) or 1.0) * buckets))).cast("int")
    return df.groupBy(b.alias("bucket")).agg(F.count("*").alias("rows"), F.sum(w).alias("weight"))


def convert_scores(df: DataFrame, raw: str, how: str, scale: float = 1.0, out: str = "score") -> DataFrame:
    """Raw boosted scores on a scale: RAW, SIGMOID, OLD_SIGMOID, CUTOFF (to [0, 1]), HALF_CUTOFF or MAXMIN over all rows."""
    from tabforge.functions import scalar as S

    x = F.col(raw)
    plain = {"RAW": lambda: x, "SIGMOID": lambda: S.sigmoid(x) * scale, "OLD_SIGMOID": lambda: S.sigmoid20(x) * scale, "CUTOFF": lambda: S.clamp01(x) * scale}
    if how in plain:
        return df.withColumn(out, plain[how]())
    ends = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    both = df.join(F.broadcast(ends))  # one row
    return both.withColumn(out, S.half_cutoff(x, F.col("__hi"), scale) if how == "HALF_CUTOFF" else S.min_max_scale(x, F.col("__lo"), F.col("__hi"), scale)).drop("__lo", "__hi")


def champion_challenger(df: DataFrame, scores: list[str], tag: str = "tag", weight: str | None = None, key: str = "id", buckets: int = 10) -> DataFrame:
    """Points of the curves of several score columns, by score_name."""
    return reduce(DataFrame.unionByName, [points(confusion(df, s, tag, weight, key), buckets=buckets).withColumn("score_name", F.lit(s)) for s in scores])


def multiclass(df: DataFrame, actual: str, scores: Column, labels: list[str]) -> DataFrame:
    """actual, predicted (label of the highest score, the first of equals), rows."""
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    return df.groupBy(F.col(actual).alias("actual"), F.element_at(F.array(*[F.lit(x) for x in labels]), best).alias("predicted")).agg(F.count("*").alias("rows"))


def vote(scores: Column, labels: list[str]) -> Column:
    """Label by majority over models (array of arrays of class scores); if votes tie, that of the highest single score."""
    k = len(labels)
    picks = F.transform(scores, lambda s: F.array_position(s, F.array_max(s)).cast("int"))
    tally = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda c: F.struct(F.size(F.filter(picks, lambda p: p == c)).alias("n"), F.array_max(F.transform(scores, lambda s: F.get(s, c - 1))).alias("top"), (-c).alias("c")))
    return F.element_at(F.array(*[F.lit(x) for x in labels]), -F.array_max(tally)["c"])


def bin_scores(df: DataFrame, bins: list[Bins], score: str) -> DataFrame:
    """column_name, bin, rows, average score."""
    sums = indexed(df, bins, [F.col(score).cast("double").alias("s")]).groupBy("k", "bin").agg(F.count("*").alias("rows"), F.avg("s").alias("avg_score"))
    return sums.select(name_of(bins).alias("column_name"), "bin", "rows", "avg_score")


def _ranked(df: DataFrame, bins: list[Bins], averages: DataFrame) -> tuple[DataFrame, Column]:
    """df with the bins' average scores in columns, and the array of (score negated, place of the column) of a row, best
    first, ties by column order."""
    avg: dict[str, dict[int, float]] = {}
    for r in averages.collect():  # columns * bins rows
        avg.setdefault(r["column_name"], {})[r["bin"]] = r["avg_score"]
    of = lambda b: F.get(F.array(*[F.lit(float(avg.get(b.name, {}).get(i, 0.0))) for i in range(b.size + 1)]), b.index())
    wide = df.select("*", *[of(b).alias(f"__avg{k}") for k, b in enumerate(bins)])
    return wide, F.sort_array(F.array(*[F.struct((-F.col(f"__avg{k}")).alias("s"), F.lit(k).alias("k")) for k in range(len(bins))]))


def importance(df: DataFrame, bins: list[Bins], averages: DataFrame, top: int = 3) -> DataFrame:
    """column_name, points: in each row the columns of the best bin scores earn top, top - 1, ... points."""
    wide, ranked = _ranked(df, bins, averages)
    sums = wide.select(F.posexplode(F.slice(ranked, 1, top)).alias("p", "x")).groupBy(F.col("x.k").alias("k")).agg(F.sum(F.lit(top) - F.col("p")).cast("bigint").alias("points"))
    return sums.select(name_of(bins).alias("column_name"), "points")


def reasons(df: DataFrame, bins: list[Bins], averages: DataFrame, texts: dict[str, str] | None = None, top: int = 3, keep: list[str] | None = None) -> DataFrame:
    """keep columns and reasons: texts of the columns with the best bin scores in a row, without repeats, best first."""
    text = F.array(*[F.lit((texts or {}).get(b.name, b.name)) for b in bins])
    wide, ranked = _ranked(df, bins, averages)
    return wide.select(*(keep or []), F.slice(F.array_distinct(F.transform(ranked, lambda x: F.get(text, x["k"]))), 1, top).alias("reasons"))


def sensitivity(diffs: DataFrame) -> DataFrame:
    """column_name, mean_abs, rms, variance of score differences (columns column_name and d)."""
    m, q = F.avg(F.abs("d")), F.avg(F.col("d") * F.col("d"))
    return diffs.groupBy("column_name").agg(m.alias("mean_abs"), F.sqrt(q).alias("rms"), (q - m * m).alias("variance"))
