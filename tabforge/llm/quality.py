"""Quality rules with risk-controlled thresholds.

Rules compare simple ratios of a text with a cutoff.  Cutoffs aren't set by hand: for each stratum (language by default)
and rule, cutoffs of a fixed grid are tried from lenient to strict on labelled documents.  A cutoff is certified if the
exact binomial test shows, at level delta / (strata * rules), that at most alpha / rules of the good documents fall
beyond it; the sequence stops at the first that isn't (fixed-sequence testing, so the grid itself costs no correction).
By the union bound, with probability 1 - delta no stratum loses more than alpha of its good documents to all rules
together.  Strata with too few labelled documents to certify anything keep everything but what the base rules reject.

All texts are measured whole, in column expressions.  Defined results: a null text counts as empty; a null stratum is a
stratum of its own; repeated rows each give a row; label rows that are null or have no document are ignored, and of
several labels of one doc_id the lower quality holds; an empty table gives an empty table; an input column called
measures, base_failed or kept is replaced, other columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm import common

#: At most this share of a stratum's good documents may be rejected by the certified cutoffs, with probability 1 - DELTA.
ALPHA, DELTA = 0.02, 0.05
#: Steps of the square root of a ratio at which cutoffs may lie.
STEPS = 40
BASE_WORDS, BASE_REPEAT = 50, 50

#: Words in 3-word windows found twice or more.  Windows are hashed with their place in the low bits and sorted, so that
#: equal ones are neighbours; the places of those with an equal neighbour give the covered words.
_REPEATED = """
element_at(transform(array(transform(__tf_words, w -> xxhash64(w))), h ->
  CASE WHEN size(h) < 4 THEN 0L ELSE
  element_at(transform(array(-shiftleft(1L, length(bin(size(h))))), m ->
    element_at(transform(array(sort_array(transform(sequence(0, size(h) - 3), i -> (xxhash64(h[i], h[i + 1], h[i + 2]) & m) | CAST(i AS BIGINT)))), p ->
      element_at(transform(array(sort_array(transform(filter(p, (x, i) -> (x & m) = (get(p, i - 1) & m) OR (x & m) = (get(p, i + 1) & m)), x -> x & ~m))), q ->
        aggregate(transform(q, (x, i) -> least(3L, coalesce(get(q, i + 1) - x, 3L))), 0L, (a, x) -> a + x)), 1)), 1)), 1) END), 1)
"""


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column `measures`: counts over the whole text."""
    text = common.text_or_empty(text_col)
    had = docs.columns
    lines = F.filter(F.split("__tf_text", "\n", -1), lambda x: F.btrim(x, F.lit(common.WORD_SPACE)) != "")
    return (
        docs.withColumn("__tf_text", text)
        .withColumn("__tf_words", common.words(F.col("__tf_text")))
        .withColumn("__tf_lines", lines)
        .select(
            *[F.col(f"`{c}`") for c in had if c != "measures"],
            F.struct(
                F.size("__tf_words").cast("long").alias("n_words"),
                F.length(F.array_join("__tf_words", "")).cast("long").alias("word_chars"),
                (F.length("__tf_text") - F.length(F.regexp_replace("__tf_text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
                F.size("__tf_lines").cast("long").alias("n_lines"),
                (F.size("__tf_lines") - F.size(F.array_distinct("__tf_lines"))).cast("long").alias("n_dup_lines"),
                F.expr(_REPEATED).alias("n_repeat_words"),
                (F.length("__tf_text") - F.length(F.regexp_replace("__tf_text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
            ).alias("measures"),
        )
    )


def base_failed(m: str = "measures") -> Column:
    return (F.col(f"{m}.n_words") < BASE_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > BASE_REPEAT * F.col(f"{m}.n_words"))


def rules(m: str = "measures") -> dict[str, Column]:
    """Ratio of each rule, higher is worse; 0 where there is nothing to count."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(f"{m}.{a}").cast("double"), F.col(f"{m}.{b}").cast("double")), F.lit(0.0))
    return {"symbols": share("n_symbols", "word_chars"), "upper": share("n_upper", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")}


def step(ratio: Column) -> Column:
    return F.least(F.lit(STEPS), F.ceil(F.sqrt(ratio) * STEPS)).cast("int")


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Bin(n, p), exactly, as the regularised incomplete beta function I_{1-p}(n-k, k+1)."""
    if k >= n:
        return 1.0
    return _beta(n - k, k + 1, 1 - p)


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(1, 20_000):
        m = i // 2
        num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / ((1 + num * d) or tiny), (1 + num / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front / f


def certified(counts: dict[tuple[str, str], dict[int, tuple[int, int]]], alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, int]]:
    """Cutoff step of each stratum and rule: beyond it a document is rejected.

    counts: (stratum, rule) -> step -> (good, bad) labelled documents.  A cutoff that rejects no more bad documents than a
    more lenient one isn't taken.
    """
    strata, names = {s for s, _ in counts}, {r for _, r in counts}
    level = delta / max(1, len(strata) * len(names))
    out: dict[str, dict[str, int]] = {s: {} for s in strata}
    for (stratum, rule), steps in counts.items():
        good, bad = sum(g for g, _ in steps.values()), sum(b for _, b in steps.values())
        best = 0
        for cut in range(STEPS - 1, -1, -1):
            lost = sum(g for s, (g, _) in steps.items() if s > cut)
            if not good or binomial_at_most(lost, good, alpha / len(names)) > level:
                break
            if (caught := sum(b for s, (_, b) in steps.items() if s > cut)) > best and caught * good > lost * bad:
                best, out[stratum][rule] = caught, cut
    return out


def calibrate(measures: DataFrame, labels: DataFrame, key: str = "doc_id", stratum_col: str = "lang", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, int]]:
    """Certified cutoffs from the measures of all labelled documents.

    What reaches the driver is bounded by strata * rules * steps; strata with fewer good documents than the least that
    could certify a cutoff are left out before.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label_col).isNotNull()).groupBy(key).agg(F.min(label_col).alias("\0good"))
    held = measures.filter(~base_failed()).select(key, F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("\0stratum"), *[step(c).alias(r) for r, c in rules().items()]).join(known, key)
    names = list(rules())
    long = held.select("\0stratum", "\0good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in names])).alias("x"))
    table = long.groupBy(F.col("\0stratum").alias("stratum"), "x.rule", "x.step").agg(F.sum(F.when(F.col("\0good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("\0good") == 1, 0).otherwise(1)).alias("bad"))
    table = common.written(table, "quality-steps")
    least = math.log(1 / delta) * len(names) / alpha / 2
    enough = table.groupBy("stratum").agg((F.sum("good") / len(names)).alias("n")).filter(F.col("n") >= least).select("stratum")
    counts: dict[tuple[str, str], dict[int, tuple[int, int]]] = {}
    for r in table.join(enough, "stratum", "left_semi").toLocalIterator():
        counts.setdefault((r["stratum"], r["rule"]), {})[r["step"]] = (r["good"], r["bad"])
    return certified(counts, alpha, delta)


def rejected(cutoffs: dict[str, dict[str, int]], stratum_col: str = "lang") -> Column:
    """Whether a certified cutoff of the row's stratum rejects it."""
    stratum, out = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")), F.lit(False)
    for r, c in rules().items():
        own = [x for s, cut in cutoffs.items() if r in cut for x in (F.lit(s), F.lit(cut[r]))]
        if own:
            out = out | (step(c) > F.coalesce(F.try_element_at(F.create_map(*own), stratum), F.lit(STEPS)))
    return out


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """keep columns of docs (all by default), measures, base_failed and kept, with cutoffs certified on the labels.

    Calibration reads a written table of measures.  Where the text isn't kept, verdicts are given on that table too; where
    it is, the table holds keys, strata and measures only, is deleted after calibration, and texts are measured once more
    on the way out: no text is written.
    """
    kept = [c for c in dict.fromkeys([*(docs.columns if keep is None else keep), key, stratum_col]) if c not in ("measures", "base_failed", "kept")]
    table = measured(docs, text_col).select(*[F.col(f"`{c}`") for c in kept], "measures")
    with common.scratch(docs.sparkSession):
        if text_col in kept:
            cutoffs = calibrate(common.written(table.select(key, stratum_col, "measures"), "quality-measures"), labels, key, stratum_col)
        else:
            table = common.written(table, "quality-measures", outer=True)
            cutoffs = calibrate(table, labels, key, stratum_col)
    return table.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected(cutoffs, stratum_col))
