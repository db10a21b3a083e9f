"""Mixing documents to target domain weights with soft membership.

A naive Bayes classifier over hashed words, learned from labelled rows, gives each document a posterior over domains.
Document rates r >= 0 are then fitted by projected gradient steps on the weighted least squares

    1/2 * sum_k (T_k(r) - G_k)^2 / T_k(1),   T_k(r) = sum_i r_i * tokens_i * posterior_ik

so that the expected token total of every domain meets its target G_k.  The gradient is taken per token of a document,
where the largest curvature is 1, so full steps are safe.  Rates are projected to r >= least (0, or 1 where no document may be lost).  A step needs only the totals, one value for each domain;
each document's rate is a fold over the steps made so far, so no state lies on executors between the jobs.

Everything is column expressions and aggregates.  Defined results: a null text counts as empty, has no tokens and takes
the prior as posterior; rows that repeat a doc_id are documents of their own with the same rate; domains that no labelled row
has are left out and the other targets scaled to 1; without any labelled row every rate is 1; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm import common

#: Labelled rows that the classifier is learned from, at most; hashed features; words that count as independent evidence.
SAMPLE, BUCKETS, EVIDENCE = 6_000, 8_192, 12
SMOOTHING = 0.1
STEPS, TOLERANCE = 60, 1e-6


@dataclass
class Domains:
    """Log-weights of the hashed words and log-priors of each domain."""

    names: list[str] = field(default_factory=list)
    prior: list[float] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)


def _hashed(text: Column) -> Column:
    return F.transform(common.words(text), lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(BUCKETS)).cast("int"))


def fit_domains(docs: DataFrame, labelled: DataFrame, names: list[str], key: str = "doc_id", text_col: str = "text", domain_col: str = "lang", sample: int = SAMPLE) -> Domains:
    """Classifier of the named domains from at most `sample` rows whose key is in `labelled`, drawn by a hash of the key."""
    drawn = labelled.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("\0h", F.xxhash64(key)).orderBy("\0h", key).limit(sample).select(key)
    rows = docs.select(key, F.col(domain_col).cast("string").alias("domain"), common.text_or_empty(text_col).alias("\0t")).filter(F.col("domain").isin(names)).join(F.broadcast(drawn), key)  # at most `sample` ids
    counts = rows.select("domain", F.explode(_hashed(F.col("\0t"))).alias("b")).groupBy("domain", "b").agg(F.count("*").alias("c")).collect()  # at most domains * BUCKETS rows
    total: dict[str, int] = {}
    for r in counts:
        total[r["domain"]] = total.get(r["domain"], 0) + r["c"]
    have = [n for n in names if n in total]
    seen = {(r["domain"], r["b"]): r["c"] for r in counts}
    all_ = sum(total.values())
    weights = [[math.log((seen.get((n, b), 0) + SMOOTHING) / (total[n] + SMOOTHING * BUCKETS)) for b in range(BUCKETS)] for n in have]
    for b in range(BUCKETS):  # relative to the mean: words alike in all domains weigh nothing
        mean = sum(w[b] for w in weights) / max(1, len(weights))
        for w in weights:
            w[b] -= mean
    return Domains(have, [math.log(total[n] / all_) for n in have], weights)


def with_posteriors(docs: DataFrame, domains: Domains, text_col: str = "text") -> DataFrame:
    """docs with n_tokens (words) and posterior array<double>, in the order of the domains' names.

    Evidence beyond EVIDENCE words is averaged, not added, so long texts don't become certain.
    """
    d = docs.withColumn("__tf_b", _hashed(common.text_or_empty(text_col)))
    n = F.size("__tf_b")
    scale = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(n, F.lit(1)))
    table = lambda w: F.split(F.lit(",".join(f"{x:.6g}" for x in w)), ",").cast("array<double>")
    total = lambda w: F.aggregate("__tf_b", F.lit(0.0), lambda a, b: a + F.get(table(w), b))
    logits = [F.lit(p) + scale * total(w) for p, w in zip(domains.prior, domains.weights, strict=True)]
    soft = common.let(F.array(*logits), lambda x: common.let(F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))))
    posterior = soft if logits else F.array().cast("array<double>")
    return d.withColumn("n_tokens", n.cast("long")).withColumn("posterior", posterior).drop("__tf_b")


def rate(steps: list[list[float]], posterior: Column, least: float = 0.0) -> Column:
    """The rate of a document after the steps: each lowers it by the posterior's product with the step, down to `least`."""
    if not steps:
        return F.lit(1.0)
    made = F.array(*[F.array(*[F.lit(float(v)) for v in g]) for g in steps])
    return F.aggregate(made, F.lit(1.0), lambda r, g: F.greatest(F.lit(float(least)), r - F.aggregate(F.zip_with(posterior, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


def fit_rates(members: DataFrame, names: list[str], targets: dict[str, float], budget: float | None = None, least: float = 0.0) -> list[list[float]]:
    """Gradient steps after which the expected token totals of the domains meet targets * budget.

    members: n_tokens and posterior of every document.  budget: tokens of the mixture; None: as many as it takes for the
    domain that is largest against its target to stay as it is, so that nothing need be lost.
    """
    share = {n: targets[n] for n in names}
    norm = sum(share.values())
    if not names or norm <= 0:
        return []

    def totals(steps):
        mass = F.col("n_tokens") * rate(steps, F.col("posterior"), least)
        row = members.agg(*[F.sum(mass * F.get("posterior", F.lit(k))) for k in range(len(names))]).head()
        return [float(v or 0.0) for v in row]

    start = totals([])
    if sum(start) <= 0:
        return []
    want = budget if budget is not None else max(t * norm / share[n] for t, n in zip(start, names, strict=True) if share[n] > 0)
    goal = [want * share[n] / norm for n in names]
    floor = 1e-9 * sum(start)
    steps: list[list[float]] = []
    now = start
    while len(steps) < STEPS and max(abs(t - g) for t, g in zip(now, goal, strict=True)) > TOLERANCE * want:
        steps.append([(t - g) / max(s, floor) for t, g, s in zip(now, goal, start, strict=True)])
        before, now = now, totals(steps)
        if max(abs(t - b) for t, b in zip(now, before, strict=True)) <= TOLERANCE * want:
            break  # rates at their bound keep the targets out of reach: this is as near as it gets
    return steps


def copies(rate_col: Column, key: Column) -> Column:
    """Whole copies of a document: the rate rounded up or down at random, by a hash of the key."""
    u = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit("copies")), 11).cast("double") / F.lit(float(2**53))
    return (F.floor(rate_col) + (u < rate_col - F.floor(rate_col)).cast("int")).cast("int")


def mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None, key: str = "doc_id", text_col: str = "text", domain_col: str = "lang", keep: list[str] | None = None, least: float = 0.0) -> tuple[DataFrame, Domains]:
    """keep columns (all by default), n_tokens, posterior, rate and copies of every document, and the classifier.

    The steps are fitted on a written table of posteriors and kept columns.  Texts are never written: where they are kept,
    that table holds no other column, is deleted after the fit, and the posteriors are computed once more on the way out.
    """
    kept = [c for c in dict.fromkeys([*(docs.columns if keep is None else keep), key]) if c not in ("n_tokens", "posterior", "rate", "copies")]
    domains = fit_domains(docs, labelled, sorted(targets), key, text_col, domain_col)
    scored = with_posteriors(docs, domains, text_col).select(*[F.col(f"`{c}`") for c in kept], "n_tokens", "posterior")
    with common.scratch(docs.sparkSession):
        if text_col in kept:
            table, members = scored, common.written(scored.select("n_tokens", "posterior"), "members")
        else:
            table = members = common.written(scored, "members", outer=True)
        steps = fit_rates(members, domains.names, targets, budget, least)
    out = table.withColumn("rate", rate(steps, F.col("posterior"), least))
    return out.withColumn("copies", copies(F.col("rate"), F.col(key))), domains
