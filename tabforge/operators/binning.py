"""Bins of columns: found by equal width, equal population, sketches, categories or entropy, then counted by tag.

Boundaries start at minus infinity and a value on a boundary belongs to the bin on its right; the missing bin is last.
Finding bins returns small specifications (columns * bins) to the driver; looking values up is a column expression, and
counting is one aggregation that is merged map-side.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.functions.scalar import category, parsed
from tabforge.operators.prep import bin_eligible, hybrid_parts
from tabforge.operators.profile import valid_number

INF = float("inf")


@dataclass
class Bins:
    """bounds: lower bounds of numeric bins, the first -inf; groups: categories of each categorical bin, after them."""

    name: str
    bounds: list[float] = field(default_factory=list)
    groups: list[list[str]] = field(default_factory=list)
    threshold: float | None = None  # of a hybrid column

    @property
    def kind(self) -> str:
        return "H" if self.threshold is not None else "C" if self.groups and not self.bounds else "N"

    @property
    def size(self) -> int:
        """Number of bins without the missing one, whose index it is."""
        return len(self.bounds) + len(self.groups)

    def index(self, c: Column | str | None = None) -> Column:
        """The bin of a value, as a column."""
        c = self.name if c is None else c
        if self.kind == "H":
            x, v = hybrid_parts(c, self.threshold)
        else:
            x, v = (valid_number(c), None) if self.kind == "N" else (None, category(c))
        numeric = place(self.bounds, parsed(c)) if self.bounds else None  # where x is there it is just this
        flat = [y for i, g in enumerate(self.groups) for k in g for y in (F.lit(k), F.lit(len(self.bounds) + i))]
        named = F.try_element_at(F.create_map(*flat), v) if flat else F.lit(None).cast("int")
        found = named if numeric is None else F.when(x.isNotNull(), numeric) if v is None else F.coalesce(F.when(x.isNotNull(), numeric), named)
        return F.coalesce(found, F.lit(self.size)).cast("int")

    def index_of(self, value) -> int:
        """The bin of a Python value."""
        if self.bounds:
            try:
                x = float(value)
                if not math.isnan(x) and (self.threshold is None or x >= self.threshold):
                    return max(0, bisect.bisect_right(self.bounds, x) - 1)
            except (TypeError, ValueError):
                pass
        return next((len(self.bounds) + i for i, g in enumerate(self.groups) if value is not None and str(value).strip() in g), self.size)

    def label(self, i: int) -> str:
        if i == self.size:
            return "missing"
        if i < len(self.bounds):
            return f"[{self.bounds[i]}, {self.bounds[i + 1] if i + 1 < len(self.bounds) else INF})"
        return "@^".join(self.groups[i - len(self.bounds)])


#: Bounds up to so many are searched by nested cases, which compile to comparisons; more by a filter of an array.
MOST_CASES = 128


def place(bounds: list[float], x: Column) -> Column:
    """Index of the last bound that isn't above x, 0 below all: a halving search."""
    if len(bounds) > MOST_CASES:
        return F.get(F.transform(F.array(x), lambda v: F.greatest(F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= v)) - 1, F.lit(0))), F.lit(0))

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(x < F.lit(float(bounds[mid])), search(low, mid - 1)).otherwise(search(mid, high))

    return search(0, len(bounds) - 1)


def indexed(df: DataFrame, bins: list[Bins], keep: list[Column]) -> DataFrame:
    """keep columns, k (place of the column in bins) and bin: a row for each row and column.

    Indexes are columns of a projection of their own, where what they share is computed once, before rows are multiplied.
    """
    names = [f"__bin{k}" for k in range(len(bins))]
    wide = df.select(*keep, *[b.index().alias(n) for b, n in zip(bins, names, strict=True)])
    return wide.select(*[c for c in wide.columns if c not in names], F.posexplode(F.array(*names)).alias("k", "bin"))


def name_of(bins: list[Bins]) -> Column:
    """Name of the column at place k."""
    return F.get(F.array(*[F.lit(b.name) for b in bins]), F.col("k"))


def _ascending(values) -> list[float]:
    return [-INF, *sorted({float(v) for v in values if v is not None and not math.isnan(v)})]


def equal_interval(df: DataFrame, columns: list[str], k: int = 10, margin: float = 0.0005) -> list[Bins]:
    """k bins of equal width over the range, widened by a margin of it on each side."""
    row = df.agg(*[f(valid_number(c)).alias(f"{i}_{n}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).head()
    out = []
    for i, c in enumerate(columns):
        lo, hi = row[f"{i}_lo"], row[f"{i}_hi"]
        if lo is None or lo == hi:
            out.append(Bins(c, [-INF]))
            continue
        lo, hi = lo - margin * (hi - lo), hi + margin * (hi - lo)
        out.append(Bins(c, _ascending(lo + (hi - lo) * j / k for j in range(1, k))))
    return out


def equal_population(df: DataFrame, columns: list[str], k: int = 10, method: str = "EqualTotal", tag: str = "tag", exact: bool = False, accuracy: int = 10_000) -> list[Bins]:
    """k bins of equal numbers of rows (EqualTotal), positives or negatives, at quantiles; ties merge bins."""
    use = bin_eligible(method, tag) if method != "EqualTotal" else F.lit(True)
    probs = [j / k for j in range(1, k)]
    arr = F.array(*[F.lit(p) for p in probs])
    value = lambda c: F.when(use, valid_number(c))
    if exact:
        found = exact_quantiles(df, {c: value(c) for c in columns}, probs)
        return [Bins(c, _ascending(found[c] or [])) for c in columns]
    row = df.agg(*[F.percentile_approx(value(c), arr, accuracy).alias(f"q{i}") for i, c in enumerate(columns)]).head()
    return [Bins(c, _ascending(row[f"q{i}"] or [])) for i, c in enumerate(columns)]


def weighted_population(df: DataFrame, column: str, k: int = 10, method: str = "WeightEqualTotal", tag: str = "tag", weight: str = "weight") -> Bins:
    """k bins of equal total weight: the least values at which the cumulative weight reaches each share.

    Values are summed first; the running sum is taken within value ranges of similar row counts and then across them.
    """
    v = df.filter(bin_eligible(method, tag)).select(valid_number(column).alias("v"), F.col(weight).cast("double").alias("w")).filter("v IS NOT NULL").groupBy("v").agg(F.sum("w").alias("w"))
    cut = running(v, "v", ["w"])
    total = cut.agg(F.max("w_cum")).head()[0] or 0.0
    share = F.array(*[F.lit(total * j / k) for j in range(1, k)])
    first = cut.select("v", F.explode(F.filter(share, lambda s: (s > F.col("w_cum") - F.col("w")) & (s <= F.col("w_cum")))).alias("s")).select("v").distinct()
    return Bins(column, _ascending(r["v"] for r in first.collect()))  # at most k rows


def running(df: DataFrame, order: str, sums: list[str], descending: bool = False, tie: list[str] | None = None, group: list[str] | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """df with <name>_cum, running sums in the given order, without sorting all rows in one task.  The dealt rows stay cached;
    held is a list that takes their frame, for the caller to let it go.

    Rows are dealt out by ranges; sums run within a range and start from the totals of the ranges before, of which there
    are as many rows as partitions (times groups).
    """
    group, tie = group or [], tie or []
    key = [*[F.col(g) for g in group], F.col(order).desc() if descending else F.col(order).asc(), *[F.col(t).asc() for t in tie]]
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *key).withColumn("__part", F.spark_partition_id())
    dealt = dealt.persist()  # the ranges must be the same in both uses
    if held is not None:
        held.append(dealt)
    local = W.partitionBy("__part", *group).orderBy(*key[len(group) :]).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*(group or [F.lit(0)])).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("__part", *group).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    totals = totals.select("__part", *group, *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__b_{s}") for s in sums])
    joined = dealt.join(totals, ["__part", *group])
    return joined.select(*df.columns, *[(F.sum(s).over(local) + F.col(f"__b_{s}")).alias(f"{s}_cum") for s in sums])


def exact_quantiles(df: DataFrame, values: dict[str, Column], probabilities: list[float]) -> dict[str, list[float] | None]:
    """Quantiles of each value expression, interpolated between neighbouring ranks; None without values.

    Distinct values are counted by column and ranked by running sums over ranges, so no task holds all values of a column;
    two values for each column and probability reach the driver.
    """
    names = list(values)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in enumerate(values.values())])).alias("x")).select("x.*")
    counts = long.filter("v IS NOT NULL").groupBy("k", "v").agg(F.count("*").alias("c"))
    held: list[DataFrame] = []
    ranked = running(counts, "v", ["c"], group=["k"], held=held)
    totals = held[0].groupBy("k").agg(F.sum("c").alias("n")).collect()  # as many rows as columns
    places = {r["k"]: [(r["n"] - 1) * p for p in probabilities] for r in totals}
    out: dict[str, list[float] | None] = dict.fromkeys(names)
    if places:
        wanted = {k: sorted({f(p) for p in at for f in (math.floor, math.ceil)}) for k, at in places.items()}
        ranks = F.element_at(F.create_map(*[x for k, rs in wanted.items() for x in (F.lit(k), F.array(*[F.lit(r).cast("bigint") for r in rs]))]), F.col("k"))
        hit = ranked.select("k", "v", F.explode(F.filter(ranks, lambda r: (r >= F.col("c_cum") - F.col("c")) & (r < F.col("c_cum")))).alias("rank"))
        at_rank = {(r["k"], r["rank"]): r["v"] for r in hit.collect()}
        for k, at in places.items():
            ends = [(p, math.floor(p), math.ceil(p)) for p in at]
            out[names[k]] = [a if (a := at_rank[k, lo]) == (b := at_rank[k, hi]) else (hi - p) * a + (p - lo) * b for p, lo, hi in ends]
    for f in held:
        f.unpersist()
    return out


def native(df: DataFrame, column: str, k: int = 10, tolerance: float = 1e-5) -> Bins:
    """Bins cut at every ceil(n / k)-th value of the sorted column; cuts within the tolerance of the last one are skipped."""
    v = df.select(valid_number(column).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").cast("double").alias("c"))
    cum = running(v, "v", ["c"])
    n = cum.agg(F.max("c_cum")).head()[0] or 0.0
    step = math.ceil(n / k) if n else 1
    ranks = F.array(*[F.lit(float(j * step)) for j in range(1, k)])
    cuts = [r["v"] for r in cum.select("v", F.explode(F.filter(ranks, lambda s: (s >= F.col("c_cum") - F.col("c")) & (s < F.col("c_cum")))).alias("s")).select("v").distinct().orderBy("v").collect()]
    out: list[float] = []
    for c in cuts:
        if not out or c - out[-1] > tolerance:
            out.append(c)
    return Bins(column, [-INF, *out])


def histogram(df: DataFrame, columns: list[str], k: int = 10, scale: int = 20) -> list[Bins]:
    """Equal-population bins from a streaming histogram of k * scale points: trapezoids between points give the shares."""
    row = df.agg(*[F.histogram_numeric(valid_number(c), F.lit(k * scale)).alias(f"h{i}") for i, c in enumerate(columns)]).head()
    return [Bins(c, _ascending(_uniform([(p["x"], p["y"]) for p in row[f"h{i}"] or []], k))) for i, c in enumerate(columns)]


def _uniform(points: list[tuple[float, float]], k: int) -> list[float]:
    """Places that part the mass of a histogram of (centre, count) points into k equal shares."""
    if len(points) < 2:
        return []
    total, out, at, done = sum(m for _, m in points), [], 0, points[0][1] / 2
    for j in range(1, k):
        want = total * j / k
        while at + 2 < len(points) and done + (points[at][1] + points[at + 1][1]) / 2 < want:
            done += (points[at][1] + points[at + 1][1]) / 2
            at += 1
        (p, m), (q, n) = points[at], points[at + 1]
        d = max(0.0, want - done)
        z = min(1.0, d / m if n == m and m else (-m + math.sqrt(max(0.0, m * m + 2 * (n - m) * d))) / (n - m) if n != m else 0.0)
        out.append(p + (q - p) * z)
    return out


def categories(df: DataFrame, columns: list[str], most: int = 10_000) -> list[Bins]:
    """A bin for each category, in order; a column of more than `most` categories has none.

    Distinct values are counted first; only those of columns with few enough reach the driver, most * columns at most.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), category(c).alias("v")) for k, c in enumerate(columns)])).alias("x")).select("x.*").filter("v IS NOT NULL").distinct()
    few = long.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("k")
    found: list[list[str]] = [[] for _ in columns]
    for r in long.join(F.broadcast(few), "k").toLocalIterator():  # as many rows as columns
        found[r["k"]].append(r["v"])
    return [Bins(c, groups=[[v] for v in sorted(found[k])]) for k, c in enumerate(columns)]


def hybrid(df: DataFrame, column: str, threshold: float, k: int = 10, method: str = "EqualTotal", tag: str = "tag", exact: bool = False) -> Bins:
    """Numeric bins of the values at or above the threshold, then a bin for each other category."""
    x, v = hybrid_parts(column, threshold)
    parts = df.select(*([tag] if tag in df.columns else []), x.alias("x"), v.alias("v"))
    (numeric,) = equal_population(parts, ["x"], k, method, tag, exact)
    (named,) = categories(parts, ["v"])
    return Bins(column, numeric.bounds, named.groups, threshold)


def bin_counts(df: DataFrame, bins: list[Bins], tag: str = "tag", weight: str | None = None, group: list[str] | None = None) -> DataFrame:
    """group columns, column_name, bin, pos, neg, weighted_pos, weighted_neg of every bin that has rows.

    Sums by place and bin are merged before the shuffle, which carries columns * bins rows; names come last.
    """
    group = group or []
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = indexed(df, bins, [*[F.col(g) for g in group], F.col(tag).alias("__tag"), w.alias("__w")])
    is_pos, is_neg = F.col("__tag") == 1, F.col("__tag") == 0
    sums = long.groupBy(*group, "k", "bin").agg(
        F.sum(F.when(is_pos, 1).otherwise(0)).cast("bigint").alias("pos"), F.sum(F.when(is_neg, 1).otherwise(0)).cast("bigint").alias("neg"),
        F.sum(F.when(is_pos, F.col("__w")).otherwise(0.0)).alias("weighted_pos"), F.sum(F.when(is_neg, F.col("__w")).otherwise(0.0)).alias("weighted_neg"),
    )
    return sums.select(*group, name_of(bins).alias("column_name"), "bin", "pos", "neg", "weighted_pos", "weighted_neg")


def _entropy(p: float, n: float) -> float:
    t = p + n
    return -sum(x / t * math.log(x / t) for x in (p, n) if x > 0) * t if t else 0.0


def merge_by_entropy(counts: list[tuple[float, float]], k: int) -> list[list[int]]:
    """Adjacent bins (pos, neg) merged until at most k are left: empty ones first, then the pair that adds least entropy."""
    parts = [([i], p, n) for i, (p, n) in enumerate(counts)]
    i = 0
    while len(parts) > 1 and i < len(parts):
        if parts[i][1] + parts[i][2] == 0:
            j = i - 1 if i else i + 1
            a, b = min(i, j), max(i, j)
            parts[a : b + 1] = [(parts[a][0] + parts[b][0], parts[a][1] + parts[b][1], parts[a][2] + parts[b][2])]
            i = 0
        else:
            i += 1
    while len(parts) > max(1, k):
        cost = [_entropy(a[1] + b[1], a[2] + b[2]) - _entropy(a[1], a[2]) - _entropy(b[1], b[2]) for a, b in zip(parts, parts[1:], strict=False)]
        i = min(range(len(cost)), key=cost.__getitem__)
        parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], parts[i][1] + parts[i + 1][1], parts[i][2] + parts[i + 1][2])]
    return [p[0] for p in parts]


def _collected(table: DataFrame, bins: list[Bins]) -> dict[str, list[tuple[int, int]]]:
    got = {b.name: [(0, 0)] * (b.size + 1) for b in bins}
    for r in table.collect():  # columns * bins rows
        got[r["column_name"]][r["bin"]] = (r["pos"], r["neg"])
    return got


def dynamic(df: DataFrame, columns: list[str], k: int = 10, fine: int = 100, tag: str = "tag", start: list[Bins] | None = None) -> list[Bins]:
    """Fine bins (by quantiles unless given) merged to k by entropy: two passes over the data, the merging on columns * fine
    rows."""
    start = start or equal_population(df, columns, fine)
    counts = _collected(bin_counts(df, start, tag), start)
    return [Bins(b.name, [b.bounds[g[0]] for g in merge_by_entropy(counts[b.name][: b.size], k)]) for b in start]


def merge_categories(df: DataFrame, bins: list[Bins], k: int, tag: str = "tag") -> list[Bins]:
    """Categorical bins sorted by positive rate and merged to k by entropy."""
    counts, out = _collected(bin_counts(df, bins, tag), bins), []
    for b in bins:
        c = counts[b.name][: b.size]
        order = sorted(range(b.size), key=lambda i: (c[i][0] / max(1, sum(c[i])), b.groups[i]))
        out.append(Bins(b.name, groups=[[v for i in g for v in b.groups[order[i]]] for g in merge_by_entropy([c[i] for i in order], k)]) if b.size else b)
    return out


def information_value(counts: list[tuple[float, float]], eps: float = 1e-10) -> float:
    pos, neg = sum(p for p, _ in counts), sum(n for _, n in counts)
    return 0.0 if not pos or not neg else sum((n / neg - p / pos) * math.log((n / neg + eps) / (p / pos + eps)) for p, n in counts)


def rebin(bins: Bins, counts: list[tuple[float, float]], most: int | None = None, least_rows: int = 0, keep_iv: float = 1.0) -> Bins:
    """Fewer bins: at most `most`, none of fewer than `least_rows` rows, then ever fewer while enough of the IV is kept.

    A bin that is too small joins the neighbour of the closer positive rate.  counts: (pos, neg) of the bins in order.
    """
    counts = list(counts[: bins.size])
    before = information_value(counts)
    groups = merge_by_entropy(counts, most) if most else [[i] for i in range(bins.size)]
    total = lambda g: (sum(counts[i][0] for i in g), sum(counts[i][1] for i in g))
    rate = lambda g: total(g)[0] / max(1, sum(total(g)))
    while len(groups) > 1 and (small := [i for i, g in enumerate(groups) if sum(total(g)) < least_rows]):
        i = small[0]
        j = min((x for x in (i - 1, i + 1) if 0 <= x < len(groups)), key=lambda x: abs(rate(groups[x]) - rate(groups[i])))
        a, b = min(i, j), max(i, j)
        groups[a : b + 1] = [groups[a] + groups[b]]
    while len(groups) > 2 and keep_iv < 1:
        fewer = [[i for part in g for i in groups[part]] for g in merge_by_entropy([total(g) for g in groups], len(groups) - 1)]
        if information_value([total(g) for g in fewer]) < keep_iv * before:
            break
        groups = fewer
    if bins.kind == "C":
        return Bins(bins.name, groups=[[v for i in g for v in bins.groups[i]] for g in groups])
    return Bins(bins.name, [bins.bounds[g[0]] for g in groups])


def local_equal_positive(pairs: list[tuple[float, int]], k: int) -> list[float]:
    """Bounds for small in-memory data: cut once a bin holds ceil(P / k) positives, never within ties."""
    pairs = sorted(pairs)
    want, have, out = math.ceil(sum(t for _, t in pairs) / k), 0, [-INF]
    for (v, t), (nxt, _) in zip(pairs, pairs[1:], strict=False):
        have += t
        if have >= want and nxt != v and len(out) < k:
            out.append(nxt)
            have = 0
    return out


def local_equal_total(values: list[float], k: int) -> list[float]:
    """Bounds for small in-memory data: cut once the share of values passes (b + 1) / k, never within ties."""
    values = sorted(values)
    out, b = [-INF], 0
    for i, (v, nxt) in enumerate(zip(values, values[1:], strict=False), 1):
        if i / len(values) >= (b + 1) / k and nxt != v and len(out) < k:
            out.append(nxt)
            while i / len(values) >= (b + 1) / k:
                b += 1
    return out
