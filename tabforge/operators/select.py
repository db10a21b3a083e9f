"""Column selection from metadata: one row per column, so these work on the driver or on small frames."""

from __future__ import annotations

import random
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Reason:
    column: str
    reason: str
    detail: str = ""


def _count(n: int, count: int | None, filter_out: float) -> int:
    return min(n, count) if count is not None else round((1 - filter_out) * n)


def by_measure(meta: DataFrame, measure: str, count: int | None = None, filter_out: float = 0.05, force: list[str] | None = None) -> DataFrame:
    """column_name, <measure>, rank, selected: forced columns first, then the best by the measure, ties by name."""
    force = force or []
    forced = F.col("column_name").isin(force) if force else F.lit(False)
    w = W.partitionBy(F.lit(0)).orderBy(forced.desc(), F.col(measure).desc_nulls_last(), "column_name")
    n = W.partitionBy(F.lit(0))
    limit = F.least(F.lit(count), F.count("*").over(n)) if count is not None else F.round((1 - filter_out) * F.count("*").over(n)).cast("int")
    return meta.select("column_name", measure, F.row_number().over(w).alias("rank"), limit.alias("__l"), forced.alias("__f")).select("column_name", measure, "rank", (F.col("__f") | (F.col("rank") <= F.col("__l"))).alias("selected"))


def mixed(meta: DataFrame, count: int | None = None, filter_out: float = 0.05) -> DataFrame:
    """Alternately the next best by KS and by IV, without repeats: a column's turn is the earlier of its two."""
    w = lambda c: F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col(c).desc_nulls_last(), "column_name"))
    t = meta.select("column_name", "ks", "iv", w("ks").alias("k"), w("iv").alias("i")).withColumn("turn", F.least(2 * F.col("k") - 1, 2 * F.col("i")))
    n = W.partitionBy(F.lit(0))
    limit = F.least(F.lit(count), F.count("*").over(n)) if count is not None else F.round((1 - filter_out) * F.count("*").over(n)).cast("int")
    r = t.select("column_name", "ks", "iv", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("turn")).alias("rank"), limit.alias("__l"))
    return r.select("column_name", "ks", "iv", "rank", (F.col("rank") <= F.col("__l")).alias("selected"))


def pareto(meta: pd.DataFrame, count: int | None = None, filter_out: float = 0.05, eps: tuple[float, float] = (0.01, 0.05)) -> list[str]:
    """Columns of the eps-box Pareto front of KS (as a share) and IV, both larger is better; the rest by KS."""
    n = _count(len(meta), count, filter_out)
    box = {r.column_name: (int(r.ks / 100 / eps[0]), int(r.iv / eps[1])) for r in meta.itertuples()}
    value = {r.column_name: (r.ks, r.iv) for r in meta.itertuples()}
    best_in_box = {}
    for c in sorted(box, key=lambda c: (-value[c][0], -value[c][1], c)):
        best_in_box.setdefault(box[c], c)
    front = [c for b, c in best_in_box.items() if not any(o != b and o[0] >= b[0] and o[1] >= b[1] for o in best_in_box)]
    rest = sorted((c for c in box if c not in front), key=lambda c: (-value[c][0], c))
    return (sorted(front, key=lambda c: (-value[c][0], c)) + rest)[:n]


def auto_filter(meta: pd.DataFrame, correlation: dict[tuple[str, str], float] | None = None, missing_rate: float = 0.98, min_iv: float = 0.0, min_ks: float = 0.0, most_correlated: float = 1.0, measure: str = "iv", force: list[str] | None = None, target: str | None = None) -> list[Reason]:
    """Columns that go, with the reason: too much missing, low IV, low KS, then of each pair that correlates too much the
    weaker by the measure, taken in order of the pairs' correlation; forced columns stay."""
    force, gone, out = set(force or []), set(), []

    def drop(c, reason, detail=""):
        if c not in force and c not in gone:
            gone.add(c)
            out.append(Reason(c, reason, detail))

    rows = {r.column_name: r for r in meta.itertuples()}
    for c, r in rows.items():
        if r.missing_rate >= missing_rate:
            drop(c, "MISSING_RATE", f"{r.missing_rate:g}")
        elif r.iv < min_iv:
            drop(c, "LOW_IV", f"{r.iv:g}")
        elif r.ks < min_ks:
            drop(c, "LOW_KS", f"{r.ks:g}")
    for (a, b), r in sorted((correlation or {}).items(), key=lambda x: (-abs(x[1]), x[0])):
        if abs(r) <= most_correlated or a == b:
            continue
        if target in (a, b):
            drop(b if a == target else a, "TARGET_CORRELATION", f"{r:g}")
        elif a < b and a in rows and b in rows and a not in gone and b not in gone:
            weak = a if getattr(rows[a], measure) < getattr(rows[b], measure) else b
            weak = (b if weak == a else a) if weak in force else weak
            drop(weak, "CORRELATION", f"{a}~{b} {r:g}")
    return out


def restore(selected: dict[str, bool], reasons: list[Reason]) -> dict[str, bool]:
    """The selection before an automatic filter, from its history."""
    return selected | {r.column: True for r in reasons}


def genetic(columns: list[str], fitness, size: int, population: int = 20, generations: int = 10, inherit: float = 0.2, cross: float = 0.6, mutate: float = 0.05, seed: int = 1) -> list[str]:
    """Column subset of least fitness (validation error) by a genetic search: the best are kept, the middle ones crossed,
    the worst mutated.  fitness takes a list of subsets and returns their errors, so a generation can run in parallel."""
    rng = random.Random(seed)
    pool = [frozenset(rng.sample(columns, size)) for _ in range(population)]
    known: dict[frozenset, float] = {}
    for _ in range(generations):
        new = [p for p in dict.fromkeys(pool) if p not in known]
        known.update(zip(new, fitness([sorted(p, key=columns.index) for p in new]), strict=True))
        ranked = sorted(dict.fromkeys(pool), key=lambda p: (known[p], sorted(p)))
        best = ranked[: max(1, round(inherit * population))]
        pool = list(best)
        while len(pool) < round((inherit + cross) * population):
            a, b = rng.choice(ranked[: len(ranked) // 2 + 1]), rng.choice(ranked)
            pool.append(frozenset(rng.sample(sorted(a | b), size)))
        while len(pool) < population:
            p = set(rng.choice(ranked[len(ranked) // 2 :] or ranked))
            for c in list(p):
                if rng.random() < max(mutate, 1 / size):
                    p.discard(c)
            p |= set(rng.sample([c for c in columns if c not in p], size - len(p)))
            pool.append(frozenset(p))
    return sorted(min(known, key=lambda p: (known[p], sorted(p))), key=columns.index)


def votes(subsets: list[list[str]], count: int) -> list[str]:
    """The columns most often chosen over several searches, ties by name."""
    n: dict[str, int] = {}
    for s in subsets:
        for c in s:
            n[c] = n.get(c, 0) + 1
    return sorted(n, key=lambda c: (-n[c], c))[:count]
