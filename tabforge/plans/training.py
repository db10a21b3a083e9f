"""Training, scoring and model-based column ranking of a project, by its configured algorithm.

LR, NN and WDL make passes over all rows and hold only weights on the driver; DT, RF and GBT are Spark's distributed
trees; a kernel SVM is fitted on a bounded sample (params "sample_rows"), since its kernel matrix is on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.config import Train
from tabforge.models import net, search, sensitivity, trees, wide_deep
from tabforge.operators import sample, select
from tabforge.operators.transform import NORM_TYPES, ColumnStats

TREES = ("DT", "RF", "GBT")
#: Rows that an SVM is fitted on unless params say otherwise.
SVM_ROWS = 2_000


@dataclass
class Wide:
    """A wide and deep model over one matrix of features, of which some are category indexes."""

    model: wide_deep.WideDeep
    numbers: list[int]
    categories: list[int]
    sizes: list[int]

    def predict(self, x: np.ndarray) -> np.ndarray:
        c = np.minimum(np.nan_to_num(x[:, self.categories], nan=0.0).astype(int), np.array(self.sizes, int) - 1)
        return self.model.predict(x[:, self.numbers], c)


def draws(t: Train, key: Column) -> list[tuple[Column, Column, int]]:
    """How often a row is taken, whether it is for validation, and the seed, of each model: one for each fold, or for each bag."""
    if t.folds > 0:
        return [(F.lit(1), sample.fold(key, t.folds) == k, t.seed) for k in range(t.folds)]
    out = []
    for b in range(t.bags):
        u = sample.unit(key, t.seed + b)
        times = sample.poisson(t.bag_rate, u) if t.with_replacement else F.when(u < t.bag_rate, 1).otherwise(0)
        out.append((times, sample.unit(key, 10_000 + t.seed + b) < t.validation_rate, t.seed + b))
    return out


def models(table: DataFrame, features: list[str], stats: dict[str, ColumnStats], t: Train, kind: str = "ZSCALE") -> tuple[list, list[float]]:
    """A model for each bag or fold, and its mean squared validation error (nan without validation rows).

    table: tag, weight and features; normalised by `kind`, or cleaned for trees.  stats: of the features' columns.
    """
    key = F.xxhash64(*table.columns)
    if t.up_sample > 1:
        table = sample.up_sampled(table, "weight", "tag", t.up_sample, key, t.seed)
    made, errors = [], []
    for times, validation, seed in draws(t, key):
        own = table.select(*features, "tag", (F.col("weight").cast("double") * times).alias("weight"), validation.alias("is_validation"), key.alias("row_key")).filter("weight > 0")
        model, error = one(own, features, stats, t, kind, seed)
        made.append(model)
        errors.append(error)
    return made, errors


def one(own: DataFrame, features: list[str], stats: dict[str, ColumnStats], t: Train, kind: str, seed: int):
    """A model and its validation error from rows marked by is_validation."""
    algorithm, p = t.algorithm.upper(), t.params
    if algorithm in ("LR", "NN"):
        p = {"hidden": [] if algorithm == "LR" else [16], "epochs": t.epochs} | p
        rows = net.prepared(own, features, "tag", "weight", F.col("is_validation"))
        n, u = search.net_of(len(features), p, seed=seed)
        stop = net.EarlyStop(float(p.get("threshold", 0.0)), float(p.get("tolerance", 0.0)), int(p.get("window", 0)))
        model, history = net.fit(rows, n, u, int(p["epochs"]), str(p.get("loss", "squared")), float(p.get("flat_spot", 0.0)), float(p.get("dropout", 0.0)), stop, seed=seed)
        rows.unpersist()
        return model, min(v for _, v in history)
    fitted = own.filter("NOT is_validation")
    if algorithm in TREES:
        named = [c for c in features if stats[c].bins.kind == "C"]
        most = max([32, int(p.get("bins", 32)), *[stats[c].bins.size + 3 for c in named]])
        more = {"loss": p["loss"]} if "loss" in p and algorithm == "GBT" else {}
        if algorithm == "GBT" and p.get("early_stop"):
            fitted, more = own, more | {"validation": "is_validation", "tolerance": float(p.get("tolerance", 0.01))}
        model = trees.fit(
            fitted, [c for c in features if c not in named], named, "tag", algorithm, "weight", int(p.get("trees", 10)), int(p.get("depth", 5)), most,
            str(p.get("subset", "AUTO")).upper(), p.get("impurity"), float(p.get("rate", 0.1)), seed, **more,
        )
    elif algorithm == "WDL":
        indexed = NORM_TYPES[kind.upper()][1] == "index"
        named = [c for c in features if indexed and c in stats and stats[c].bins.kind == "C"]
        numbers, sizes = [c for c in features if c not in named], [stats[c].bins.size + 1 for c in named]
        wide, _ = wide_deep.fit(fitted, numbers, dict(zip(named, sizes, strict=True)), "tag", "weight", int(p.get("epochs", t.epochs)), float(p.get("rate", 0.05)), int(p.get("width", 4)), p.get("hidden", [8]), seed)
        model = Wide(wide, [features.index(c) for c in numbers], [features.index(c) for c in named], sizes)
    elif algorithm == "SVM":
        cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
        some = fitted.orderBy(F.xxhash64("row_key", F.lit(seed)), "row_key").limit(int(p.get("sample_rows", SVM_ROWS))).select(*cols, "tag").toPandas()
        model = search.Svm.fit(some[features].to_numpy(float), np.where(some["tag"].to_numpy(int) == 1, 1.0, -1.0), str(p.get("kernel", "rbf")), float(p.get("c", 1.0)), float(p.get("gamma", 1.0 / max(1, len(features)))), int(p.get("epochs", t.epochs)), seed)
    else:
        raise ValueError(f"unknown algorithm {t.algorithm}")
    gap = F.get("scores", F.lit(0)) - F.col("tag")
    error = scored(own.filter("is_validation"), features, [model]).agg((F.sum(gap * gap * F.col("weight")) / F.sum("weight")).alias("e")).head()["e"]
    return model, float("nan") if error is None else float(error)


def scored(table: DataFrame, features: list[str], of: list, scale: float = 1.0, out: str = "scores") -> DataFrame:
    """table with an array of the models' scores; boosted regressions are cut to 0 to 1."""
    if not of or not isinstance(of[0], PipelineModel):
        return net.scored(table, features, of, out, scale)
    wide = table
    for i, model in enumerate(of):
        wide = trees.scored(model, wide, f"__score{i}")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * scale
    return wide.select(*table.columns, F.array(*[unit(F.col(f"__score{i}")) for i in range(len(of))]).alias(out))


def ranked(table: DataFrame, features: list[str], stats: dict[str, ColumnStats], t: Train, by: str, count: int) -> list[str]:
    """Columns by what a model makes of them, best first, ties by name.

    by: FI (gain in a random forest over cleaned columns), SE or ST (root mean square of score, or tag, less the score with
    the column at its mean), VOTED (how often genetic searches choose a column; ones never chosen come last).
    table: cleaned columns for FI, else normalised ones, one feature for each column.
    """
    if by == "FI":
        model, _ = one(table.withColumn("is_validation", F.lit(False)), features, stats, Train("RF", seed=t.seed, params={k: v for k, v in t.params.items() if k in ("trees", "depth", "bins")}), "", t.seed)
        gains = trees.importance(model, [*[c for c in features if stats[c].bins.kind != "C"], *[c for c in features if stats[c].bins.kind == "C"]])
        return sorted(gains, key=lambda c: (-gains[c], c))
    if set(features) != set(stats):
        raise ValueError(f"{by} needs a normalisation with one feature for each column")
    if by in ("SE", "ST"):
        kind = t.algorithm.upper() if t.algorithm.upper() in ("LR", "NN") else "NN"
        own = {k: v for k, v in t.params.items() if k in ("hidden", "epochs", "rate", "update")} if kind == t.algorithm.upper() else {}
        rows = table.withColumns({"is_validation": sample.unit(F.xxhash64(*table.columns), 10_000 + t.seed) < t.validation_rate})
        model, _ = one(rows, features, stats, Train(kind, epochs=t.epochs, seed=t.seed, params=own), "", t.seed)
        means = table.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]).head()
        got = sensitivity.of_model(table, features, model.predict, [float(means[f"m{i}"] or 0.0) for i in range(len(features))], "tag" if by == "ST" else None).collect()
        rms = {r["column_name"]: r["rms"] for r in got}
        return sorted(features, key=lambda c: (-rms.get(c, 0.0), c))
    if by != "VOTED":
        raise ValueError(f"unknown ranking {by}")
    size = max(1, min(count, len(features)))
    fitness = search.subset_fitness(table, features, "tag", seed=t.seed)
    try:
        subsets = [select.genetic(features, fitness, size, population=8, generations=3, seed=t.seed + i) for i in range(3)]
    finally:
        fitness.done()
    return select.votes([*subsets, features], len(features))
