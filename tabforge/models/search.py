"""Training around single models: bags, folds, grid search, one-vs-all, stacking, wrappers for column search, support
vectors, and model files."""

from __future__ import annotations

import itertools
import json
import os
import pickle
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.models import net
from tabforge.models.net import EarlyStop, Net, Updater
from tabforge.operators import sample


def grid(params: dict[str, object], most: int | None = None, seed: int = 1) -> list[dict[str, object]]:
    """All combinations of list-valued parameters, by key; with more than `most` a random subset of them."""
    keys = sorted(params)
    every = [dict(zip(keys, v, strict=True)) for v in itertools.product(*[params[k] if isinstance(params[k], list) else [params[k]] for k in keys])]
    return every if most is None or len(every) <= most else random.Random(seed).sample(every, most)


def grid_file(text: str) -> list[dict[str, object]]:
    """Combinations from lines of key:value;key:value; values are JSON where they parse."""

    def value(v: str):
        try:
            return json.loads(v)
        except ValueError:
            return v

    return [{k.strip(): value(v.strip()) for k, v in (p.split(":", 1) for p in line.split(";") if p.strip())} for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]


def net_of(columns: int, params: dict[str, object], outputs: int = 1, seed: int = 1) -> tuple[Net, Updater]:
    n = Net.create(columns, list(params.get("hidden", [])), list(params.get("activations", [])), outputs, params.get("output", "sigmoid"), params.get("init", "xavier"), seed)
    return n, Updater(params.get("update", "ADAM"), params.get("rate", 0.05), params.get("momentum", 0.5), params.get("decay", 0.0), params.get("norm", "none"))


def train_bags(df: DataFrame, columns: list[str], target: str, key, params: dict[str, object], bags: int = 1, rate: float = 1.0, replacement: bool = False, validation: float = 0.2, weight: str | None = None, seed: int = 1) -> list[tuple[Net, list[tuple[float, float]]]]:
    """A net per bag: rows are drawn by hashes of the key, so bags need no copies of the data."""
    out = []
    for b in range(bags):
        times = sample.poisson(rate, sample.unit(key, seed + b)) if replacement else F.when(sample.unit(key, seed + b) < rate, 1).otherwise(0)
        own = df.withColumn("__w", (F.col(weight).cast("double") if weight else F.lit(1.0)) * times).filter("__w > 0")
        rows = net.prepared(own, columns, target, "__w", sample.unit(key, 10_000 + seed + b) < validation if validation else None)
        n, u = net_of(len(columns), params, seed=seed + b)
        out.append(net.fit(rows, n, u, int(params.get("epochs", 100)), str(params.get("loss", "squared")), float(params.get("flat_spot", 0.0)), float(params.get("dropout", 0.0)), EarlyStop(float(params.get("threshold", 0.0)), float(params.get("tolerance", 0.0)), int(params.get("window", 0))), seed=seed + b))
        rows.unpersist()
    return out


def cross_validated(df: DataFrame, columns: list[str], target: str, key, params: dict[str, object], folds: int = 5, weight: str | None = None, seed: int = 1) -> list[float]:
    """Validation error of each fold of a hash of the key."""
    errors = []
    for k in range(folds):
        rows = net.prepared(df, columns, target, weight, sample.fold(key, folds) == k)
        n, u = net_of(len(columns), params, seed=seed)
        _, history = net.fit(rows, n, u, int(params.get("epochs", 100)), str(params.get("loss", "squared")), seed=seed)
        errors.append(min(v for _, v in history))
        rows.unpersist()
    return errors


def best_of_grid(df: DataFrame, columns: list[str], target: str, key, params: dict[str, object], folds: int = 3, most: int | None = None, weight: str | None = None) -> tuple[dict[str, object], list[tuple[dict[str, object], float]]]:
    """The combination of least mean validation error, and all with their errors."""
    tried = [(p, float(np.mean(cross_validated(df, columns, target, key, p, folds, weight)))) for p in grid(params, most)]
    return min(tried, key=lambda x: x[1])[0], tried


def one_vs_all(df: DataFrame, columns: list[str], target: str, classes: list[object], params: dict[str, object], weight: str | None = None) -> list[Net]:
    """A net per class against the others; the class of the highest score is predicted."""
    out = []
    for c in classes:
        rows = net.prepared(df.withColumn("__t", (F.col(target) == c).cast("double")), columns, "__t", weight)
        n, u = net_of(len(columns), params)
        out.append(net.fit(rows, n, u, int(params.get("epochs", 100)))[0])
        rows.unpersist()
    return out


def native_multiclass(df: DataFrame, columns: list[str], target: str, classes: list[object], params: dict[str, object], weight: str | None = None) -> Net:
    """One net with an output per class."""
    marks = [f"__c{i}" for i in range(len(classes))]
    rows = net.prepared(df.withColumns({m: (F.col(target) == c).cast("double") for m, c in zip(marks, classes, strict=True)}), columns, marks, weight)
    n, u = net_of(len(columns), params, len(classes))
    out = net.fit(rows, n, u, int(params.get("epochs", 100)))[0]
    rows.unpersist()
    return out


def stacked(df: DataFrame, parts: list[tuple[list[str], dict[str, object]]], target: str, key, final: dict[str, object], weight: str | None = None, seed: int = 1) -> tuple[list[Net], Net]:
    """Sub-models on their own columns, then a final model on their scores.  Scores are of rows that a sub-model's
    training leaves out (two halves by a hash of the key), so the final model doesn't learn from fitted rows."""
    half = sample.unit(key, seed) < 0.5
    every = list(dict.fromkeys(c for columns, _ in parts for c in columns))
    rows = net.prepared(df, every, target, weight, half)
    # Of each part a net for either half and one for all rows.
    jobs = [(columns, params, side) for columns, params in parts for side in (True, False, None)]
    made = [net_of(len(columns), params, seed=seed) for columns, params, _ in jobs]
    places, sides, epochs = [[every.index(c) for c in columns] for columns, _, _ in jobs], [side for _, _, side in jobs], [int(params.get("epochs", 50)) for _, params, _ in jobs]
    nets = net.fit_together(rows, [n for n, _ in made], [u for _, u in made], places, sides, epochs)
    rows.unpersist()
    subs, scored = nets[2::3], df
    for i, (columns, _) in enumerate(parts):
        scored = net.scored(scored, columns, nets[3 * i : 3 * i + 2], "__s").withColumn(f"__score{i}", F.when(half, F.get("__s", F.lit(1))).otherwise(F.get("__s", F.lit(0)))).drop("__s")
    rows = net.prepared(scored, [f"__score{i}" for i in range(len(parts))], target, weight)
    n, u = net_of(len(parts), final, seed=seed)
    top = net.fit(rows, n, u, int(final.get("epochs", 50)))[0]
    rows.unpersist()
    return subs, top


def subset_fitness(df: DataFrame, columns: list[str], target: str, epochs: int = 15, hidden: int = 4, seed: int = 1) -> Callable[[list[list[str]]], list[float]]:
    """Validation error of a small net on a column subset, over all rows: every epoch is one pass in which each partition
    adds up the gradients of all subsets of a generation.  Three tenths of the rows, by a hash, are for validation.
    The rows are cached; done() of what is returned lets them go."""
    import pandas as pd

    numbers = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns], F.col(target).cast("double").alias("__t"))
    about = numbers.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).head()
    scaled = numbers.select(*[((F.col(c) - F.lit(about[f"m{i}"] or 0.0)) / F.lit(about[f"s{i}"] or 1.0)).alias(c) for i, c in enumerate(columns)], "__t")
    rows = net.prepared(scaled, columns, "__t", validation=sample.unit(F.xxhash64(*columns), seed) < 0.3)

    def sums(nets: list[Net], chosen: list[list[int]], validation: bool) -> np.ndarray:
        """Sums over the training rows of all gradients, or over the validation rows of squared errors; then the rows."""
        size = len(nets) if validation else sum(w.size for n in nets for w in n.weights)

        def run(batches):
            total = np.zeros(size + 1)
            for x, t, _, marks in (block for pdf in batches for block in net.unpacked(pdf)):
                x, t = x[marks == validation], t[marks == validation, 0]
                if not len(t):
                    continue
                if validation:
                    total[:-1] += [((n.predict(x[:, c]) - t) ** 2).sum() for n, c in zip(nets, chosen, strict=True)]
                else:
                    total[:-1] += np.concatenate([g.ravel() for n, c in zip(nets, chosen, strict=True) for g in n.gradient(x[:, c], t, np.ones(len(t)))[0]])
                total[-1] += len(t)
            yield pd.DataFrame({"i": np.arange(size + 1), "v": total})

        out = np.zeros(size + 1)
        for r in rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # as many rows as weights
            out[r["i"]] = r["v"]
        return out

    def fitness(subsets: list[list[str]]) -> list[float]:
        if not subsets:
            return []
        chosen = [[columns.index(c) for c in s] for s in subsets]
        nets = [Net.create(len(c), [hidden], seed=seed) for c in chosen]
        updaters = [Updater("ADAM", 0.1) for _ in nets]
        for _ in range(epochs):
            flat, at = sums(nets, chosen, False), 0
            for k, n in enumerate(nets):
                grads = []
                for w in n.weights:
                    grads.append(flat[at : at + w.size].reshape(w.shape))
                    at += w.size
                nets[k] = Net(n.sizes, n.activations, updaters[k].step(n.weights, grads, flat[-1]))
        errors = sums(nets, chosen, True)
        return [float(e / max(errors[-1], 1.0)) for e in errors[:-1]]

    fitness.done = rows.unpersist
    return fitness


@dataclass
class Svm:
    """Support vector machine with a linear, polynomial, sigmoid or RBF kernel, on a bounded sample of rows."""

    kernel: str
    gamma: float
    vectors: np.ndarray
    alpha: np.ndarray
    bias: float

    def _k(self, a, b):
        d = a @ b.T
        return {"linear": lambda: d, "poly": lambda: (self.gamma * d + 1) ** 3, "sigmoid": lambda: np.tanh(self.gamma * d), "rbf": lambda: np.exp(-self.gamma * np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * d))}[self.kernel]()

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self._k(np.asarray(x, float), self.vectors) @ self.alpha + self.bias

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The decision as a score of 0 to 1."""
        return 1 / (1 + np.exp(-np.clip(self.decision(x), -500, 500)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, kernel: str = "rbf", c: float = 1.0, gamma: float = 0.5, epochs: int = 200, seed: int = 1) -> Svm:
        """Dual coordinate ascent; y is -1 or 1.  The bias is folded into the kernel as a constant."""
        m = Svm(kernel, gamma, np.asarray(x, float), np.zeros(len(x)), 0.0)
        k = m._k(m.vectors, m.vectors) + 1.0
        a, f, rng = np.zeros(len(x)), np.zeros(len(x)), np.random.default_rng(seed)
        for _ in range(epochs):
            moved = 0.0
            for i in rng.permutation(len(x)):
                new = min(c, max(0.0, a[i] + (1 - y[i] * f[i]) / k[i, i]))
                if new != a[i]:
                    f += (new - a[i]) * y[i] * k[:, i]
                    moved = max(moved, abs(new - a[i]))
                    a[i] = new
            if moved < 1e-4:
                break
        keep = a > 1e-9
        return Svm(kernel, gamma, m.vectors[keep], (a * y)[keep], float((a * y).sum()))


def save_models(path: str, models: list[object], kind: str) -> None:
    """Model files <kind><i>.model under a local path; what they hold is told by their extension's owner, the kind."""
    os.makedirs(path, exist_ok=True)
    for i, m in enumerate(models):
        with open(os.path.join(path, f"{kind.lower()}{i}.model"), "wb") as f:
            f.write(m.to_json().encode() if isinstance(m, Net) else pickle.dumps(m))


def load_models(path: str, kind: str) -> list[object]:
    """Models of a kind in the order of their numbers."""
    names = sorted((n for n in os.listdir(path) if n.startswith(kind.lower()) and n.endswith(".model")), key=lambda n: int(n[len(kind) : -6]))
    out = []
    for n in names:
        with open(os.path.join(path, n), "rb") as f:
            raw = f.read()
        out.append(Net.from_json(raw.decode()) if raw[:1] == b"{" else pickle.loads(raw))
    return out
