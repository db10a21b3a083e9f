"""Wide and deep model: a linear part over categories and numbers plus a net over numbers and category embeddings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.models.net import Net, Updater


@dataclass
class WideDeep:
    """embed: a matrix per category column; wide: a weight per category; dense: weights of numbers and bias; deep: the net."""

    embed: list[np.ndarray]
    wide: list[np.ndarray]
    dense: np.ndarray
    deep: Net

    @staticmethod
    def create(numbers: int, categories: list[int], width: int = 4, hidden: list[int] = (8,), seed: int = 1) -> WideDeep:
        rng = np.random.default_rng(seed)
        return WideDeep([rng.normal(0, 0.1, (c, width)) for c in categories], [np.zeros(c) for c in categories], np.zeros(numbers + 1), Net.create(numbers + width * len(categories), list(hidden), ["relu"] * len(hidden), 1, "linear", seed=seed))

    def parameters(self) -> list[np.ndarray]:
        return [*self.embed, *self.wide, self.dense, *self.deep.weights]

    def replaced(self, p: list[np.ndarray]) -> WideDeep:
        k = len(self.embed)
        return WideDeep(p[:k], p[k : 2 * k], p[2 * k], Net(self.deep.sizes, self.deep.activations, p[2 * k + 1 :]))

    def _logit(self, x: np.ndarray, c: np.ndarray):
        z = np.hstack([x, *[e[c[:, j]] for j, e in enumerate(self.embed)]])
        wide = x @ self.dense[:-1] + self.dense[-1] + sum((w[c[:, j]] for j, w in enumerate(self.wide)), np.zeros(len(x)))
        return z, wide + self.deep.predict(z)

    def predict(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(x, c)[1], -500, 500)))

    def gradient(self, x: np.ndarray, c: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Sums over rows of the log-loss's gradient by all parameters, and of the loss."""
        z, logit = self._logit(x, c)
        p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        d = (p - t) * w
        # The deep net's output is linear: a target of output - d makes its squared loss's slope d.
        out = self.deep.layers(z)
        delta, grads, back = d[:, None], [], None
        inputs = [z, *[o for _, o in out[:-1]]]
        from tabforge.models.net import ACTIVATIONS

        for k in range(len(out) - 1, -1, -1):
            grads.insert(0, np.vstack([inputs[k].T @ delta, delta.sum(0, keepdims=True)]))
            back = delta @ self.deep.weights[k][:-1].T
            if k:
                delta = back * ACTIVATIONS[self.deep.activations[k - 1]][1](*out[k - 1])
        embed, width, n = [], self.embed[0].shape[1] if self.embed else 0, x.shape[1]
        wide = []
        for j, (e, v) in enumerate(zip(self.embed, self.wide, strict=True)):
            g, h = np.zeros_like(e), np.zeros_like(v)
            np.add.at(g, c[:, j], back[:, n + j * width : n + (j + 1) * width])
            np.add.at(h, c[:, j], d)
            embed.append(g)
            wide.append(h)
        loss = -(t * np.log(np.clip(p, 1e-12, 1)) + (1 - t) * np.log(np.clip(1 - p, 1e-12, 1))) * w
        return [*embed, *wide, np.append(x.T @ d, d.sum()), *grads], float(loss.sum())


def fit(df: DataFrame, numbers: list[str], categories: dict[str, int], target: str, weight: str | None = None, epochs: int = 50, rate: float = 0.05, width: int = 4, hidden: list[int] = (8,), seed: int = 1) -> tuple[WideDeep, list[float]]:
    """Full-batch training with Adam.  categories: column of indexes -> number of indexes (the last is for unseen ones)."""
    model, step, losses = WideDeep.create(len(numbers), list(categories.values()), width, hidden, seed), Updater("ADAM", rate), []
    rows = df.select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers]).alias("x"), F.array(*[F.least(F.coalesce(F.col(c).cast("int"), F.lit(n - 1)), F.lit(n - 1)) for c, n in categories.items()]).cast("array<int>").alias("c"), F.col(target).cast("double").alias("t"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).persist()
    for _ in range(epochs):
        size = sum(p.size for p in model.parameters())

        def run(batches, model=model, size=size):
            total = np.zeros(size + 2)
            for pdf in batches:
                if len(pdf):
                    g, e = model.gradient(np.stack(pdf["x"].to_numpy()), np.stack(pdf["c"].to_numpy()).astype(int), pdf["t"].to_numpy(float), pdf["w"].to_numpy(float))
                    total += np.concatenate([*[m.ravel() for m in g], [e, pdf["w"].sum()]])
            yield pd.DataFrame({"i": np.arange(size + 2), "v": total})

        flat = np.zeros(size + 2)
        for r in rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            flat[r["i"]] = r["v"]
        grads, at = [], 0
        for p in model.parameters():
            grads.append(flat[at : at + p.size].reshape(p.shape))
            at += p.size
        losses.append(float(flat[-2] / max(flat[-1], 1e-12)))
        model = model.replaced(step.step(model.parameters(), grads, flat[-1]))
    rows.unpersist()
    return model, losses
