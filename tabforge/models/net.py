"""Feed-forward nets (no hidden layer: logistic regression) trained by full-batch gradients.

Every epoch is one pass: each partition computes the gradient of its rows with NumPy, the sums are added in a tree of
aggregations, and the driver, which holds only the weights, makes the update.  Nothing that grows with the data reaches
the driver.  Rows are read from a cached table of feature arrays.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVATIONS = {
    "sigmoid": (lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500))), lambda x, y: y * (1 - y)),
    "tanh": (np.tanh, lambda x, y: 1 - y * y),
    "linear": (lambda x: x, lambda x, y: np.ones_like(x)),
    "relu": (lambda x: np.maximum(x, 0), lambda x, y: (x > 0).astype(float)),
    "leakyrelu": (lambda x: np.where(x > 0, x, 0.01 * x), lambda x, y: np.where(x > 0, 1.0, 0.01)),
    "swish": (lambda x: x / (1 + np.exp(-np.clip(x, -500, 500))), lambda x, y: (s := 1 / (1 + np.exp(-np.clip(x, -500, 500)))) * (1 + x * (1 - s))),
    "ptanh": (lambda x: np.where(x > 0, np.tanh(x), 0.25 * np.tanh(x)), lambda x, y: np.where(x > 0, 1.0, 0.25) * (1 - np.tanh(x) ** 2)),
    "sin": (np.sin, lambda x, y: np.cos(x)),
    "log": (lambda x: np.sign(x) * np.log1p(np.abs(x)), lambda x, y: 1 / (1 + np.abs(x))),
}
#: loss -> (error, slope by output); outputs are probabilities for log.
LOSSES = {
    "squared": (lambda o, t: (o - t) ** 2 / 2, lambda o, t: o - t),
    "absolute": (lambda o, t: np.abs(o - t), lambda o, t: np.sign(o - t)),
    "log": (lambda o, t: -(t * np.log(np.clip(o, 1e-12, 1)) + (1 - t) * np.log(np.clip(1 - o, 1e-12, 1))), lambda o, t: (o - t) / np.clip(o * (1 - o), 1e-12, None)),
}


@dataclass
class Net:
    """Layer sizes from inputs to outputs, their activations, and weight matrices with the bias in the last row."""

    sizes: list[int]
    activations: list[str]
    weights: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def create(inputs: int, hidden: list[int] = (), activations: list[str] = (), outputs: int = 1, output: str = "sigmoid", init: str = "xavier", seed: int = 1) -> Net:
        sizes = [inputs, *hidden, outputs]
        rng = np.random.default_rng(seed)
        weights = []
        for a, b in zip(sizes, sizes[1:], strict=False):
            draw = {
                "xavier": lambda a=a, b=b: rng.uniform(-1, 1, (a, b)) * math.sqrt(6 / (a + b)),
                "he": lambda a=a, b=b: rng.normal(0, math.sqrt(2 / a), (a, b)),
                "lecun": lambda a=a, b=b: rng.normal(0, math.sqrt(1 / a), (a, b)),
                "gaussian": lambda a=a, b=b: rng.normal(0, 1, (a, b)),
                "default": lambda a=a, b=b: rng.uniform(-1, 1, (a, b)),
                "zero": lambda a=a, b=b: np.zeros((a, b)),
            }[init]()
            weights.append(np.vstack([draw, np.zeros((1, b))]))
        return Net(sizes, [*activations, *["tanh"] * (len(hidden) - len(activations)), output], weights)

    def layers(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(sum, output) of every layer."""
        out = []
        for w, a in zip(self.weights, self.activations, strict=True):
            s = x @ w[:-1] + w[-1]
            x = ACTIVATIONS[a][0](s)
            out.append((s, x))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        y = self.layers(np.asarray(x, float))[-1][1]
        return y[:, 0] if y.shape[1] == 1 else y

    def hidden(self, x: np.ndarray, layer: int = -2) -> np.ndarray:
        return self.layers(np.asarray(x, float))[layer][1]

    def gradient(self, x: np.ndarray, t: np.ndarray, w: np.ndarray, loss: str = "squared", flat_spot: float = 0.0, drop: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], float]:
        """Sum over rows of the loss's gradient by the weights, and of the loss.  drop: a mask of kept units per hidden layer."""
        layers, y = [], np.asarray(x, float)
        for k, (m, a) in enumerate(zip(self.weights, self.activations, strict=True)):
            s = y @ m[:-1] + m[-1]
            o = ACTIVATIONS[a][0](s)
            if drop and k < len(drop):
                o = o * drop[k]
            layers.append((y, s, o))
            y = o
        error, slope = LOSSES[loss]
        t2 = t.reshape(len(x), -1)
        delta = slope(y, t2) * (ACTIVATIONS[self.activations[-1]][1](layers[-1][1], y) + flat_spot) * w[:, None]
        grads = []
        for k in range(len(layers) - 1, -1, -1):
            before, _, _ = layers[k]
            grads.insert(0, np.vstack([before.T @ delta, delta.sum(0, keepdims=True)]))
            if k:
                d = ACTIVATIONS[self.activations[k - 1]][1](layers[k - 1][1], layers[k - 1][2])
                delta = (delta @ self.weights[k][:-1].T) * d * (drop[k - 1] if drop and k - 1 < len(drop) else 1)
        return grads, float((error(y, t2).sum(1) * w).sum())

    def to_json(self) -> str:
        return json.dumps({"sizes": self.sizes, "activations": self.activations, "weights": [w.tolist() for w in self.weights]})

    @staticmethod
    def from_json(text: str) -> Net:
        d = json.loads(text)
        return Net(d["sizes"], d["activations"], [np.array(w) for w in d["weights"]])

    def expression(self, columns: list[str]) -> Column:
        """The score of a logistic or linear model as a column expression, without Python on the executors."""
        if len(self.weights) != 1 or self.activations[0] not in ("sigmoid", "linear"):
            raise ValueError("only models without hidden layers are expressions")
        w = self.weights[0][:, 0]
        s = sum((F.col(c).cast("double") * float(v) for c, v in zip(columns, w[:-1], strict=True)), F.lit(float(w[-1])))
        return 1 / (1 + F.exp(-s)) if self.activations[0] == "sigmoid" else s


@dataclass
class Updater:
    """Weight updates from gradient sums: B (back-propagation with momentum), Q (quickprop), R (resilient), M (Manhattan),
    ADAM, ADAGRAD, RMSPROP, MOMENTUM or NESTEROV, with L1 or L2 decay."""

    kind: str = "B"
    rate: float = 0.1
    momentum: float = 0.5
    decay: float = 0.0
    norm: str = "none"
    beta1: float = 0.9
    beta2: float = 0.999
    state: dict = field(default_factory=dict)

    def step(self, weights: list[np.ndarray], grads: list[np.ndarray], rows: float) -> list[np.ndarray]:
        n = self.state["n"] = self.state.get("n", 0) + 1
        out = []
        for k, (w, g) in enumerate(zip(weights, grads, strict=True)):
            g = g / max(rows, 1e-12)
            if self.norm == "l2":
                g = g + self.decay * w
            elif self.norm == "l1":
                g = g + self.decay * np.sign(w)
            out.append(w + self._delta(k, n, g))
        return out

    def _kept(self, k, name, like):
        return self.state.setdefault((k, name), np.zeros_like(like))

    def _delta(self, k: int, n: int, g: np.ndarray) -> np.ndarray:
        kind, s = self.kind.upper(), self.state
        if kind in ("B", "MOMENTUM"):
            d = -self.rate * g + self.momentum * self._kept(k, "d", g)
        elif kind == "NESTEROV":
            v = self._kept(k, "d", g)
            new = self.momentum * v - self.rate * g
            s[k, "d"] = new
            return -self.momentum * v + (1 + self.momentum) * new
        elif kind == "ADAM":
            m, v = self._kept(k, "m", g), self._kept(k, "v", g)
            s[k, "m"], s[k, "v"] = m, v = self.beta1 * m + (1 - self.beta1) * g, self.beta2 * v + (1 - self.beta2) * g * g
            return -self.rate * (m / (1 - self.beta1**n)) / (np.sqrt(v / (1 - self.beta2**n)) + 1e-8)
        elif kind == "ADAGRAD":
            s[k, "v"] = v = self._kept(k, "v", g) + g * g
            return -self.rate * g / (np.sqrt(v) + 1e-8)
        elif kind == "RMSPROP":
            s[k, "v"] = v = 0.9 * self._kept(k, "v", g) + 0.1 * g * g
            return -self.rate * g / (np.sqrt(v) + 1e-8)
        elif kind == "M":
            return -self.rate * np.sign(g)
        elif kind == "R":
            last, size = self._kept(k, "g", g), s.setdefault((k, "size"), np.full_like(g, 0.1))
            turn = np.sign(g * last)
            size = np.clip(np.where(turn > 0, size * 1.2, np.where(turn < 0, size * 0.5, size)), 1e-6, 50)
            s[k, "size"], s[k, "g"] = size, np.where(turn < 0, 0.0, g)
            return np.where(turn < 0, 0.0, -np.sign(g) * size)
        elif kind == "Q":
            last, d0 = self._kept(k, "g", g), self._kept(k, "d", g)
            jump = np.divide(g, last - g, out=np.zeros_like(g), where=np.abs(last - g) > 1e-12) * d0
            d = np.where(d0 == 0, -self.rate * g, np.clip(jump, -1.75 * np.abs(d0), 1.75 * np.abs(d0)) - np.where(g * last > 0, self.rate * g, 0.0))
            s[k, "g"] = g
        else:
            raise ValueError(f"unknown update {self.kind}")
        s[k, "d"] = d
        return d


@dataclass
class EarlyStop:
    """When training ends before its epochs: error below a threshold, changes below a tolerance, or no better validation
    error for a window of epochs."""

    threshold: float = 0.0
    tolerance: float = 0.0
    window: int = 0

    def done(self, history: list[tuple[float, float]], change: float) -> bool:
        if self.threshold and (history[-1][0] + history[-1][1]) / 2 < self.threshold or self.tolerance and change < self.tolerance:
            return True
        return bool(self.window) and len(history) > self.window and min(v for _, v in history[-self.window :]) >= min(v for _, v in history[: -self.window])


def prepared(df: DataFrame, columns: list[str], target: str | list[str], weight: str | None = None, validation: Column | None = None) -> DataFrame:
    """block: all that training reads, packed once into one binary of doubles per Arrow batch, and cached; see unpacked().

    Epochs then move a few large values between the JVM and Python instead of an array object per row.
    """
    t = [target] if isinstance(target, str) else target
    wide = df.select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)], *[F.col(c).cast("double").alias(f"t{i}") for i, c in enumerate(t)],
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (validation if validation is not None else F.lit(False)).cast("double").alias("v"),
    )

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"d": [len(columns)], "block": [np.ascontiguousarray(pdf.to_numpy(float)).tobytes()], "width": [pdf.shape[1]]})

    return wide.mapInPandas(run, "d int, block binary, width int").persist()


def unpacked(pdf: pd.DataFrame):
    """features, targets, weights and validation marks of each block of prepared rows."""
    for d, raw, width in zip(pdf["d"], pdf["block"], pdf["width"], strict=True):
        m = np.frombuffer(raw).reshape(-1, width)
        yield m[:, :d], m[:, d:-2], m[:, -2], m[:, -1] > 0.5


def epoch(rows: DataFrame, net: Net, loss: str, flat_spot: float = 0.0, drop: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], float, float, float, float]:
    """Gradient sums and (training error, training weight, validation error, validation weight): one row per partition
    with partial sums is reduced by an aggregation, element by element."""
    size = sum(w.size for w in net.weights)

    def run(batches):
        total, acc = np.zeros(size), np.zeros(4)
        for x, t, w, val in (block for pdf in batches for block in unpacked(pdf)):
            if (~val).any():
                g, e = net.gradient(x[~val], t[~val], w[~val], loss, flat_spot, drop)
                total += np.concatenate([m.ravel() for m in g])
                acc[:2] += e, w[~val].sum()
            if val.any():
                _, e = net.gradient(x[val], t[val], w[val], loss, flat_spot)
                acc[2:] += e, w[val].sum()
        yield pd.DataFrame({"i": np.arange(size + 4), "v": np.concatenate([total, acc])})

    got = rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # as many rows as weights
    flat = np.zeros(size + 4)
    for r in got:
        flat[r["i"]] = r["v"]
    grads, at = [], 0
    for w in net.weights:
        grads.append(flat[at : at + w.size].reshape(w.shape))
        at += w.size
    return grads, *flat[size:].tolist()


def fit(rows: DataFrame, net: Net, updater: Updater | None = None, epochs: int = 100, loss: str = "squared", flat_spot: float = 0.0, dropout: float = 0.0, stop: EarlyStop | None = None, fixed: list[int] | None = None, checkpoint: str | None = None, every: int = 10, seed: int = 1) -> tuple[Net, list[tuple[float, float]]]:
    """Trains from the net's weights on, so that training can go on from an earlier model; fixed layers keep theirs.

    Returns the net of the least validation error (or the last, without validation rows) and the errors of each epoch.
    With a checkpoint path, weights and optimiser state are saved every few epochs and training resumes from there.
    """
    import os
    import pickle

    updater, stop, rng = updater or Updater(), stop or EarlyStop(), np.random.default_rng(seed)
    history: list[tuple[float, float]] = []
    best, least = net, math.inf
    if checkpoint and os.path.exists(checkpoint):
        with open(checkpoint, "rb") as f:
            net, updater.state, history, best, least = pickle.load(f)
    while len(history) < epochs:
        drop = [(rng.random(n) >= dropout) / (1 - dropout) for n in net.sizes[1:-1]] if dropout else None
        grads, e, w, ve, vw = epoch(rows, net, loss, flat_spot, drop)
        history.append((e / max(w, 1e-12), ve / vw if vw else e / max(w, 1e-12)))
        if history[-1][1] < least:
            best, least = net, history[-1][1]
        weights = updater.step(net.weights, [np.zeros_like(g) if fixed and k in fixed else g for k, g in enumerate(grads)], w)
        change = max(float(np.abs(a - b).max()) for a, b in zip(weights, net.weights, strict=True))
        net = Net(net.sizes, net.activations, weights)
        if checkpoint and len(history) % every == 0:
            with open(checkpoint + ".new", "wb") as f:
                pickle.dump((net, updater.state, history, best, least), f)
            os.replace(checkpoint + ".new", checkpoint)
        if stop.done(history, change):
            break
    return (best if any(v != t for t, v in history) else net), history


def fit_together(rows: DataFrame, nets: list[Net], updaters: list[Updater], columns: list[list[int]], sides: list[bool | None], epochs: list[int], loss: str = "squared") -> list[Net]:
    """Nets over the same prepared rows, each on its own columns (their places) and on the rows of one side of the
    validation mark (None: all): an epoch is one pass that adds up the gradients of all nets that still train."""
    nets = list(nets)
    for done in range(max(epochs, default=0)):
        live = [k for k, n in enumerate(epochs) if done < n]
        sizes = [sum(w.size for w in nets[k].weights) for k in live]

        def run(batches, live=live, sizes=sizes, now=tuple(nets)):
            total = [np.zeros(n + 1) for n in sizes]
            for x, t, w, mark in (block for pdf in batches for block in unpacked(pdf)):
                for acc, k in zip(total, live, strict=True):
                    own = np.ones(len(w), bool) if sides[k] is None else mark == sides[k]
                    if own.any():
                        g, _ = now[k].gradient(x[own][:, columns[k]], t[own], w[own], loss)
                        acc += np.concatenate([*[m.ravel() for m in g], [w[own].sum()]])
            yield pd.DataFrame({"i": np.arange(sum(sizes) + len(sizes)), "v": np.concatenate(total)})

        flat = np.zeros(sum(sizes) + len(sizes))
        for r in rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # as many rows as weights
            flat[r["i"]] = r["v"]
        at = 0
        for k in live:
            grads = []
            for w in nets[k].weights:
                grads.append(flat[at : at + w.size].reshape(w.shape))
                at += w.size
            nets[k] = Net(nets[k].sizes, nets[k].activations, updaters[k].step(nets[k].weights, grads, flat[at]))
            at += 1
    return nets


def scored(df: DataFrame, columns: list[str], nets: list[Net], out: str = "scores", scale: float = 1.0) -> DataFrame:
    """df with an array of the nets' scores, computed in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(columns)))
        return pd.Series(list(np.stack([n.predict(m) * scale for n in nets], 1))) if len(x) else pd.Series([], dtype=object)

    return df.withColumn(out, run(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])))
