"""Scoring by any Python model: a function from a matrix of columns to scores, or a file that names one."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scored(df: DataFrame, columns: list[str], predict: Callable[[np.ndarray], np.ndarray], out: str = "score", scale: float = 1.0) -> DataFrame:
    """df with the scores of a model, computed in Arrow batches; missing values reach the model as NaN."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        rows = np.array([[np.nan if v is None else v for v in r] for r in x], float)
        return pd.Series(np.asarray(predict(rows), float) * scale)

    return df.withColumn(out, run(F.array(*[F.col(c).cast("double") for c in columns])))


def load(text: str) -> tuple[list[str], Callable[[np.ndarray], np.ndarray]]:
    """Columns and model of a JSON specification: {"columns": [...], "module": ..., "factory": ..., "arguments": {...}}."""
    spec = json.loads(text)
    return spec["columns"], getattr(importlib.import_module(spec["module"]), spec["factory"])(**spec.get("arguments", {}))
