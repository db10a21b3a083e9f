"""Configuration of a modelling project: what the steps read, with defaults and checks."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

#: Values that count as missing, compared in lower case (fixed values).
MISSING_TOKENS = ("", "?")
BIN_METHODS = ("EqualPositive", "EqualNegative", "EqualTotal", "EqualInterval", "WeightEqualPositive", "WeightEqualNegative", "WeightEqualTotal", "WeightEqualInterval")
ALGORITHMS = ("SPDTI", "SPDT", "MunroPatI", "MunroPat", "DynamicBinning", "Native", "Exact")
FILTERS = ("KS", "IV", "MIX", "PARETO", "SE", "ST", "FI", "VOTED")
MODELS = ("NN", "LR", "SVM", "DT", "RF", "GBT", "WDL")


@dataclass
class DataSet:
    path: str = ""
    delimiter: str = "|"
    header_path: str | None = None
    header_delimiter: str = "|"
    filter_expression: str = ""
    validation_path: str | None = None
    validation_filter: str = ""
    segments: list[str] = field(default_factory=list)
    target: str = ""
    pos_tags: list[str] = field(default_factory=list)
    neg_tags: list[str] = field(default_factory=list)
    weight: str | None = None
    missing: tuple[str, ...] = MISSING_TOKENS
    meta: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    hybrid: dict[str, float] = field(default_factory=dict)
    candidates: list[str] = field(default_factory=list)


@dataclass
class Stats:
    max_bins: int = 10
    max_categories: int = 0
    method: str = "EqualPositive"
    algorithm: str = "SPDTI"
    sample_rate: float = 1.0
    sample_negatives_only: bool = False
    value_threshold: float | None = None
    psi_unit: str | None = None


@dataclass
class Normalize:
    kind: str = "ZSCALE"
    cutoff: float = 6.0
    parquet: bool = False
    missing_category: str = "POSRATE"


@dataclass
class VarSelect:
    filter_by: str = "KS"
    count: int | None = None
    filter_out_ratio: float = 0.05
    missing_rate: float = 0.98
    correlation: float = 1.0
    min_iv: float = 0.0
    min_ks: float = 0.0
    force_select: list[str] = field(default_factory=list)
    force_remove: list[str] = field(default_factory=list)


@dataclass
class Train:
    algorithm: str = "NN"
    bags: int = 1
    bag_rate: float = 1.0
    with_replacement: bool = False
    validation_rate: float = 0.2
    epochs: int = 100
    folds: int = -1
    up_sample: float = 1.0
    seed: int = 1
    params: dict[str, Any] = field(default_factory=dict)


@dataclass
class Eval:
    name: str = "Eval1"
    data: DataSet = field(default_factory=DataSet)
    buckets: int = 10
    selector: str = "mean"
    scale: float = 1000.0
    conversion: str = "OLD_SIGMOID"
    champion: list[str] = field(default_factory=list)


@dataclass
class Project:
    name: str = "model"
    data: DataSet = field(default_factory=DataSet)
    stats: Stats = field(default_factory=Stats)
    normalize: Normalize = field(default_factory=Normalize)
    varselect: VarSelect = field(default_factory=VarSelect)
    train: Train = field(default_factory=Train)
    evals: list[Eval] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)

    @staticmethod
    def from_json(text: str) -> Project:
        return _load(Project, json.loads(text))

    def problems(self) -> list[str]:
        """What is wrong with the configuration, as sentences; empty if nothing is."""
        from tabforge.operators.transform import NORM_TYPES

        out = []
        d, s = self.data, self.stats
        if not d.target:
            out.append("The target column isn't set.")
        if set(d.pos_tags) & set(d.neg_tags):
            out.append("A tag is both positive and negative.")
        if d.target and d.target in d.candidates:
            out.append("The target is a candidate column.")
        if s.method not in BIN_METHODS:
            out.append(f"Unknown binning method {s.method}.")
        if s.algorithm not in ALGORITHMS:
            out.append(f"Unknown binning algorithm {s.algorithm}.")
        if s.max_bins < 2:
            out.append("At least two bins are needed.")
        if not 0 < s.sample_rate <= 1 or not 0 < self.train.bag_rate <= 1:
            out.append("Rates must lie above 0 and not above 1.")
        if not 0 <= self.train.validation_rate < 1:
            out.append("The validation rate must lie in [0, 1).")
        if self.normalize.kind.upper() not in NORM_TYPES:
            out.append(f"Unknown normalisation {self.normalize.kind}.")
        if self.normalize.cutoff <= 0:
            out.append("The cutoff must be positive.")
        if self.varselect.filter_by.upper() not in FILTERS:
            out.append(f"Unknown selection {self.varselect.filter_by}.")
        if not 0 <= self.varselect.filter_out_ratio < 1:
            out.append("The filter-out ratio must lie in [0, 1).")
        if both := set(self.varselect.force_select) & set(self.varselect.force_remove):
            out.append(f"Columns are both forced in and out: {', '.join(sorted(both))}.")
        if self.train.algorithm.upper() not in MODELS:
            out.append(f"Unknown model {self.train.algorithm}.")
        if self.train.bags < 1 or self.train.epochs < 1:
            out.append("Bags and epochs must be at least 1.")
        if self.train.folds in (0, 1) or self.train.up_sample < 1:
            out.append("Folds are at least 2 (or -1 for none), up-sampling at least 1.")
        if len({e.name for e in self.evals}) < len(self.evals):
            out.append("Two evaluation sets have one name.")
        return out


def _load(kind, value):
    if not dataclasses.is_dataclass(kind):
        return value
    known = {f.name: f for f in dataclasses.fields(kind)}
    if extra := set(value) - set(known):
        raise ValueError(f"unknown settings of {kind.__name__}: {', '.join(sorted(extra))}")
    nested = {"data": DataSet, "stats": Stats, "normalize": Normalize, "varselect": VarSelect, "train": Train}
    out = {}
    for k, v in value.items():
        if k == "evals":
            out[k] = [_load(Eval, e) for e in v]
        elif k in nested and isinstance(v, dict):
            out[k] = _load(nested[k], v)
        else:
            out[k] = tuple(v) if k == "missing" else v
    return kind(**out)
