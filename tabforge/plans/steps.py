"""The steps of a modelling project over a configuration: init, stats, norm, varsel, train, posttrain, eval, export.

State between steps is the column metadata, a dictionary of small per-column records; tables stay in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.config import Project
from tabforge.functions import expression
from tabforge.operators import binning, correlate, drift, evaluate, metrics, prep, profile, sample, select, transform
from tabforge.operators.transform import ColumnStats
from tabforge.plans import training


@dataclass
class Run:
    project: Project
    meta: dict[str, dict] = field(default_factory=dict)
    stats: dict[str, ColumnStats] = field(default_factory=dict)
    models: list = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    history: list[list[select.Reason]] = field(default_factory=list)

    def selected(self) -> list[str]:
        return [c for c, m in self.meta.items() if m.get("selected")]


def start(project: Project) -> Run:
    if problems := project.problems():
        raise ValueError(" ".join(problems))
    return Run(project)


def init(run: Run, df: DataFrame) -> Run:
    """Types and flags of the columns; precedence of flags: weight, target, meta, force-remove, force-select."""
    d, v = run.project.data, run.project.varselect
    free = [c for c in df.columns if c not in (d.target, d.weight, *d.meta)]
    inferred = {r["column_name"]: r["column_type"] for r in profile.infer_types(df, free).collect()} if free else {}
    for c in df.columns:
        flag = "Weight" if c == d.weight else "Target" if c == d.target else "Meta" if c in d.meta else "ForceRemove" if c in v.force_remove else "ForceSelect" if c in v.force_select else "Candidate" if not d.candidates or c in d.candidates else None
        kind = "N" if flag == "Weight" else "C" if flag == "Target" or c in d.categorical else "H" if c in d.hybrid else inferred.get(c, "C")
        run.meta[c] = {"type": kind, "flag": flag, "selected": False, "stats": {}}
    return run


def _tagged(run: Run, df: DataFrame) -> DataFrame:
    d = run.project.data
    return prep.tagged(expression.keep_rows(df, d.filter_expression), d.target, d.pos_tags, d.neg_tags, d.weight)


def _columns(run: Run, *types: str) -> list[str]:
    return [c for c, m in run.meta.items() if m["flag"] in ("Candidate", "ForceSelect") and m["type"] in types]


def find_bins(run: Run, df: DataFrame, tag: str = "tag") -> list[binning.Bins]:
    s = run.project.stats
    numeric, named, mixed = _columns(run, "N"), _columns(run, "C"), _columns(run, "H")
    if s.sample_rate < 1:
        df = sample.rows(df, s.sample_rate, F.xxhash64(*df.columns), negatives_only=tag if s.sample_negatives_only else None)
    if not numeric:
        bins = []
    elif s.method.endswith("EqualInterval"):
        bins = binning.equal_interval(df, numeric, s.max_bins)
    elif s.algorithm == "DynamicBinning":
        bins = binning.dynamic(df, numeric, s.max_bins)
    elif s.algorithm == "Native":
        bins = [binning.native(df, c, s.max_bins) for c in numeric]
    elif s.method.startswith("Weight"):
        bins = [binning.weighted_population(df, c, s.max_bins, s.method) for c in numeric]
    elif s.algorithm.startswith("SPDT") and s.method == "EqualTotal":
        bins = binning.histogram(df, numeric, s.max_bins)
    else:
        bins = binning.equal_population(df, numeric, s.max_bins, s.method, exact=s.algorithm == "Exact")
    cats = binning.categories(df, named) if named else []
    if s.max_categories and cats:
        cats = binning.merge_categories(df, cats, s.max_categories)
    return bins + cats + [binning.hybrid(df, c, run.project.data.hybrid[c], s.max_bins, s.method) for c in mixed]


def stats(run: Run, df: DataFrame) -> Run:
    """Bins, counts, separation and moments of every candidate column: one pass to find bins, one to count, one for moments."""
    t = _tagged(run, df)
    bins = find_bins(run, t)
    table = binning.bin_counts(t, bins, "tag", "weight").persist()
    numeric = _columns(run, "N", "H")
    moments = profile.numeric(t, numeric) if numeric else None
    empty = df.sparkSession.createDataFrame([], "column_name string, mean double, std_dev double, min double, max double")
    run.stats = transform.column_stats(bins, table, moments if moments is not None else empty)
    for r in metrics.separation(table).collect():
        run.meta[r["column_name"]]["stats"].update({k: r[k] for k in ("ks", "iv", "woe", "weighted_ks", "weighted_iv", "weighted_woe")})
    for r in profile.missing_counts(t, [b.name for b in bins]).collect() if bins else []:
        run.meta[r["column_name"]]["stats"].update(total=r["total"], missing=r["missing"], missing_rate=r["missing"] / max(1, r["total"]))
    for b in bins:
        s = run.stats[b.name]
        run.meta[b.name]["bins"] = b
        run.meta[b.name]["stats"].update(mean=s.mean, std_dev=s.std_dev, min=s.min, max=s.max)
    table.unpersist()
    return run


def psi(run: Run, df: DataFrame) -> Run:
    for r in drift.psi(drift.population(_tagged(run, df), [s.bins for s in run.stats.values()], run.project.stats.psi_unit)).collect():
        run.meta[r["column_name"]]["stats"]["psi"] = r["psi"]
    return run


def correlation(run: Run, df: DataFrame) -> dict[tuple[str, str], float]:
    cols: dict[str, Column] = {s.bins.name: transform._at(s.rates, s.bins.index()) if s.bins.kind == "C" else profile.valid_number(s.bins.name) for s in run.stats.values()}
    return {(r["column_a"], r["column_b"]): r["r"] for r in correlate.matrix(_tagged(run, df), cols | {"tag": F.col("tag")}).collect()}


def varsel(run: Run, correlations: dict[tuple[str, str], float] | None = None, df: DataFrame | None = None) -> Run:
    """Automatic filter, then selection by the configured measure; the reasons are kept, so a run can be taken back.

    FI, SE, ST and VOTED train models, so they need the rows, df.
    """
    import pandas as pd

    v = run.project.varselect
    kind = v.filter_by.upper()
    if kind not in ("KS", "IV", "MIX", "PARETO") and df is None:
        raise ValueError(f"Selection by {kind} needs the rows.")
    rows = [{"column_name": c, "ks": m["stats"].get("ks") or 0.0, "iv": m["stats"].get("iv") or 0.0, "missing_rate": m["stats"].get("missing_rate", 0.0)} for c, m in run.meta.items() if "bins" in m and m["flag"] != "ForceRemove"]
    meta = pd.DataFrame(rows, columns=["column_name", "ks", "iv", "missing_rate"])
    reasons = select.auto_filter(meta, correlations, v.missing_rate, v.min_iv, v.min_ks, v.correlation, force=v.force_select, target="tag")
    run.history.append(reasons)
    left = meta[~meta.column_name.isin([r.column for r in reasons])]
    n = select._count(len(left), v.count, v.filter_out_ratio)
    by = lambda k: list(left.sort_values([k, "column_name"], ascending=[False, True]).column_name)
    order = select.pareto(left, v.count, v.filter_out_ratio) if kind == "PARETO" else by("iv") if kind == "IV" else by("ks")
    if kind in ("FI", "SE", "ST", "VOTED") and len(left):
        stats = {c: run.stats[c] for c in left.column_name}
        table, features = _trainable(run, df, stats, kind == "FI")
        order = training.ranked(table, features, stats, run.project.train, kind, n)
    if kind == "MIX":
        order = list(dict.fromkeys(c for pair in zip(by("ks"), by("iv"), strict=True) for c in pair))
    chosen = list(dict.fromkeys([*[c for c in v.force_select if c in set(left.column_name)], *order]))[: max(n, len(v.force_select))]
    for c, m in run.meta.items():
        m["selected"] = c in chosen
    return run


def _trainable(run: Run, df: DataFrame, stats: dict[str, ColumnStats], cleaned: bool, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Tag, weight, kept columns and features, and the features' names."""
    n, kept = run.project.normalize, ["tag", "weight", *(keep or [])]
    t = _tagged(run, df)
    table = transform.clean(t, stats, kept) if cleaned else transform.normalize(t, stats, n.kind, n.cutoff, kept, n.missing_category)
    return table, [c for c in table.columns if c not in kept]


def norm(run: Run, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Normalised columns, or cleaned ones where the algorithm is one of trees."""
    table, run.features = _trainable(run, df, {c: run.stats[c] for c in run.selected() or run.stats}, run.project.train.algorithm.upper() in training.TREES, keep)
    return table


def train(run: Run, table: DataFrame) -> Run:
    """Models of the configured algorithm, one for each bag or fold, and their validation errors."""
    run.models, run.errors = training.models(table, run.features, run.stats, run.project.train, run.project.normalize.kind)
    return run


def score(run: Run, df: DataFrame, keep: list[str] | None = None, scale: float = 1000.0) -> DataFrame:
    table = training.scored(norm(run, df, keep), run.features, run.models, scale)
    return table.select("tag", "weight", *(keep or []), "scores", *[c.alias(n) for n, c in evaluate.score_summary(F.col("scores")).items()])


def performance(run: Run, scored: DataFrame, key: str, selector: str = "mean", buckets: int = 10) -> tuple[DataFrame, DataFrame]:
    """Curve points and areas of scored rows."""
    p = evaluate.points(evaluate.confusion(scored, selector, "tag", "weight", key), buckets=buckets).persist()
    return p, evaluate.areas(p)


def posttrain(run: Run, df: DataFrame, key: str) -> DataFrame:
    """Average score of every bin, written into the metadata, and the importance of the columns."""
    bins = [run.stats[c].bins for c in run.selected() or run.stats]
    t = _tagged(run, df)
    scores = score(run, df, [key]).select(key, F.col("mean").alias("__score"))
    joined = t.join(scores, key)
    averages = evaluate.bin_scores(joined, bins, "__score").persist()
    for r in averages.collect():
        run.meta[r["column_name"]].setdefault("bin_scores", {})[r["bin"]] = r["avg_score"]
    return evaluate.importance(joined, bins, averages)
