"""Decision trees, random forests and boosted trees on Spark's histogram trees, and what is read off them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of feature subsets -> Spark's; AUTO is Spark's own choice.
SUBSETS = {"ALL": "all", "HALF": "0.5", "ONETHIRD": "onethird", "TWOTHIRDS": "0.6667", "SQRT": "sqrt", "LOG2": "log2", "AUTO": "auto"}
#: Losses of boosted regressions -> Spark's.
BOOST_LOSSES = {"squared": "squared", "halfgradient": "squared", "absolute": "absolute"}


def fit(df: DataFrame, numeric: list[str], categorical: list[str], target: str, kind: str = "RF", weight: str | None = None, trees: int = 10, depth: int = 5, bins: int = 32, subset: str = "AUTO", impurity: str | None = None, rate: float = 0.1, seed: int = 1, regression: bool = False, loss: str | None = None, validation: str | None = None, tolerance: float = 0.01) -> PipelineModel:
    """kind: DT, RF or GBT.  Unseen categories are a category of their own; numbers must not be missing.

    Boosted trees: loss is log (of classes), squared, halfgradient or absolute, the last three by regression on the target;
    with a validation column (true: not trained on) boosting ends once the validation error stops falling by the tolerance.
    """
    if kind == "GBT" and loss not in (None, "log", *BOOST_LOSSES):
        raise ValueError(f"unknown loss {loss}")
    boost = {"maxIter": trees, "stepSize": rate, "featureSubsetStrategy": SUBSETS[subset]} | ({"validationIndicatorCol": validation, "validationTol": tolerance} if validation else {})
    if kind == "GBT" and loss in BOOST_LOSSES:
        regression = True
        # Half the gradient of the squared loss is the squared loss at half the step.
        boost |= {"lossType": BOOST_LOSSES[loss]} | ({"stepSize": rate / 2} if loss == "halfgradient" else {})
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep") for c in categorical]
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"{c}__i" for c in categorical]], outputCol="features", handleInvalid="keep"))
    common = {"featuresCol": "features", "labelCol": target, "maxDepth": depth, "maxBins": bins, "seed": seed} | ({"weightCol": weight} if weight else {})
    make = {
        ("DT", False): lambda: DecisionTreeClassifier(**common, impurity=impurity or "gini"), ("DT", True): lambda: DecisionTreeRegressor(**common),
        ("RF", False): lambda: RandomForestClassifier(**common, numTrees=trees, featureSubsetStrategy=SUBSETS[subset], impurity=impurity or "gini"), ("RF", True): lambda: RandomForestRegressor(**common, numTrees=trees, featureSubsetStrategy=SUBSETS[subset]),
        ("GBT", False): lambda: GBTClassifier(**common, **boost), ("GBT", True): lambda: GBTRegressor(**common, **boost),
    }
    return Pipeline(stages=[*stages, make[kind, regression]()]).fit(df)


def scored(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """df with the probability of the second class, or the prediction of a regression."""
    from pyspark.ml.functions import vector_to_array

    made = model.transform(df)
    value = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in made.columns else F.col("prediction")
    return made.select(*df.columns, value.alias(out))


def importance(model: PipelineModel, columns: list[str]) -> dict[str, float]:
    """Gain of each column, summing to 1."""
    v = model.stages[-1].featureImportances.toArray()
    return {c: float(v[i]) for i, c in enumerate(columns)}


@dataclass
class Node:
    column: int = -1
    threshold: float = 0.0
    left_categories: tuple[float, ...] = ()
    left: Node | None = None
    right: Node | None = None
    value: float = 0.0


def roots(model: PipelineModel) -> list[Node]:
    """The trees of a model as plain nodes, to be turned into expressions, paths or files."""
    m = model.stages[-1]
    own = list(m.trees) if hasattr(m, "trees") else [m]

    def walk(j) -> Node:
        if j.subtreeDepth() == 0:
            return Node(value=float(j.prediction()))
        s = j.split()
        out = Node(int(s.featureIndex()), left=walk(j.leftChild()), right=walk(j.rightChild()), value=float(j.prediction()))
        if s.getClass().getSimpleName() == "ContinuousSplit":
            out.threshold = float(s.threshold())
        else:
            out.left_categories = tuple(float(x) for x in s.leftCategories())
        return out

    return [walk(t._java_obj.rootNode()) for t in own]


def _goes_left(n: Node, columns: list[Column]) -> Column:
    x = columns[n.column]
    return x.isin(*n.left_categories) if n.left_categories else x <= n.threshold


def expression(n: Node, columns: list[Column]) -> Column:
    """A tree's prediction as nested conditions."""
    return F.lit(n.value) if n.left is None else F.when(_goes_left(n, columns), expression(n.left, columns)).otherwise(expression(n.right, columns))


def path(n: Node, columns: list[Column], depth: int) -> Column:
    """L and R of a row's first decisions in a tree, padded with L where it ends early."""
    if n.left is None or depth == 0:
        return F.lit("L" * depth)
    return F.when(_goes_left(n, columns), F.concat(F.lit("L"), path(n.left, columns, depth - 1))).otherwise(F.concat(F.lit("R"), path(n.right, columns, depth - 1)))


def encoded(df: DataFrame, trees: list[Node], columns: list[str], depth: int, keep: list[str] | None = None) -> DataFrame:
    """keep columns and a path of depth - 1 decisions per tree: a projection."""
    cols = [F.col(c).cast("double") for c in columns]
    return df.select(*(keep or []), *[path(t, cols, depth - 1).alias(f"tree_{i}") for i, t in enumerate(trees)])


def friedman_gain(left: tuple[float, float], right: tuple[float, float]) -> float:
    """Friedman's improvement of a split from (count, sum) of both sides."""
    (nl, sl), (nr, sr) = left, right
    return (nr * sl - nl * sr) ** 2 / (nl * nr * (nl + nr)) if nl and nr else 0.0
