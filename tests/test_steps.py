import math

import numpy as np
import pytest

from tabforge.config import DataSet, Normalize, Project, Train, VarSelect
from tabforge.models import trees
from tabforge.plans import steps


@pytest.fixture(scope="module")
def rows(spark):
    """x and c decide the target, z has nothing to do with it."""
    rng = np.random.default_rng(7)
    out = []
    for i in range(600):
        x, z, c = float(rng.normal()), float(rng.normal()), "abc"[int(rng.integers(3))]
        out.append((str(i), "R" if 2 * x + (2 if c == "a" else -1) + 0.3 * rng.normal() > 0 else "N", x, z, c, 1.0))
    return spark.createDataFrame(out, "id string, t string, x double, z double, c string, w double").cache()


def project(**more):
    return Project("p", DataSet(target="t", pos_tags=["R"], neg_tags=["N"], meta=["id"], weight="w", categorical=["c"]), **more)


def trained(rows, **more):
    run = steps.stats(steps.init(steps.start(project(**more)), rows), rows)
    return steps.train(run, steps.norm(run, rows))


def accuracy(run, rows):
    got = steps.score(run, rows, ["id"], scale=1.0).select("tag", "scores").collect()
    assert all(0 <= s <= 1 for r in got for s in r["scores"])
    return np.mean([(np.mean(r["scores"]) > 0.5) == (r["tag"] == 1) for r in got])


@pytest.mark.parametrize(
    "settings",
    [
        {"algorithm": "DT"}, {"algorithm": "RF", "bags": 2, "bag_rate": 0.8}, {"algorithm": "GBT"}, {"algorithm": "GBT", "params": {"loss": "squared", "trees": 5}},
        {"algorithm": "GBT", "params": {"loss": "absolute", "trees": 5}}, {"algorithm": "GBT", "params": {"early_stop": True, "trees": 15}}, {"algorithm": "SVM", "params": {"sample_rows": 300}},
    ],
    ids=lambda s: "-".join(map(str, [s["algorithm"], *s.get("params", {}).values()])),
)
def test_algorithms_learn(rows, settings):
    run = trained(rows, train=Train(**settings))
    assert len(run.models) == settings.get("bags", 1) and all(0 <= e < 0.2 for e in run.errors)
    assert accuracy(run, rows) > 0.85


@pytest.mark.parametrize("kind", ["ZSCALE", "ZSCALE_INDEX"])
def test_wide_and_deep_with_and_without_indexes(rows, kind):
    run = trained(rows, normalize=Normalize(kind), train=Train("WDL", epochs=25, params={"rate": 0.1}))
    assert run.models[0].sizes == ([4] if kind == "ZSCALE_INDEX" else [])
    assert accuracy(run, rows) > 0.85


def test_folds_validate_every_row_once_and_up_sampling_raises_scores(rows):
    run = trained(rows, train=Train("LR", folds=3, epochs=20))
    assert len(run.models) == len(run.errors) == 3 and all(e < 0.25 for e in run.errors)
    mean = lambda r: np.mean([x["mean"] for x in steps.score(r, rows, ["id"]).collect()])
    plain, raised = (trained(rows, train=Train("LR", epochs=20, up_sample=u)) for u in (1.0, 6.0))
    assert mean(raised) > mean(plain)


def test_no_validation_rows_give_no_error(rows):
    assert math.isnan(trained(rows, train=Train("DT", validation_rate=0.0)).errors[0])


@pytest.mark.parametrize("kind", ["SE", "ST", "FI", "VOTED"])
def test_model_based_selection_leaves_the_noise_out(rows, kind):
    run = steps.stats(steps.init(steps.start(project(varselect=VarSelect(kind, count=2), train=Train("LR", epochs=30, params={"rate": 0.3}))), rows), rows)
    assert set(steps.varsel(run, df=rows).selected()) == {"x", "c"}


def test_model_based_selection_needs_rows_and_single_features(rows):
    run = steps.stats(steps.init(steps.start(project(normalize=Normalize("ONEHOT"), varselect=VarSelect("SE"))), rows), rows)
    with pytest.raises(ValueError):
        steps.varsel(run)
    with pytest.raises(ValueError):
        steps.varsel(run, df=rows)


def test_half_the_gradient_is_half_the_step(rows):
    df = rows.selectExpr("x", "z", "CAST(t = 'R' AS DOUBLE) AS tag")
    a, b = (trees.roots(trees.fit(df, ["x", "z"], [], "tag", "GBT", trees=3, depth=2, rate=r, loss=k)) for k, r in (("halfgradient", 0.2), ("squared", 0.1)))
    assert a == b


@pytest.mark.parametrize("settings", [{"folds": 1}, {"up_sample": 0.5}])
def test_impossible_settings_are_told(settings):
    assert project(train=Train(**settings)).problems()
    with pytest.raises(ValueError):
        trees.fit(None, [], [], "t", "GBT", loss="hinge")
