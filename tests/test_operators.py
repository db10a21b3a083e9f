import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabforge.config import DataSet, Project
from tabforge.functions import expression, scalar
from tabforge.models import net, search, trees, wide_deep
from tabforge.operators import binning, evaluate, metrics, prep, profile, sample, select, transform
from tabforge.operators.binning import INF, Bins
from tabforge.sources import tables


def bin_frame(spark, neg, pos):
    return spark.createDataFrame([("c", i, p, n, float(p), float(n)) for i, (n, p) in enumerate(zip(neg, pos, strict=True))], "column_name string, bin int, pos long, neg long, weighted_pos double, weighted_neg double")


def test_ks_iv_golden(spark):
    r = metrics.separation(bin_frame(spark, [1, 2, 3, 4, 5, 6], [2, 2, 5, 5, 5, 5])).head()
    assert round(r.iv, 2) == 0.08 and round(r.ks, 2) == 10.71 and r.weighted_iv == r.iv
    assert metrics.separation(bin_frame(spark, [1, 2], [0, 0])).head().ks is None


def test_z_score_golden(spark):
    z = lambda x, m, s, c: spark.range(1).select(transform.z_score(F.lit(float(x)), m, s, c)).head()[0]
    assert [z(2, 2, 1, 6), z(12, 2, 1, 6), z(2, 4, 1, 2), z(2, 4, 0, 2)] == [0, 6, -2, 0]


def test_woe_lookup_golden(spark):
    s = transform.ColumnStats(Bins("v", [-INF, 2.0, 4.0, 6.0]), woe=(10, 11, 12, 13, 6.5))
    df = spark.createDataFrame([("3.0",), ("wrong_format",), (None,), ("2.0",), ("NaN",), ("-1",)], "v string")
    assert [r.v for r in transform.normalize(df, {"v": s}, "WOE").collect()] == [11, 6.5, 6.5, 11, 6.5, 10]


def test_area_golden(spark):
    p = spark.createDataFrame([("roc", 0, 0.0, 0.0), ("roc", 1, 0.5, 0.6), ("roc", 2, 1.0, 1.0)], "curve string, bucket int, fpr double, recall double").withColumns({m: F.lit(0.0) for m in evaluate._MEASURES if m not in ("fpr", "recall")})
    assert abs(evaluate.areas(p).head().auc - 0.55) < 1e-12


def test_points_follow_the_sequential_rule(spark):
    rng = random.Random(3)
    rows = [(i, rng.random(), int(rng.random() < 0.1), rng.random()) for i in range(37)]
    df = spark.createDataFrame(rows, "id int, score double, tag int, w double").repartition(5)
    c = evaluate.confusion(df, weight="w")
    measured = evaluate.rates(c).orderBy("rn").toPandas()
    for curve, m in evaluate.CURVES.items():
        want, b = [], 1
        for r in measured.itertuples():
            if b <= 10 and getattr(r, m) >= b / 10 - 1e-12:
                want.append((b, r.rn))
                b += 1
        got = sorted((r.bucket, r.rn) for r in evaluate.points(c, [curve]).collect() if r.bucket)
        assert got == want, curve


@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=12), st.one_of(st.none(), st.floats(-1e6, 1e6)))
def test_bin_index_of_values(bounds, v):
    b = Bins("x", [-INF, *sorted(set(bounds))])
    i = b.index_of(v)
    assert i == b.size if v is None else b.bounds[i] <= v and (i + 1 == b.size or v < b.bounds[i + 1])


def test_bin_index_column_agrees(spark):
    bins = [Bins("v", [-INF, 0.0, 1.5]), Bins("v", groups=[["a"], ["b", "c"]]), Bins("v", [-INF, 5.0], [["x"], ["3"]], 2.0)]
    values = ["-1", "0", "1.5", "1e3", "a", " c ", "?", "", None, "3", "x", "zz", "nan", "inf", "2"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for b in bins:
        got = [r[0] for r in df.select(b.index()).collect()]
        assert got == [b.index_of(None if v is None or v.strip() in ("", "?") or v in ("nan", "inf") and b.kind != "C" else v) for v in values]


def test_running_sums_over_ranges(spark):
    rows = [(random.Random(i).randrange(20), i, 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "o int, id int, x double").repartition(7)
    got = {r.id: r.x_cum for r in binning.running(df, "o", ["x"], descending=True, tie=["id"]).collect()}
    order = [i for _, i in sorted((-o, i) for o, i, _ in rows)]
    assert got == {i: k + 1.0 for k, i in enumerate(order)}


def test_entropy_and_rebin():
    counts = [(0, 0), (5, 5), (6, 4), (0, 10), (1, 9)]
    merged = binning.merge_by_entropy(counts, 2)
    assert sorted(i for g in merged for i in g) == list(range(5)) and len(merged) == 2 and merged[1] == [3, 4]
    b = binning.rebin(Bins("x", [-INF, 1.0, 2.0, 3.0, 4.0]), counts, 4, 9, 0.9)
    assert 2 <= b.size <= 4 and b.bounds[0] == -INF
    assert binning.local_equal_total([1, 1, 1, 2, 3, 4], 2) == [-INF, 2]
    assert binning.local_equal_positive([(1, 1), (1, 1), (2, 0), (3, 1), (4, 1)], 2) == [-INF, 2]


def test_expressions(spark):
    df = spark.createDataFrame([("M", "10", "", "7"), ("B", "9.5", "x", None), ("?", "abc", None, "8")], "d string, n string, e string, k string")
    keep = lambda t, **o: [r.d for r in expression.keep_rows(df, t, **o).collect()]
    assert keep("n >= 10") == ["M"] and keep("n < 10 or d == '?'") == ["B", "?"] and keep("!(d == \"M\") && k != null") == ["?"]
    assert keep("e != null and e.isEmpty()") == ["M"] and keep("k % 2 == 1") == ["M"] and keep("d.substring(0, 1) == 'B'") == ["B"]
    assert keep("n > k") == ["M", "?"] and keep("") == keep("((") == ["M", "B", "?"]
    with pytest.raises(expression.ExpressionError):
        keep("nosuch == 1", strict=True)
    assert expression.variables("a > 1 and b.isEmpty() or a == c") == ["a", "b", "c"]
    assert [r[0] for r in df.select(expression.weight_of(df, "n * 2 - 19")).collect()] == [1.0, 0.0, 1.0]


@given(st.floats(-70000, 70000))
def test_half_precision_rule(x):
    mag = abs(x)
    e = max(-14, math.floor(math.log2(mag))) if mag else -14
    unit = 2.0 ** (e - 10)
    v = round(x / unit) * unit
    want = float(np.float16(x)) if abs(x) < 65520 else math.copysign(math.inf, x)
    assert (math.copysign(math.inf, x) if abs(v) >= 65520 else v) == want


def test_scalars(spark):
    df = spark.createDataFrame([(1.0009765,), (0.1,), (-65519.0,), (70000.0,), (3e-8,), (None,)], "x double")
    with np.errstate(over="ignore"):
        want = [None if r.x is None else float(np.float16(r.x)) for r in df.collect()]
    assert [r[0] for r in df.select(scalar.to_float16("x")).collect()] == want
    assert scalar.clean_name("a.b c/d-e") == "a_b_c_d_e" and scalar.same_name("x::y", "y") and scalar.resolve("b", ["a::b", "c"]) == "a::b"
    one = spark.createDataFrame([("[1, x,3]", "a||b|", "1.50")], "l string, s string, t string")
    r = one.select(scalar.parse_list("l"), scalar.split_literal("s", "|"), scalar.trim_tag("t"), scalar.decode_base64(scalar.encode_base64("s"))).head()
    assert list(r) == [[1.0, None, 3.0], ["a", "", "b", ""], "1.5", "a||b|"]


def test_sampling_is_stable_and_fair(spark):
    df = spark.range(20_000).withColumn("tag", (F.col("id") % 10 == 0).cast("int"))
    a = {r.id for r in sample.rows(df, 0.3, F.col("id"), 1).collect()}
    assert a == {r.id for r in sample.rows(df.repartition(9), 0.3, F.col("id"), 1).collect()} and abs(len(a) - 6000) < 300
    assert sample.rows(df, 0.1, F.col("id"), 1, "tag").filter("tag = 1").count() == 2000
    mean = df.select(F.avg(sample.poisson(1.3, sample.unit(F.col("id"), 2)))).head()[0]
    assert abs(mean - 1.3) < 0.05
    assert sample.column_subset(list("abcdef"), "HALF", 1) == sample.column_subset(list("abcdef"), "AUTO", 1)


def test_profile_of_messy_columns(spark):
    df = spark.createDataFrame([("1",), ("2",), ("?",), ("",), (None,), ("x",), ("-7",)], "v string")
    r = profile.numeric(df, ["v"]).head()
    assert (r.total, r.missing, r.valid, r.max, r.min) == (7, 4, 3, 2.0, -7.0)
    assert profile.numeric(df, ["v"], threshold=1.0).head().valid == 2
    assert profile.numeric(df.limit(0), ["v"]).head().mean is None
    neg = spark.createDataFrame([(-3.0,), (-1.0,)], "v double")
    assert profile.numeric(neg, ["v"]).head().max == -1.0


def test_nets_learn_and_updaters_descend(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a + b > 0)) for a, b in x], "a double, b double, tag int")
    rows = net.prepared(df, ["a", "b"], "tag")
    for kind, rate in (("B", 2.0), ("Q", 0.5), ("R", 0.1), ("M", 0.1), ("ADAM", 0.3), ("ADAGRAD", 0.5), ("RMSPROP", 0.1), ("MOMENTUM", 2.0), ("NESTEROV", 2.0)):
        model, history = net.fit(rows, net.Net.create(2), net.Updater(kind, rate), 6, "log")
        assert history[-1][0] < history[0][0], kind
    model, history = net.fit(rows, net.Net.create(2), net.Updater("ADAM", 0.3), 15, "log")
    p = [r.scores[0] for r in net.scored(df, ["a", "b"], [model]).collect()]
    e = [r[0] for r in df.select(model.expression(["a", "b"])).collect()]
    assert np.allclose(p, e) and np.mean((np.array(p) > 0.5) == (x.sum(1) > 0)) > 0.9
    again = net.Net.from_json(model.to_json())
    assert np.allclose(again.predict(x), model.predict(x))


@pytest.mark.parametrize("act", list(net.ACTIVATIONS))
def test_gradients_are_those_of_the_loss(act):
    rng = np.random.default_rng(1)
    x, t, w = rng.normal(size=(5, 3)), rng.random((5, 1)), rng.random(5)
    n = net.Net.create(3, [4], [act], 1, "sigmoid", seed=2)
    g, _ = n.gradient(x, t, w, "squared")
    for k in range(2):
        i = (1, 0)
        m = n.weights[k]
        m[i] += 1e-6
        _, up = n.gradient(x, t, w, "squared")
        m[i] -= 2e-6
        _, down = n.gradient(x, t, w, "squared")
        m[i] += 1e-6
        assert abs((up - down) / 2e-6 - g[k][i]) < 1e-5


def test_wide_deep_gradient():
    rng = np.random.default_rng(1)
    x, c, t, w = rng.normal(size=(6, 2)), rng.integers(0, 3, (6, 1)), rng.integers(0, 2, 6).astype(float), np.ones(6)
    m = wide_deep.WideDeep.create(2, [3], 2, [3], 4)
    g, _ = m.gradient(x, c, t, w)
    for k, p in enumerate(m.parameters()):
        i = (0,) * p.ndim
        p[i] += 1e-6
        up = m.gradient(x, c, t, w)[1]
        p[i] -= 2e-6
        down = m.gradient(x, c, t, w)[1]
        p[i] += 1e-6
        assert abs((up - down) / 2e-6 - g[k][i]) < 1e-5


def test_svm_and_grids():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    y = np.where((x**2).sum(1) > 1.2, 1, -1)
    assert (np.sign(search.Svm.fit(x, y, "rbf", 10.0, 1.0).decision(x)) == y).mean() > 0.95
    assert len(search.grid({"a": [1, 2], "b": 3, "c": [4, 5]})) == 4 and len(search.grid({"a": list(range(9))}, 3)) == 3
    assert search.grid_file("a:1;b:[2]\n# no\nc:x") == [{"a": 1, "b": [2]}, {"c": "x"}]
    assert trees.friedman_gain((2, 2.0), (2, 0.0)) == 1.0


def test_selection():
    import pandas as pd

    meta = pd.DataFrame({"column_name": list("abcd"), "ks": [40.0, 30.0, 5.0, 1.0], "iv": [0.1, 0.9, 0.2, 0.0], "missing_rate": [0, 0, 0, 0.99]})
    assert select.pareto(meta, 2) == ["a", "b"]
    out = select.auto_filter(meta, {("a", "b"): 0.99, ("b", "a"): 0.99}, most_correlated=0.9, min_ks=2.0)
    assert [(r.column, r.reason) for r in out] == [("d", "MISSING_RATE"), ("a", "CORRELATION")]
    assert [r.column for r in select.auto_filter(meta, {("a", "b"): 0.99}, most_correlated=0.9, force=["a", "d"])] == ["b"]
    best = select.genetic(list("abcdef"), lambda ps: [-len(set(p) & {"a", "c"}) for p in ps], 2, 12, 12)
    assert best == ["a", "c"] and select.votes([["a", "b"], ["b"]], 1) == ["b"]


def test_files(spark, tmp_path):
    p = f"file://{tmp_path}/t"
    df = spark.createDataFrame([("1", "x", ""), ("2", None, "z|")], "id string, a string, b string")
    tables.write_delimited(df.select("id", "a"), p, "|", compress=True)
    back = tables.read_delimited(spark, p, "|", header_path=p + ".header")
    assert back.columns == ["id", "a"] and {tuple(r) for r in back.collect()} == {("1", "x"), ("2", "")}
    (tmp_path / "d.txt").write_text("id,t a\n1,y\nbad\n2,n\n")
    got = tables.read_delimited(spark, f"file://{tmp_path}/d.txt", ",", target="t a")
    assert got.columns == ["id", "t_a"] and got.count() == 2
    meta = {"c": {"type": "C", "flag": "Candidate", "selected": True, "stats": {"ks": 1.5}, "bins": Bins("c", groups=[["a"], ["b"]])}}
    tables.save_meta(spark, meta, f"file://{tmp_path}/m")
    assert tables.load_meta(spark, f"file://{tmp_path}/m") == meta
    assert "CASE WHEN" in tables.export_woe(Bins("n", [-INF, 1.0]), [0.1, 0.2, 0.3]) and tables.export_stats(meta).count("\n") == 2
    pr = Project("p", DataSet(target="t"))
    tables.save_project(pr, str(tmp_path / "p.json"))
    assert tables.load_project(str(tmp_path / "p.json")) == pr and pr.problems() == [] and Project().problems()


def test_tags_and_segments(spark):
    df = spark.createDataFrame([("1.0", "2"), (" 0", "x"), ("2", "-1"), (None, None)], "t string, w string")
    out = prep.tagged(df, "t", ["1"], ["0"], "w")
    assert [(r.tag, r.weight) for r in out.collect()] == [(1, 2.0), (0, 1.0)]
    assert prep.segmented(df, ["t == 2", "w == 'x'"]).groupBy("segment").count().count() == 3
    assert prep.dry_run(df, "t > 0", 10) == {"read": 4, "kept": 2}


def test_projects(tmp_path):
    from tabforge.config import Eval
    from tabforge.plans import project

    d = str(tmp_path / "p")
    project.create(d, "one")
    with pytest.raises(FileExistsError):
        project.create(d, "two")
    project.add_eval(d, Eval("E1"))
    project.save_version(d, "v1")
    project.add_eval(d, Eval("E2"))
    assert project.evals(d) == ["E1", "E2"] and project.versions(d) == ["v1"]
    project.delete_eval(d, "E1")
    project.switch_version(d, "v1")
    assert project.evals(d) == ["E1"] and project.opened(d).name == "one"


def test_models_are_saved(tmp_path):
    search.save_models(str(tmp_path), [net.Net.create(2), net.Net.create(3)], "NN")
    assert [m.sizes for m in search.load_models(str(tmp_path), "NN")] == [[2, 1], [3, 1]]


def test_generic_models(spark):
    from tabforge.models import generic

    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, b double")
    got = generic.scored(df, ["a", "b"], lambda x: np.nansum(x, 1), scale=10.0).collect()
    assert [r.score for r in got] == [30.0, 30.0]
    cols, model = generic.load('{"columns": ["a"], "module": "numpy", "factory": "poly1d", "arguments": {"c_or_r": [2, 1]}}')
    assert cols == ["a"] and list(model(np.array([1.0, 2.0]))) == [3.0, 5.0]


def test_subset_fitness_reads_every_row(spark):
    # a tells the target of all rows but the 6,000 that hash least, which only b tells.
    rows = spark.range(40_000).select(F.expr("pmod(xxhash64(id), 1000) / 1000D").alias("a"), F.expr("pmod(xxhash64(id, 7), 1000) / 1000D").alias("b"))
    first = rows.withColumn("r", F.row_number().over(Window.orderBy(F.xxhash64("a", "b"))))
    df = first.select("a", "b", F.when(F.col("r") <= 6000, F.col("b") > 0.5).otherwise(F.col("a") > 0.5).cast("int").alias("tag"))
    fitness = search.subset_fitness(df, ["a", "b"], "tag", epochs=15)
    by_a, by_b = fitness([["a"], ["b"]])
    fitness.done()
    assert by_a < by_b and fitness([]) == []


def test_exact_quantiles_are_those_of_percentile(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, float(rng.randrange(9)), rng.gauss(0, 1)]), float(rng.randrange(3)), None) for _ in range(2_001)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in "abc"]).head()
    got = {r.column_name: r.q for r in profile.quantiles(df, list("abc"), probs, exact=True).collect()}
    assert got["c"] is None and want.c is None and all(np.allclose(got[c], want[c], rtol=1e-12, atol=0) for c in "ab")
    assert got["b"] == want.b
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    bins = binning.equal_population(df.withColumn("tag", F.lit(1)), ["a", "b"], 4, exact=True)
    assert bins[0].bounds == [-INF, *want_bounds(df, "a")] and len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def want_bounds(df, c):
    return sorted(set(df.agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).head()[0]))


def test_no_task_of_exact_quantiles_holds_all_values(spark):
    plan = profile.quantiles(spark.range(10).withColumn("v", F.col("id").cast("double")), ["v"], exact=True)._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_shuffled_bounds_the_rows_of_a_task(spark):
    df = spark.range(1_000).withColumn("x", F.col("id") * 2)
    out = transform.shuffled(df, 4, most=100)
    assert out.rdd.getNumPartitions() == 10 and max(out.rdd.glom().map(len).collect()) < 200
    rows = out.collect()
    assert sorted(r.id for r in rows) == list(range(1_000)) and rows != sorted(rows) and rows == transform.shuffled(df.repartition(3), 4, most=100).collect()
    assert transform.shuffled(df, 4).rdd.getNumPartitions() == 4


def test_nets_fitted_together_are_those_fitted_alone(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *map(float, x), float(x.sum() > 0), float(rng.random())) for i, x in enumerate(rng.normal(size=(400, 3)))], "id long, a double, b double, c double, tag double, w double")
    side = F.col("id") % 3 == 0
    rows = net.prepared(df, ["a", "b", "c"], "tag", "w", side)
    jobs = [([0], True, 4, []), ([2, 1], False, 7, [3]), ([0, 1], None, 5, [])]
    start = [search.net_of(len(c), {"hidden": h}) for c, _, _, h in jobs]
    got = net.fit_together(rows, [n for n, _ in start], [u for _, u in start], [c for c, _, _, _ in jobs], [s for _, s, _, _ in jobs], [e for _, _, e, _ in jobs])
    rows.unpersist()
    for model, (c, s, e, h) in zip(got, jobs, strict=True):
        own = net.prepared(df if s is None else df.filter(side if s else ~side), ["abc"[i] for i in c], "tag", "w")
        n, u = search.net_of(len(c), {"hidden": h})
        alone, _ = net.fit(own, n, u, e)
        own.unpersist()
        assert all(np.allclose(x, y) for x, y in zip(model.weights, alone.weights, strict=True))


def test_stacked_models_ask_for_no_fewer_epochs_than_the_default(spark, monkeypatch):
    """The registered query asks for as many epochs as stacking has by default."""
    from tabforge import catalog

    seen = []
    monkeypatch.setattr(search, "stacked", lambda df, parts, target, key, final: seen.append([*[p for _, p in parts], final]) or ([], net.Net.create(2)))
    catalog.QUERIES["stacked_models"](spark, "/root/testdata/sf0.001")
    assert seen and all(p.get("epochs", 50) >= 50 for p in seen[0])
