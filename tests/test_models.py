"""Learners against closed forms, brute force and invariants."""

import itertools
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from rigspark import catalog
from rigspark.catalog import training
from rigspark.models import selection as sel
from rigspark.models.learners import KnnRegressor, MlpRegressor, Ridge
from rigspark.models.registry import REGISTRY, Choice, EnsembleModel, Real, TargetModel, Whole, fit_model, sample_params
from rigspark.models.stages import InteractionFeatures, VifSelector
from rigspark.operators import prepare as pr
from rigspark.plans import decide as dc

FEATURES = ["time_s", "load_n", "temp_c", "conc", "ester"]


@pytest.fixture(scope="module")
def table(spark):
    """12 runs with a known law for both targets."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(360):
        run, seq = i % 12, i // 12
        load, temp, conc, ester = 20.0 + 15 * (run % 5) + rng.random(), 40.0 + 20 * (run % 3) + rng.random(), 0.05 * run, run % 2
        cof = 0.05 + 4e-4 * load + 0.05 * conc + 0.002 * rng.random()
        rows.append((f"run{run:02d}", seq, f"run{run:02d}#{seq:04d}", 40.0 + 240 * seq, load, temp, conc, ester, cof, 1.0 + 3e-3 * temp, float(0.5 + rng.random())))
    return spark.createDataFrame(rows, "run_id string, seq bigint, row_id string, time_s double, load_n double, temp_c double, conc double, "
                                       "ester int, cof double, fai double, weight double").cache()


@pytest.mark.parametrize("weighted", [False, True])
def test_ridge_closed_form(spark, weighted):
    rng = np.random.default_rng(2)
    x = rng.random((150, 4))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    y = z @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.random(150) + 3
    w = rng.random(150) + 0.5
    w = w / w.mean() if weighted else np.ones(150)
    d = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(z, y, w)], "a double, b double, c double, d double, label double, w double")
    est = Ridge(alpha=10.0, weightCol="w") if weighted else Ridge(alpha=10.0)
    m = est.fit(VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(d))
    zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
    want = np.linalg.solve((zc * w[:, None]).T @ zc + 10.0 * np.eye(4), (zc * w[:, None]).T @ yc)
    assert np.allclose(m.coefficients.toArray(), want, atol=1e-6)


def test_exact_match_decides_alone(spark):
    rows = [(0, 0.0, 5.0), (1, 1.0, 7.0), (2, 3.0, 1.0)]
    d = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "id int, x double, label double"))
    q = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame([(0.0,), (2.0,)], "x double"))
    near = KnnRegressor(k=2, weights="distance", idCol="id").fit(d).transform(q)
    assert {r["x"]: r["prediction"] for r in near.collect()} == {0.0: 5.0, 2.0: 4.0}
    plain = KnnRegressor(k=2, idCol="id").fit(d).transform(q)
    assert {r["x"]: r["prediction"] for r in plain.collect()} == {0.0: 6.0, 2.0: 4.0}


@pytest.mark.parametrize("act", ["relu", "tanh"])
def test_net_learns_a_line(spark, act):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(float(a), float(b), float(2 * a - b)) for a, b in rng.normal(size=(300, 2))], "a double, b double, label double")
    d = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(d)
    m = MlpRegressor(layers=[16], activation=act, lr=0.05, epochs=40).fit(d)
    assert m.losses[-1] < 0.1 * m.losses[0]
    e = m.transform(d).select(F.avg(F.pow(F.col("prediction") - F.col("label"), 2)) / F.var_pop("label")).first()[0]
    assert e < 0.1


@pytest.mark.parametrize("name,params", [("forest", {"n_estimators": 5, "max_depth": 4}), ("boosted_a", {"n_estimators": 5, "max_depth": 3}),
                                         ("ridge", {"alpha": 1.0}), ("knn", {"k": 3})])
def test_models_survive_saving(spark, table, tmp_path, name, params):
    m = fit_model(REGISTRY[name], params, table, FEATURES)
    m.save(f"file://{tmp_path}/m")
    again = TargetModel.load(spark, f"file://{tmp_path}/m")
    key = lambda d: sorted((r["row_id"], round(r["pred_cof"], 12), round(r["pred_fai"], 12)) for r in d.collect())
    assert key(again.transform(table)) == key(m.transform(table))


def test_ensemble_survives_saving(spark, table, tmp_path):
    members = [fit_model(REGISTRY["ridge"], {"alpha": 1.0}, table, FEATURES), fit_model(REGISTRY["knn"], {"k": 3}, table, FEATURES)]
    m = EnsembleModel(members, [0.25, 0.5])
    m.save(f"file://{tmp_path}/m")
    again = EnsembleModel.load(spark, f"file://{tmp_path}/m")
    key = lambda d: sorted((r["row_id"], round(r["pred_cof"], 12), round(r["pred_fai"], 12)) for r in d.collect())
    assert key(again.transform(table)) == key(m.transform(table))
    assert (again.name, again.weights, again.targets, again.lower) == (m.name, m.weights, m.targets, m.lower)


def test_log_target_and_floor(table):
    m = fit_model(REGISTRY["forest"], {"n_estimators": 8, "max_depth": 6}, table, FEATURES)
    scores = {r["target"]: r["r2"] for r in sel.model_scores({"forest": m}, {"train": table}).collect()}
    assert scores["cof"] > 0.8 and scores["fai"] > 0.9 and scores["all"] == pytest.approx((scores["cof"] + scores["fai"]) / 2)
    low = EnsembleModel([SQLTransformer(statement="SELECT *, -1e0 AS pred_cof, -1e0 AS pred_fai FROM __THIS__")], [1.0]).transform(table)
    assert low.select(F.min("pred_cof")).first()[0] == 0.001


def test_model_scores_fits_every_family_whole(spark, table, monkeypatch):
    fits = []

    def fit(spec, params, df, features):
        fits.append((spec.name, dict(params), df.count()))
        return fit_model(REGISTRY["ridge"], {"alpha": 1.0}, df, features)
    train, test = table.filter("run_id <> 'run07'"), table.filter("run_id = 'run07'")
    monkeypatch.setattr(training, "halves", lambda *_: (train, test))
    monkeypatch.setattr(training, "fit_model", fit)
    out = catalog.queries()["model_scores"](spark, "no folder").collect()
    assert sorted(fits, key=lambda f: f[0]) == [(name, {}, 330) for name in sorted(REGISTRY)]
    assert {(r["model"], r["split"], r["target"]) for r in out} == set(itertools.product(REGISTRY, ("train", "test"), ("all", "cof", "fai")))
    assert all(r["score_ms"] > 0 and r["n_scored"] == 30 for r in out)


def test_deep_trees_are_the_same_with_stored_nodes(table):
    spec = REGISTRY["forest"]
    plain = replace(spec, make=lambda p: spec.make(p).setCacheNodeIds(False))
    params = {"n_estimators": 4}
    assert spec.make(params).getCacheNodeIds() and not spec.make({"max_depth": 5}).getCacheNodeIds()
    key = lambda s: sorted((r["row_id"], r["pred_cof"], r["pred_fai"]) for r in fit_model(s, params, table, FEATURES).transform(table).collect())
    assert key(spec) == key(plain)


def test_search_spaces():
    rng = random.Random(1)
    draws = [sample_params({"i": Whole(-1, 10), "f": Real(0.01, 0.1), "mixed": [0, 0.1, 1.0], "none": [None, 10], "t": Choice((50,), (50, 50))}, rng) for _ in range(300)]
    assert {d["i"] for d in draws} == set(range(-1, 11))
    assert all(0.01 <= d["f"] <= 0.1 for d in draws) and len({d["f"] for d in draws}) > 200
    assert {d["mixed"] for d in draws} == {0, 0.1, 1.0} and {d["none"] for d in draws} == {None, 10} and {d["t"] for d in draws} == {(50,), (50, 50)}


def test_search_is_repeatable_and_survives_a_bad_trial(table):
    d = sel.tag_folds(table, pr.group_kfold(table, 2))
    (a, best), (b, again) = (sel.search(REGISTRY["ridge"], d, FEATURES, 2, n_trials=2) for _ in range(2))
    assert best == again and a.collect() == b.collect()
    some, best = sel.search(REGISTRY["ridge"], d, FEATURES, 2, n_trials=6, space={"alpha": [-5.0, 1.0]})
    assert {(r["params"]["alpha"], r["r2_cv"] == -100.0, r["failure"] is not None) for r in some.collect()} == {("-5.0", True, True), ("1.0", False, False)}
    assert best == {"alpha": 1.0}
    with pytest.raises(RuntimeError, match="every trial"):
        sel.search(REGISTRY["ridge"], d, FEATURES, 2, n_trials=1, space={"alpha": [-5.0]})


def test_blend_weights_beat_every_grid_point(table):
    stub = lambda c, f: SQLTransformer(statement=f"SELECT *, {c} AS pred_cof, {f} AS pred_fai FROM __THIS__")
    models = [stub("cof + 2e-1", "fai"), stub("cof - 1e-1", "fai + 1e-1"), stub("6e-2 + 0*cof", "1e0 + 0*fai")]
    w = np.array(sel.ensemble_weights(models, table))
    g, b, yy, n = sel.gram_sums(sel.wide_predictions(models, table), 3)
    loss = lambda v: float(v @ g @ v - 2 * b @ v)
    assert w.min() >= 0 and w.sum() == pytest.approx(1.0)
    steps = [np.array([i, j, 20 - i - j]) / 20 for i, j in itertools.product(range(21), repeat=2) if i + j <= 20]
    assert all(loss(w) <= loss(v) + 1e-9 for v in steps)


def numpy_vif(x):
    """Least squares on centred columns; uncentred, a mean of 1e6 costs it three digits against exact fractions."""
    x = x - x.mean(axis=0)
    out = []
    for j in range(x.shape[1]):
        a = np.column_stack([np.delete(x, j, axis=1), np.ones(len(x))])
        r = x[:, j] - a @ np.linalg.lstsq(a, x[:, j], rcond=None)[0]
        out.append(((x[:, j] - x[:, j].mean()) ** 2).sum() / (r ** 2).sum())
    return out


def test_vif_equals_least_squares(spark):
    rng = np.random.default_rng(8)
    x = rng.random((200, 4))
    x[:, 3] = x[:, 0] + 0.1 * rng.random(200)
    x[:, 2] = 1e6 + 1e-2 * x[:, 2]  # large mean, small spread
    d = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    got = [r["vif"] for r in pr.vif(d, list("abcd")).collect()]
    assert np.allclose(got, numpy_vif(x), rtol=1e-6)


def test_vif_selection_respects_protection(spark):
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b), float(a), float(a + b), 1.0) for a, b in rng.random((100, 2))]
    d = spark.createDataFrame(rows, "load_n double, temp_c double, copy double, total double, flat double")
    kept = VifSelector(inputCols=d.columns, protected=["load_n", "temp_c"]).fit(d).kept
    assert kept == ["load_n", "temp_c"]


def test_interactions_use_the_means_of_the_fitted_table(table):
    m = InteractionFeatures().fit(table.filter("ester = 0"))
    mean = table.filter("ester = 0").agg(F.avg("load_n"), F.avg("temp_c")).first()
    r = m.transform(table.filter("ester = 1")).first()
    assert r["load_n_x_temp_c"] == pytest.approx((r["load_n"] - mean[0]) * (r["temp_c"] - mean[1]))


def test_retrain_and_curves(table):
    spec = REGISTRY["ridge"]
    first = fit_model(spec, {"alpha": 1.0}, table, FEATURES)
    dirty = table.withColumn("cof", F.when((F.col("seq") == 3) & (F.col("run_id") == "run01"), 0.9).otherwise(F.col("cof")))
    _, kept = sel.retrain(spec, {"alpha": 1.0}, first, dirty, FEATURES)
    assert kept.count() == 359
    curve = sel.learning_curve(spec, {"alpha": 1.0}, table, FEATURES, sizes=(0.5, 1.0), splits=2).orderBy("share").collect()
    assert len(curve) == 2 and curve[0]["n_runs"] < curve[1]["n_runs"] <= 12


def test_steady_accuracy_of_a_perfect_model(table):
    flat = table.withColumn("cof", 0.05 + F.col("conc")).withColumn("fai", 1.0 + F.col("conc"))
    perfect = SQLTransformer(statement="SELECT *, 0.05 + conc AS pred_cof, 1.0 + conc AS pred_fai FROM __THIS__")
    assert all(r["r2"] == pytest.approx(1.0) for r in sel.steady_accuracy({"p": perfect}, flat).collect())


def test_run_in_model(table):
    d = table.groupBy("run_id").agg(*[F.min(c).alias(c) for c in ("conc", "load_n", "temp_c", "ester")]).withColumn("run_in_s", F.col("load_n") * 10)
    score, importance = sel.run_in_model(d, iterations=10)
    assert sum(r["importance"] for r in importance.collect()) == pytest.approx(1.0)
    assert score(d).filter("pred_run_in IS NULL").count() == 0


def test_suggestions_cover_both_states(spark, table):
    stub = lambda k: SQLTransformer(statement=f"SELECT *, 5e-2 + {k}*load_n AS pred_cof, 1e0 + {k}*temp_c AS pred_fai FROM __THIS__")
    grid = table.select("load_n").distinct().limit(15).crossJoin(spark.createDataFrame([(0.1, 50.0), (0.3, 70.0)], "conc double, temp_c double"))
    grid = grid.crossJoin(spark.createDataFrame([(0,), (1,)], "ester int")).withColumn("point_id", F.xxhash64("load_n", "conc", "ester"))
    picks, safe = dc.suggest_experiments({"a": stub("1e-4"), "b": stub("3e-4")}, grid, table, 3)
    assert picks.groupBy("ester").count().collect() and picks.count() == 6 and safe.count() <= 2


def test_nets_in_company_equal_nets_alone(table):
    from rigspark.models.learners import train_nets

    rows = table.select(F.array(*[(F.col(c) / 50).cast("double") for c in FEATURES]).alias("x"), F.array(F.col("cof"), F.col("fai")).alias("y"), (F.hash("run_id") % 3).alias("fold"))
    fits = [{"target": t, "without": w, "layers": layers, "act": act, "lr": 0.01, "l2": 1e-4, "epochs": 6, "patience": 3, "seed": 1}
            for t, w, layers, act in ((0, None, [5], "relu"), (1, 0, [4], "tanh"), (0, 1, [3, 3], "relu"))]
    together = train_nets(rows, fits)
    for fit, got in zip(fits, together):
        alone = train_nets(rows, [fit])[0]
        assert alone["sizes"] == got["sizes"] and alone["theta"] == pytest.approx(got["theta"]) and alone["loss"] == pytest.approx(got["loss"])


def test_moments_equal_refitting(table):
    """Scores of folds and prefixes from sums of products equal those of ordinary fits on the same rows."""
    from rigspark.models import moments

    d = sel.tag_folds(table, pr.group_kfold(table, 3))
    scores = {(k, fold): r2 for k, fold, r2, _ in moments.fold_scores(d, FEATURES, [0.5, 20.0])}
    for k, alpha in enumerate((0.5, 20.0)):
        for fold in range(3):
            model = fit_model(REGISTRY["ridge"], {"alpha": alpha}, d.filter(F.col("fold") != fold), FEATURES).unclamped()
            got = sel.regression_metrics(sel.long_predictions({"m": model}, d.filter(F.col("fold") == fold), ["row_id"]), ["model"]).filter("target = 'all'").first()["r2"]
            assert scores[k, fold] == pytest.approx(got, rel=1e-6, abs=1e-9)


def test_search_trains_the_nets_of_all_trials_together(table):
    d = sel.tag_folds(table, pr.group_kfold(table, 2))
    trials, best = sel.search(REGISTRY["mlp"], d, FEATURES, 2, n_trials=2, fixed={"epochs": 5})
    assert trials.count() == 2 and best["epochs"] == 5 and trials.filter("failure IS NOT NULL").count() == 0
