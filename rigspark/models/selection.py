"""Validation, search, ensembles and model reports."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.physics import add_features
from ..operators.prepare import group_shuffle_split, residual_filter
from ..operators.relational import arg_row
from ..operators.stats import regression_metrics
from ..operators.timeseries import first_row, steady_state
from ..params import ERROR_LIMIT, FOLDS, SEED, SETPOINT, STEADY_AT_SECONDS, TARGETS, TRIALS
from ..plans.scenarios import as_points, sweep
from ..scale import attach, ordered_positions, with_positions
from ..session import cut
from . import moments
from .registry import EnsembleModel, ModelSpec, TargetModel, fit_model, fit_stacked_folds, long_predictions, sample_params, wide_predictions


# The setpoint and the ranges that run-in trends are drawn at.
RUN_IN_BASE = {"load_n": 100.0, "temp_c": 100.0, "conc": 0.5}
RUN_IN_RANGES = {"temp_c": (40.0, 120.0), "load_n": (10.0, 200.0), "conc": (0.0, 0.6)}


def unclamped(model: Model) -> Model:
    """The model without its lower bound, as validation and training scores use it."""
    return model.unclamped() if hasattr(model, "unclamped") else model


def tag_folds(df: DataFrame, folds: DataFrame, group: str = "run_id") -> DataFrame:
    return cut(attach(df, folds.select(group, "fold"), group))


def cross_predictions(spec: ModelSpec, params: Mapping, df: DataFrame, features: Sequence[str], folds: int = FOLDS,
                      keys: Sequence[str] = ("row_id", "fold"), parallelism: int = 2, targets: Iterable[str] = TARGETS) -> DataFrame:
    """Out-of-fold predictions, long. ``df`` carries ``fold``; each fold is an ordinary fit from a small thread pool.

    Linear families are fitted for all folds from one aggregate of moments.
    """
    if spec.linear:
        return moments.fold_predictions(df, list(features), float(params.get("alpha", 1.0)), spec.name, keys, targets)
    if spec.stacked:
        return _by_fold(spec, fit_stacked_folds(spec, [params], df, features, targets)[0], df, keys, targets)

    def one(i: int) -> DataFrame:
        model = unclamped(fit_model(spec, params, df.filter(F.col("fold") != i), features, targets))
        return long_predictions({spec.name: model}, df.filter(F.col("fold") == i), keys, targets)

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(one, range(folds)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_fold(spec: ModelSpec, models: Mapping[int, TargetModel], df: DataFrame, keys: Sequence[str], targets: Iterable[str]) -> DataFrame:
    parts = [long_predictions({spec.name: unclamped(m)}, df.filter(F.col("fold") == i), keys, targets) for i, m in sorted(models.items())]
    return reduce(lambda a, b: a.unionByName(b), parts)


def cross_validate(spec: ModelSpec, params: Mapping, df: DataFrame, features: Sequence[str], folds: int = FOLDS,
                   parallelism: int = 2, targets: Iterable[str] = TARGETS) -> DataFrame:
    """R2 and RMSE per fold: one metrics aggregate over all folds."""
    preds = cross_predictions(spec, params, df, features, folds, parallelism=parallelism, targets=targets)
    return regression_metrics(preds, ["model", "fold"]).filter("target = 'all'").drop("target")


def search(spec: ModelSpec, df: DataFrame, features: Sequence[str], folds: int = FOLDS, n_trials: int = TRIALS, seed: int = SEED,
           parallelism: int = 2, space: Mapping | None = None, fixed: Mapping | None = None,
           targets: Iterable[str] = TARGETS) -> tuple[DataFrame, dict]:
    """Seeded random search; a failed trial scores -100 and names its reason. Returns the trials table and the best parameters.

    All trials of a linear family are scored from one aggregate of moments, the nets of all trials and folds are trained in the same jobs.
    Raises if no trial succeeded.
    """
    rng = random.Random(seed)
    draws = [sample_params(space or spec.space, rng) for _ in range(n_trials)]

    def one(p: dict) -> tuple[float, str | None]:
        try:
            scores = cross_validate(spec, {**p, **(fixed or {})}, df, features, folds, parallelism=1, targets=targets)
            return float(scores.agg(F.avg("r2")).first()[0]), None
        except Exception as error:  # noqa: BLE001 - a trial may fail on its parameters
            return -100.0, f"{type(error).__name__}: {error}"[:500]

    if spec.linear:
        alphas = moments.alphas_of([{**p, **(fixed or {})} for p in draws])
        fine = [i for i, a in enumerate(alphas) if a >= 0]
        scored = moments.fold_scores(df, list(features), [alphas[i] for i in fine], targets) if fine else []
        found = [(-100.0, f"ValueError: alpha {a} is below 0") for a in alphas]
        for k, i in enumerate(fine):
            found[i] = (float(np.mean([r2 for j, _, r2, _ in scored if j == k])), None)
    elif spec.stacked:
        found = []
        for models in fit_stacked_folds(spec, [{**p, **(fixed or {})} for p in draws], df, features, targets):
            preds = _by_fold(spec, models, df, ["row_id", "fold"], targets)
            r2 = regression_metrics(preds, ["model", "fold"]).filter("target = 'all'").agg(F.avg("r2")).first()[0]
            found.append((float(r2), None) if np.isfinite(r2) else (-100.0, "the net diverged"))
    else:
        with ThreadPoolExecutor(parallelism) as pool:
            found = list(pool.map(one, draws))
    scores = [s for s, _ in found]
    if all(reason for _, reason in found):
        raise RuntimeError(f"every trial of {spec.name} failed; the first: {found[0][1]}")
    rows = [(spec.name, i, {k: str(v) for k, v in p.items()}, s, reason) for i, (p, (s, reason)) in enumerate(zip(draws, found))]
    trials = df.sparkSession.createDataFrame(rows, "model string, trial int, params map<string,string>, r2_cv double, failure string")
    best = max(range(len(draws)), key=lambda i: (scores[i], -i))
    return trials, {**draws[best], **(fixed or {})}


def param_importance(trials: DataFrame, bins: int = 3) -> DataFrame:
    """Share of the score variance between levels of each parameter (numbers in ``bins`` equal ranges)."""
    long = trials.filter("r2_cv > -100").select("model", "r2_cv", F.explode("params").alias("param", "value"))
    long = long.withColumn("num", F.col("value").try_cast("double"))
    span = long.groupBy("model", "param").agg(
        F.min("num").alias("lo"), F.max("num").alias("hi"), F.count("num").alias("n_num"), F.count(F.lit(1)).alias("n_all"),
        F.avg("r2_cv").alias("mu"), F.var_pop("r2_cv").alias("var"))
    d = long.join(F.broadcast(span), ["model", "param"])
    numeric = (F.col("n_num") == F.col("n_all")) & (F.col("hi") > F.col("lo"))
    level = F.when(numeric, F.least(F.lit(bins - 1), F.floor((F.col("num") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0e0)) * bins))
                   .cast("string")).otherwise(F.col("value"))
    groups = d.groupBy("model", "param", level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("r2_cv").alias("m"), F.first("mu").alias("mu"), F.first("var").alias("var"), F.first("n_all").alias("n_all"))
    return groups.groupBy("model", "param").agg(F.when(F.first("var") > 0, F.sum(F.col("n") * (F.col("m") - F.col("mu")) ** 2)
                                                       / (F.first("n_all") * F.first("var"))).otherwise(0e0).alias("importance"))


def model_scores(models: Mapping[str, Model], splits: Mapping[str, DataFrame], key: str = "row_id", targets: Iterable[str] = TARGETS) -> DataFrame:
    """R2, RMSE and MAE of every model on every split, and what a timed pass of the model alone took (see ``time_scoring``, over the last split).

    The split ``train`` is scored unclamped.
    """
    preds = None
    for split, df in splits.items():
        scorers = {n: unclamped(m) for n, m in models.items()} if split == "train" else models
        part = long_predictions(scorers, df.withColumn("split", F.lit(split)), [key, "split"], targets)
        preds = part if preds is None else preds.unionByName(part)
    table = cut(regression_metrics(preds, ["model", "split"]))
    timings = time_scoring(models, list(splits.values())[-1], targets)
    return table.join(F.broadcast(timings), "model", "left").select(*table.columns, "score_ms", "n_scored")


def time_scoring(models: Mapping[str, Model], df: DataFrame, targets: Iterable[str] = TARGETS) -> DataFrame:
    """One timed pass per model: ``model``, ``score_ms``, and ``n_scored``, the rows that Spark observed in that pass.

    The rows are stored first, so that every pass reads the same table; predictions are made and thrown away.
    """
    stored, rows = cut(df), []
    for name, m in models.items():
        seen = Observation()
        scored = m.transform(stored).select(*[f"pred_{t}" for t in targets]).observe(seen, F.count(F.lit(1)).alias("n"))
        start = time.time()
        scored.write.format("noop").mode("overwrite").save()
        rows.append((name, 1000 * (time.time() - start), seen.get["n"]))
    return df.sparkSession.createDataFrame(rows, "model string, score_ms double, n_scored bigint")


def steady_accuracy(models: Mapping[str, Model], df: DataFrame, prepare=add_features, at: float = STEADY_AT_SECONDS,
                    targets: Iterable[str] = TARGETS) -> DataFrame:
    """Observed steady mean per run against the prediction for its first-row setpoint, for all models in one scoring."""
    points = first_row(df).withColumn("time_s", F.lit(float(at)))
    observed = steady_state(df, means=targets).select("run_id", *targets)
    return regression_metrics(long_predictions(models, prepare(points.join(observed, "run_id")), ["run_id"], targets), ["model"])


def gram_sums(df: DataFrame, members: int, targets: Iterable[str] = TARGETS) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Member-by-member and member-by-target products over ``_m<i>_<target>`` columns: one aggregate."""
    pairs = list(itertools.combinations_with_replacement(range(members), 2))
    total = lambda e: F.sum(sum(e[1:], e[0]))
    aggs = [total([F.col(f"_m{i}_{t}") * F.col(f"_m{j}_{t}") for t in targets]).alias(f"g_{i}_{j}") for i, j in pairs]
    aggs += [total([F.col(f"_m{i}_{t}") * F.col(t) for t in targets]).alias(f"b_{i}") for i in range(members)]
    aggs += [total([F.col(t) * F.col(t) for t in targets]).alias("yy"), F.count(F.lit(1)).alias("n")]
    r = df.agg(*aggs).first()
    g = np.zeros((members, members))
    for i, j in pairs:
        g[i, j] = g[j, i] = r[f"g_{i}_{j}"]
    return g, np.array([r[f"b_{i}"] for i in range(members)]), r["yy"], r["n"] * len(tuple(targets))


def simplex_least_squares(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights >= 0 with sum 1 that minimise w'Gw - 2b'w: every support of the few members is solved."""
    m = len(b)
    best, best_w = np.inf, np.full(m, 1.0 / m)
    for size in range(1, m + 1):
        for s in itertools.combinations(range(m), size):
            s = list(s)
            kkt = np.block([[2 * g[np.ix_(s, s)], np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            w = np.linalg.lstsq(kkt, np.concatenate([2 * b[s], [1.0]]), rcond=None)[0][:size]
            if (w < -1e-9).any():
                continue
            full = np.zeros(m)
            full[s] = np.clip(w, 0, None)
            full /= full.sum()
            loss = float(full @ g @ full - 2 * b @ full)
            if loss < best - 1e-15:
                best, best_w = loss, full
    return best_w


def ensemble_weights(models: Sequence[Model], df: DataFrame, targets: Iterable[str] = TARGETS) -> list[float]:
    """Blend weights from labelled rows the members were not fitted on."""
    d = wide_predictions([unclamped(m) for m in models], df, targets)
    g, b, _, _ = gram_sums(d, len(models), targets)
    return simplex_least_squares(g, b).tolist()


def build_ensemble(models: Sequence[Model], df: DataFrame, targets: Iterable[str] = TARGETS) -> EnsembleModel:
    return EnsembleModel(list(models), ensemble_weights(models, df, targets), targets=targets)


def ensemble_cv_by_members(scores: Iterable[float]) -> float:
    """Parity rule: an ensemble's validation score as the mean of its members' scores."""
    scores = list(scores)
    return sum(scores) / len(scores)


def best_model(metrics: DataFrame, on: str = "r2_cv", model: str = "model") -> DataFrame:
    return arg_row(metrics, on, model, "max")


def retrain(spec: ModelSpec, params: Mapping, model: Model, df: DataFrame, features: Sequence[str], limit: float = ERROR_LIMIT,
            target: str = TARGETS[0]) -> tuple[TargetModel, DataFrame]:
    """Refit on the rows that survive the residual filter of the first target."""
    scored = model.transform(df).withColumn("abs_err", F.abs(F.col(f"pred_{target}") - F.col(target)))
    kept = cut(residual_filter(scored, limit).select(*df.columns))
    return fit_model(spec, params, kept, features), kept


def feature_importance(model: TargetModel) -> DataFrame:
    """Tree importances, averaged over the targets."""
    from pyspark.sql import SparkSession

    values = [m.featureImportances.toArray() for m in model.fitted.values()]
    mean = np.mean(values, axis=0)
    return SparkSession.getActiveSession().createDataFrame(
        [(model.name, f, float(v)) for f, v in zip(model.features, mean)], "model string, feature string, importance double")


def learning_curve(spec: ModelSpec, params: Mapping, df: DataFrame, features: Sequence[str], sizes: Sequence[float] | None = None,
                   splits: int = FOLDS, test: float = 0.1, seed: int = SEED, parallelism: int = 2, targets: Iterable[str] = TARGETS) -> DataFrame:
    """Train and validation R2 for growing prefixes of the training rows in (run, seq) order.

    Linear families take all splits and sizes from one aggregate of moments.
    """
    sizes = list(sizes if sizes is not None else np.linspace(0.2, 1.0, 10))
    spark, df = df.sparkSession, df.drop("is_test", "split")
    if spec.linear:
        return _curve(spark, moments.prefix_scores(df, list(features), float(params.get("alpha", 1.0)), sizes, splits, test, seed, targets),
                      df.groupBy("run_id").count().agg(F.avg("count")).first()[0])
    draws = cut(group_shuffle_split(df, splits, test, seed))
    counts = cut(df.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n")))
    placed = cut(with_positions(df, "run_id", "seq", "_pos", "_run_rows"))

    def one(split: int) -> list[tuple]:
        mine = draws.filter(F.col("split") == split).drop("split")
        starts = ordered_positions(counts.join(mine.filter(~F.col("is_test")), "run_id"), [F.col("run_id")], "_n", "_start", "_train")
        train = attach(placed, starts.select("run_id", "_start", "_train"), "run_id").withColumn("_at", F.col("_start") + F.col("_pos"))
        train = cut(train)
        total = train.count()
        held = cut(attach(df, mine.filter("is_test"), "run_id"))
        out = []
        for share in sizes:
            part = train.filter(F.col("_at") < F.lit(int(share * total)))
            model = fit_model(spec, params, part, features, targets).unclamped()
            preds = long_predictions({"train": model}, part, ["row_id"], targets).unionByName(
                long_predictions({"cv": model}, held, ["row_id"], targets))
            r2 = {r["model"]: r["r2"] for r in regression_metrics(preds, ["model"]).filter("target = 'all'").collect()}
            out.append((split, float(share), int(share * total), r2["train"], r2["cv"]))
        return out

    with ThreadPoolExecutor(parallelism) as pool:
        rows = [r for part in pool.map(one, range(splits)) for r in part]
    return _curve(spark, rows, counts.agg(F.avg("_n")).first()[0])


def _curve(spark, rows: list[tuple], per_run: float) -> DataFrame:
    table = spark.createDataFrame(rows, "split int, share double, n_rows bigint, train double, cv double")
    return table.groupBy("share").agg(
        (F.avg("n_rows") / F.lit(float(per_run))).alias("n_runs"), F.avg("train").alias("train_mean"), F.stddev_pop("train").alias("train_std"),
        F.avg("cv").alias("cv_mean"), F.stddev_pop("cv").alias("cv_std"))


def run_in_model(runs: DataFrame, label: str = "run_in_s", iterations: int = 300, step: float = 0.05, depth: int = 4):
    """Boosted model of run-in time on the setpoint; returns it and its importances."""
    va = VectorAssembler(inputCols=list(SETPOINT), outputCol="features")
    model = GBTRegressor(maxIter=iterations, stepSize=step, maxDepth=depth, seed=SEED, labelCol=label, predictionCol="pred_run_in").fit(va.transform(runs))
    rows = [(f, float(v)) for f, v in zip(SETPOINT, model.featureImportances.toArray())]
    return (lambda d: model.transform(va.transform(d)).drop("features")), runs.sparkSession.createDataFrame(rows, "feature string, importance double")


def run_in_trends(score, spark, base: Mapping[str, float] = RUN_IN_BASE, n: int = 20) -> DataFrame:
    """Predicted run-in time while one setpoint variable runs over its range and the others stay at ``base``, for both states: long."""
    parts = None
    for var, (lo, hi) in RUN_IN_RANGES.items():
        at = sweep(as_points(spark, {**base, "ester": 0}), var, lo, hi, n)
        part = score(at).select(F.lit(var).alias("variable"), "step", F.col(var).alias("value"), "ester", "pred_run_in")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def scored_pairs(models: Mapping[str, Model], df: DataFrame, keys: Sequence[str] = ("row_id",), targets: Iterable[str] = TARGETS) -> DataFrame:
    """Actual, predicted and residual (predicted minus actual) per model and target."""
    return long_predictions(models, df, keys, targets).withColumn("residual", F.col("pred") - F.col("y"))


