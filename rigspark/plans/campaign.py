"""A whole measurement campaign: raw runs in, report tables out."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from ..models import selection as sel
from ..models.registry import REGISTRY, EnsembleModel, TargetModel, fit_model, long_predictions
from ..models.stages import ALL_FEATURES, InteractionFeatures, SetpointFeatures, VifSelector
from ..operators import prepare as pr, relational as rl, stats as st, timeseries as ts
from ..params import BASE_FEATURES, FOLDS, SEED, SETPOINT, TARGETS, TEST_SHARE, TRIALS, Params
from ..session import cut
from ..sources.stage import ModelStore
from . import decide as dc, explain as ex, scenarios as sc
from .clean import clean_runs, feature_table


@dataclass(frozen=True)
class Settings:
    """What to train and how hard to search."""

    models: tuple[str, ...] = tuple(REGISTRY)
    trials: int = TRIALS
    folds: int = FOLDS
    test: float = TEST_SHARE
    seed: int = SEED
    parallelism: int = 2
    ensemble_on_test: bool = False  # parity with fitting blend weights on the test rows
    ensemble_score_by_members: bool = False  # parity with averaging the members' validation scores
    fixed: Mapping[str, Mapping] = field(default_factory=dict)  # parameters to pin per model
    spaces: Mapping[str, Mapping] = field(default_factory=dict)  # search spaces to use instead of the registry's
    validation: Mapping[str, float] = field(default_factory=lambda: {"load_n": 180, "temp_c": 100, "conc": 0.55, "ester": 1})
    picks: int = 5
    run_in_rounds: int = 300
    store: str | None = None  # folder that keeps fitted models, designs and reduced tables from one run to the next


@dataclass
class Outcome:
    """Fitted objects and report tables of a campaign."""

    features: list[str]
    models: dict[str, object]
    best: str
    final: object
    tables: dict[str, DataFrame]


def prepare_rows(raw: DataFrame, params: Params = Params()) -> DataFrame:
    """Cleaned rows with features, weights and a unique row key, stored."""
    d = feature_table(clean_runs(raw, params))
    key = F.concat_ws("#", "run_id", F.lpad(F.col("seq").cast("string"), 12, "0"), F.col("is_summary").cast("int").cast("string"))
    return cut(d.withColumn("row_id", key))


def split_rows(rows: DataFrame, test: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """``is_test`` per row, drawn by run and stratified by load and temperature bins."""
    runs = st.run_setpoints(rows)
    marks = pr.stratified_run_split(pr.quantile_bins(runs, ["load_n", "temp_c"]), ["load_n_bin", "temp_c_bin"], test, seed)
    return rl.attach_stats(rows, marks.select("run_id", "is_test"))


def blend_out_of_fold(specs: Mapping[str, Mapping], train: DataFrame, features: list[str], folds: int) -> tuple[list[float], float]:
    """Blend weights from the members' out-of-fold predictions, and the blend's own validation R2."""
    parts = rl.stack([sel.cross_predictions(REGISTRY[n], p, train, features, folds) for n, p in specs.items()])
    names = list(specs)
    per_model = [F.max(F.when(F.col("model") == n, F.col("pred"))).alias(f"_m{i}_y") for i, n in enumerate(names)]
    wide = cut(parts.groupBy("row_id", "fold", "target").agg(F.max("y").alias("y"), *per_model))
    g, b, _, _ = sel.gram_sums(wide, len(names), ("y",))
    weights = sel.simplex_least_squares(g, b).tolist()
    blend = sum((F.col(f"_m{i}_y") * F.lit(w) for i, w in enumerate(weights)), F.lit(0e0))
    scores = st.regression_metrics(wide.withColumn("pred", blend), ["fold"]).filter("target = 'all'")
    return weights, scores.agg(F.avg("r2")).first()[0]


class _Unstored:
    """Makes everything anew."""

    def model(self, name, make, load):
        return make()

    def table(self, name, make):
        return cut(make())


def run_campaign(raw: DataFrame, params: Params = Params(), settings: Settings = Settings()) -> Outcome:
    """Clean, split, search, fit, decide and explain.

    With ``settings.store`` a second run on equal inputs and settings takes cleaned rows, models, kept rows and designs from there and fits
    nothing; ``raw`` must then be a plan that reads the archive (not a stored copy, which has another name each time).
    """
    spark, s = raw.sparkSession, settings
    kept_things = ModelStore(raw, s.store, (params, replace(s, store=None))) if s.store else _Unstored()
    rows = kept_things.table("clean_rows", lambda: prepare_rows(raw, params))
    tagged = split_rows(rows, s.test, s.seed)
    interactions = InteractionFeatures().fit(tagged.filter(~F.col("is_test")))
    rows = cut(interactions.transform(tagged))
    train, test = rows.filter(~F.col("is_test")), rows.filter("is_test")
    features = VifSelector(inputCols=list(ALL_FEATURES)).fit(train).kept
    folded = sel.tag_folds(train, pr.group_kfold(train, s.folds))

    def prepare(d: DataFrame) -> DataFrame:
        return interactions.transform(SetpointFeatures().transform(d))

    # search, fit and score every family
    models, chosen, trials, seconds, cv = {}, {}, None, {}, {}
    for name in s.models:
        def fit(name=name):
            start, spec = time.time(), REGISTRY[name]
            table, best = sel.search(spec, folded, features, s.folds, s.trials, s.seed, s.parallelism, s.spaces.get(name), s.fixed.get(name))
            tried = [[r["trial"], dict(r["params"]), r["r2_cv"], r["failure"]] for r in table.collect()]
            return fit_model(spec, best, train, features), {"best": best, "trials": tried, "seconds": time.time() - start}
        models[name], notes = kept_things.model(name, fit, TargetModel.load)
        chosen[name] = {k: tuple(v) if isinstance(v, list) else v for k, v in notes["best"].items()}
        table = spark.createDataFrame([(name, *t) for t in notes["trials"]], "model string, trial int, params map<string,string>, r2_cv double, failure string")
        trials = table if trials is None else trials.unionByName(table)
        cv[name], seconds[name] = max(t[2] for t in notes["trials"]), notes["seconds"]
    smooth = [n for n in s.models if REGISTRY[n].smooth]
    ranked = spark.createDataFrame([(n, float(v)) for n, v in cv.items()], "model string, r2_cv double")
    top = [r["model"] for r in rl.top_models(ranked, min(3, len(cv)), smooth).orderBy("place").collect()]

    def blend():
        if s.ensemble_on_test:
            weights, score = sel.ensemble_weights([models[n] for n in top], test), sel.ensemble_cv_by_members(cv[n] for n in top)
        else:
            weights, score = blend_out_of_fold({m: chosen[m] for m in top}, folded, features, s.folds)
        if s.ensemble_score_by_members:
            score = sel.ensemble_cv_by_members(cv[n] for n in top)
        return EnsembleModel([models[n] for n in top], weights), {"weights": list(weights), "score": score}
    models["ensemble"], notes = kept_things.model("ensemble", blend, EnsembleModel.load)
    weights, score = notes["weights"], notes["score"]
    seconds["ensemble"] = sum(seconds[n] for n in top)
    cv["ensemble"] = score
    metrics = sel.model_scores(models, {"train": train, "test": test})
    steady = sel.steady_accuracy(models, test, prepare)
    info = spark.createDataFrame([(n, float(cv[n]), float(seconds[n]), str(chosen.get(n, dict(zip(top, weights))))) for n in models],
                                 "model string, r2_cv double, tuning_s double, best_params string")
    best = max(s.models, key=lambda n: (cv[n], n)) if cv["ensemble"] <= max(cv[n] for n in s.models) else "ensemble"

    # drop anomalies of the best model and refit it on everything else
    scored = models[best].transform(rows).withColumn("abs_err", F.abs(F.col("pred_cof") - F.col("cof")))
    kept = kept_things.table("kept_rows", lambda: pr.residual_filter(scored).select(*rows.columns))
    if best == "ensemble":
        final, _ = kept_things.model("final", lambda: (EnsembleModel([fit_model(REGISTRY[n], chosen[n], kept, features) for n in top], weights), {}), EnsembleModel.load)
    else:
        final, _ = kept_things.model("final", lambda: (fit_model(REGISTRY[best], chosen[best], kept, features), {}), TargetModel.load)

    # decisions over the setpoint grid
    first = rows.agg(F.min("run_id")).first()[0]
    grid = cut(sc.campaign_grid(spark))
    scored = cut(final.transform(prepare(grid)).withColumnsRenamed({f"pred_{t}": t for t in TARGETS}))
    front = cut(dc.pareto_front(scored.select("point_id", *TARGETS)))
    optima = cut(dc.scalar_optimum(scored).select("point_id", "ester", "conc", "load_n", "temp_c", "time_s", "score"))
    tails = cut(optima.join(dc.tail_value(final, optima, prepare=prepare), "point_id"))
    curve, run_in = dc.optimum_curve(final, optima, rows, first, prepare=prepare)
    steady_rows = ts.steady_state(rows)
    design = []

    def designed(i: int) -> DataFrame:
        design.extend(design or dc.suggest_experiments({n: models[n] for n in top}, grid, rows, s.picks, prepare))
        return design[i]
    picks, safe = kept_things.table("design", lambda: designed(0)), kept_things.table("safe_points", lambda: designed(1))
    curves, at_point = dc.validate_at(models, rows, s.validation, first, prepare)
    measured_run_in = ts.run_in_time(rows, order=["seq", "is_summary"]).join(ts.first_row(rows), "run_id")
    run_in_score, run_in_importance = sel.run_in_model(measured_run_in.select("run_id", "run_in_s", *SETPOINT), iterations=s.run_in_rounds)
    base = sc.as_points(spark, {**sel.RUN_IN_BASE, "ester": 0})
    trends = rl.stack([long_predictions(models, prepare(sc.sweep(base, var, lo, hi)), ["step", "ester", var])
                       .withColumn("variable", F.lit(var)).withColumnRenamed(var, "value") for var, (lo, hi) in sel.RUN_IN_RANGES.items()])
    surface = final.transform(prepare(sc.surface(optima.select("ester", "temp_c"), "conc", sel.RUN_IN_RANGES["conc"], "load_n", sel.RUN_IN_RANGES["load_n"])))
    trees = [n for n in s.models if REGISTRY[n].tree]
    interaction_names = [c for c in ALL_FEATURES if c not in BASE_FEATURES]
    tables = {
        "model_metrics": metrics.join(F.broadcast(info), "model"),
        "model_steady": steady,
        "trials": trials,
        "param_importance": sel.param_importance(trials),
        "pareto": dc.annotated_front(front, grid.drop("time_s")),
        "knee": dc.knee_point(front).join(grid.drop("time_s"), "point_id"),
        "optimums": tails.join(run_in, "point_id").join(dc.stability(final, tails, prepare=prepare), "point_id"),
        "optimum_curves": curve,
        "doe_suggestions": picks,
        "doe_curves": dc.doe_curves(final, picks.select("point_id", "conc", "load_n", "temp_c", F.col("ester").cast("int").alias("ester")), rows, first, prepare=prepare),
        "safe_points": safe,
        "validation_curves": curves,
        "validation_point": at_point,
        "steady_states": steady_rows,
        "distribution": st.setpoint_distribution(rows),
        "correlation": st.correlation(rows, TARGETS, [*BASE_FEATURES, *interaction_names]),
        "describe": st.describe(rows, ("time_s", "load_n", "temp_c", "conc", "ester", *TARGETS)),
        "describe_kept": st.describe(kept, ("time_s", "load_n", "temp_c", "conc", "ester", *TARGETS)),
        "run_in": measured_run_in,
        "run_in_importance": run_in_importance,
        "run_in_trends": sel.run_in_trends(run_in_score, spark),
        "trends": trends,
        "surface": surface.select("ester", "i", "j", "conc", "load_n", *[f"pred_{t}" for t in TARGETS]),
        "high_cof": st.high_counts(rows),
        "flag_effect": st.flag_effect(steady_rows),
        "box_stats": st.box_stats(rows, "cof"),
        "histogram": st.histogram(rows, "cof"),
        "range_rmse": st.range_rmse(sel.scored_pairs({best: models[best]}, test).filter("target = 'cof'")),
        "learning_curve": sel.learning_curve(REGISTRY["ridge"], {"alpha": 1.0}, train, features, splits=s.folds),
        "errors": st.error_by_run(sel.scored_pairs({best: models[best]}, test, ["run_id", "time_s", "load_n", "temp_c"]).filter("target = 'cof'")),
        "partial_dependence": ex.partial_dependence(final, test, "load_n"),
    }
    if trees:
        tree = max(trees, key=lambda n: (cv[n], n))
        model: TargetModel = models[tree]
        tables["feature_importance"] = sel.feature_importance(model)
        tables["shapley"] = cut(ex.shapley(model, test, features, ex.sample_rows(train, 20, seed=s.seed), value=F.log("pred_cof")))
        tables["shapley_summary"] = ex.shapley_summary(tables["shapley"])
    return Outcome(features, models, best, final, tables)

