"""Model families, their search spaces, and models of both targets."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.physics import clamp
from ..params import LOWER_BOUND, SEED, TARGETS
from .learners import KnnModel, KnnRegressor, MlpRegressor, Ridge, train_nets
from .moments import gather, total
from .stages import AffineModel, PopulationScaler


class Domain:
    """What a searched parameter may be."""

    def draw(self, rng: random.Random):
        raise NotImplementedError


@dataclass(frozen=True)
class Whole(Domain):
    lo: int
    hi: int

    def draw(self, rng: random.Random) -> int:
        return rng.randint(self.lo, self.hi)


@dataclass(frozen=True)
class Real(Domain):
    lo: float
    hi: float

    def draw(self, rng: random.Random) -> float:
        return rng.uniform(self.lo, self.hi)


class Choice(Domain):
    def __init__(self, *values):
        self.values = values

    def draw(self, rng: random.Random):
        return rng.choice(self.values)


@dataclass(frozen=True)
class ModelSpec:
    """A family: how to build it from parameters, what to search, how to train it."""

    name: str
    make: Callable[[Mapping], Estimator]
    space: Mapping[str, Domain] = field(default_factory=dict)
    weighted: bool = False
    log_target: bool = True
    scaled: bool = False
    tree: bool = False
    smooth: bool = False
    #: validated from moments, without fits: see moments.py
    linear: bool = False
    #: the fits of all targets, folds and trials are trained in the same jobs
    stacked: bool = False


def _depth(value) -> int:
    """None is unlimited, -1 is the leaf-count default: 31 leaves, five levels. Spark allows at most 30."""
    return 30 if value is None else 5 if value <= 0 else min(int(value), 30)


def forest(p: Mapping) -> Estimator:
    """Deep trees keep the node of every row: sent to the tasks instead, the trees grow with every level. The trees are the same."""
    depth = _depth(p.get("max_depth"))
    return RandomForestRegressor(
        numTrees=int(p.get("n_estimators", 100)), maxDepth=depth, featureSubsetStrategy="all",
        minInstancesPerNode=int(p.get("min_samples_leaf", 1)), cacheNodeIds=depth > 10, seed=SEED)


def boosted(p: Mapping) -> Estimator:
    return GBTRegressor(
        maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)), maxDepth=_depth(p.get("max_depth", 5)),
        minInstancesPerNode=max(1, int(p.get("min_child", 1))), seed=SEED)


# The search spaces of the seven families, as ranges and choices.
REGISTRY: dict[str, ModelSpec] = {s.name: s for s in (
    ModelSpec("boosted_a", boosted, {"n_estimators": Whole(100, 500), "learning_rate": Real(0.01, 0.1),
                                     "max_depth": Whole(3, 7), "min_child": Whole(1, 10)}, weighted=True, tree=True),
    ModelSpec("mlp", lambda p: MlpRegressor(
        layers=list(p.get("layers", (50,))), activation=p.get("activation", "relu"), lr=float(p.get("lr", 0.01)),
        l2=float(p.get("l2", 1e-4)), epochs=int(p.get("epochs", 500))),
        {"layers": Choice((50,), (100,), (50, 50)), "l2": Real(0.0001, 0.1), "activation": Choice("relu", "tanh"), "lr": Real(0.001, 0.01)},
        scaled=True, smooth=True, stacked=True),
    ModelSpec("forest", forest, {"n_estimators": Whole(100, 500), "max_depth": Choice(None, 10, 20), "min_samples_leaf": Whole(1, 10)},
              weighted=True, tree=True),
    ModelSpec("boosted_b", boosted, {"n_estimators": Whole(100, 500), "learning_rate": Real(0.01, 0.1),
                                     "max_depth": Whole(-1, 10), "min_child": Whole(20, 100)}, weighted=True, tree=True),
    ModelSpec("boosted_c", boosted, {"n_estimators": Whole(200, 500), "learning_rate": Real(0.03, 0.1), "max_depth": Whole(4, 8),
                                     "min_child": Whole(1, 50)}, weighted=True, tree=True),
    ModelSpec("knn", lambda p: KnnRegressor(k=int(p.get("k", 5)), weights=p.get("weights", "uniform"), idCol="row_id"),
              {"k": Whole(3, 20), "weights": Choice("uniform", "distance")}, scaled=True),
    ModelSpec("ridge", lambda p: Ridge(alpha=float(p.get("alpha", 1.0))), {"alpha": Real(0.1, 100.0)},
              log_target=False, scaled=True, smooth=True, linear=True),
)}


def sample_params(space: Mapping[str, Domain | Sequence], rng: random.Random) -> dict:
    """One draw from every domain; a plain list is a choice."""
    return {name: (d if isinstance(d, Domain) else Choice(*d)).draw(rng) for name, d in space.items()}


def fit_model(spec: ModelSpec, params: Mapping, df: DataFrame, features: Iterable[str], targets: Iterable[str] = TARGETS,
              weight: str | None = "weight") -> TargetModel:
    """One fitted regressor per target. Scaling is fitted on the rows given, never on rows held out."""
    features = list(features)
    shared: list = []
    inputs = features
    if spec.scaled:
        inputs = [f"_z_{c}" for c in features]
        shared.append(PopulationScaler(inputCols=features, outputCols=inputs).fit(df))
    shared.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    ready = df
    for stage in shared:
        ready = stage.transform(ready)
    fitted = {}
    if spec.stacked:  # the nets of all targets share their jobs
        est = spec.make(params)
        models = est.fit_together(ready, {t: F.log(t) if spec.log_target else F.col(t) for t in targets}, "features")
        return TargetModel(spec.name, shared, {t: m._set(featuresCol="features", predictionCol=f"_p_{t}") for t, m in models.items()}, features, spec.log_target)
    if spec.name == "knn" and "row_id" in ready.columns:
        models = spec.make(params).fit_together(ready, {t: F.log(t) if spec.log_target else F.col(t) for t in targets}, "features")
        for t, m in models.items():
            m.prediction = f"_p_{t}"
        return TargetModel(spec.name, shared, models, features, spec.log_target)
    for t in targets:
        label = F.log(t) if spec.log_target else F.col(t)
        est = spec.make(params)
        est = est.copy({est.labelCol: "label", est.featuresCol: "features", est.predictionCol: f"_p_{t}"})
        cols = ["features", label.alias("label")]
        if spec.weighted and weight and weight in df.columns:
            est = est.copy({est.weightCol: weight})
            cols.append(F.col(weight))
        if "row_id" in ready.columns:
            cols.append(F.col("row_id"))
        fitted[t] = est.fit(ready.select(*cols))
    return TargetModel(spec.name, shared, fitted, features, spec.log_target)


def fit_stacked_folds(spec: ModelSpec, draws: Sequence[Mapping], df: DataFrame, features: Iterable[str], targets: Iterable[str] = TARGETS) -> list[dict[int, TargetModel]]:
    """Per draw of parameters a model for every ``fold`` of ``df``, fitted on the others: all nets in the same jobs."""
    features, targets = list(features), list(targets)
    folds, shift = gather(df, features, targets, "fold")
    whole, scalers = total(folds.values()), {}
    for (fold,), own in folds.items():
        rest = whole - own
        mean = rest.sums[0, 1:len(features) + 1] / rest.sums[0, 0]
        spread = np.sqrt(np.clip(np.diag(rest.sums)[1:len(features) + 1] / rest.sums[0, 0] - mean ** 2, 0, None))
        scalers[fold] = mean + shift[:len(features)], np.where(spread > 0, spread, 1.0)
    labels = [F.log(t) if spec.log_target else F.col(t) for t in targets]
    rows = df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.array(*[c.cast("double") for c in labels]).alias("y"), F.col("fold").cast("int").alias("fold"))
    made = [spec.make(p) for p in draws]
    plan = [(d, fold, t) for d in range(len(draws)) for fold in scalers for t in range(len(targets))]
    states = train_nets(rows, [{"target": t, "without": fold, "shift": scalers[fold][0], "scale": scalers[fold][1], **made[d].settings()} for d, fold, t in plan])
    out: list[dict[int, TargetModel]] = [{} for _ in draws]
    inputs = [f"_z_{c}" for c in features]
    for (d, fold, t), state in zip(plan, states):
        if fold not in out[d]:
            scaler = AffineModel(inputCols=features, outputCols=inputs).with_state([(float(a), float(b)) for a, b in zip(*scalers[fold])])
            out[d][fold] = TargetModel(spec.name, [scaler, VectorAssembler(inputCols=inputs, outputCol="features")], {}, features, spec.log_target)
        out[d][fold].fitted[targets[t]] = made[d].model_of(state)._set(featuresCol="features", predictionCol=f"_p_{targets[t]}")
    return out


class TargetModel(Model):
    """Adds ``pred_<target>`` for each target; predictions are returned to the target's own scale."""

    def __init__(self, name: str, shared: list, fitted: dict, features: list[str], log_target: bool, lower: float | None = LOWER_BOUND):
        super().__init__()
        self.name, self.shared, self.fitted, self.features, self.log_target, self.lower = name, shared, fitted, features, log_target, lower

    def unclamped(self) -> TargetModel:
        return TargetModel(self.name, self.shared, self.fitted, self.features, self.log_target, None)

    def _transform(self, df: DataFrame) -> DataFrame:
        d = df
        for stage in self.shared:
            d = stage.transform(d)
        if self.fitted and all(isinstance(m, KnnModel) for m in self.fitted.values()):
            d = KnnModel.transform_together(list(self.fitted.values()), d)
        else:
            for m in self.fitted.values():
                d = m.transform(d)
        back = {}
        for t in self.fitted:
            p = F.exp(f"_p_{t}") if self.log_target else F.col(f"_p_{t}")
            back[f"pred_{t}"] = clamp(p, self.lower) if self.lower is not None else p
        return d.select(*df.columns, *[c.alias(n) for n, c in back.items()])

    def save(self, path: str) -> None:
        spark = next(iter(self.fitted.values())).refs.sparkSession if isinstance(next(iter(self.fitted.values())), KnnModel) else None
        PipelineModel(self.shared).write().overwrite().save(f"{path}/inputs")
        kinds = {}
        for t, m in self.fitted.items():
            if isinstance(m, KnnModel):
                m.save(f"{path}/{t}")
                kinds[t] = "knn"
            else:
                PipelineModel([m]).write().overwrite().save(f"{path}/{t}")
                kinds[t] = "stage"
        spark = spark or SparkSession.getActiveSession()
        meta = {"name": self.name, "features": self.features, "log_target": self.log_target, "lower": self.lower, "kinds": kinds}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> TargetModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        shared = PipelineModel.load(f"{path}/inputs").stages
        fitted = {t: KnnModel.load(spark, f"{path}/{t}") if kind == "knn" else PipelineModel.load(f"{path}/{t}").stages[0]
                  for t, kind in meta["kinds"].items()}
        return TargetModel(meta["name"], shared, fitted, meta["features"], meta["log_target"], meta["lower"])


class EnsembleModel(Model):
    """Weighted mean of the members' predictions, all columns added in one narrow pass."""

    def __init__(self, members: list[Model], weights: list[float], name: str = "ensemble", targets: Iterable[str] = TARGETS,
                 lower: float | None = LOWER_BOUND):
        super().__init__()
        self.members, self.weights, self.name, self.targets, self.lower = members, list(weights), name, tuple(targets), lower

    def _transform(self, df: DataFrame) -> DataFrame:
        d = wide_predictions([m.unclamped() if hasattr(m, "unclamped") else m for m in self.members], df, self.targets, "_e")
        total = sum(self.weights)
        out = {}
        for t in self.targets:
            p = sum((F.col(f"_e{i}_{t}") * F.lit(w / total) for i, w in enumerate(self.weights)), F.lit(0e0))
            out[f"pred_{t}"] = clamp(p, self.lower) if self.lower is not None else p
        return d.select(*df.columns, *[c.alias(n) for n, c in out.items()])

    def save(self, path: str) -> None:
        for i, m in enumerate(self.members):
            m.save(f"{path}/member_{i}")
        meta = {"name": self.name, "weights": [float(w) for w in self.weights], "targets": self.targets, "lower": self.lower}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> EnsembleModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        members = [TargetModel.load(spark, f"{path}/member_{i}") for i in range(len(meta["weights"]))]
        return EnsembleModel(members, meta["weights"], meta["name"], meta["targets"], meta["lower"])


def wide_predictions(models: Iterable[Model], df: DataFrame, targets: Iterable[str] = TARGETS, prefix: str = "_m") -> DataFrame:
    """Columns ``_m<i>_<target>`` of every model side by side, without joining predictions."""
    d = df
    for i, m in enumerate(models):
        d = m.transform(d).withColumnsRenamed({f"pred_{t}": f"{prefix}{i}_{t}" for t in targets})
    return d


def long_predictions(models: Mapping[str, Model], df: DataFrame, keys: Iterable[str], targets: Iterable[str] = TARGETS) -> DataFrame:
    """Rows (keys..., model, target, pred) of every model in one pass over ``df``."""
    names = list(models)
    d = wide_predictions([models[n] for n in names], df, targets)
    rows = [F.struct(F.lit(n).alias("model"), F.lit(t).alias("target"), F.col(f"_m{i}_{t}").alias("pred"),
                     *([F.col(t).alias("y")] if t in df.columns else []))
            for i, n in enumerate(names) for t in targets]
    return d.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")
