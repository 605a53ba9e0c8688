"""Regressors as Spark ML stages: ridge, nearest neighbours and a small dense net."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasWeightCol
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..operators.neighbors import knn_join
from ..params import SEED
from ..scale import attach, fits
from ..session import cut


#: Rows of one vector from which on its prediction is broadcast to them.
HOT_ROWS = 100_000


class _Regressor(HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    def _take(self, kwargs):
        self._set(**{k: v for k, v in kwargs.items() if v is not None})


class Ridge(Estimator, HasWeightCol, _Regressor):
    """Least squares with an L2 penalty ``alpha`` on already standardised inputs.

    Spark divides its penalty by the label's deviation and by the row count,
    so both are measured in one aggregate before the normal-equation solve.
    """

    alpha = Param(Params._dummy(), "alpha", "L2 penalty", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, weightCol=None, alpha=1.0):
        super().__init__()
        self._setDefault(alpha=1.0, featuresCol="features", labelCol="label", predictionCol="prediction")
        self._take(self._input_kwargs)

    def _fit(self, df: DataFrame):
        y = F.col(self.getLabelCol())
        w = F.col(self.getWeightCol()) if self.isDefined(self.weightCol) else F.lit(1e0)
        m = df.agg(F.sum(w).alias("n"), (F.sum(w * y) / F.sum(w)).alias("mu")).first()
        var = df.agg((F.sum(w * (y - F.lit(float(m["mu"]))) ** 2) / F.sum(w)).alias("v")).first()["v"]
        reg = self.getOrDefault(self.alpha) / m["n"] * float(np.sqrt(var))
        lr = LinearRegression(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol(),
                              elasticNetParam=0.0, regParam=reg, solver="normal", standardization=False)
        if self.isDefined(self.weightCol):
            lr = lr.setWeightCol(self.getWeightCol())
        return lr.fit(df)


class KnnRegressor(Estimator, _Regressor):
    """Mean of the k nearest training rows; ``distance`` weights by 1/d and lets exact matches decide alone."""

    k = Param(Params._dummy(), "k", "neighbours", typeConverter=TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", typeConverter=TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique row key, orders ties", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, k=5, weights="uniform", idCol=None):
        super().__init__()
        self._setDefault(k=5, weights="uniform", featuresCol="features", labelCol="label", predictionCol="prediction")
        self._take(self._input_kwargs)

    def _fit(self, df: DataFrame) -> KnnModel:
        vec = vector_to_array(self.getFeaturesCol())
        rid = F.col(self.getOrDefault(self.idCol))
        refs = df.select(rid.alias("rid"), vec.alias("vec"), F.col(self.getLabelCol()).alias("y"))
        return KnnModel(refs, self.getOrDefault(self.k), self.getOrDefault(self.weights),
                        self.getFeaturesCol(), self.getPredictionCol())

    def fit_together(self, df: DataFrame, labels: dict, features: str) -> dict:
        """A model per label over the same rows; together they look for neighbours once."""
        every = {f"y{i}": c for i, c in enumerate(labels.values())}
        refs = df.select(F.col(self.getOrDefault(self.idCol)).alias("rid"), vector_to_array(features).alias("vec"), *[c.alias(y) for y, c in every.items()])
        models = {name: KnnModel(refs.select("rid", "vec", F.col(y).alias("y")), self.getOrDefault(self.k), self.getOrDefault(self.weights),
                                 features, self.getPredictionCol()) for name, y in zip(labels, every)}
        for m in models.values():
            m.shared = refs
        return models


class KnnModel(Model):
    """Holds the training rows as a plan; nothing is brought to the driver."""

    def __init__(self, refs: DataFrame, k: int, weights: str, features: str, prediction: str):
        super().__init__()
        self.refs, self.k, self.weights, self.features, self.prediction = refs, k, weights, features, prediction
        self.shared: DataFrame | None = None  # the rows with the labels of all models fitted together

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._predicted(df, self.refs, {"y": self.prediction})

    @staticmethod
    def transform_together(models: list[KnnModel], df: DataFrame) -> DataFrame:
        """The predictions of all models: one search if they were fitted together, else one each."""
        first = models[0]
        if first.shared is not None and all(m.shared is first.shared for m in models):
            return first._predicted(df, first.shared, {f"y{i}": m.prediction for i, m in enumerate(models)})
        for m in models:
            df = m.transform(df)
        return df

    def _predicted(self, df: DataFrame, refs: DataFrame, wanted: dict[str, str]) -> DataFrame:
        d = df.withColumn("_vec", vector_to_array(self.features))
        met = cut(d.groupBy("_vec").agg(F.count(F.lit(1)).alias("_rows")))
        near = knn_join(met.select(F.col("_vec").alias("vec")), refs, self.k, list(wanted))

        def mean(y: str):
            if self.weights != "distance":
                return F.avg(y)
            exact = F.avg(F.when(F.col("dist") == 0, F.col(y)))
            inv = F.when(F.col("dist") > 0, F.lit(1e0) / F.col("dist"))
            return F.coalesce(exact, F.sum(inv * F.col(y)) / F.sum(inv))

        found = cut(near.groupBy(F.col("vec").alias("_vec")).agg(*[mean(y).alias(p) for y, p in wanted.items()]))
        if fits(found):
            return attach(d, found, "_vec").drop("_vec")
        # many vectors: their rows meet them by a shuffle; the few vectors with very many rows are broadcast
        hot = cut(met.filter(F.col("_rows") > HOT_ROWS).select("_vec"))
        hot_found = found.join(F.broadcast(hot), "_vec", "left_semi")
        cold = d.join(F.broadcast(hot), "_vec", "left_anti").join(found, "_vec")
        names = [*df.columns, *wanted.values()]
        return cold.select(*names).unionByName(d.join(F.broadcast(hot_found), "_vec").select(*names))

    def save(self, path: str) -> None:
        self.refs.write.mode("overwrite").parquet(f"{path}/rows")
        meta = json.dumps({"k": self.k, "weights": self.weights, "features": self.features, "prediction": self.prediction})
        self.refs.sparkSession.createDataFrame([(meta,)], "meta string").write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> KnnModel:
        m = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return KnnModel(spark.read.parquet(f"{path}/rows"), m["k"], m["weights"], m["features"], m["prediction"])


# --- dense net -------------------------------------------------------------

_ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1.0 - a * a),
}


def _shapes(sizes):
    return [((a, b), (b,)) for a, b in zip(sizes[:-1], sizes[1:])]


def _unflatten(theta, sizes):
    out, at = [], 0
    for (w, b) in _shapes(sizes):
        n = w[0] * w[1]
        out.append((theta[at:at + n].reshape(w), theta[at + n:at + n + b[0]]))
        at += n + b[0]
    return out


def _forward(layers, x, act):
    f = _ACTIVATIONS[act][0]
    seen = [x]
    for i, (w, b) in enumerate(layers):
        z = seen[-1] @ w + b
        seen.append(f(z) if i < len(layers) - 1 else z)
    return seen


def _gradient(theta, sizes, act, x, y):
    """Sum over rows of the squared-error gradient, and the sum of squared errors."""
    layers = _unflatten(theta, sizes)
    seen = _forward(layers, x, act)
    delta = seen[-1] - y[:, None]
    sse = float((delta ** 2).sum())
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(seen[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ layers[i][0].T) * _ACTIVATIONS[act][1](seen[i])
    return np.concatenate(parts[::-1]), sse


class MlpRegressor(Estimator, _Regressor):
    """Dense net trained by full-batch Adam.

    Each epoch is one Spark job, for one net or many (see ``train_nets``): every task adds up the gradient of its rows,
    the sums are added by parameter number in a shuffle, and the driver sees
    one number per parameter. A tenth of the rows (by hash) is held out; the
    best epoch on it wins, and training stops when it no longer improves.
    """

    layers = Param(Params._dummy(), "layers", "hidden sizes", typeConverter=TypeConverters.toListInt)
    activation = Param(Params._dummy(), "activation", "relu or tanh", typeConverter=TypeConverters.toString)
    lr = Param(Params._dummy(), "lr", "step size", typeConverter=TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "L2 penalty", typeConverter=TypeConverters.toFloat)
    epochs = Param(Params._dummy(), "epochs", "most epochs", typeConverter=TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "epochs without progress", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, layers=None, activation="relu", lr=0.01, l2=1e-4,
                 epochs=500, patience=10, seed=SEED):
        super().__init__()
        self._setDefault(layers=[50], activation="relu", lr=0.01, l2=1e-4, epochs=500, patience=10, seed=SEED,
                         featuresCol="features", labelCol="label", predictionCol="prediction")
        self._take(self._input_kwargs)

    def _fit(self, df: DataFrame) -> MlpModel:
        return self.fit_together(df, {None: F.col(self.getLabelCol())}, self.getFeaturesCol())[None]

    def settings(self) -> dict:
        g = self.getOrDefault
        return {"layers": g(self.layers), "act": g(self.activation), "lr": g(self.lr), "l2": g(self.l2), "epochs": g(self.epochs),
                "patience": g(self.patience), "seed": g(self.seed)}

    def fit_together(self, df: DataFrame, labels: dict, features: str) -> dict:
        """A net per label over the same rows, trained in the same jobs."""
        rows = df.select(vector_to_array(features).alias("x"), F.array(*[c.cast("double") for c in labels.values()]).alias("y"), F.lit(-1).alias("fold"))
        states = train_nets(rows, [{"target": i, **self.settings()} for i in range(len(labels))])
        return {name: self.model_of(state) for name, state in zip(labels, states)}

    def model_of(self, state: dict) -> MlpModel:
        model = MlpModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        return model._set(state=json.dumps(state))


#: Weights of all nets that one job an epoch adds up gradients for.
STACKED_WEIGHTS = 400_000


def train_nets(rows: DataFrame, fits: list[dict]) -> list[dict]:
    """Train several nets side by side: one Spark job an epoch for all of them, whatever targets, folds and settings they have.

    ``rows`` have inputs ``x``, one number per target ``y``, and ``fold``. A fit names its ``target``, the fold it is trained ``without`` (all
    rows if absent), the ``shift`` and ``scale`` of its inputs (none if absent), and a net's settings. A tenth of the rows, by the hash of
    their inputs, is held out of every fit and tells when it stops. A fit gets the same net alone or in company.
    """
    rows = cut(rows.withColumn("held", F.pmod(F.xxhash64("x"), F.lit(10)) == 0))
    width = rows.agg(F.max(F.size("x"))).first()[0]
    targets = rows.agg(F.max(F.size("y"))).first()[0]
    y = [F.col("y")[t] for t in range(targets)]
    sums = rows.filter(~F.col("held")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{e}{t}") for t, c in enumerate(y) for e, f in (("m", F.avg), ("v", F.var_pop))])
    parts = [r.asDict() for r in sums.collect()]

    def start(fit: dict) -> dict:
        mine, t = [r for r in parts if r["fold"] != fit.get("without")], fit["target"]
        n = sum(r["n"] for r in mine)
        mu = sum(r["n"] * r[f"m{t}"] for r in mine) / n
        sd = float(np.sqrt(sum(r["n"] * (r[f"v{t}"] + (r[f"m{t}"] - mu) ** 2) for r in mine) / n)) or 1.0
        sizes, act, rng = [width, *fit["layers"], 1], fit["act"], np.random.default_rng(fit["seed"])
        theta = np.concatenate([np.concatenate([
            rng.uniform(-1, 1, w[0] * w[1]) * np.sqrt((6.0 if act == "relu" else 2.0) / (w[0] + w[1])), np.zeros(b[0])]) for w, b in _shapes(sizes)])
        decay = np.concatenate([np.concatenate([np.ones(w[0] * w[1]), np.zeros(b[0])]) for w, b in _shapes(sizes)])
        return {**fit, "n": n, "mu": mu, "sd": sd, "sizes": sizes, "theta": theta, "decay": decay, "mom": np.zeros(len(theta)), "vel": np.zeros(len(theta)),
                "best": np.inf, "best_theta": theta, "stale": 0, "loss": [], "epoch": 0}

    nets, todo, live = [start(f) for f in fits], list(range(len(fits))), []
    while todo or live:
        while todo and (not live or sum(len(nets[k]["theta"]) for k in live) + len(nets[todo[0]]["theta"]) <= STACKED_WEIGHTS):
            live.append(todo.pop(0))
        sums = _epoch(rows, {k: {name: nets[k].get(name) for name in ("theta", "sizes", "act", "mu", "sd", "target", "without", "shift", "scale")} for k in live})
        live = [k for k in live if _learn(nets[k], sums[k])]
    return [{"theta": m["best_theta"].tolist(), "sizes": m["sizes"], "act": m["act"], "mu": m["mu"], "sd": m["sd"], "loss": m["loss"]} for m in nets]


def _epoch(rows: DataFrame, nets: dict[int, dict]) -> dict[int, np.ndarray]:
    """Per net the summed gradient, the squared error of its rows, and that of its held-out rows."""
    def run(batches):
        totals = {k: np.zeros(len(m["theta"]) + 2) for k, m in nets.items()}
        for pdf in batches:
            held, fold = pdf["held"].to_numpy(dtype=bool), pdf["fold"].to_numpy()
            x, y = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1), np.array(pdf["y"].tolist(), dtype=float).reshape(len(pdf), -1)
            for k, m in nets.items():
                mine = np.ones(len(pdf), bool) if m["without"] is None else fold != m["without"]
                z = x if m["scale"] is None else (x - m["shift"]) / m["scale"]
                v = (y[:, m["target"]] - m["mu"]) / m["sd"]
                learn, check = mine & ~held, mine & held
                if learn.any():
                    grad, sse = _gradient(m["theta"], m["sizes"], m["act"], z[learn], v[learn])
                    totals[k][:-2] += grad
                    totals[k][-2] += sse
                if check.any():
                    totals[k][-1] += float(((_forward(_unflatten(m["theta"], m["sizes"]), z[check], m["act"])[-1][:, 0] - v[check]) ** 2).sum())
        for k, total in totals.items():
            yield pd.DataFrame({"f": np.full(len(total), k), "i": np.arange(len(total)), "g": total})

    found = rows.mapInPandas(run, "f int, i int, g double").groupBy("f", "i").agg(F.sum("g").alias("g")).toPandas()
    out = {k: np.zeros(len(m["theta"]) + 2) for k, m in nets.items()}
    for k, part in found.groupby("f"):
        out[k][part["i"].to_numpy()] = part["g"].to_numpy()
    return out


def _learn(m: dict, s: np.ndarray) -> bool:
    """One step of Adam; whether the net goes on."""
    m["epoch"] += 1
    grad = s[:-2] / m["n"] + m["l2"] * m["decay"] * m["theta"] / m["n"]
    held_loss = s[-1] if s[-1] else s[-2]
    m["loss"].append(float(s[-2] / m["n"]))
    if held_loss < m["best"] * (1 - 1e-4):
        m["best"], m["best_theta"], m["stale"] = held_loss, m["theta"].copy(), 0
    else:
        m["stale"] += 1
        if m["stale"] >= m["patience"]:
            return False
    t = m["epoch"]
    m["mom"], m["vel"] = 0.9 * m["mom"] + 0.1 * grad, 0.999 * m["vel"] + 0.001 * grad ** 2
    m["theta"] = m["theta"] - m["lr"] * (m["mom"] / (1 - 0.9 ** t)) / (np.sqrt(m["vel"] / (1 - 0.999 ** t)) + 1e-8)
    return t < m["epochs"]


class MlpModel(Model, _Regressor):
    state = Param(Params._dummy(), "state", "weights as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol=None, predictionCol=None):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self._take(self._input_kwargs)

    @property
    def losses(self) -> list[float]:
        return json.loads(self.getOrDefault(self.state))["loss"]

    def _transform(self, df: DataFrame) -> DataFrame:
        s = json.loads(self.getOrDefault(self.state))
        theta, sizes, act, mu, sd = np.array(s["theta"]), s["sizes"], s["act"], s["mu"], s["sd"]

        @F.pandas_udf("double")
        def predict(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), dtype=float).reshape(len(v), sizes[0])
            return pd.Series(_forward(_unflatten(theta, sizes), x, act)[-1][:, 0] * sd + mu)

        return df.withColumn(self.getPredictionCol(), predict(vector_to_array(self.getFeaturesCol())))
