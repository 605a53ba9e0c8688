"""Model training, selection and scoring (M), ingest and stage queries (S6-S8)."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.physics import add_features
from ..models import selection as sel
from ..models.learners import KnnRegressor
from ..models.registry import REGISTRY, EnsembleModel, fit_model, wide_predictions
from ..models.stages import ALL_FEATURES, InteractionFeatures, VifSelector
from ..operators import prepare as pr, relational as rl, stats as st, timeseries as ts
from ..params import Params
from ..schema import EVENTS_SCHEMA, measurements
from ..session import cut, shared_dir
from ..sources.report import write_report
from ..sources.stage import stage
from ..streaming.ingest import ingest_stream, read_clean
from .base import ORACLES, query, rnd, rounded, table, valid, with_v
from .signal import S, smooth  # signal registers the clean_runs SQL first
from .tables import _TM, P, predictions

FEATURES = ["time_s", "load_n", "temp_c", "conc", "ester"]
_SMALL = {"n_estimators": 8, "max_depth": 5}


def training(spark, sf):
    """Smoothed rows with derived inputs, weights and a row key."""
    d = add_features(smooth(spark, sf).withColumn("ester", F.col("ester").cast("int")))
    d = st.sample_weights(d)
    return cut(d.withColumn("row_id", F.concat_ws("#", "run_id", F.lpad(F.col("seq").cast("string"), 12, "0"))))


def halves(spark, sf):
    """Train and test rows by run."""
    d = training(spark, sf)
    marks = pr.stratified_run_split(pr.quantile_bins(st.run_setpoints(d), ["load_n", "temp_c"]), ["load_n_bin", "temp_c_bin"])
    d = cut(rl.attach_stats(d, marks.select("run_id", "is_test")))
    return d.filter(~F.col("is_test")), d.filter("is_test")


def stub(name_cof: str, name_fai: str) -> SQLTransformer:
    """A closed-form predictor as an ML stage."""
    return SQLTransformer(statement=f"SELECT *, {name_cof} AS pred_cof, {name_fai} AS pred_fai FROM __THIS__")


def stubs():
    """The closed-form models both engines know, by name."""
    return {
        "plane": stub("3e-2 + 4e-4*load_n + 5e-2*conc", "7e-1 + 2e-3*load_n + 1e-3*temp_c"),
        "level": stub("7e-2 + 1e-5*temp_c", "12e-1 + 1e-3*temp_c"),
        "flag": stub("6e-2 + 1e-2*ester", "11e-1 + 1e-1*ester"),
    }


@query("ridge", with_v(""", a AS (SELECT avg(load_n) AS ml, stddev_pop(load_n) AS sl, avg(temp_c) AS mt, stddev_pop(temp_c) AS st,
  corr(load_n, temp_c) AS r, avg(cof) AS my, count(*) AS n, covar_pop(cof, load_n)/stddev_pop(load_n) AS c1, covar_pop(cof, temp_c)/stddev_pop(temp_c) AS c2 FROM v),
b AS (SELECT *, ((1+1000/n)*c1 - r*c2)/((1+1000/n)*(1+1000/n) - r*r) AS b1, ((1+1000/n)*c2 - r*c1)/((1+1000/n)*(1+1000/n) - r*r) AS b2 FROM (SELECT * REPLACE (CAST(n AS DOUBLE) AS n) FROM a))
SELECT run_id, seq, round(my + b1*(load_n-ml)/sl + b2*(temp_c-mt)/st, 8) AS pred FROM v, b"""))
def ridge(spark, sf):
    d = valid(spark, sf)
    model = fit_model(REGISTRY["ridge"], {"alpha": 1000.0}, d, ["load_n", "temp_c"], ["cof"]).unclamped()
    return model.transform(d).select("run_id", "seq", rnd("pred_cof", 8).alias("pred"))


def _family(spark, sf, params, names):
    """Scores and timings of the families; they are fitted side by side, scored and timed one after the other."""
    train, test = halves(spark, sf)
    with ThreadPoolExecutor(len(names)) as pool:
        models = dict(zip(names, pool.map(lambda n: fit_model(REGISTRY[n], params, train, FEATURES), names)))
    return sel.model_scores(models, {"train": train, "test": test})


def _small_family(spark, sf, *names):
    return _family(spark, sf, _SMALL, names).drop("score_ms", "n_scored")


@query("random_forest")
def random_forest(spark, sf):
    return _small_family(spark, sf, "forest")


@query("gbt")
def gbt(spark, sf):
    return _small_family(spark, sf, "boosted_a", "boosted_b", "boosted_c")


@query("mlp_regress")
def mlp_regress(spark, sf):
    return _small_family(spark, sf, "mlp")


@query("knn_regress", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS DOUBLE) AS y FROM embeddings),
d AS (SELECT a.vec_id, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS p FROM e a, e b)
SELECT vec_id, round(avg(y), 9) AS pred FROM d WHERE p <= 5 GROUP BY vec_id""")
def knn_regress(spark, sf):
    d = table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
                                              F.col("label").cast("double").alias("label"))
    model = KnnRegressor(k=5, idCol="vec_id").fit(d)
    return model.transform(d).select("vec_id", rnd("prediction").alias("pred"))


@query("param_importance", """WITH t AS (SELECT event_type AS model, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
  CASE WHEN user_id % 2 = 0 THEN 'relu' ELSE 'tanh' END AS act, value/1000e0 AS s FROM events),
b AS (SELECT model, min(k) AS lo, max(k) AS hi, avg(s) AS mu, var_pop(s) AS va, count(*) AS n FROM t GROUP BY model),
g AS (SELECT model, 'k' AS param, least(2, floor((k-lo)/(hi-lo)*3)) AS l, count(*) AS c, avg(s) AS m FROM t JOIN b USING (model) GROUP BY 1, 2, 3
  UNION ALL SELECT model, 'act', CASE WHEN act = 'relu' THEN 0 ELSE 1 END, count(*), avg(s) FROM t GROUP BY 1, 2, 3)
SELECT model, param, round(sum(c*(m-mu)*(m-mu))/min(n*va), 9) AS importance FROM g JOIN b USING (model) GROUP BY 1, 2""")
def param_importance(spark, sf):
    e = table(spark, sf, "events")
    params = F.create_map(F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1),
                          F.lit("act"), F.when(F.col("user_id") % 2 == 0, "relu").otherwise("tanh"))
    trials = e.select(F.col("event_type").alias("model"), params.alias("params"), (F.col("value") / F.lit(1000e0)).alias("r2_cv"))
    return rounded(sel.param_importance(trials))


@query("model_scores")
def model_scores(spark, sf):
    """Every family with its own settings: metrics by split and target, and what scoring took."""
    return _family(spark, sf, {}, list(REGISTRY))


_STEADY = """, o AS (SELECT run_id, avg(cof) AS cof, avg(fai) AS fai FROM (SELECT *, max(time_s) OVER (PARTITION BY run_id) AS e FROM v) WHERE time_s >= e - 300 GROUP BY run_id),
f AS (SELECT run_id, arg_min(load_n, seq) AS load_n, arg_min(temp_c, seq) AS temp_c, arg_min(conc, seq) AS conc FROM v GROUP BY run_id),
z AS (SELECT 'cof' AS target, cof AS y, 3e-2 + 4e-4*load_n + 5e-2*conc AS pred FROM o JOIN f USING (run_id)
  UNION ALL SELECT 'fai', fai, 7e-1 + 2e-3*load_n + 1e-3*temp_c FROM o JOIN f USING (run_id)),
t AS (SELECT target, count(*) AS n, 1 - sum((pred-y)*(pred-y))/(var_pop(y)*count(y)) AS r2, avg((pred-y)*(pred-y)) AS mse, avg(abs(pred-y)) AS mae FROM z GROUP BY 1)"""


@query("steady_accuracy", with_v(_STEADY + """ SELECT 'plane' AS model, target, n AS n_rows, round(r2, 7) AS r2, round(sqrt(mse), 9) AS rmse, round(mae, 9) AS mae FROM t
UNION ALL SELECT 'plane', 'all', CAST(sum(n) AS BIGINT), round(avg(r2), 7), round(sqrt(avg(mse)), 9), round(avg(mae), 9) FROM t"""))
def steady_accuracy(spark, sf):
    out = sel.steady_accuracy({"plane": stubs()["plane"]}, valid(spark, sf))
    return rounded(out.select("model", "target", "n_rows", "r2", "rmse", "mae"), r2=7)


_W3 = ", w3 AS (SELECT *, 3e-2 + 4e-4*load_n + 5e-2*conc AS a0, 7e-2 + 1e-5*temp_c AS a1, 6e-2 + 1e-2*ester AS a2, " \
      "7e-1 + 2e-3*load_n + 1e-3*temp_c AS f0, 12e-1 + 1e-3*temp_c AS f1, 11e-1 + 1e-1*ester AS f2 FROM v)"


_MOMENTS = ["g00", "g01", "g02", "g11", "g12", "g22"]


@query("ensemble_moments", with_v(_W3 + " " + " UNION ALL ".join(
    f"SELECT 'g{i}{j}' AS term, round(sum(a{i}*a{j} + f{i}*f{j})/count(*), 8) AS value FROM w3" for i in range(3) for j in range(i, 3))
    + "".join(f" UNION ALL SELECT 'b{i}', round(sum(a{i}*cof + f{i}*fai)/count(*), 8) FROM w3" for i in range(3))))
def ensemble_moments(spark, sf):
    """The moments the blend weights are solved from."""
    d = wide_predictions(list(stubs().values()), valid(spark, sf))
    g, b, _, n = sel.gram_sums(d, 3)
    n //= 2
    rows = [(f"g{i}{j}", float(g[i, j] / n)) for i in range(3) for j in range(i, 3)] + [(f"b{i}", float(b[i] / n)) for i in range(3)]
    return rounded(spark.createDataFrame(rows, "term string, value double"), 8)


# the best blend lies in a corner, on an edge or inside: all seven candidates, the admissible one of least loss
_BLEND = _W3 + ", mo AS (SELECT " + ", ".join(f"avg(a{g[1]}*a{g[2]} + f{g[1]}*f{g[2]}) AS {g}" for g in _MOMENTS) + ", " + ", ".join(
    f"avg(a{i}*cof + f{i}*fai) AS b{i}" for i in range(3)) + """ FROM w3),
ca AS (SELECT *, 1e0 AS w0, 0e0 AS w1, 0e0 AS w2 FROM mo UNION ALL SELECT *, 0, 1, 0 FROM mo UNION ALL SELECT *, 0, 0, 1 FROM mo
  UNION ALL SELECT * EXCLUDE (t), t, 1-t, 0 FROM (SELECT *, (b0-b1-g01+g11)/(g00-2*g01+g11) AS t FROM mo)
  UNION ALL SELECT * EXCLUDE (t), t, 0, 1-t FROM (SELECT *, (b0-b2-g02+g22)/(g00-2*g02+g22) AS t FROM mo)
  UNION ALL SELECT * EXCLUDE (t), 0, t, 1-t FROM (SELECT *, (b1-b2-g12+g22)/(g11-2*g12+g22) AS t FROM mo)
  UNION ALL SELECT * EXCLUDE (p, q, r, c, d), (c*r-d*q)/(p*r-q*q), (d*p-c*q)/(p*r-q*q), 1 - (c*r-d*q)/(p*r-q*q) - (d*p-c*q)/(p*r-q*q) FROM
    (SELECT *, g00-2*g02+g22 AS p, g01-g02-g12+g22 AS q, g11-2*g12+g22 AS r, b0-b2-g02+g22 AS c, b1-b2-g12+g22 AS d FROM mo)),
be AS (SELECT * FROM ca WHERE w0 >= -1e-9 AND w1 >= -1e-9 AND w2 >= -1e-9
  ORDER BY w0*w0*g00 + w1*w1*g11 + w2*w2*g22 + 2*(w0*w1*g01 + w0*w2*g02 + w1*w2*g12) - 2*(w0*b0 + w1*b1 + w2*b2) LIMIT 1)"""


@query("ensemble_weights", with_v(_BLEND + """ SELECT 'plane' AS model, round(w0, 6) + 0e0 AS weight FROM be UNION ALL SELECT 'level', round(w1, 6) + 0e0 FROM be
  UNION ALL SELECT 'flag', round(w2, 6) + 0e0 FROM be"""))
def ensemble_weights(spark, sf):
    weights = sel.ensemble_weights(list(stubs().values()), valid(spark, sf))
    return rounded(spark.createDataFrame([(n, float(w)) for n, w in zip(stubs(), weights)], "model string, weight double"), 6)


@query("ensemble_predict", with_v(_W3 + """ SELECT run_id, seq, round(greatest(5e-1*a0 + 3e-1*a1 + 2e-1*a2, 1e-3), 9) AS pred_cof,
  round(greatest(5e-1*f0 + 3e-1*f1 + 2e-1*f2, 1e-3), 9) AS pred_fai FROM w3"""))
def ensemble_predict(spark, sf):
    out = EnsembleModel(list(stubs().values()), [0.5, 0.3, 0.2]).transform(valid(spark, sf))
    return rounded(out.select("run_id", "seq", "pred_cof", "pred_fai"))


@query("best_model", with_v(_TM + """ SELECT model, round(r2_cv, 8) AS r2_cv FROM (SELECT model, avg(r2) AS r2_cv FROM tm WHERE split = 'train' GROUP BY model)
  ORDER BY r2_cv DESC, model LIMIT 1"""))
def best_model(spark, sf):
    m = st.target_metrics(predictions(spark, sf)).filter("split = 'train'").groupBy("model").agg(F.avg("r2").alias("r2_cv"))
    return rounded(sel.best_model(m.withColumn("m", F.col("model")), model="m").drop("m"), 8)


@query("feature_importance")
def feature_importance(spark, sf):
    d = training(spark, sf)
    d = InteractionFeatures().fit(d).transform(d)
    kept = VifSelector(inputCols=list(ALL_FEATURES)).fit(d).kept
    return sel.feature_importance(fit_model(REGISTRY["forest"], _SMALL, d, kept))


@query("top_features", with_v("SELECT 'cof' AS target, * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(corr({c}, cof)), 9) AS importance FROM v" for c in FEATURES) + ") ORDER BY importance DESC, feature LIMIT 3"))
def top_features(spark, sf):
    """Strongest inputs by absolute correlation."""
    d = st.correlation(valid(spark, sf), ["cof"], FEATURES)
    return rl.top_features(d.select("target", F.col("input").alias("feature"), rnd(F.abs("r")).alias("importance")))


def _run_in(spark, sf):
    d = valid(spark, sf)
    return sel.run_in_model(ts.run_in_time(d).select("run_id", "run_in_s").join(ts.first_row(d), "run_id"))


@query("run_in_model")
def run_in_model(spark, sf):
    return _run_in(spark, sf)[1]


@query("run_in_trends")
def run_in_trends(spark, sf):
    return sel.run_in_trends(_run_in(spark, sf)[0], spark)


@query("actual_vs_predicted", with_v(P + """ SELECT run_id, seq, 'plane' AS model, 'cof' AS target, round(cof, 9) AS y, round(greatest(pred, 1e-3), 9) AS pred,
  round(greatest(pred, 1e-3) - cof, 9) AS residual FROM sc"""))
def actual_vs_predicted(spark, sf):
    out = sel.scored_pairs({"plane": EnsembleModel([stubs()["plane"]], [1.0])}, valid(spark, sf), ["run_id", "seq"])
    return rounded(out.filter("target = 'cof'"))


# --- ingest, report, stages ------------------------------------------------

def _fresh(spark, kind):
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@query("incremental_ingest", ORACLES["clean_runs"])
def incremental_ingest(spark, sf):
    """Two deliveries of which every run has a part in both."""
    base = _fresh(spark, "ingest")
    events = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf}/events.parquet")
    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        stream = ingest_stream(spark, f"{base}/in", f"{base}/checkpoint", f"{base}/rows", EVENTS_SCHEMA, "parquet",
                               Params(downsample=5, rolling=4), shape=measurements)
        stream.awaitTermination()
    return rounded(read_clean(spark, f"{base}/rows"), time_s=6)


@query("write_tables", with_v(""" SELECT 'steady' AS name, count(*) AS n_rows, round(sum(cof), 8) AS total FROM
  (SELECT run_id, avg(cof) AS cof FROM (SELECT *, max(time_s) OVER (PARTITION BY run_id) AS e FROM v) WHERE time_s >= e - 300 GROUP BY run_id)
UNION ALL SELECT 'errors', count(*), round(sum(mx), 8) FROM (SELECT run_id, max(cof) AS mx FROM v GROUP BY run_id)"""))
def write_tables(spark, sf):
    d = valid(spark, sf)
    tables = {"steady": ts.steady_state(d).select("run_id", "cof"), "errors": d.groupBy("run_id").agg(F.max("cof").alias("cof"))}
    paths = write_report(tables, _fresh(spark, "report"))
    back = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.sum("cof"), 8).alias("total")).withColumn("name", F.lit(n))
            for n, p in paths.items()]
    return rl.stack(back)


@query("stage_checkpoint", with_v(S + " SELECT run_id, seq, round(cof, 12) AS cof FROM s"))
def stage_checkpoint(spark, sf):
    """Built, stored, and read again from the stored stage."""
    base = _fresh(spark, "stage")
    again = [stage(lambda: smooth(spark, sf), base, "smooth-4", origin=valid(spark, sf)) for _ in range(2)][1]
    return rounded(again.select("run_id", "seq", "cof"), 12)

