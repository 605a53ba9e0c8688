"""Aggregates, joins, orderings, sets and preparation (A4-A17, J, K, U, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.physics import snap
from ..operators import prepare as pr, relational as rl, stats as st, timeseries as ts
from ..session import cut
from .base import query, rnd, rounded, valid, with_v
from .signal import S, smooth

# A predictor both engines can state.
P = """, sc AS (SELECT v.*, 3e-2 + 4e-4*load_n + 5e-2*conc AS pred, 3e-2 + 4e-4*load_n + 5e-2*conc - cof AS residual,
  abs(3e-2 + 4e-4*load_n + 5e-2*conc - cof) AS abs_err FROM v)"""


def scored(spark, sf):
    """Rows with a closed-form prediction, its residual and absolute error."""
    d = valid(spark, sf)
    pred = F.lit(3e-2) + F.lit(4e-4) * F.col("load_n") + F.lit(5e-2) * F.col("conc")
    d = d.withColumn("pred", pred)
    return d.withColumn("residual", F.col("pred") - F.col("cof")).withColumn("abs_err", F.abs(F.col("pred") - F.col("cof")))


# Three closed-form "models" x two targets x two splits, long.
L = P + """, lg AS (SELECT run_id, seq, 'plane' AS model, target, y, pred, CASE WHEN seq % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM (
  SELECT run_id, seq, 'cof' AS target, cof AS y, 3e-2 + 4e-4*load_n + 5e-2*conc AS pred FROM v
  UNION ALL SELECT run_id, seq, 'fai', fai, 7e-1 + 2e-3*load_n + 1e-3*temp_c FROM v)
 UNION ALL SELECT run_id, seq, 'level', target, y, pred, CASE WHEN seq % 10 = 0 THEN 'test' ELSE 'train' END FROM (
  SELECT run_id, seq, 'cof' AS target, cof AS y, 7e-2 + 1e-5*temp_c AS pred FROM v
  UNION ALL SELECT run_id, seq, 'fai', fai, 12e-1 + 1e-3*temp_c FROM v)
 UNION ALL SELECT run_id, seq, 'flag', target, y, pred, CASE WHEN seq % 10 = 0 THEN 'test' ELSE 'train' END FROM (
  SELECT run_id, seq, 'cof' AS target, cof AS y, 6e-2 + 1e-2*ester AS pred FROM v
  UNION ALL SELECT run_id, seq, 'fai', fai, 11e-1 + 1e-1*ester FROM v))"""


def predictions(spark, sf):
    """Long (model, split, target, y, pred) rows; a narrow explode, so the scan happens once."""
    d = valid(spark, sf)
    col = F.col
    forms = {
        "plane": (F.lit(3e-2) + F.lit(4e-4) * col("load_n") + F.lit(5e-2) * col("conc"),
                  F.lit(7e-1) + F.lit(2e-3) * col("load_n") + F.lit(1e-3) * col("temp_c")),
        "level": (F.lit(7e-2) + F.lit(1e-5) * col("temp_c"), F.lit(12e-1) + F.lit(1e-3) * col("temp_c")),
        "flag": (F.lit(6e-2) + F.lit(1e-2) * col("ester"), F.lit(11e-1) + F.lit(1e-1) * col("ester")),
    }
    rows = [F.struct(F.lit(m).alias("model"), F.lit(t).alias("target"), F.col(t).alias("y"), p.alias("pred"))
            for m, ps in forms.items() for t, p in zip(("cof", "fai"), ps)]
    split = F.when(col("seq") % 10 == 0, "test").otherwise("train").alias("split")
    return d.select("run_id", "seq", split, F.explode(F.array(*rows)).alias("r")).select("run_id", "seq", "split", "r.*")


@query("sample_weights", with_v(""", g AS (SELECT *, count(*) OVER (PARTITION BY conc, round_even(load_n, 0), round_even(temp_c, 0), ester) AS c FROM v)
SELECT run_id, seq, round(sqrt(1e0/c) * (SELECT count(*)/sum(sqrt(1e0/c)) FROM g), 9) AS weight FROM g"""))
def sample_weights(spark, sf):
    return rounded(st.sample_weights(valid(spark, sf)).select("run_id", "seq", "weight"))


_SP = ", sp AS (SELECT run_id, avg(conc) AS conc, avg(load_n) AS load_n, avg(temp_c) AS temp_c, arg_min(ester, seq) AS ester FROM v GROUP BY run_id)"


@query("run_setpoints", with_v(_SP + " SELECT run_id, round(conc, 9) AS conc, round(load_n, 9) AS load_n, round(temp_c, 9) AS temp_c, ester FROM sp"))
def run_setpoints(spark, sf):
    return rounded(st.run_setpoints(valid(spark, sf)))


@query("setpoint_distribution", with_v(_SP + """ SELECT CAST(round_even(temp_c/5e0, 0)*5 AS INT) AS temp_c, CAST(round_even(load_n/5e0, 0)*5 AS INT) AS load_n,
  round_even(conc*100e0, 0)/100e0 AS conc, ester, count(*) AS n_runs FROM sp GROUP BY 1, 2, 3, 4"""))
def setpoint_distribution(spark, sf):
    return st.setpoint_distribution(valid(spark, sf))


@query("high_cof_counts", with_v("SELECT run_id, count(*) AS n_rows FROM v WHERE cof > 26e-2 GROUP BY ROLLUP (run_id)"))
def high_cof_counts(spark, sf):
    return st.high_counts(valid(spark, sf))


_DC = ("time_s", "load_n", "temp_c", "conc", "ester", "cof", "fai")


@query("describe", with_v(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM v""" for c in _DC)))
def describe(spark, sf):
    return rounded(st.describe(valid(spark, sf), _DC), 6)


_CI = ("time_s", "load_n", "temp_c", "conc", "ester")


@query("correlation", with_v(" UNION ALL ".join(
    f"SELECT '{t}' AS target, '{i}' AS input, round(corr({t}, {i}), 9) AS r FROM v" for t in ("cof", "fai") for i in _CI)))
def correlation(spark, sf):
    return rounded(st.correlation(valid(spark, sf), ("cof", "fai"), _CI))


@query("histogram", with_v(""", b AS (SELECT min(cof) AS a, max(cof) AS z FROM v),
h AS (SELECT CAST(least(14, floor((cof-a)/(z-a)*15)) AS INT) AS bin, count(*) AS n FROM v, b GROUP BY 1)
SELECT CAST(i AS INT) AS bin, round(a + i*((z-a)/15e0), 9) AS lo, round(a + (i+1)*((z-a)/15e0), 9) AS hi, coalesce(n, 0) AS n_rows
FROM b, (SELECT unnest(range(15)) AS i) LEFT JOIN h ON h.bin = i"""))
def histogram(spark, sf):
    return rounded(st.histogram(valid(spark, sf), "cof", 15))


@query("box_stats", with_v(""", q AS (SELECT ester, quantile_cont(cof, 0.25) AS q1, quantile_cont(cof, 0.5) AS md, quantile_cont(cof, 0.75) AS q3 FROM v GROUP BY ester)
SELECT ester, round(min(q1), 9) AS q1, round(min(md), 9) AS median, round(min(q3), 9) AS q3,
  round(min(CASE WHEN cof BETWEEN q1-15e-1*(q3-q1) AND q3+15e-1*(q3-q1) THEN cof END), 9) AS whisker_lo,
  round(max(CASE WHEN cof BETWEEN q1-15e-1*(q3-q1) AND q3+15e-1*(q3-q1) THEN cof END), 9) AS whisker_hi,
  count(CASE WHEN NOT cof BETWEEN q1-15e-1*(q3-q1) AND q3+15e-1*(q3-q1) THEN 1 END) AS n_outliers
FROM v JOIN q USING (ester) GROUP BY ester"""))
def box_stats(spark, sf):
    return rounded(st.box_stats(valid(spark, sf), "cof", "ester"))


_ST = S + """, st AS (SELECT run_id, avg(cof) AS cof, avg(load_n) AS load_n, avg(temp_c) AS temp_c, CAST(arg_min(ester, seq) AS INT) AS ester
  FROM (SELECT *, max(time_s) OVER (PARTITION BY run_id) AS e FROM s) WHERE time_s >= e - 300 GROUP BY run_id)"""


@query("flag_effect", with_v(_ST + """ SELECT l AS load_n, t AS temp_c, ester, round(avg(cof), 12) AS mean, round(stddev_samp(cof), 12) AS std, count(*) AS n_runs
  FROM (SELECT round_even(load_n, 0) AS l, round_even(temp_c, 0) AS t, ester, cof FROM st) GROUP BY GROUPING SETS ((l, ester), (t, ester))"""))
def flag_effect(spark, sf):
    steady = ts.steady_state(smooth(spark, sf)).withColumn("ester", F.col("ester").cast("int"))
    return rounded(st.flag_effect(steady), 12)


@query("error_by_run", with_v(P + """ SELECT run_id, count(*) AS n_rows, round(avg(time_s), 6) AS avg_time, round(avg(load_n), 9) AS avg_load,
  round(avg(temp_c), 9) AS avg_temp FROM sc WHERE abs(residual) > 5e-2 GROUP BY run_id"""))
def error_by_run(spark, sf):
    return rounded(st.error_by_run(scored(spark, sf)), avg_time=6)


@query("range_rmse", with_v(P + """ SELECT cof > 26e-2 AS is_high, round(sqrt(avg(residual*residual)), 9) AS rmse, count(*) AS n_rows FROM sc GROUP BY 1"""))
def range_rmse(spark, sf):
    return rounded(st.range_rmse(scored(spark, sf), y="cof"))


_TM = L + """, tm AS (SELECT model, split, target, count(*) AS n, 1 - sum((pred-y)*(pred-y))/(var_pop(y)*count(y)) AS r2, avg((pred-y)*(pred-y)) AS mse,
  avg(abs(pred-y)) AS mae FROM lg GROUP BY 1, 2, 3)"""


@query("regression_metrics", with_v(_TM + """ SELECT model, split, target, n AS n_rows, round(r2, 8) AS r2, round(sqrt(mse), 9) AS rmse, round(mae, 9) AS mae FROM tm
UNION ALL SELECT model, split, 'all', CAST(sum(n) AS BIGINT), round(avg(r2), 8), round(sqrt(avg(mse)), 9), round(avg(mae), 9) FROM tm GROUP BY 1, 2"""))
def regression_metrics(spark, sf):
    return rounded(st.regression_metrics(predictions(spark, sf)), r2=8)


@query("run_minmax_score", with_v(""", b AS (SELECT min(cof) AS a, max(cof) AS z, min(fai) AS c, max(fai) AS y FROM v)
SELECT run_id, seq, round((cof-a)/(z-a+1e-9) + (fai-c)/(y-c+1e-9), 9) AS score FROM v, b"""))
def run_minmax_score(spark, sf):
    return rounded(st.minmax_score(valid(spark, sf)).select("run_id", "seq", "score"))


@query("metric_cube", with_v(L + """ SELECT model, split, target, count(*) AS n_rows, round(sqrt(avg((pred-y)*(pred-y))), 9) AS rmse,
  round(avg(abs(pred-y)), 9) AS mae FROM lg GROUP BY CUBE (model, split, target)"""))
def metric_cube(spark, sf):
    return rounded(st.metric_cube(predictions(spark, sf)))


# --- joins -----------------------------------------------------------------

@query("group_stat_join", with_v(""", b AS (SELECT run_id, avg(cof) AS mu, stddev_pop(cof) AS sd FROM v GROUP BY run_id)
SELECT run_id, seq, round((cof-mu)/(sd+1e-9), 7) AS z FROM v JOIN b USING (run_id)"""))
def group_stat_join(spark, sf):
    d = valid(spark, sf)
    stats = d.groupBy("run_id").agg(F.avg("cof").alias("mu"), F.stddev_pop("cof").alias("sd"))
    out = rl.attach_stats(d, stats)
    return out.select("run_id", "seq", rnd((F.col("cof") - F.col("mu")) / (F.col("sd") + F.lit(1e-9)), 7).alias("z"))


@query("split_semi", with_v("""SELECT run_id, seq, round(cof, 9) AS cof FROM v WHERE run_id IN (SELECT run_id FROM v GROUP BY run_id HAVING avg(cof) > 7e-2)"""))
def split_semi(spark, sf):
    d = valid(spark, sf)
    chosen = d.groupBy("run_id").agg(F.avg("cof").alias("mu")).filter(F.col("mu") > 7e-2)
    return rounded(rl.runs_subset(d, chosen).select("run_id", "seq", "cof"))


# axes of the measured campaign: distinct concentrations, load and temperature levels
_AX = """, ax AS (SELECT list_sort(list(DISTINCT CAST(round_even(conc*100e0, 0) AS INT))) AS cs, list_sort(list(DISTINCT CAST(round_even(load_n/5e0, 0)*5 AS INT))) AS ls,
  list_sort(list(DISTINCT CAST(round_even(temp_c/5e0, 0)*5 AS INT))) AS tl FROM v),
gr AS (SELECT c/100e0 AS conc, CAST(l AS DOUBLE) AS load_n, CAST(t AS DOUBLE) AS temp_c, e AS ester FROM
  (SELECT unnest(cs) AS c FROM ax), (SELECT unnest(ls) AS l FROM ax), (SELECT unnest(tl) AS t FROM ax), (SELECT unnest([0, 1]) AS e))"""


def grid(d):
    """Every combination of the concentration, load and temperature levels that were measured."""
    axes = {"ester": d.sparkSession.createDataFrame([(0,), (1,)], "ester int"),
            "conc": d.select(F.rint(F.col("conc") * 100) / F.lit(100e0)), "load_n": d.select(snap("load_n", 5)), "temp_c": d.select(snap("temp_c", 5))}
    return cut(rl.setpoint_grid(d.sparkSession, axes).select("point_id", "conc", "load_n", "temp_c", "ester"))


@query("setpoint_cross", with_v(_AX + " SELECT * FROM gr"))
def setpoint_cross(spark, sf):
    return grid(valid(spark, sf)).drop("point_id")


@query("novel_setpoints", with_v(_AX + """ SELECT gr.* FROM gr ANTI JOIN
  (SELECT DISTINCT CAST(round_even(conc*100, 0) AS INT) AS c, CAST(trunc(load_n) AS INT) AS l, CAST(trunc(temp_c) AS INT) AS t, ester AS e FROM v) k
  ON CAST(round_even(gr.conc*100, 0) AS INT) = k.c AND CAST(trunc(gr.load_n) AS INT) = k.l AND CAST(trunc(gr.temp_c) AS INT) = k.t AND gr.ester = k.e"""))
def novel_setpoints(spark, sf):
    d = valid(spark, sf)
    return rl.novel(grid(d), d).drop("point_id")


@query("zip_tables", with_v(""" SELECT run_id, a.n AS n_rows, round(a.mu, 9) AS cof, b.n AS n_high, round(b.mu, 9) AS high FROM
  (SELECT run_id, count(*) AS n, avg(cof) AS mu FROM v GROUP BY run_id) a FULL JOIN
  (SELECT run_id, count(*) AS n, avg(cof) AS mu FROM v WHERE cof > 26e-2 GROUP BY run_id) b USING (run_id)"""))
def zip_tables(spark, sf):
    d = valid(spark, sf)
    a = d.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("cof").alias("cof"))
    b = d.filter(F.col("cof") > 26e-2).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_high"), F.avg("cof").alias("high"))
    return rounded(rl.align(a, b, "run_id"))


@query("state_compare", with_v("""SELECT temp_c, round(c0, 9) AS cof_0, round(c1, 9) AS cof_1, round(c0-c1, 9) AS cof_gain FROM
  (SELECT round_even(temp_c/5e0, 0)*5 AS temp_c, avg(CASE WHEN ester = 0 THEN cof END) AS c0, avg(CASE WHEN ester = 1 THEN cof END) AS c1 FROM v GROUP BY 1)"""))
def state_compare(spark, sf):
    d = valid(spark, sf).withColumn("temp_c", snap("temp_c", 5))
    return rounded(rl.compare_states(d, ["temp_c"], values=["cof"]))


@query("model_lookup", with_v(_TM + " SELECT model, target, round(r2, 8) AS r2 FROM tm WHERE split = 'test' AND model IN ('plane', 'flag')"))
def model_lookup(spark, sf):
    m = st.target_metrics(predictions(spark, sf)).filter("split = 'test'")
    return rounded(rl.pick_models(m, ["plane", "flag"]).select("model", "target", "r2"), 8)


# --- orderings and sets ----------------------------------------------------

@query("top_models", with_v(_TM + """, o AS (SELECT model, avg(r2) AS r2_cv FROM tm WHERE split = 'test' GROUP BY model),
k AS (SELECT *, row_number() OVER (ORDER BY r2_cv DESC, model) AS place FROM o),
b AS (SELECT min(CASE WHEN model IN ('plane') THEN place END) AS sm FROM k)
SELECT model, round(r2_cv, 8) AS r2_cv, CASE WHEN sm > 2 AND place = sm THEN 2 ELSE place END AS place FROM k, b
WHERE CASE WHEN sm > 2 THEN place < 2 OR place = sm ELSE place <= 2 END"""))
def top_models(spark, sf):
    m = st.target_metrics(predictions(spark, sf)).filter("split = 'test'").groupBy("model").agg(F.avg("r2").alias("r2_cv"))
    out = rl.top_models(m, 2, ("plane",)).select("model", "r2_cv", F.col("place").cast("bigint").alias("place"))
    return rounded(out, 8)


@query("argmin_row", with_v("SELECT run_id, seq, round(cof, 9) AS cof FROM v ORDER BY cof, seq LIMIT 1"))
def argmin_row(spark, sf):
    return rounded(rl.arg_row(valid(spark, sf).select("run_id", "seq", "cof"), "cof", "seq"))


@query("argmax_row", with_v("""SELECT run_id, seq, round(fai, 9) AS fai FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY fai DESC, seq) AS p FROM v)
  WHERE p = 1"""))
def argmax_row(spark, sf):
    return rounded(rl.arg_row(valid(spark, sf).select("run_id", "seq", "fai"), "fai", "seq", "max", "run_id"))


@query("sorted_report", with_v("SELECT run_id, count(*) AS n_rows, round(max(cof), 9) AS worst FROM v GROUP BY run_id"))
def sorted_report(spark, sf):
    d = valid(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("cof").alias("worst"))
    return rl.sorted_report(rounded(d), "n_rows", ["run_id"])


@query("least_error_keep", with_v(P + """ SELECT run_id, seq, round(abs_err, 9) AS abs_err FROM
  (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY abs_err, seq) AS p FROM sc) WHERE p = 1"""))
def least_error_keep(spark, sf):
    return rounded(rl.keep_least_error(scored(spark, sf).select("run_id", "seq", "abs_err")))


@query("concat_states", with_v("""SELECT run_id, seq, e AS ester, round(conc, 9) AS conc FROM v, (SELECT unnest([0, 1]) AS e)"""))
def concat_states(spark, sf):
    d = valid(spark, sf).select("run_id", "seq", "conc")
    return rounded(rl.stack([d.withColumn("ester", F.lit(0)), d.withColumn("ester", F.lit(1))]))


@query("exclude_chosen", with_v("""SELECT run_id, seq FROM v WHERE (run_id, seq) NOT IN
  (SELECT run_id, seq FROM (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY cof, seq) AS p FROM v) WHERE p = 1)"""))
def exclude_chosen(spark, sf):
    d = valid(spark, sf)
    best = rl.arg_row(d.select("run_id", "seq", "cof"), "cof", "seq", "min", "run_id")
    return rl.exclude(d, best, ["run_id", "seq"]).select("run_id", "seq")


@query("retained_vs_excluded", with_v(P + """ SELECT abs_err <= 5e-2 AS retained, count(*) AS n_rows, round(avg(cof), 9) AS cof,
  round(max(abs_err), 9) AS worst FROM sc GROUP BY 1"""))
def retained_vs_excluded(spark, sf):
    kept, lost = rl.split_mask(scored(spark, sf), F.col("abs_err") <= 5e-2)
    both = rl.stack([kept.withColumn("retained", F.lit(True)), lost.withColumn("retained", F.lit(False))])
    return rounded(both.groupBy("retained").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("cof").alias("cof"), F.max("abs_err").alias("worst")))


# --- preparation -----------------------------------------------------------

BINS = _SP + """, e AS (SELECT quantile_cont(load_n, 1/3e0) AS l1, quantile_cont(load_n, 2/3e0) AS l2, quantile_cont(temp_c, 1/3e0) AS t1, quantile_cont(temp_c, 2/3e0) AS t2 FROM sp),
qb AS (SELECT run_id, (CASE WHEN load_n > l1 THEN 1 ELSE 0 END) + (CASE WHEN load_n > l2 THEN 1 ELSE 0 END) AS load_n_bin,
  (CASE WHEN temp_c > t1 THEN 1 ELSE 0 END) + (CASE WHEN temp_c > t2 THEN 1 ELSE 0 END) AS temp_c_bin FROM sp, e)"""


def binned(spark, sf):
    return pr.quantile_bins(st.run_setpoints(valid(spark, sf)), ["load_n", "temp_c"])


@query("quantile_bins", with_v(BINS + " SELECT * FROM qb"))
def quantile_bins(spark, sf):
    return binned(spark, sf).select("run_id", "load_n_bin", "temp_c_bin")


SPLIT = """, sz AS (SELECT load_n_bin, temp_c_bin, count(*) AS n FROM qb GROUP BY 1, 2),
w AS (SELECT *, ceil(1e-1*sum(n) OVER ()) AS want, sum(n) OVER () AS total FROM sz),
b AS (SELECT *, floor(want*n/total) AS base, want*n/total - floor(want*n/total) AS rem FROM w),
qt AS (SELECT load_n_bin, temp_c_bin, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, load_n_bin, temp_c_bin) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY load_n_bin, temp_c_bin ORDER BY md5(concat(run_id, '#42')), run_id) AS p FROM qb)"""


@query("stratified_run_split", with_v(BINS + SPLIT + " SELECT run_id, load_n_bin, temp_c_bin, p <= quota AS is_test FROM o JOIN qt USING (load_n_bin, temp_c_bin)"))
def stratified_run_split(spark, sf):
    out = pr.stratified_run_split(binned(spark, sf), ["load_n_bin", "temp_c_bin"])
    return out.select("run_id", "load_n_bin", "temp_c_bin", "is_test")


@query("group_kfold", with_v(""", r AS (SELECT run_id, count(*) AS n_rows FROM v GROUP BY run_id),
o AS (SELECT *, row_number() OVER (ORDER BY n_rows DESC, run_id) - 1 AS p FROM r)
SELECT run_id, CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INT) AS fold, n_rows FROM o"""))
def group_kfold(spark, sf):
    return pr.group_kfold(valid(spark, sf))


@query("group_shuffle_split", with_v(""", r AS (SELECT DISTINCT run_id FROM v), s AS (SELECT run_id, i AS split FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS i))
SELECT split, run_id, row_number() OVER (PARTITION BY split ORDER BY md5(concat(run_id, '#42#', CAST(split AS VARCHAR))), run_id)
  <= ceil(1e-1*count(*) OVER (PARTITION BY split)) AS is_test FROM s"""))
def group_shuffle_split(spark, sf):
    return pr.group_shuffle_split(valid(spark, sf))


@query("quantile_outliers", with_v(""", q AS (SELECT run_id, quantile_cont(cof, 0.01) AS a, quantile_cont(cof, 0.99) AS b, quantile_cont(fai, 0.01) AS c,
  quantile_cont(fai, 0.99) AS d FROM v GROUP BY run_id)
SELECT run_id, seq, round(cof, 9) AS cof, round(fai, 9) AS fai FROM v JOIN q USING (run_id) WHERE cof BETWEEN a AND b AND fai BETWEEN c AND d"""))
def quantile_outliers(spark, sf):
    return rounded(pr.quantile_outliers(valid(spark, sf), "run_id", ["cof", "fai"]).select("run_id", "seq", "cof", "fai"))


@query("residual_anomalies", with_v(P + """, a AS (SELECT *, count(CASE WHEN abs_err <= 1e-4 THEN 1 END) OVER (PARTITION BY run_id) AS ok,
  row_number() OVER (PARTITION BY run_id ORDER BY abs_err, seq) AS p FROM sc)
SELECT run_id, seq, round(abs_err, 9) AS abs_err FROM a WHERE abs_err <= 1e-4 OR (ok = 0 AND p = 1)"""))
def residual_anomalies(spark, sf):
    out = pr.residual_filter(scored(spark, sf), 1e-4)
    return rounded(out.select("run_id", "seq", "abs_err"))


@query("setpoint_features", with_v("""SELECT run_id, seq, round(ln(time_s), 9) AS log_time, round(time_s*time_s, 3) AS time_squared,
  round(3e0*load_n/(2e0*pi()*power(cbrt(3e0*load_n*5e0/(4e0*(210000e0/(2e0*(1e0-9e-2))))), 2)), 6) AS hertz_mpa FROM v"""))
def setpoint_features(spark, sf):
    from ..models.stages import SetpointFeatures

    out = SetpointFeatures().transform(valid(spark, sf))
    return rounded(out.select("run_id", "seq", "log_time", "time_squared", "hertz_mpa"), time_squared=3, hertz_mpa=6)


@query("vif", with_v(""", r AS (SELECT corr(load_n, temp_c) AS a, corr(load_n, conc) AS b, corr(temp_c, conc) AS c FROM v),
d AS (SELECT *, 1 + 2*a*b*c - a*a - b*b - c*c AS det FROM r)
SELECT 'load_n' AS feature, round((1-c*c)/det, 8) AS vif FROM d UNION ALL SELECT 'temp_c', round((1-b*b)/det, 8) FROM d
UNION ALL SELECT 'conc', round((1-a*a)/det, 8) FROM d"""))
def vif(spark, sf):
    return rounded(pr.vif(valid(spark, sf), ["load_n", "temp_c", "conc"]), 8)


@query("vif_select")
def vif_select(spark, sf):
    from ..models.stages import ALL_FEATURES, InteractionFeatures, SetpointFeatures, VifSelector

    d = SetpointFeatures().transform(valid(spark, sf))
    d = cut(InteractionFeatures().fit(d).transform(d))
    model = VifSelector(inputCols=list(ALL_FEATURES)).fit(d)
    return spark.createDataFrame([(c, c in model.kept) for c in ALL_FEATURES], "feature string, kept boolean")



_TRIO = ["hertz_mpa", "load_n", "load_n_div_temp_c"]
_HZ = "3e0*load_n/(2e0*pi()*power(cbrt(3e0*load_n*5e0/(4e0*(210000e0/(2e0*(1e0-9e-2))))), 2))"


# the worst free column goes while it is inflated; the load may not go
@query("vif_prune", with_v(f""", z AS (SELECT {_HZ} AS h, load_n AS l, load_n/(temp_c + 1e-6) AS q FROM v),
c AS (SELECT corr(h, l) AS hl, corr(h, q) AS hq, corr(l, q) AS lq FROM z), d AS (SELECT *, 1 + 2*hl*hq*lq - hl*hl - hq*hq - lq*lq AS det FROM c),
o AS (SELECT *, (1-lq*lq)/det AS vh, (1-hl*hl)/det AS vq FROM d),
t AS (SELECT *, CASE WHEN greatest(vh, vq) <= 5 THEN 'none' WHEN vh >= vq THEN 'h' ELSE 'q' END AS gone FROM o),
k AS (SELECT gone <> 'h' AND NOT (gone = 'q' AND 1/(1-hl*hl) > 5) AS h, gone <> 'q' AND NOT (gone = 'h' AND 1/(1-lq*lq) > 5) AS q FROM t)
SELECT 'hertz_mpa' AS feature, h AS kept FROM k UNION ALL SELECT 'load_n', true UNION ALL SELECT 'load_n_div_temp_c', q FROM k"""))
def vif_prune(spark, sf):
    from ..models.stages import InteractionFeatures, SetpointFeatures, VifSelector

    d = SetpointFeatures().transform(valid(spark, sf))
    model = VifSelector(inputCols=_TRIO).fit(cut(InteractionFeatures().fit(d).transform(d)))
    return spark.createDataFrame([(c, c in model.kept) for c in _TRIO], "feature string, kept boolean")
