"""Decision and explanation queries (D, J5, J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.physics import snap
from ..models.registry import long_predictions
from ..operators import relational as rl, timeseries as ts
from ..operators.neighbors import nearest_distance
from ..plans import decide as dc, explain as ex, scenarios as sc
from ..session import cut
from .base import query, rounded, valid, with_v
from .tables import _AX, grid
from .training import stub, stubs


def points(spark, sf):
    """Every measured row as a candidate setpoint, numbered by its position key."""
    return valid(spark, sf).withColumn("point_id", F.col("seq"))


def _front_sql(by: str = "") -> str:
    p, j = (f"PARTITION BY {by} ", f"AND b.{by} = v.{by}") if by else ("", "")
    cols = f"{by}, " if by else ""
    return f""", g AS (SELECT {cols}cof, min(fai) AS f FROM v GROUP BY {cols}cof),
h AS (SELECT *, min(f) OVER ({p}ORDER BY cof ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g),
fr AS (SELECT v.* FROM v JOIN (SELECT * FROM h WHERE prev IS NULL OR f < prev) b ON v.cof = b.cof AND v.fai = b.f {j})"""


@query("pareto_front", with_v(_front_sql() + " SELECT run_id, seq, round(cof, 9) AS cof, round(fai, 9) AS fai FROM fr"))
def pareto_front(spark, sf):
    return rounded(dc.pareto_front(points(spark, sf)).select("run_id", "seq", "cof", "fai"))


@query("dominance_anti", with_v(""" SELECT run_id, seq, conc FROM (SELECT run_id, seq, round(conc, 9) AS conc, cof, time_s FROM v) a
  WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.cof <= a.cof AND b.time_s <= a.time_s AND (b.cof < a.cof OR b.time_s < a.time_s))"""))
def dominance_anti(spark, sf):
    return rounded(dc.pareto_front(points(spark, sf), "cof", "time_s").select("run_id", "seq", "conc"))


@query("pareto_by_category", with_v(_front_sql("ester") + """ SELECT ester, seq AS point_id, round(conc, 9) AS conc,
  round_even(load_n/5e0, 0)*5 AS load_n, round_even(temp_c/5e0, 0)*5 AS temp_c, round(cof, 9) AS cof, round(fai, 9) AS fai FROM fr"""))
def pareto_by_category(spark, sf):
    d = points(spark, sf)
    front = dc.pareto_front(d.select("point_id", "ester", "cof", "fai"), by="ester")
    labels = d.select("point_id", "conc", snap("load_n", 5).alias("load_n"), snap("temp_c", 5).alias("temp_c"))
    return rounded(dc.annotated_front(front, labels))


@query("knee_point", with_v(_front_sql("ester") + """, e AS (SELECT ester, min(cof) AS x0, max(cof) AS x1, min(fai) AS y1, max(fai) AS y0, count(*) AS n FROM fr GROUP BY ester),
k AS (SELECT fr.ester, seq, cof, fai, CASE WHEN n > 2 THEN abs((x1-x0)/(x1-x0+1e-9)*((fai-y1)/(y0-y1+1e-9) - (y0-y1)/(y0-y1+1e-9)) + (y0-y1)/(y0-y1+1e-9)*(cof-x0)/(x1-x0+1e-9))
  / sqrt(power((x1-x0)/(x1-x0+1e-9), 2) + power((y0-y1)/(y0-y1+1e-9), 2)) ELSE 0e0 END AS d FROM fr JOIN e USING (ester))
SELECT ester, seq AS point_id, round(cof, 9) AS cof, round(fai, 9) AS fai, round(d, 8) AS knee_distance FROM
  (SELECT *, row_number() OVER (PARTITION BY ester ORDER BY d DESC, cof, seq) AS p FROM k) WHERE p = 1"""))
def knee_point(spark, sf):
    front = dc.pareto_front(points(spark, sf).select("point_id", "ester", "cof", "fai"), by="ester")
    return rounded(dc.knee_point(front, by="ester"), knee_distance=8)


_OPT = """, b AS (SELECT ester, min(cof) AS a, max(cof) AS z, min(fai) AS c, max(fai) AS y FROM v GROUP BY ester),
op AS (SELECT * FROM (SELECT v.*, (cof-a)/(z-a+1e-9) + (fai-c)/(y-c+1e-9) AS score FROM v JOIN b USING (ester))
  QUALIFY row_number() OVER (PARTITION BY ester ORDER BY score, seq) = 1)"""


def optima(spark, sf):
    return dc.scalar_optimum(points(spark, sf))


@query("scalar_optimum", with_v(_OPT + " SELECT ester, seq AS point_id, round(cof, 9) AS cof, round(fai, 9) AS fai, round(score, 8) AS score FROM op"))
def scalar_optimum(spark, sf):
    return rounded(optima(spark, sf).select("ester", "point_id", "cof", "fai", "score"), score=8)


def drifting():
    """A closed-form predictor that settles over time."""
    return stub("3e-2 + 4e-4*load_n + 5e-2*conc + 2e-1/ln(time_s)", "7e-1 + 2e-3*load_n + 1e-1/ln(time_s)")


@query("expected_tail_value", with_v(""" SELECT run_id, round(avg(3e-2 + 4e-4*l + 5e-2*c + 2e-1/ln(t)), 9) AS tail_cof, round(avg(7e-1 + 2e-3*l + 1e-1/ln(t)), 9) AS tail_fai
  FROM (SELECT run_id, arg_min(load_n, seq) AS l, arg_min(conc, seq) AS c FROM v GROUP BY run_id), (SELECT CAST(unnest(range(6900, 7201, 10)) AS DOUBLE) AS t) GROUP BY run_id"""))
def expected_tail_value(spark, sf):
    return rounded(dc.tail_value(drifting(), ts.first_row(valid(spark, sf)), key="run_id"))


@query("optimum_curve", with_v(_OPT + """, tm AS (SELECT seq, time_s FROM v WHERE run_id = (SELECT min(run_id) FROM v)),
cv AS (SELECT op.seq AS point_id, tm.seq AS step, tm.time_s, 3e-2 + 4e-4*op.load_n + 5e-2*op.conc + 2e-1/ln(tm.time_s) AS cof FROM op, tm),
w AS (SELECT point_id, step, time_s, avg(cof) OVER (PARTITION BY point_id ORDER BY step ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS s,
  row_number() OVER (PARTITION BY point_id ORDER BY step DESC) AS p, count(*) OVER (PARTITION BY point_id) AS n FROM cv),
t AS (SELECT point_id, avg(s) AS mu, greatest(3e0*stddev_pop(s), 5e-2*avg(s)) AS tol FROM w WHERE p <= greatest(100, floor(1e-1*n)) GROUP BY point_id)
SELECT point_id, round(coalesce(max(CASE WHEN abs(s-mu) > tol THEN time_s END), 0e0), 6) AS run_in_s, round(max(mu), 9) AS final_mean, round(max(tol), 9) AS tolerance
FROM w JOIN t USING (point_id) GROUP BY point_id"""))
def optimum_curve(spark, sf):
    d = valid(spark, sf)
    best = optima(spark, sf).select("point_id", "time_s", "load_n", "temp_c", "conc", "ester")
    first = d.agg(F.min("run_id")).first()[0]
    _, run_in = dc.optimum_curve(drifting(), best, d, first)
    return rounded(run_in, run_in_s=6)


@query("stability", with_v(""", c AS (SELECT seq, load_n AS l, temp_c AS t, conc AS c, 3e-2 + 4e-4*load_n + 5e-2*conc AS r FROM v),
k AS (SELECT seq, max(abs(3e-2 + 4e-4*(l*(1+a*1e-1)) + 5e-2*c - r)/r) AS d FROM c, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)
  WHERE NOT (a = 0 AND b = 0) GROUP BY seq)
SELECT seq AS point_id, round(d, 9) AS max_deviation, CASE WHEN d < 5e-2 THEN 'Stable' ELSE 'Unstable' END AS status FROM k"""))
def stability(spark, sf):
    d = points(spark, sf)
    ref = F.lit(3e-2) + F.lit(4e-4) * F.col("load_n") + F.lit(5e-2) * F.col("conc")
    pts = d.select("point_id", "load_n", "temp_c", "conc", "ester", ref.alias("tail_cof"))
    return rounded(dc.stability(stubs()["plane"], pts))


_DIS = """, pr AS (SELECT seq, ester, 'cof' AS target, 3e-2 + 4e-4*load_n + 5e-2*conc AS p0, 7e-2 + 1e-5*temp_c AS p1, 6e-2 + 1e-2*ester AS p2 FROM v
  UNION ALL SELECT seq, ester, 'fai', 7e-1 + 2e-3*load_n + 1e-3*temp_c, 12e-1 + 1e-3*temp_c, 11e-1 + 1e-1*ester FROM v),
sp AS (SELECT seq, target, sqrt((power(p0-(p0+p1+p2)/3e0, 2) + power(p1-(p0+p1+p2)/3e0, 2) + power(p2-(p0+p1+p2)/3e0, 2))/3e0) AS s FROM pr),
ra AS (SELECT target, min(s) AS lo, max(s) AS hi FROM sp GROUP BY target),
un AS (SELECT seq, avg((s-lo)/(hi-lo+1e-9)) AS u FROM sp JOIN ra USING (target) GROUP BY seq)"""


@query("model_disagreement", with_v(_DIS + " SELECT seq AS point_id, round(u, 8) AS uncertainty FROM un"))
def model_disagreement(spark, sf):
    preds = long_predictions(stubs(), points(spark, sf).drop("cof", "fai"), ["point_id"])
    return rounded(dc.disagreement(preds), 8)


_NEAR = _AX + """, b AS (SELECT min(conc) AS c0, max(conc)-min(conc) AS c1, min(load_n) AS l0, max(load_n)-min(load_n) AS l1, min(temp_c) AS t0, max(temp_c)-min(temp_c) AS t1 FROM gr),
ms AS (SELECT DISTINCT (conc-c0)/c1 AS c, (load_n-l0)/l1 AS l, (temp_c-t0)/t1 AS t, CAST(ester AS DOUBLE) AS e FROM v, b),
nd AS (SELECT gr.conc, gr.load_n, gr.temp_c, gr.ester, min(sqrt(power((gr.conc-c0)/c1-c, 2) + power((gr.load_n-l0)/l1-l, 2) + power((gr.temp_c-t0)/t1-t, 2) + power(gr.ester-e, 2))) AS d
  FROM gr, b, ms GROUP BY 1, 2, 3, 4)"""


@query("nearest_distance", with_v(_NEAR + " SELECT conc, load_n, temp_c, ester, round(d, 9) AS distance FROM nd"))
def nearest(spark, sf):
    d = valid(spark, sf)
    g, m = dc.scaled_setpoints(grid(d), d)
    out = nearest_distance(g, m, ["_s_conc", "_s_load_n", "_s_temp_c", "_s_ester"])
    return rounded(out.select("conc", "load_n", "temp_c", "ester", "distance"))


@query("sparsity", with_v(_NEAR + " SELECT conc, load_n, temp_c, ester, round((d-(SELECT min(d) FROM nd))/((SELECT max(d)-min(d) FROM nd)+1e-9), 8) AS sparsity FROM nd"))
def sparsity(spark, sf):
    d = valid(spark, sf)
    return rounded(dc.sparsity(grid(d), d).select("conc", "load_n", "temp_c", "ester", "sparsity"), 8)


def candidates(spark, sf):
    """The campaign's grid with distances, disagreement of the closed-form models and their mean prediction, each state for itself."""
    d = valid(spark, sf)
    g = grid(d)
    preds = long_predictions(stubs(), g, ["point_id", "ester"])
    return d, g, cut(dc.design_candidates(preds, g, d))


_GP = {"cof": ("3e-2 + 4e-4*load_n + 5e-2*conc", "7e-2 + 1e-5*temp_c", "6e-2 + 1e-2*ester"),
       "fai": ("7e-1 + 2e-3*load_n + 1e-3*temp_c", "12e-1 + 1e-3*temp_c", "11e-1 + 1e-1*ester")}
_SD = "sqrt((power({0}-({0}+{1}+{2})/3e0, 2) + power({1}-({0}+{1}+{2})/3e0, 2) + power({2}-({0}+{1}+{2})/3e0, 2))/3e0)"
# candidates of each state, then five rounds: the best of each state, and distances to it
_DOE = _AX + """, gi AS (SELECT row_number() OVER (ORDER BY ester, conc, load_n, temp_c) - 1 AS point_id, * FROM gr),
b AS (SELECT min(conc) AS c0, max(conc)-min(conc) AS c1, min(load_n) AS l0, max(load_n)-min(load_n) AS l1, min(temp_c) AS t0, max(temp_c)-min(temp_c) AS t1 FROM gr),
ms AS (SELECT DISTINCT (conc-c0)/c1 AS c, (load_n-l0)/l1 AS l, (temp_c-t0)/t1 AS t, ester FROM v, b),
gs AS (SELECT gi.*, (conc-c0)/c1 AS c, (load_n-l0)/l1 AS l, (temp_c-t0)/t1 AS t, """ + ", ".join(
    _SD.format(*(f"({p})" for p in ps)) + f" AS u_{t}" for t, ps in _GP.items()) + """ FROM gi, b),
nd AS (SELECT point_id, min(sqrt(power(gs.c-ms.c, 2) + power(gs.l-ms.l, 2) + power(gs.t-ms.t, 2))) AS d FROM gs JOIN ms USING (ester) GROUP BY 1),
un AS (SELECT *, ((u_cof - min(u_cof) OVER g)/(max(u_cof) OVER g - min(u_cof) OVER g + 1e-9) + (u_fai - min(u_fai) OVER g)/(max(u_fai) OVER g - min(u_fai) OVER g + 1e-9))/2e0 AS u
  FROM gs WINDOW g AS (PARTITION BY ester)),
kn AS (SELECT DISTINCT CAST(round_even(conc*100, 0) AS INT) AS kc, CAST(trunc(load_n) AS INT) AS kl, CAST(trunc(temp_c) AS INT) AS kt, ester AS ke FROM v),
p0 AS (SELECT un.*, d FROM un JOIN nd USING (point_id) ANTI JOIN kn
  ON CAST(round_even(conc*100, 0) AS INT) = kc AND CAST(trunc(load_n) AS INT) = kl AND CAST(trunc(temp_c) AS INT) = kt AND ester = ke)""" + "".join(f""",
q{i} AS (SELECT *, (d - min(d) OVER g)/(max(d) OVER g - min(d) OVER g + 1e-9) AS n FROM p{i - 1} WINDOW g AS (PARTITION BY ester)),
b{i} AS (SELECT {i} AS place, *, 5e-1*u + 5e-1*n AS score FROM q{i} QUALIFY row_number() OVER (PARTITION BY ester ORDER BY 5e-1*u + 5e-1*n DESC, point_id) = 1),
p{i} AS (SELECT p.* REPLACE (least(p.d, sqrt(power(p.c-b.c, 2) + power(p.l-b.l, 2) + power(p.t-b.t, 2))) AS d) FROM p{i - 1} p JOIN b{i} b USING (ester)
  WHERE p.point_id <> b.point_id)""" for i in range(1, 6)) + ", pk AS (" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(1, 6)) + ")"


@query("doe_sequential", with_v(_DOE + """ SELECT place, point_id, conc, load_n, temp_c, CAST(ester AS DOUBLE) AS ester, round(u, 8) AS uncertainty,
  round(u_cof, 9) AS uncertainty_cof, round(u_fai, 9) AS uncertainty_fai, round(d, 8) AS distance, round(n, 8) AS norm_distance, round(score, 8) AS score FROM pk"""))
def doe_sequential(spark, sf):
    d, g, cands = candidates(spark, sf)
    picks = dc.doe_sequential(rl.novel(cands, d), d, scale_on=g, by="ester", carry=["uncertainty_cof", "uncertainty_fai"], distance="distance")
    return rounded(picks, 8, uncertainty_cof=9, uncertainty_fai=9)


@query("doe_curves", with_v(_DOE + """ SELECT point_id, v.seq AS step, round(v.time_s, 6) AS time_s,
  round(3e-2 + 4e-4*pk.load_n + 5e-2*pk.conc + 2e-1/ln(v.time_s), 8) AS cof FROM pk, v WHERE v.run_id = (SELECT min(run_id) FROM v)"""))
def doe_curves(spark, sf):
    d, g, cands = candidates(spark, sf)
    picks = dc.doe_sequential(rl.novel(cands, d), d, scale_on=g, by="ester", carry=["uncertainty_cof", "uncertainty_fai"], distance="distance")
    first = d.agg(F.min("run_id")).first()[0]
    return rounded(dc.doe_curves(drifting(), picks, d, first), 8, time_s=6)


@query("safe_point", with_v(_DIS + """, cd AS (SELECT ester, seq, u, abs(load_n - 100e0) AS d, 3e-2 + 4e-4*load_n + 5e-2*conc AS p FROM v JOIN un USING (seq)),
q AS (SELECT ester, quantile_cont(d, 0.25) AS qd, quantile_cont(u, 0.25) AS qu FROM cd GROUP BY ester)
SELECT ester, seq AS point_id, round(p, 9) AS pred FROM cd JOIN q USING (ester) WHERE d < qd AND u < qu QUALIFY row_number() OVER (PARTITION BY ester ORDER BY p, seq) = 1"""))
def safe_point(spark, sf):
    d = points(spark, sf)
    unc = dc.disagreement(long_predictions(stubs(), d.drop("cof", "fai"), ["point_id"]))
    pred = F.lit(3e-2) + F.lit(4e-4) * F.col("load_n") + F.lit(5e-2) * F.col("conc")
    c = d.select("point_id", "ester", F.abs(F.col("load_n") - F.lit(100e0)).alias("distance"), pred.alias("pred")).join(unc, "point_id")
    return rounded(dc.safe_point(c, by="ester").select("ester", "point_id", "pred"))


_FIRST = "f AS (SELECT run_id, arg_min(load_n, seq) AS load_n, arg_min(temp_c, seq) AS temp_c, arg_min(conc, seq) AS conc FROM v GROUP BY run_id)"


@query("trend_sweep", with_v(f""", {_FIRST}, s AS (SELECT run_id, i AS step, e AS ester, load_n, conc, 40e0 + i*(80e0/19e0) AS temp_c FROM f, (SELECT unnest(range(20)) AS i), (SELECT unnest([0, 1]) AS e))
SELECT run_id, CAST(step AS INT) AS step, ester, round(temp_c, 6) AS temp_c, model, round(pred, 9) AS pred FROM (
  SELECT *, 'plane' AS model, 3e-2 + 4e-4*load_n + 5e-2*conc AS pred FROM s UNION ALL SELECT *, 'level', 7e-2 + 1e-5*temp_c FROM s UNION ALL SELECT *, 'flag', 6e-2 + 1e-2*ester FROM s)"""))
def trend_sweep(spark, sf):
    pts = sc.sweep(ts.first_row(valid(spark, sf)), "temp_c", 40, 120)
    out = long_predictions(stubs(), pts, ["run_id", "step", "ester", "temp_c"]).filter("target = 'cof'").drop("target")
    return rounded(out, temp_c=6)


@query("trend_sweep_load", with_v(f""", {_FIRST}, s AS (SELECT run_id, i AS step, e AS ester, temp_c, conc, 10e0 + i*(190e0/19e0) AS load_n FROM f, (SELECT unnest(range(20)) AS i), (SELECT unnest([0, 1]) AS e))
SELECT run_id, CAST(step AS INT) AS step, ester, round(load_n, 6) AS load_n, model, round(pred, 9) AS pred FROM (
  SELECT *, 'plane' AS model, 3e-2 + 4e-4*load_n + 5e-2*conc AS pred FROM s UNION ALL SELECT *, 'level', 7e-2 + 1e-5*temp_c FROM s UNION ALL SELECT *, 'flag', 6e-2 + 1e-2*ester FROM s)"""))
def trend_sweep_load(spark, sf):
    pts = sc.sweep(ts.first_row(valid(spark, sf)), "load_n", 10, 200)
    out = long_predictions(stubs(), pts, ["run_id", "step", "ester", "load_n"]).filter("target = 'cof'").drop("target")
    return rounded(out, load_n=6)


@query("trend_sweep_conc", with_v(f""", {_FIRST}, s AS (SELECT run_id, i AS step, e AS ester, load_n, temp_c, i*(6e-1/19e0) AS conc FROM f, (SELECT unnest(range(20)) AS i), (SELECT unnest([0, 1]) AS e))
SELECT run_id, CAST(step AS INT) AS step, ester, round(conc, 6) AS conc, model, round(pred, 9) AS pred FROM (
  SELECT *, 'plane' AS model, 3e-2 + 4e-4*load_n + 5e-2*conc AS pred FROM s UNION ALL SELECT *, 'level', 7e-2 + 1e-5*temp_c FROM s UNION ALL SELECT *, 'flag', 6e-2 + 1e-2*ester FROM s)"""))
def trend_sweep_conc(spark, sf):
    pts = sc.sweep(ts.first_row(valid(spark, sf)), "conc", 0, 0.6)
    out = long_predictions(stubs(), pts, ["run_id", "step", "ester", "conc"]).filter("target = 'cof'").drop("target")
    return rounded(out, conc=6)


@query("hertz_trend", with_v(f""", {_FIRST}, s AS (SELECT run_id, i AS step, e AS ester, conc, 10e0 + i*(190e0/19e0) AS l FROM f, (SELECT unnest(range(20)) AS i), (SELECT unnest([0, 1]) AS e))
SELECT run_id, CAST(step AS INT) AS step, ester, round(3e0*l/(2e0*pi()*power(cbrt(3e0*l*5e0/(4e0*(210000e0/(2e0*(1e0-9e-2))))), 2)), 5) AS hertz_mpa,
  round(3e-2 + 4e-4*l + 5e-2*conc, 9) AS pred FROM s"""))
def hertz_trend(spark, sf):
    pts = sc.hertz_sweep(ts.first_row(valid(spark, sf)))
    out = stubs()["plane"].transform(pts).select("run_id", "step", "ester", "hertz_mpa", F.col("pred_cof").alias("pred"))
    return rounded(out, hertz_mpa=5)


@query("response_surface", with_v(_OPT + """ SELECT ester, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(10e0 + j*(190e0/49e0), 6) AS load_n, round(i*(6e-1/49e0), 9) AS conc,
  round(3e-2 + 4e-4*(10e0 + j*(190e0/49e0)) + 5e-2*(i*(6e-1/49e0)) + 1e-4*temp_c, 9) AS cof FROM op, (SELECT unnest(range(50)) AS i), (SELECT unnest(range(50)) AS j)"""))
def response_surface(spark, sf):
    pts = sc.surface(optima(spark, sf).select("ester", "temp_c"), "conc", (0, 0.6), "load_n", (10, 200))
    out = stub("3e-2 + 4e-4*load_n + 5e-2*conc + 1e-4*temp_c", "load_n").transform(pts)
    return rounded(out.select("ester", "i", "j", "load_n", "conc", F.col("pred_cof").alias("cof")), load_n=6)


@query("validation_point", with_v(""", r AS (SELECT min(run_id) AS id FROM v WHERE round_even(load_n, 0) = 45 AND round_even(temp_c, 0) = 60 AND abs(conc - 2e-1) <= 1e-3 + 2e-6 AND ester = 0),
t AS (SELECT time_s FROM v WHERE run_id = (SELECT min(run_id) FROM v))
SELECT 'measured' AS model, round(time_s, 6) AS time_s, round(cof, 9) AS cof, round(fai, 9) AS fai FROM v, r WHERE run_id = id
UNION ALL SELECT 'plane', round(time_s, 6), round(3e-2 + 4e-4*45e0 + 5e-2*2e-1, 9), round(7e-1 + 2e-3*45e0 + 1e-3*60e0, 9) FROM t
UNION ALL SELECT 'flag', round(time_s, 6), round(6e-2, 9), round(11e-1, 9) FROM t"""))
def validation_point(spark, sf):
    d = valid(spark, sf)
    models = {n: m for n, m in stubs().items() if n != "level"}
    first = d.agg(F.min("run_id")).first()[0]
    curves, _ = dc.validate_at(models, d, {"load_n": 45, "temp_c": 60, "conc": 0.2, "ester": 0}, first)
    return rounded(curves, time_s=6)


@query("validation_value", """SELECT 'plane' AS model, round(3e-2 + 4e-4*45e0 + 5e-2*2e-1, 9) AS cof, round(7e-1 + 2e-3*45e0 + 1e-3*60e0, 9) AS fai
UNION ALL SELECT 'flag', round(6e-2, 9), round(11e-1, 9) UNION ALL SELECT 'drift', round(3e-2 + 4e-4*45e0 + 5e-2*2e-1 + 2e-1/ln(7050e0), 9), round(7e-1 + 2e-3*45e0 + 1e-1/ln(7050e0), 9)""")
def validation_value(spark, sf):
    """What the models say at the validation setpoint once it is steady."""
    d = valid(spark, sf)
    models = {n: m for n, m in stubs().items() if n != "level"} | {"drift": drifting()}
    _, one = dc.validate_at(models, d, {"load_n": 45, "temp_c": 60, "conc": 0.2, "ester": 0}, d.agg(F.min("run_id")).first()[0])
    return rounded(one)


@query("partial_dependence", with_v(""", q AS (SELECT quantile_cont(load_n, 0.05) AS a, quantile_cont(load_n, 0.95) AS b FROM v),
g AS (SELECT a + i*((b-a)/19e0) AS l FROM q, (SELECT unnest(range(20)) AS i))
SELECT round(l, 6) AS load_n, round(avg(3e-2 + 4e-4*l + 5e-2*conc + 1e-5*l*temp_c), 9) AS mean_pred, count(*) AS n_rows FROM g, v GROUP BY l"""))
def partial_dependence(spark, sf):
    return rounded(ex.partial_dependence(bent(), valid(spark, sf), "load_n"), load_n=6)


def bent():
    """A closed-form predictor in which load and temperature interact."""
    return stub("3e-2 + 4e-4*load_n + 5e-2*conc + 1e-5*load_n*temp_c", "load_n")


@query("partial_dependence_temp", with_v(""", q AS (SELECT quantile_cont(temp_c, 0.05) AS a, quantile_cont(temp_c, 0.95) AS b FROM v),
g AS (SELECT a + i*((b-a)/19e0) AS t FROM q, (SELECT unnest(range(20)) AS i))
SELECT round(t, 6) AS temp_c, round(avg(3e-2 + 4e-4*load_n + 5e-2*conc + 1e-5*load_n*t), 9) AS mean_pred, count(*) AS n_rows FROM g, v GROUP BY t"""))
def partial_dependence_temp(spark, sf):
    return rounded(ex.partial_dependence(bent(), valid(spark, sf), "temp_c"), temp_c=6)


@query("partial_dependence_conc", with_v(""", g AS (SELECT DISTINCT conc AS c FROM v)
SELECT round(c, 6) AS conc, round(avg(3e-2 + 4e-4*load_n + 5e-2*c + 1e-5*load_n*temp_c), 9) AS mean_pred, count(*) AS n_rows FROM g, v GROUP BY c"""))
def partial_dependence_conc(spark, sf):
    return rounded(ex.partial_dependence(bent(), valid(spark, sf), "conc"), conc=6)


@query("partial_dependence_pair", with_v(""", q AS (SELECT quantile_cont(load_n, 0.05) AS a, quantile_cont(load_n, 0.95) AS b, quantile_cont(temp_c, 0.05) AS c, quantile_cont(temp_c, 0.95) AS d FROM v),
g AS (SELECT a + i*((b-a)/19e0) AS l, c + j*((d-c)/19e0) AS t FROM q, (SELECT unnest(range(20)) AS i), (SELECT unnest(range(20)) AS j))
SELECT round(l, 6) AS load_n, round(t, 6) AS temp_c, round(avg(3e-2 + 4e-4*l + 5e-2*conc + 1e-5*l*t), 9) AS mean_pred, count(*) AS n_rows FROM g, v GROUP BY l, t"""))
def partial_dependence_pair(spark, sf):
    return rounded(ex.partial_dependence(bent(), valid(spark, sf), ["load_n", "temp_c"]), load_n=6, temp_c=6)


# attributions of a linear predictor have the closed form b * (x - mean of the background)
_KEYS = ["load_n", "temp_c", "conc"]
_SH = """, ro AS (SELECT * FROM v),
bg AS (SELECT avg(load_n) AS load_n, avg(temp_c) AS temp_c, avg(conc) AS conc FROM (SELECT * FROM v ORDER BY md5(concat(CAST(seq AS VARCHAR), '#7')), seq LIMIT 10)),
ph AS (SELECT ro.seq, ro.ester, 'load_n' AS feature, ro.load_n AS value, 4e-4*(ro.load_n-bg.load_n) AS phi FROM ro, bg
  UNION ALL SELECT ro.seq, ro.ester, 'temp_c', ro.temp_c, 1e-4*(ro.temp_c-bg.temp_c) FROM ro, bg UNION ALL SELECT ro.seq, ro.ester, 'conc', ro.conc, 5e-2*(ro.conc-bg.conc) FROM ro, bg)"""


def attributions(spark, sf):
    d = valid(spark, sf)
    model = stub("3e-2 + 4e-4*load_n + 5e-2*conc + 1e-4*temp_c", "load_n")
    return d, ex.shapley(model, d, _KEYS, ex.sample_rows(d, 10, "seq", 7), permutations=4, key="seq", closed=True)


@query("shapley", with_v(_SH + " SELECT seq, feature, round(phi, 9) AS phi FROM ph"))
def shapley(spark, sf):
    return rounded(attributions(spark, sf)[1])


@query("shap_summary", with_v(_SH + " SELECT feature, round(avg(abs(phi)), 9) AS importance, count(*) AS n_rows FROM ph GROUP BY feature"))
def shap_summary(spark, sf):
    return rounded(ex.shapley_summary(attributions(spark, sf)[1]))


@query("shap_dependence", with_v(_SH + " SELECT seq, feature, round(value, 9) AS value, round(phi, 9) AS phi, ester AS colour FROM ph WHERE feature IN ('load_n', 'temp_c')"))
def shap_dependence(spark, sf):
    d, attr = attributions(spark, sf)
    return rounded(ex.shapley_pairs(attr, d, ["load_n", "temp_c"], key="seq"))



@query("top_attributed", with_v(_SH + " SELECT feature, round(avg(abs(phi)), 9) AS importance, count(*) AS n_rows FROM ph GROUP BY feature ORDER BY avg(abs(phi)) DESC, feature LIMIT 2"))
def top_attributed(spark, sf):
    """Strongest inputs by mean absolute attribution."""
    return rounded(rl.top_features(ex.shapley_summary(attributions(spark, sf)[1]), 2))


@query("attribution_paths", with_v(_SH + """, im AS (SELECT feature, avg(abs(phi)) AS importance FROM ph GROUP BY feature)
SELECT seq, feature, round(phi, 9) AS phi, round(1e-1 + sum(phi) OVER (PARTITION BY seq ORDER BY importance, feature), 9) AS path FROM ph JOIN im USING (feature)"""))
def attribution_paths(spark, sf):
    return rounded(ex.decision_paths(attributions(spark, sf)[1], 0.1, None, key="seq").drop("importance"))


@query("attribution_order", with_v(_SH + " SELECT seq, round(sum(phi), 9) AS output FROM ph GROUP BY seq"))
def attribution_order(spark, sf):
    return rounded(ex.order_by_output(attributions(spark, sf)[1], key="seq"))
