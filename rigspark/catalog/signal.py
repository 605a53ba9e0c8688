"""Time-series queries (A1-A3, W, C1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..operators.relational import attach_count
from ..params import Params
from ..plans.clean import clean_runs as clean
from ..session import cut
from .base import query, rnd, rounded, runs, valid, with_m, with_v

_N, _W = 5, 4

# blocks of 5 rows averaged, then a strict trailing mean of 4
D = f""", p AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1)/{_N}) AS BIGINT) AS b FROM v),
d AS (SELECT run_id, b AS seq, avg(time_s) AS time_s, avg(load_n) AS load_n, avg(temp_c) AS temp_c, avg(conc) AS conc,
  avg(ester) AS ester, avg(cof) AS cof, avg(fai) AS fai FROM p GROUP BY run_id, b)"""
S = D + f""", r AS (SELECT run_id, seq, time_s, load_n, temp_c, conc, ester, fai,
  avg(cof) OVER w AS cof, count(cof) OVER w AS n FROM d WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN {_W - 1} PRECEDING AND CURRENT ROW)),
s AS (SELECT * EXCLUDE (n) FROM r WHERE n = {_W})"""


def sampled(spark, sf):
    return ts.downsample(valid(spark, sf), _N)


def smooth(spark, sf):
    """The resampled, smoothed signal as a stored table: later steps read it more than once."""
    return cut(ts.rolling_mean(sampled(spark, sf), "cof", _W, dense=True))


@query("downsample", with_v(D + """ SELECT run_id, seq, round(time_s, 6) AS time_s, round(load_n, 9) AS load_n, round(temp_c, 9) AS temp_c,
  round(conc, 9) AS conc, round(ester, 9) AS ester, round(cof, 9) AS cof, round(fai, 9) AS fai FROM d"""))
def downsample(spark, sf):
    return rounded(sampled(spark, sf), time_s=6)


@query("rolling_mean_strict", with_v(S + " SELECT run_id, seq, round(cof, 12) AS cof, round(fai, 12) AS fai FROM s"))
def rolling_mean_strict(spark, sf):
    d = ts.rolling_mean(sampled(spark, sf), "cof", _W, dense=True)
    return rounded(d.select("run_id", "seq", "cof", "fai"), 12)


@query("rolling_mean_partial", with_v("""SELECT run_id, seq, round(avg(cof) OVER (PARTITION BY run_id ORDER BY seq
  ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 12) AS smooth FROM v"""))
def rolling_mean_partial(spark, sf):
    d = ts.rolling_mean(valid(spark, sf), "cof", 60, strict=False, out="smooth")
    return rounded(d.select("run_id", "seq", "smooth"), 12)


@query("last_window", with_v("""SELECT run_id, seq, round(cof, 9) AS cof FROM (SELECT *, max(time_s) OVER (PARTITION BY run_id) AS e FROM v)
  WHERE time_s >= e - 300"""))
def last_window(spark, sf):
    return rounded(ts.last_window(valid(spark, sf)).select("run_id", "seq", "cof"))


@query("steady_state", with_v(S + """ SELECT run_id, round(avg(cof), 9) AS cof, round(avg(fai), 9) AS fai, round(avg(conc), 9) AS conc,
  round(avg(load_n), 9) AS load_n, round(avg(temp_c), 9) AS temp_c, round(arg_min(ester, seq), 9) AS ester, count(*) AS n_rows
  FROM (SELECT *, max(time_s) OVER (PARTITION BY run_id) AS e FROM s) WHERE time_s >= e - 300 GROUP BY run_id"""))
def steady_state(spark, sf):
    return rounded(ts.steady_state(smooth(spark, sf)))


@query("run_summary_row", with_v(S + """ SELECT run_id, max(seq) AS seq, 7200e0 AS time_s, round(arg_max(load_n, seq), 9) AS load_n,
  round(arg_max(conc, seq), 9) AS conc, round(avg(cof), 9) AS cof, round(avg(fai), 9) AS fai, true AS is_summary
  FROM (SELECT *, max(time_s) OVER (PARTITION BY run_id) AS e FROM s) WHERE time_s >= e - 300 GROUP BY run_id"""))
def run_summary_row(spark, sf):
    d = ts.summary_rows(smooth(spark, sf).select("run_id", "seq", "time_s", "load_n", "conc", "cof", "fai"))
    return rounded(d)


@query("tail_n", with_v("""SELECT run_id, seq, round(cof, 9) AS cof FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS p,
  count(*) OVER (PARTITION BY run_id) AS n FROM v) WHERE p <= greatest(50, floor(1e-1*n))"""))
def tail_n(spark, sf):
    return rounded(ts.tail_n(valid(spark, sf)).select("run_id", "seq", "cof"))


_RUN_IN = """, w AS (SELECT run_id, seq, time_s, avg(cof) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS s,
  row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS p, count(*) OVER (PARTITION BY run_id) AS n FROM v),
t AS (SELECT run_id, avg(s) AS mu, greatest(3e0*stddev_pop(s), 5e-2*avg(s)) AS tol FROM w WHERE p <= greatest(50, floor(1e-1*n)) GROUP BY run_id),
ri AS (SELECT run_id, coalesce(max(CASE WHEN abs(s-mu) > tol THEN time_s END), 0e0) AS run_in_s, max(mu) AS final_mean, max(tol) AS tolerance
  FROM w JOIN t USING (run_id) GROUP BY run_id)"""


@query("run_in_time", with_v(_RUN_IN + """ SELECT run_id, round(run_in_s, 6) AS run_in_s, round(final_mean, 9) AS final_mean,
  round(tolerance, 9) AS tolerance FROM ri"""))
def run_in_time(spark, sf):
    return rounded(ts.run_in_time(valid(spark, sf)), run_in_s=6)


@query("first_row_of_run", with_v("""SELECT run_id, round(arg_min(conc, seq), 9) AS conc, round(arg_min(load_n, seq), 9) AS load_n,
  round(arg_min(temp_c, seq), 9) AS temp_c, arg_min(ester, seq) AS ester FROM v GROUP BY run_id"""))
def first_row_of_run(spark, sf):
    return rounded(ts.first_row(valid(spark, sf)))


@query("group_count_attach", with_v("""SELECT run_id, seq, count(*) OVER (PARTITION BY conc, round_even(load_n, 0), ester) AS n_group FROM v"""))
def group_count_attach(spark, sf):
    d = valid(spark, sf).withColumn("load_n", F.rint("load_n"))
    return attach_count(d, ["conc", "load_n", "ester"]).select("run_id", "seq", "n_group")


@query("reference_curve", with_v(""", f AS (SELECT run_id, round_even(avg(load_n), 0) AS load_n, round_even(avg(temp_c), 0) AS temp_c FROM v GROUP BY run_id)
SELECT f.run_id AS setpoint, c.seq AS step, round(c.time_s, 6) AS time_s, f.load_n, f.temp_c
FROM (SELECT * FROM v WHERE run_id = (SELECT min(run_id) FROM v)) c, f"""))
def reference_curve(spark, sf):
    d = valid(spark, sf)
    points = d.groupBy(F.col("run_id").alias("setpoint")).agg(F.rint(F.avg("load_n")).alias("load_n"), F.rint(F.avg("temp_c")).alias("temp_c"))
    first = d.agg(F.min("run_id")).first()[0]
    return rounded(ts.template_curve(d, first, points).select("setpoint", "step", "time_s", "load_n", "temp_c"), 6)


@query("clean_runs", with_m(f""", t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY run_id) AS n0 FROM m),
v AS (SELECT * EXCLUDE (rn, n0) FROM t WHERE rn > 1 AND rn <= n0 - 5 AND load_n <> 0 AND temp_c <> 0 AND time_s > 35){S},
z AS (SELECT run_id, seq, time_s, load_n, temp_c, conc, CAST(trunc(ester) AS INT) AS ester, cof, fai, false AS is_summary FROM s),
y AS (SELECT run_id, max(seq) AS seq, 7200e0 AS time_s, arg_max(load_n, seq) AS load_n, arg_max(temp_c, seq) AS temp_c, arg_max(conc, seq) AS conc,
  arg_max(ester, seq) AS ester, avg(cof) AS cof, avg(fai) AS fai, true AS is_summary
  FROM (SELECT *, max(time_s) OVER (PARTITION BY run_id) AS e FROM z) WHERE time_s >= e - 300 GROUP BY run_id)
SELECT run_id, seq, round(time_s, 6) AS time_s, round(load_n, 9) AS load_n, round(temp_c, 9) AS temp_c, round(conc, 9) AS conc, ester,
  round(cof, 9) AS cof, round(fai, 9) AS fai, is_summary FROM (SELECT * FROM z UNION ALL SELECT * FROM y) WHERE time_s > 0 AND cof > 0 AND fai > 0"""))
def clean_runs(spark, sf):
    return rounded(clean(runs(spark, sf), Params(downsample=_N, rolling=_W)), time_s=6)
