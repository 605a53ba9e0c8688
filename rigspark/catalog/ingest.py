"""Sources and projections (S, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as ph, rows as rw
from ..models.stages import InteractionFeatures, PopulationScaler, RangeScaler
from ..operators.stats import regime_share, run_setpoints
from ..schema import EVENTS_SCHEMA
from ..sources.runs import audit, coerce, read_runs, trim_rows, union_all
from .base import query, rnd, rounded, runs, table, valid, with_m, with_v


@query("scan_runs", """SELECT 'events.parquet' AS run_id, event_id AS seq, event_id, user_id, event_type, value FROM events""")
def scan_runs(spark, sf):
    d = read_runs(spark, f"{sf}/events.parquet", "parquet", EVENTS_SCHEMA)
    return d.select("run_id", "seq", "event_id", "user_id", "event_type", "value")


@query("trim_rows", with_m(""", t AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS p, count(*) OVER (PARTITION BY run_id) AS n FROM m)
SELECT run_id, seq, round(cof, 9) AS cof FROM t WHERE p > 1 AND p <= n - 5"""))
def trim(spark, sf):
    return trim_rows(runs(spark, sf)).select("run_id", "seq", rnd("cof").alias("cof"))


def _raw_cells(spark, sf):
    """Run cells as text, with the kinds of bad cells run files have, taken from the log itself."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("run_id"),
        F.when(F.col("user_id") % 11 == 0, "N/A").otherwise(F.col("value").cast("string")).alias("COF"),
        F.when(F.col("user_id") % 7 == 0, "NaN").otherwise(F.regexp_extract("props", "([0-9]+)", 1)).alias("Temperature 1"),
        F.when(F.col("event_type") != "click", F.col("user_id").cast("string")).alias("Concentration"),
        F.when(F.col("user_id") % 3 == 0, F.lit(None)).when(F.col("user_id") % 3 == 1, "1").otherwise("0").alias("Esterified"))


_RAW = """raw AS (SELECT event_id AS seq, event_type AS run_id,
  CASE WHEN user_id % 11 = 0 THEN 'N/A' ELSE CAST(value AS VARCHAR) END AS cof,
  CASE WHEN user_id % 7 = 0 THEN 'NaN' ELSE regexp_extract(props, '([0-9]+)', 1) END AS temp_c,
  CASE WHEN event_type <> 'click' THEN CAST(user_id AS VARCHAR) END AS conc,
  CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN '1' ELSE '0' END AS ester FROM events)"""


@query("coerce_types", f"""WITH {_RAW} SELECT seq, run_id, TRY_CAST(cof AS DOUBLE) AS cof,
  CASE WHEN isnan(TRY_CAST(temp_c AS DOUBLE)) THEN NULL ELSE TRY_CAST(temp_c AS DOUBLE) END AS temp_c,
  TRY_CAST(conc AS DOUBLE) AS conc, TRY_CAST(ester AS DOUBLE) AS ester FROM raw""")
def coerce_types(spark, sf):
    return coerce(_raw_cells(spark, sf)).select("seq", "run_id", "cof", "temp_c", "conc", "ester")


@query("schema_audit", f"""WITH {_RAW} SELECT run_id, count(*) AS n_rows,
  concat_ws(',', CASE WHEN count(conc) = 0 THEN 'conc' END, CASE WHEN count(ester) = 0 THEN 'ester' END) AS missing
  FROM raw GROUP BY run_id HAVING count(conc) = 0 OR count(ester) = 0""")
def schema_audit(spark, sf):
    return audit(coerce(_raw_cells(spark, sf))).withColumn("missing", F.concat_ws(",", "missing"))


@query("union_runs", with_m("""SELECT run_id, seq, round(cof, 9) AS cof, round(CASE WHEN ester = 1 THEN fai END, 9) AS fai FROM m"""))
def union_runs(spark, sf):
    d = runs(spark, sf)
    narrow = d.filter("ester = 0").select("run_id", "seq", "cof")
    wide = d.filter("ester = 1").select("run_id", "seq", "fai", "cof")
    return rounded(union_all([narrow, wide]))


@query("valid_rows", with_m("""SELECT run_id, seq, round(time_s, 6) AS time_s FROM m WHERE conc IS NOT NULL AND cof IS NOT NULL
  AND fai IS NOT NULL AND load_n <> 0 AND temp_c <> 0 AND time_s > 35"""))
def valid_rows(spark, sf):
    return rw.valid_rows(runs(spark, sf)).select("run_id", "seq", rnd("time_s", 6).alias("time_s"))


@query("positive_targets", """SELECT event_id, value FROM events WHERE event_id > 0 AND value > 0""")
def positive_targets(spark, sf):
    return rw.positive(table(spark, sf, "events"), ("event_id", "value")).select("event_id", "value")


@query("default_flag", f"WITH {_RAW} SELECT seq, coalesce(TRY_CAST(TRY_CAST(ester AS DOUBLE) AS INT), 0) AS ester FROM raw")
def default_flag(spark, sf):
    return rw.default_flag(coerce(_raw_cells(spark, sf))).select("seq", "ester")


@query("time_features", with_v("SELECT run_id, seq, round(ln(time_s), 9) AS log_time, round(time_s*time_s, 3) AS time_squared FROM v"))
def time_features(spark, sf):
    return valid(spark, sf).select("run_id", "seq", rnd(ph.log_time("time_s")).alias("log_time"),
                                   rnd(ph.time_squared("time_s"), 3).alias("time_squared"))


_E = "(210000e0/(2e0*(1e0-9e-2)))"


@query("hertz_stress", with_v(f"""SELECT run_id, seq, round(3e0*load_n/(2e0*pi()*power(cbrt(3e0*load_n*5e0/(4e0*{_E})), 2)), 6) AS hertz_mpa
  FROM v"""))
def hertz_stress(spark, sf):
    return valid(spark, sf).select("run_id", "seq", rnd(ph.hertz_stress("load_n"), 6).alias("hertz_mpa"))


@query("hertz_two_body", with_v("""SELECT run_id, seq,
  round(3e0*load_n/(2e0*pi()*power(cbrt(3e0*load_n*5e0/(4e0*es)), 2)), 6) AS hertz_mpa
  FROM (SELECT *, 1e0/((1e0-9e-2)/210000e0 + (1e0-625e-4)/(70000e0+temp_c)) AS es FROM v)"""))
def hertz_two_body(spark, sf):
    e2 = F.lit(70000e0) + F.col("temp_c")
    return valid(spark, sf).select(
        "run_id", "seq", rnd(ph.hertz_two_body("load_n", 210000.0, 0.3, e2, 0.25), 6).alias("hertz_mpa"))


@query("hertz_profile", with_v(f""", c AS (SELECT run_id, avg(load_n) AS l FROM v GROUP BY run_id),
p AS (SELECT run_id, cbrt(3e0*l*5e0/(4e0*{_E})) AS a, l FROM c),
g AS (SELECT run_id, a, 3e0*l/(2e0*pi()*a*a) AS pm, ix, iy, -15e-1*a + ix*(3e0*a/20e0) AS x, -15e-1*a + iy*(3e0*a/20e0) AS y
  FROM p, (SELECT unnest(range(21)) AS ix), (SELECT unnest(range(21)) AS iy))
SELECT run_id, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy,
  round(CASE WHEN 1e0-(x*x+y*y)/(a*a) >= 0 THEN pm*sqrt(1e0-(x*x+y*y)/(a*a)) ELSE 0e0 END, 4) AS pressure FROM g"""))
def hertz_profile(spark, sf):
    contacts = run_setpoints(valid(spark, sf)).select("run_id", "load_n")
    return ph.hertz_profile(contacts, n=21).select("run_id", "ix", "iy", rnd("pressure", 4).alias("pressure"))


_COF = """CASE WHEN lam <= 8e-1 THEN 12e-2 WHEN lam <= 26e-1
  THEN 25e-3 + 95e-3*(5e-1*(1e0+cos(pi()*(lam-8e-1)/18e-1))) ELSE 25e-3 + 25e-3*(lam-26e-1) END"""


@query("stribeck_curve", f"""SELECT event_id, round({_COF}, 9) AS cof FROM (SELECT event_id, value/25e0 AS lam FROM events)""")
def stribeck_curve(spark, sf):
    return table(spark, sf, "events").select("event_id", rnd(ph.stribeck_cof(F.col("value") / F.lit(25e0))).alias("cof"))


@query("regime_share", with_v("""SELECT run_id, round(avg(CASE WHEN lam <= 8e-1 THEN 1e0 ELSE 0e0 END), 9) AS boundary,
  round(avg(CASE WHEN lam > 8e-1 AND lam <= 26e-1 THEN 1e0 ELSE 0e0 END), 9) AS mixed,
  round(avg(CASE WHEN lam > 26e-1 THEN 1e0 ELSE 0e0 END), 9) AS hydrodynamic
  FROM (SELECT run_id, cof*25e0 AS lam FROM v) GROUP BY run_id"""))
def regime(spark, sf):
    return rounded(regime_share(valid(spark, sf).withColumn("lam", F.col("cof") * F.lit(25e0)), "lam"))


_PAIRS = [("load_n", "temp_c"), ("load_n", "conc"), ("temp_c", "conc"), ("ester", "temp_c"), ("ester", "load_n"), ("ester", "conc")]


@query("interactions", with_v(", s AS (SELECT avg(load_n) AS load_n, avg(temp_c) AS temp_c, avg(conc) AS conc, avg(ester) AS ester FROM v) SELECT run_id, seq, "
       + ", ".join(f"round((v.{a}-s.{a})*(v.{b}-s.{b}), 6) AS {a}_x_{b}" for a, b in _PAIRS) + " FROM v, s"))
def interactions(spark, sf):
    d = valid(spark, sf)
    out = InteractionFeatures().fit(d).transform(d)
    return out.select("run_id", "seq", *[rnd(f"{a}_x_{b}", 6).alias(f"{a}_x_{b}") for a, b in _PAIRS])


@query("ratios", with_v("""SELECT run_id, seq, round(load_n/(temp_c+1e-6), 9) AS load_n_div_temp_c,
  round(conc/(load_n+1e-6), 9) AS conc_div_load_n, round(temp_c/(conc+1e-6), 3) AS temp_c_div_conc FROM v"""))
def ratios(spark, sf):
    d = rw.ratios(valid(spark, sf))
    return d.select("run_id", "seq", rnd("load_n_div_temp_c").alias("load_n_div_temp_c"),
                    rnd("conc_div_load_n").alias("conc_div_load_n"), rnd("temp_c_div_conc", 3).alias("temp_c_div_conc"))


@query("standardize", with_v(", s AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("load_n", "temp_c", "conc")) + " FROM v) SELECT run_id, seq, " + ", ".join(
    f"round(({c}-m_{c})/s_{c}, 8) AS {c}" for c in ("load_n", "temp_c", "conc")) + " FROM v, s"))
def standardize(spark, sf):
    d = valid(spark, sf)
    cols = ["load_n", "temp_c", "conc"]
    out = PopulationScaler(inputCols=cols, outputCols=cols).fit(d).transform(d)
    return rounded(out.select("run_id", "seq", *cols), 8)


@query("minmax_scale", with_v(""", s AS (SELECT min(load_n) AS a, max(load_n) AS b, min(temp_c) AS c, max(temp_c) AS d FROM v WHERE ester = 0)
SELECT run_id, seq, round((load_n-a)/(b-a), 9) AS load_n, round((temp_c-c)/(d-c), 9) AS temp_c FROM v, s"""))
def minmax_scale(spark, sf):
    d = valid(spark, sf)
    cols = ["load_n", "temp_c"]
    out = RangeScaler(inputCols=cols, outputCols=cols).fit(d.filter("ester = 0")).transform(d)
    return rounded(out.select("run_id", "seq", *cols))


@query("log_target", with_v("""SELECT run_id, seq, round(ln(cof), 9) AS log_cof, round(exp(ln(cof)), 9) AS cof FROM v"""))
def log_target(spark, sf):
    d = valid(spark, sf).withColumn("log_cof", F.log("cof"))
    return d.select("run_id", "seq", rnd("log_cof").alias("log_cof"), rnd(F.exp("log_cof")).alias("cof"))


@query("clamp_prediction", with_m("SELECT run_id, seq, round(greatest(cof - 5e-2, 1e-3), 9) AS pred FROM m"))
def clamp_prediction(spark, sf):
    return runs(spark, sf).select("run_id", "seq", rnd(ph.clamp(F.col("cof") - F.lit(5e-2))).alias("pred"))


@query("round_setpoint", with_m("""SELECT run_id, seq, round_even(load_n/5e0, 0)*5e0 AS load_n,
  round_even(temp_c/5e0, 0)*5e0 AS temp_c, round_even(fai*100e0, 0)/100e0 AS fai FROM m"""))
def round_setpoint(spark, sf):
    return runs(spark, sf).select("run_id", "seq", ph.snap("load_n", 5).alias("load_n"), ph.snap("temp_c", 5).alias("temp_c"),
                                  ph.round_half_even("fai", 2).alias("fai"))


@query("near_match", with_m("""SELECT run_id, seq, round(cof, 9) AS cof FROM m WHERE round_even(load_n, 0) = 45 AND round_even(temp_c, 0) = 60
  AND abs(conc - 2e-1) <= 1e-3 + 1e-5*2e-1 AND ester = 0"""))
def near_match(spark, sf):
    d = rw.near_match(runs(spark, sf), {"load_n": 45, "temp_c": 60, "conc": 0.2, "ester": 0})
    return d.select("run_id", "seq", rnd("cof").alias("cof"))


@query("friendly_names", with_m("""SELECT run_id, count(*) AS n_rows, round(avg(load_n), 9) AS "Load [N]",
  round(avg(cof), 9) AS "Coefficient of Friction (COF) [-]" FROM m GROUP BY run_id"""))
def friendly_names(spark, sf):
    d = runs(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.avg("load_n")).alias("load_n"),
                                             rnd(F.avg("cof")).alias("cof"))
    return rw.friendly_names(d)


def _noise(c):
    return f"(CAST(('0x' || substr(md5(concat(run_id, '#42#{c}')), 1, 8)) AS BIGINT)/4294967296e0*2 - 1)"


@query("jitter_points", with_v(f"""SELECT run_id, round(avg(load_n) + {_noise('load_n')}*2e0, 9) AS load_n_plot,
  round(avg(temp_c) + {_noise('temp_c')}*1e0, 9) AS temp_c_plot, round(greatest(avg(conc) + {_noise('conc')}*1e-2, 0e0), 9) AS conc_plot
  FROM v GROUP BY run_id"""))
def jitter_points(spark, sf):
    out = rw.jitter(run_setpoints(valid(spark, sf)), {"load_n": 2.0, "temp_c": 1.0, "conc": 0.01})
    return rounded(out.select("run_id", "load_n_plot", "temp_c_plot", "conc_plot"))

