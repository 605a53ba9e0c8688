"""Small literal inputs with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from rigspark.functions import physics as ph, rows as rw
from rigspark.models.stages import PopulationScaler, RangeScaler
from rigspark.operators import prepare as pr, relational as rl, stats as st, timeseries as ts
from rigspark.params import Params
from rigspark.plans import decide as dc, scenarios as sc
from rigspark.plans.clean import clean_runs
from rigspark.scale import quantiles
from rigspark.sources.runs import audit, coerce, trim_rows, union_all


def one(spark, expr, **cols):
    names = list(cols)
    d = spark.createDataFrame([tuple(cols[n] for n in names)], names) if names else spark.range(1)
    return d.select(expr.alias("r")).first()["r"]


def signal(spark, values, run="a", **extra):
    rows = [(run, i, float(v)) for i, v in enumerate(values)]
    d = spark.createDataFrame(rows, "run_id string, seq bigint, cof double").withColumn("time_s", F.col("seq") * 1e0)
    return d.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.mark.parametrize("load,stress", [(100.0, 2176.1348915877), (180.0, 2647.1383960503)])
def test_hertz(spark, load, stress):
    assert one(spark, ph.hertz_stress("x"), x=load) == pytest.approx(stress, rel=1e-12)
    assert one(spark, ph.hertz_two_body("x", 210000, 0.3, 210000, 0.3), x=load) == pytest.approx(stress, rel=1e-12)


def test_hertz_profile_is_zero_outside(spark):
    d = ph.hertz_profile(spark.createDataFrame([(100.0,)], "load_n double"), n=31)
    r = d.agg(F.max("pressure").alias("top"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.hypot("x_mm", "y_mm") > F.col("a_mm"), F.col("pressure"))).alias("out")).first()
    assert r["n"] == 961 and r["out"] == 0.0 and r["top"] == pytest.approx(2176.1348915877, rel=1e-9)


@pytest.mark.parametrize("lam,mu", [(0.5, 0.12), (0.8, 0.12), (1.7, 0.0725), (2.6, 0.025), (3.6, 0.05)])
def test_stribeck(spark, lam, mu):
    assert one(spark, ph.stribeck_cof("x"), x=lam) == pytest.approx(mu, abs=1e-12)


def test_rounding_is_half_even(spark):
    assert one(spark, ph.snap("x", 5), x=12.5) == 10.0
    assert one(spark, ph.snap("x", 5), x=17.5) == 20.0
    assert one(spark, ph.round_half_even("x", 0), x=2.5) == 2.0


def test_quantile_and_deviation(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    assert quantiles(d, "x", [0.25]).first()[0] == [1.75]
    r = st.describe(d, ["x"]).first()
    assert r["std"] == pytest.approx(3.5590260841, rel=1e-9) and (r["q25"], r["q50"], r["q75"]) == (1.75, 3.0, 5.25)


def test_downsample_keeps_the_short_last_block(spark):
    out = [r["cof"] for r in ts.downsample(signal(spark, [1, 2, 3, 4, 5]), 2).orderBy("seq").collect()]
    assert out == [1.5, 3.5, 5.0]


def test_rolling_means(spark):
    d = signal(spark, [1, 2, 3, 4])
    assert [r["cof"] for r in ts.rolling_mean(d, "cof", 3).orderBy("seq").collect()] == [2.0, 3.0]
    assert [r["cof"] for r in ts.rolling_mean(d, "cof", 3, strict=False).orderBy("seq").collect()] == [1.0, 1.5, 2.0, 3.0]


def test_strict_rolling_of_a_short_run_is_empty(spark):
    assert ts.rolling_mean(signal(spark, [1, 2]), "cof", 3).count() == 0


def test_summary_row_of_a_run_that_outlasts_the_test(spark):
    d = signal(spark, range(1, 11), fai=1.0, load_n=5.0).withColumn("time_s", F.col("seq") * 1000e0)
    out = ts.summary_rows(d, span=1500).first()
    assert (out["seq"], out["time_s"], out["cof"], out["is_summary"]) == (7, 7200.0, 9.5, True)


def test_run_in_time(spark):
    flat = ts.run_in_time(signal(spark, [0.1] * 200)).first()
    assert flat["run_in_s"] == 0.0
    steps = ts.run_in_time(signal(spark, [0.5] * 100 + [0.1] * 400), n=1).first()
    assert steps["run_in_s"] == 99.0 and steps["final_mean"] == pytest.approx(0.1)


FRONT = [(1, 5), (2, 3), (2, 3), (3, 3), (4, 1), (5, 1)]


def test_pareto_keeps_duplicates_and_drops_weakly_dominated(spark):
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(FRONT)], "point_id int, cof double, fai double")
    assert sorted(r["point_id"] for r in dc.pareto_front(d).collect()) == [0, 1, 2, 4]


def test_kfold_deals_by_size_to_and_fro(spark):
    d = spark.createDataFrame([(r,) for r, n in zip("abcd", (5, 4, 3, 2)) for _ in range(n)], "run_id string")
    fold = {r["run_id"]: r["fold"] for r in pr.group_kfold(d, 2).collect()}
    assert fold["a"] == fold["d"] != fold["b"] == fold["c"]


def test_novel_setpoints_truncate(spark):
    grid = spark.createDataFrame([(0.5, 100.0, 60.0, 1), (0.5, 105.0, 60.0, 1)], "conc double, load_n double, temp_c double, ester int")
    seen = spark.createDataFrame([(0.501, 100.9, 60.2, 1)], grid.schema)
    assert [r["load_n"] for r in rl.novel(grid, seen).collect()] == [105.0]


def test_constant_columns_scale_to_zero(spark):
    d = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    for stage in (RangeScaler, PopulationScaler):
        assert stage(inputCols=["x"], outputCols=["y"]).fit(d).transform(d).first()["y"] == 0.0


def test_residual_filter_never_loses_a_run(spark):
    rows = [("a", 0, 0.2), ("a", 1, 0.06), ("a", 2, 0.06), ("b", 0, 0.01), ("b", 1, 0.3)]
    d = spark.createDataFrame(rows, "run_id string, seq bigint, abs_err double")
    assert sorted((r["run_id"], r["seq"]) for r in pr.residual_filter(d).collect()) == [("a", 1), ("b", 0)]


def test_weights_average_one(spark):
    rows = [(0.1, 100.2, 60.0, 0), (0.1, 99.8, 60.0, 0), (0.1, 100.0, 60.4, 0), (0.2, 100.0, 60.0, 1)]
    out = [r["weight"] for r in st.sample_weights(spark.createDataFrame(rows, "conc double, load_n double, temp_c double, ester int")).collect()]
    assert sum(out) / 4 == pytest.approx(1.0) and max(out) / min(out) == pytest.approx(math.sqrt(3))


def test_histogram_last_bin_is_closed_and_empty_bins_stay(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double")
    assert [r["n_rows"] for r in st.histogram(d, "x", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 1]
    flat = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert sum(r["n_rows"] for r in st.histogram(flat, "x", 4).collect()) == 4


def test_bins_of_repeated_and_constant_values(spark):
    d = spark.createDataFrame([(f"r{i}", float(v), 7.0) for i, v in enumerate([1, 1, 1, 1, 2, 3])], "run_id string, x double, c double")
    out = {r["run_id"]: (r["x_bin"], r["c_bin"]) for r in pr.quantile_bins(d, ["x", "c"]).collect()}
    assert [out[f"r{i}"][0] for i in range(6)] == [0, 0, 0, 0, 1, 1]
    assert sorted(v[1] for v in out.values()) == [0, 0, 1, 1, 2, 2]


def test_top_models_lets_a_smooth_one_in(spark):
    m = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7), ("ridge", 0.1), ("mlp", 0.2)], "model string, r2_cv double")
    assert [r["model"] for r in rl.top_models(m).orderBy("place").collect()] == ["a", "b", "mlp"]
    without = m.filter("model NOT IN ('ridge', 'mlp')")
    assert [r["model"] for r in rl.top_models(without).orderBy("place").collect()] == ["a", "b", "c"]


def test_metrics_of_a_constant_target(spark):
    d = spark.createDataFrame([("m", "s", "t", 1.0, 1.0), ("m", "s", "t", 1.0, 1.0)], "model string, split string, target string, y double, pred double")
    assert {r["r2"] for r in st.regression_metrics(d).collect()} == {1.0}


def test_coerce_and_audit(spark):
    d = spark.createDataFrame([("a", "1.5", "NaN", None), ("b", "x", "3", "0.1")], "run_id string, COF string, `Temperature 1` string, Concentration string")
    out = {r["run_id"]: r for r in coerce(d).collect()}
    assert out["a"]["cof"] == 1.5 and out["a"]["temp_c"] is None and out["b"]["cof"] is None and out["b"]["temp_c"] == 3.0
    assert {r["run_id"]: r["missing"] for r in audit(coerce(d)).collect()} == {"a": ["conc", "ester"], "b": ["ester"]}


def test_trim_of_a_run_shorter_than_its_footer(spark):
    d = union_all([signal(spark, range(4), "short"), signal(spark, range(10), "long")])
    assert sorted((r["run_id"], r["seq"]) for r in trim_rows(d).collect()) == [("long", i) for i in range(1, 5)]


def test_clean_of_text_rows(spark):
    rows = [("a", 0, "s", "N", "C", "-", "-", "wt%", "-")]
    rows += [("a", i, str(30 + 10 * i), "100", "80", "0.1", "1.0", "0.3", None) for i in range(1, 41)]
    rows += [("a", 41 + i, "footer", None, None, None, None, None, None) for i in range(5)]
    raw = spark.createDataFrame(rows, "run_id string, seq bigint, Time string, Load string, Temperature string, COF string, "
                                      "`Friction absolute integral` string, Concentration string, Esterified string")
    out = clean_runs(raw, Params(downsample=4, rolling=3)).orderBy("seq", "is_summary").collect()
    assert len(out) == 9 and out[-1]["is_summary"] and out[-1]["time_s"] == 7200.0
    assert {r["ester"] for r in out} == {0} and all(abs(r["cof"] - 0.1) < 1e-12 for r in out)


def closed_form(grid):
    cof = "5e-2 + 3e-4*load_n + 4e-1*(conc-35e-2)*(conc-35e-2) + 2e-4*(temp_c-80) - 1e-2*ester"
    fai = "2e0 - 4e-3*load_n + 5e-1*(conc-2e-1)*(conc-2e-1) + 5e-3*abs(temp_c-90) - 1e-1*ester"
    return grid.withColumn("cof", F.expr(cof)).withColumn("fai", F.expr(fai))


def test_campaign_grid_decisions(spark):
    scored = closed_form(sc.campaign_grid(spark))
    assert scored.count() == 17238
    front = dc.pareto_front(scored.select("point_id", "cof", "fai"))
    assert front.count() == 90
    knee = dc.knee_point(front).first()
    assert knee["point_id"] == 13270 and knee["knee_distance"] == pytest.approx(0.080057989, abs=1e-8)
    best = {r["ester"]: (r["point_id"], r["score"]) for r in dc.scalar_optimum(scored).collect()}
    assert best[0][0] == 5297 and best[1][0] == 13916
    assert best[0][1] == pytest.approx(0.5595014242753367, abs=1e-9)


def test_near_match_and_noise(spark):
    d = spark.createDataFrame([("a", 180.4, 99.6, 0.5504, 1), ("b", 181.0, 100.0, 0.55, 1)], "run_id string, load_n double, temp_c double, conc double, ester int")
    assert [r["run_id"] for r in rw.near_match(d, {"load_n": 180, "temp_c": 100, "conc": 0.55, "ester": 1}).collect()] == ["a"]
    moved = rw.jitter(d, {"load_n": 2.0, "conc": 5.0}).collect()
    assert all(abs(r["load_n_plot"] - r["load_n"]) <= 2 and r["conc_plot"] >= 0 for r in moved)
