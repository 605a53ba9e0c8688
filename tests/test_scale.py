"""One run holds a third of all rows; chunk borders, salts and slices must not change a result."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from rigspark import scale
from rigspark.models import learners
from rigspark.models.registry import REGISTRY, fit_model
from rigspark.operators import neighbors as nb, prepare as pr, relational as rl, stats as st, timeseries as ts
from rigspark.plans import decide as dc
from rigspark.sources.runs import trim_rows


@pytest.fixture(scope="module")
def skewed(spark):
    """30 runs; run r0 has 500 of 1,500 rows. Sequence keys have gaps, values have ties."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        run = "r0" if i % 3 == 0 else f"r{1 + int(rng.integers(29))}"
        v = 0.25 if rng.random() < 0.3 else float(rng.random())
        rows.append((run, 2 * i, float(i), v, float(rng.random()), 60.0 + int(rng.integers(3)), 0.1, int(rng.integers(2))))
    d = spark.createDataFrame(rows, "run_id string, seq bigint, time_s double, cof double, fai double, load_n double, conc double, ester int")
    return d.withColumn("temp_c", F.lit(80e0)).cache()


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.select(*cols).collect())


OPERATORS = {
    "downsample": lambda d, n: ts.downsample(d, 7, rows=n),
    "rolling_strict": lambda d, n: ts.rolling_mean(d, "cof", 20, rows=n),
    "rolling_partial": lambda d, n: ts.rolling_mean(d, "cof", 60, strict=False, rows=n),
    "last_window": lambda d, n: ts.last_window(d, 300, rows=n),
    "summary_rows": lambda d, n: ts.summary_rows(d, 300, rows=n),
    "tail_n": lambda d, n: ts.tail_n(d, 5, rows=n),
    "run_in_time": lambda d, n: ts.run_in_time(d, n=10, tail=5, rows=n),
    "trim_rows": lambda d, n: trim_rows(d, 3, 5, rows=n),
    "residual_filter": lambda d, n: pr.residual_filter(d.withColumn("abs_err", F.col("cof") + 0.04), 0.05, rows=n),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_chunks_do_not_matter(skewed, name):
    op = OPERATORS[name]
    assert rows_of(op(skewed, 16)) == rows_of(op(skewed, 1 << 20))


def test_positions_equal_one_window_per_run(skewed):
    got = scale.with_positions(skewed, "run_id", "seq", rows=11).select("run_id", "seq", "pos", "n_rows")
    w = W.partitionBy("run_id")
    want = skewed.select("run_id", "seq", (F.row_number().over(w.orderBy("seq")) - 1).alias("pos"), F.count(F.lit(1)).over(w).alias("n_rows"))
    assert rows_of(got) == rows_of(want)


def test_trailing_equals_one_window_per_run(skewed):
    got = ts.rolling_mean(skewed, "cof", 50, strict=False, out="m", rows=8).select("run_id", "seq", "m")
    want = skewed.select("run_id", "seq", F.avg("cof").over(W.partitionBy("run_id").orderBy("seq").rowsBetween(-49, 0)).alias("m"))
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_partition_count_does_not_matter(spark, skewed, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = rows_of(ts.run_in_time(skewed, n=10, tail=5))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        assert rows_of(ts.run_in_time(skewed.repartition(partitions), n=10, tail=5)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("by", [(), "run_id"])
@pytest.mark.parametrize("limit", [1, 40])
def test_sliced_quantiles_are_exact(skewed, by, limit):
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    assert rows_of(explode(scale.quantiles(skewed, ["cof", "fai"], qs, by, rows=limit))) \
        == rows_of(explode(scale.quantiles(skewed, ["cof", "fai"], qs, by)))


def explode(d):
    return d.select(*[c for c in d.columns if not c.endswith("_q")], F.posexplode(F.arrays_zip("cof_q", "fai_q"))).select("*", "col.*").drop("col")


def test_sliced_quantiles_of_a_constant_and_of_far_apart_values(spark):
    d = spark.createDataFrame([(1.0, 5.0)] * 50 + [(1e12, 5.0)] + [(1.0 + i * 1e-9, 5.0) for i in range(60)], "cof double, fai double")
    qs = [0.1, 0.5, 0.9]
    assert scale.quantiles(d, ["cof", "fai"], qs, rows=5).first() == scale.quantiles(d, ["cof", "fai"], qs).first()


def test_outliers_on_both_paths(skewed):
    assert rows_of(pr.quantile_outliers(skewed, "run_id", ["cof", "fai"], rows=60)) == rows_of(pr.quantile_outliers(skewed, "run_id", ["cof", "fai"]))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_broadcast(skewed, how):
    stats = skewed.filter("run_id <> 'r5'").groupBy("run_id").agg(F.avg("fai").alias("mu"))
    assert rows_of(scale.attach(skewed, stats, "run_id", how, rows=0)) == rows_of(scale.attach(skewed, stats, "run_id", how))


def test_weights_beyond_the_broadcast_limit(skewed, monkeypatch):
    want = rows_of(st.sample_weights(skewed))
    monkeypatch.setattr(scale, "fits", lambda *a, **k: False)
    assert rows_of(st.sample_weights(skewed)) == want


def test_ordered_positions_and_running_sums(skewed):
    n = skewed.count()
    got = scale.ordered_positions(skewed.repartition(5), [F.col("time_s").desc()]).select("time_s", "pos", "total").collect()
    assert all(r["pos"] == n - 1 - r["time_s"] and r["total"] == n for r in got)
    sums = scale.ordered_positions(skewed.select("time_s", "seq"), [F.col("time_s")], "seq", "before").collect()
    assert all(r["before"] == r["time_s"] * (r["time_s"] - 1) for r in sums)


def test_folds_are_disjoint_and_balanced(skewed):
    folds = pr.group_kfold(skewed, 4).collect()
    assert len(folds) == len({r["run_id"] for r in folds}) == skewed.select("run_id").distinct().count()
    load = [sum(r["n_rows"] for r in folds if r["fold"] == f) for f in range(4)]
    assert sum(load) == 1500 and max(load) - min(load) <= max(r["n_rows"] for r in folds)


def test_split_is_by_run_and_repeatable(skewed):
    runs = skewed.select("run_id").distinct().withColumn("k", F.length("run_id"))
    a = {r["run_id"]: r["is_test"] for r in pr.stratified_run_split(runs, ["k"]).collect()}
    b = {r["run_id"]: r["is_test"] for r in pr.stratified_run_split(runs.repartition(7), ["k"]).collect()}
    assert a == b and sum(a.values()) == -(-len(a) // 10)


def brute_front(pts):
    return sorted(i for i, (x, y) in enumerate(pts)
                  if not any(a <= x and b <= y and (a < x or b < y) for a, b in pts))


@pytest.mark.parametrize("shape", ["random", "falling", "copies"])
@pytest.mark.parametrize("limit", [5, 1_000_000])
def test_front_equals_brute_force(spark, shape, limit):
    rng = np.random.default_rng(5)
    if shape == "falling":
        pts = [(float(i), float(-i)) for i in range(150)]
    else:
        pts = [(float(x), float(y)) for x, y in rng.integers(0, 25, (250, 2))]
        if shape == "copies":
            pts = pts + [(0.0, 3.0)] * 120
    d = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "point_id int, cof double, fai double")
    got = sorted(r["point_id"] for r in dc.pareto_front(d, slices=8, slice_rows=limit).collect())
    assert got == brute_front(pts)


@pytest.mark.parametrize("block", [40, 20_000])
def test_neighbours_equal_brute_force(spark, block):
    rng = np.random.default_rng(1)
    refs, queries = rng.random((240, 3)), rng.random((60, 3))
    refs[:80] = refs[0]  # a third of the references are copies
    queries[:20] = refs[0]
    r = spark.createDataFrame([(i, v.tolist(), float(i)) for i, v in enumerate(refs)], "rid bigint, vec array<double>, y double")
    q = spark.createDataFrame([(v.tolist(),) for v in queries], "vec array<double>")
    found = {}
    for row in nb.knn_join(q, r, 4, ["y"], block_rows=block).collect():
        found.setdefault(tuple(row["vec"]), []).append((row["place"], row["rid"], row["y"]))
    assert len(found) == 41
    for v, got in found.items():
        dist = np.sqrt(((refs - np.array(v)) ** 2).sum(axis=1))
        want = np.lexsort((np.arange(len(refs)), dist))[:4].tolist()
        assert [g[1] for g in sorted(got)] == want and [int(g[2]) for g in sorted(got)] == want


def test_sequential_design_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    pts = [(i, float(c), float(l), float(t), 0, float(rng.random())) for i, (c, l, t) in enumerate(rng.random((60, 3)))]
    seen = [(float(c), float(l), float(t), 0) for c, l, t in rng.random((8, 3))]
    cands = spark.createDataFrame(pts, "point_id int, conc double, load_n double, temp_c double, ester int, uncertainty double")
    measured = spark.createDataFrame(seen, "conc double, load_n double, temp_c double, ester int")
    got = [r["point_id"] for r in dc.doe_sequential(cands, measured).orderBy("place").collect()]
    x = np.array([p[1:5] for p in pts], dtype=float)
    lo, width = x.min(axis=0), x.max(axis=0) - x.min(axis=0)
    width[width == 0] = 1.0
    z, known = (x - lo) / width, list((np.array(seen, dtype=float) - lo) / width)
    pool, want = list(range(60)), []
    for _ in range(5):
        d = np.array([min(np.linalg.norm(z[i] - k) for k in known) for i in pool])
        score = 0.5 * np.array([pts[i][5] for i in pool]) + 0.5 * (d - d.min()) / (d.max() - d.min() + 1e-9)
        best = pool[int(score.argmax())]
        want.append(best)
        known.append(z[best])
        pool.remove(best)
    assert got == want


def test_semi_and_anti_joins_beyond_the_limit(skewed, monkeypatch):
    chosen = skewed.filter("fai > 0.995").select("run_id")
    want = rows_of(rl.runs_subset(skewed, chosen))
    monkeypatch.setattr(scale, "fits", lambda *a, **k: False)
    assert rows_of(rl.runs_subset(skewed, chosen)) == want


def test_null_keys_are_keys(spark):
    d = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, v int")
    for rows in (200_000, 0):
        out = scale.attach(d, d.groupBy("k").agg(F.count("*").alias("n")), "k", rows=rows)
        assert sorted((r["v"], r["n"]) for r in out.collect()) == [(1, 2), (2, 2), (3, 1)]


def test_dropped_run_keeps_one_row_beside_its_summary(spark):
    d = spark.createDataFrame([("a", 0, 0.9, False), ("a", 1, 0.7, False), ("a", 1, 0.7, True), ("b", 0, 0.01, False)],
                              "run_id string, seq bigint, abs_err double, is_summary boolean")
    assert sorted((r["run_id"], r["seq"], r["is_summary"]) for r in pr.residual_filter(d, 0.05).collect()) == [("a", 1, False), ("b", 0, False)]


def test_template_curve_has_no_cap(spark):
    from rigspark.operators.timeseries import template_curve

    signal = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0), ("a", 1, 2.0, 2.0, 3.0)], "run_id string, seq bigint, time_s double, load_n double, temp_c double")
    points = spark.range(250_001).select(F.col("id").alias("setpoint"))
    out = template_curve(signal, "a", points)
    assert out.count() == 500_002 and out.select("setpoint", "step").distinct().count() == 500_002


@pytest.mark.parametrize("how", ["min", "max"])
def test_best_rows_of_groups_keep_null_groups_and_null_scores(spark, how):
    rows = [("a", 3, 1.0), ("a", 1, 1.0), ("a", 2, None), (None, 5, 2.0), (None, 6, 7.0), ("c", 9, None), ("c", 8, None)]
    d = spark.createDataFrame(rows, "g string, k bigint, s double")
    got = {(r["g"], r["k"]) for r in rl.arg_row(d, "s", "k", how, "g").collect()}
    assert got == {("a", 1), (None, 5 if how == "min" else 6), ("c", 8)}


def test_front_keeps_null_categories_and_crowded_values(spark):
    rows = [(None, 0.001, 2.0 + i) for i in range(50)] + [(None, 0.001, 1.0)] * 3 + [("b", 0.001, 0.5), ("b", 0.5, 0.4), ("b", 0.6, 0.4)]
    d = spark.createDataFrame(rows, "g string, cof double, fai double")
    assert rows_of(dc.pareto_front(d, by="g")) == rows_of(spark.createDataFrame(
        [(None, 0.001, 1.0)] * 3 + [("b", 0.001, 0.5), ("b", 0.5, 0.4)], d.schema))


@pytest.mark.parametrize("dims, reach", [(6, 0.25), (24, 0.25), (24, -1.0)])
def test_wide_neighbours_in_blocks_and_windows(spark, dims, reach, monkeypatch):
    """Vectors without structure go by blocks; both ways give the distances and ties of a plain scan, and no vector is repeated per cell."""
    monkeypatch.setattr(nb, "MOST_REACHED", reach)
    monkeypatch.setattr(nb, "LEAST_CELL", 64)
    rng = np.random.default_rng(dims)
    y = np.round(rng.normal(size=(700, dims)), 1 if dims < 10 else 6)
    y[100:140] = y[0]
    x = np.concatenate([y[::5], rng.normal(size=(60, dims)) * 3])
    r = spark.createDataFrame([(i, [float(a) for a in v], float(i % 7)) for i, v in enumerate(y)], "rid bigint, vec array<double>, y double")
    q = spark.createDataFrame([([float(a) for a in v],) for v in x], "vec array<double>")
    got = {}
    for row in nb.knn_join(q, r, 5, ["y"], block_rows=90).collect():
        got.setdefault(tuple(row["vec"]), []).append((row["dist"], row["rid"], row["y"]))
    assert len(got) == len({tuple(v) for v in x.tolist()})
    for v, found in got.items():
        d = nb._dist(np.array([v]), y)[0]
        assert sorted(found) == [(d[i], i, float(i % 7)) for i in sorted(range(len(y)), key=lambda i: (d[i], i))[:5]]


def test_products_leave_out_nothing_within_rounding():
    rng = np.random.default_rng(3)
    for shift in (0.0, 1e6, 1e160):
        y = rng.normal(size=(900, 20)) + shift
        x = np.concatenate([y[:30], rng.normal(size=(30, 20)) + shift])
        y[500:520] = y[3]
        row, at, dist = nb._nearest(x, y, 4)
        d = nb._dist(x, y)
        for i in range(len(x)):
            best = sorted(range(len(y)), key=lambda j: (d[i, j], j))[:4]
            assert at[row == i].tolist() == best and dist[row == i].tolist() == d[i, best].tolist()


def test_targets_share_one_search_for_neighbours(spark, monkeypatch):
    """A model of several targets looks for neighbours once, also where its predictions are too many to broadcast, and predicts as each alone."""
    rng = np.random.default_rng(8)
    rows = [(f"r{i}", *map(float, v), float(i % 5 + 1), float(i % 3 + 1)) for i, v in enumerate(rng.integers(0, 4, (200, 5)))]
    d = spark.createDataFrame(rows, "row_id string, a double, b double, c double, d double, e double, cof double, fai double")
    both, features = ["cof", "fai"], list("abcde")
    want = {r["row_id"]: r for r in fit_model(REGISTRY["knn"], {"k": 3}, d, features, ["cof"]).transform(d).collect()}
    calls = []
    monkeypatch.setattr(learners, "knn_join", lambda *a, **k: calls.append(1) or nb.knn_join(*a, **k))
    monkeypatch.setattr(learners, "fits", lambda df: False)
    monkeypatch.setattr(learners, "HOT_ROWS", 1)
    model = fit_model(REGISTRY["knn"], {"k": 3}, d, features, both)
    got = model.transform(d).collect()
    assert len(calls) == 1 and len(got) == 200
    assert all(abs(r["pred_cof"] - want[r["row_id"]]["pred_cof"]) < 1e-12 for r in got)
    for t in both:
        alone = {r["row_id"]: r[f"_p_{t}"] for r in model.fitted[t].transform(reduce(lambda x, s: s.transform(x), model.shared, d)).collect()}
        assert all(abs(np.exp(alone[r["row_id"]]) - r[f"pred_{t}"]) < 1e-9 for r in got)
