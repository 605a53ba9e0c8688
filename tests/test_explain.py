import pytest
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from rigspark.plans import explain as ex


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(80).select(F.col("id").alias("row_id"), (F.col("id") % 7 * 1e0).alias("a"), (F.col("id") % 5 * 2e0).alias("b"),
                               (F.col("id") % 3 * 1e0).alias("c"), (F.col("id") % 2).cast("int").alias("ester"))
    return d.cache()


@pytest.fixture(scope="module")
def model(spark):
    return SQLTransformer(statement="SELECT *, a*b + sqrt(c + a) AS pred_cof FROM __THIS__")


def test_attributions_add_up(rows, model):
    bg = ex.sample_rows(rows, 6, seed=3)
    attr = ex.shapley(model, rows, ["a", "b", "c"], bg, permutations=5, sample=30)
    base = model.transform(bg).agg(F.avg("pred_cof")).first()[0]
    out = {r["row_id"]: r["pred_cof"] for r in model.transform(rows).collect()}
    total = attr.groupBy("row_id").agg(F.sum("phi").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert len(total) == 30
    assert all(r["n"] == 3 and r["s"] == pytest.approx(out[r["row_id"]] - base, abs=1e-9) for r in total)


def test_all_orders_give_the_exact_value(spark):
    """For f = a*b and one background row at 0, each factor gets half of the product."""
    d = spark.createDataFrame([(1, 3.0, 4.0)], "row_id int, a double, b double")
    bg = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
    m = SQLTransformer(statement="SELECT *, a*b AS pred_cof FROM __THIS__")
    phi = {r["feature"]: r["phi"] for r in ex.shapley(m, d, ["a", "b"], bg, permutations=2).collect()}
    assert phi == {"a": 6.0, "b": 6.0}


def test_paths_end_at_the_prediction(rows, model):
    bg = ex.sample_rows(rows, 6, seed=3)
    attr = ex.shapley(model, rows, ["a", "b", "c"], bg, permutations=4, sample=20)
    base = model.transform(bg).agg(F.avg("pred_cof")).first()[0]
    ends = ex.decision_paths(attr, base, 5).groupBy("row_id").agg(F.max_by("path", "importance").alias("end")).collect()
    out = {r["row_id"]: r["pred_cof"] for r in model.transform(rows).collect()}
    assert len(ends) == 5 and all(r["end"] == pytest.approx(out[r["row_id"]], abs=1e-9) for r in ends)
    order = [r["output"] for r in ex.order_by_output(attr).collect()]
    assert order == sorted(order, reverse=True)
    assert ex.shapley_pairs(attr, rows, ["a"]).count() == 20


@pytest.mark.parametrize("features,cells", [("a", 7), (["a", "b"], 35)])
def test_partial_dependence_equals_brute_force(rows, model, features, cells):
    got = ex.partial_dependence(model, rows, features).collect()
    data = rows.collect()
    assert len(got) == cells
    for g in got:
        want = [(g["a"]) * (g["b"] if "b" in features else r["b"]) + (r["c"] + g["a"]) ** 0.5 for r in data]
        assert g["mean_pred"] == pytest.approx(sum(want) / len(want)) and g["n_rows"] == 80
