"""A whole campaign over an archive of files, and a second one that takes everything fitted from the store."""

import random

import pytest
from pyspark.sql import functions as F

from rigspark.models import selection as sel
from rigspark.params import Params
from rigspark.plans import campaign as ca
from rigspark.schema import run_file_schema
from rigspark.sources.runs import read_runs
from rigspark.sources.stage import ModelStore

PARAMS = Params(downsample=4, rolling=3)
SETTINGS = {"models": ("ridge", "forest"), "trials": 2, "folds": 2, "picks": 2, "run_in_rounds": 3, "fixed": {"forest": {"n_estimators": 3, "max_depth": 3}},
            "validation": {"load_n": 100, "temp_c": 60, "conc": 0.1, "ester": 1}}


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    folder, r = tmp_path_factory.mktemp("archive"), random.Random(3)
    for i in range(12):
        load, temp, conc, ester = 40 + 20 * (i % 4), 60 + 20 * (i % 3), 0.1 * (i % 5), i % 2
        head = ["Time", "Load", "Temperature", "COF", "Friction absolute integral", "Concentration", "Esterified"]
        lines = [",".join(head), ",".join("-" * 7)]
        for k in range(100):
            cof = 0.08 + 0.0004 * load + 0.02 * conc + 0.05 / (k + 2) + r.gauss(0, 0.0005)
            lines.append(f"{40 + 30 * k},{load},{temp},{cof:.6f},{1 + cof:.6f},{conc},{ester}")
        (folder / f"run{i:02d}.csv").write_text("\n".join(lines + ["end,,,,,,"] * 5) + "\n")
    return str(folder)


def test_campaign_and_its_second_run(spark, archive, tmp_path, monkeypatch):
    go = lambda: ca.run_campaign(read_runs(spark, archive, "csv", run_file_schema()), PARAMS, ca.Settings(**SETTINGS, store=str(tmp_path / "store")))
    first = go()
    sizes = {name: t.count() for name, t in first.tables.items()}
    assert all(n > 0 for name, n in sizes.items() if name not in ("errors", "high_cof", "safe_points", "model_steady", "validation_point", "validation_curves")), sizes
    assert sizes["doe_suggestions"] == 4 and first.tables["doe_suggestions"].groupBy("ester").count().count() == 2
    assert {r["model"] for r in first.tables["model_metrics"].collect()} == {"ridge", "forest", "ensemble"}
    assert first.tables["model_metrics"].filter("score_ms IS NULL OR n_scored = 0").count() == 0

    def never(*args, **kwargs):
        raise AssertionError("fitted again")
    for where, name in ((ca, "fit_model"), (sel, "fit_model"), (sel, "search"), (ca, "blend_out_of_fold"), (ca.dc, "suggest_experiments"), (ca, "prepare_rows")):
        monkeypatch.setattr(where, name, never)
    monkeypatch.setattr(sel, "learning_curve", lambda *a, **k: None)  # a report, not a stored model
    second = go()
    assert second.best == first.best
    pick = lambda o: sorted((r["place"], r["point_id"], round(r["score"], 9)) for r in o.tables["doe_suggestions"].collect())
    assert pick(first) == pick(second)
    score = lambda o: sorted((r["model"], r["split"], r["target"], round(r["r2"], 9)) for r in o.tables["model_metrics"].collect())
    assert score(first) == score(second)


def test_store_counts_finished_things_only_and_forgets_other_states(spark, tmp_path):
    origin, root = spark.range(5), str(tmp_path / "models")
    store = ModelStore(origin, root, "a")

    class Saved:
        def save(self, path):
            spark.range(1).write.mode("overwrite").parquet(path)

    made = []
    make = lambda: (made.append(1) or Saved(), {"x": 1})
    load = lambda s, path: s.read.parquet(path).count()
    assert isinstance(store.model("m", make, load)[0], Saved) and ModelStore(spark.range(5), root, "a").model("m", make, load) == (1, {"x": 1}) and made == [1]
    with pytest.raises(ValueError):
        store.model("n", lambda: (_ for _ in ()).throw(ValueError()), load)
    assert store.notes("n") is None
    other = ModelStore(origin, root, "b")
    assert other.table("t", lambda: origin.select((F.col("id") * 2).alias("y"))).count() == 5
    assert other.forget_others() == [store.key] and store.notes("m") is None and other.notes("t") == {}
