"""Validation of the linear family (M6, M7, M14, M16), with SQL that solves the same small systems."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from ..models import selection as sel
from ..models.registry import REGISTRY, fit_model, sample_params
from ..operators import prepare as pr
from ..params import FOLDS, SEED, TRIALS
from .base import query, rounded, with_v
from .signal import S
from .tables import BINS, SPLIT
from .training import FEATURES, halves, training

SIZES = np.linspace(0.2, 1.0, 10).tolist()
ALPHAS = [p["alpha"] for rng in [random.Random(SEED)] for p in [sample_params(REGISTRY["ridge"].space, rng) for _ in range(TRIALS)]]

# --- SQL: sums of products, ridge by elimination ----------------------------

_P, _T = len(FEATURES), 2
_X = [f"x{i}" for i in range(_P)] + [f"y{t}" for t in range(_T)]
#: Rows around the means of the table, which neither slopes nor errors feel.
_ROWS = S + ", x AS (SELECT run_id, seq, cof, " + ", ".join(
    f"{c} - avg({c}) OVER () AS {x}" for c, x in zip([*FEATURES[:-1], "trunc(ester)", "cof", "fai"], _X)) + " FROM s)"
_SUMS = {"n": "count(*)"} | {f"s_{a}": f"sum({a})" for a in _X} | {f"q_{a}_{b}": f"sum({a}*{b})" for i, a in enumerate(_X) for b in _X[i:]}
_MOMENTS = ", ".join(f"{e} AS {n}" for n, e in _SUMS.items())


def _ridge(cells: str, keys: str, name: str) -> str:
    """CTEs that end in ``name``: per row of ``cells`` (keys, alpha, sums) the intercept b_t and slopes b_i_t of both targets."""
    x, y = _X[:_P], _X[_P:]
    q = lambda a, b: f"q_{a}_{b}" if _X.index(a) <= _X.index(b) else f"q_{b}_{a}"
    cov = lambda a, b: f"({q(a, b)} - s_{a}*s_{b}/n)"  # noqa: E731  times n
    cols = [f"s_{a}/n AS m_{a}" for a in _X] + [f"CASE WHEN {cov(a, a)} > 0 THEN sqrt({cov(a, a)}/n) ELSE 1e0 END AS d_{a}" for a in x]
    out = f", {name}_c AS (SELECT *, {', '.join(cols)} FROM {cells})"
    cells_ = [f"{cov(a, b)}/(d_{a}*d_{b}){' + alpha' if a == b else ''} AS a_{i}_{j}" for i, a in enumerate(x) for j, b in enumerate(x) if j >= i]
    cells_ += [f"{cov(a, b)}/d_{a} AS r_{i}_{t}" for i, a in enumerate(x) for t, b in enumerate(y)]
    means = [f"m_{a}" for a in _X] + [f"d_{a}" for a in x]
    out += f", {name}_0 AS (SELECT {keys}, {', '.join(means + cells_)} FROM {name}_c)"
    for k in range(_P - 1):  # column k is cleared below the diagonal
        new = [f"a_{i}_{j} - a_{k}_{i}*a_{k}_{j}/a_{k}_{k} AS a_{i}_{j}" for i in range(k + 1, _P) for j in range(i, _P)]
        new += [f"r_{i}_{t} - a_{k}_{i}*r_{k}_{t}/a_{k}_{k} AS r_{i}_{t}" for i in range(k + 1, _P) for t in range(_T)]
        out += f", {name}_{k + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM {name}_{k})"
    last = f"{name}_{_P - 1}"
    for i in reversed(range(_P)):
        slopes = [f"(r_{i}_{t}{''.join(f' - a_{i}_{j}*w_{j}_{t}' for j in range(i + 1, _P))})/a_{i}_{i} AS w_{i}_{t}" for t in range(_T)]
        out += f", {name}_w{i} AS (SELECT *, {', '.join(slopes)} FROM {last})"
        last = f"{name}_w{i}"
    b = [f"w_{i}_{t}/d_{a} AS b_{i}_{t}" for i, a in enumerate(x) for t in range(_T)]
    level = [f"m_{c}{''.join(f' - w_{i}_{t}*m_{a}/d_{a}' for i, a in enumerate(x))} AS b_{t}" for t, c in enumerate(y)]
    return out + f", {name} AS (SELECT {keys}, {', '.join(level + b)} FROM {last})"


def _pred(t: int) -> str:
    return f"b_{t}" + "".join(f" + b_{i}_{t}*{a}" for i, a in enumerate(_X[:_P]))


def _errors(rows: str, keys: str, name: str) -> str:
    """CTE of errors per ``keys`` and target over ``rows`` that carry coefficients, and one of both targets together."""
    per = " UNION ALL ".join(
        f"SELECT {keys}, {t} AS t, count(*) AS n_rows, 1 - sum(({_pred(t)}-y{t})**2)/(var_pop(y{t})*count(*)) AS r2, avg(({_pred(t)}-y{t})**2) AS mse, "
        f"avg(abs({_pred(t)}-y{t})) AS mae FROM {rows} GROUP BY {keys}" for t in range(_T))
    return f", {name}_t AS ({per}), {name} AS (SELECT {keys}, CAST(sum(n_rows) AS BIGINT) AS n_rows, avg(r2) AS r2, sqrt(avg(mse)) AS rmse, avg(mae) AS mae FROM {name}_t GROUP BY {keys})"


_FOLDS = _ROWS + """, rn AS (SELECT run_id, count(*) AS n_rows FROM x GROUP BY run_id),
fo AS (SELECT run_id, CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS fold FROM (SELECT *, row_number() OVER (ORDER BY n_rows DESC, run_id) - 1 AS p FROM rn)),
f AS (SELECT x.*, fold FROM x JOIN fo USING (run_id)), pm AS (SELECT fold, """ + _MOMENTS + " FROM f GROUP BY fold), tm AS (SELECT " + ", ".join(
    f"sum({n}) AS {n}" for n in _SUMS) + " FROM pm), rest AS (SELECT fold, " + ", ".join(f"tm.{n} - pm.{n} AS {n}" for n in _SUMS) + " FROM pm, tm)"


@query("cross_validate", with_v(_FOLDS + ", ce AS (SELECT *, 1e0 AS alpha FROM rest)" + _ridge("ce", "fold", "co") + ", sc AS (SELECT * FROM f JOIN co USING (fold))"
                                + _errors("sc", "fold", "er") + """ SELECT 'ridge' AS model, CAST(fold AS INT) AS fold, n_rows, round(r2, 7) AS r2, round(rmse, 8) AS rmse,
  round(mae, 8) AS mae FROM er"""))
def cross_validate(spark, sf):
    d = training(spark, sf)
    d = sel.tag_folds(d, pr.group_kfold(d, FOLDS))
    out = sel.cross_validate(REGISTRY["ridge"], {"alpha": 1.0}, d, FEATURES, FOLDS)
    return rounded(out.select("model", "fold", "n_rows", "r2", "rmse", "mae"), 8, r2=7)


@query("hyper_search", with_v(_FOLDS + ", al AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a!r}, CAST('{a!r}' AS DOUBLE))" for i, a in enumerate(ALPHAS)) + ") v(trial, name, alpha)), ce AS (SELECT * FROM rest, al)" + _ridge("ce", "fold, trial", "co") + ", sc AS (SELECT * FROM f JOIN co USING (fold))"
    + _errors("sc", "fold, trial", "er") + """ SELECT 'ridge' AS model, trial, round(CAST(name AS DOUBLE), 9) AS alpha, round(avg(r2), 7) AS r2_cv FROM er JOIN al USING (trial)
  GROUP BY trial, name"""))
def hyper_search(spark, sf):
    d = training(spark, sf)
    d = sel.tag_folds(d, pr.group_kfold(d, FOLDS))
    trials, _ = sel.search(REGISTRY["ridge"], d, FEATURES, FOLDS, TRIALS)
    return rounded(trials.select("model", "trial", F.col("params")["alpha"].cast("double").alias("alpha"), "r2_cv"), r2_cv=7)


_CURVE = _ROWS + """, rs AS (SELECT DISTINCT run_id, i AS split FROM x, (SELECT unnest([0, 1, 2, 3, 4]) AS i)),
dr AS (SELECT split, run_id, row_number() OVER (PARTITION BY split ORDER BY md5(concat(run_id, '#42#', CAST(split AS VARCHAR))), run_id)
  <= ceil(1e-1*count(*) OVER (PARTITION BY split)) AS is_test FROM rs),
tr AS (SELECT split, x.*, row_number() OVER (PARTITION BY split ORDER BY run_id, seq) - 1 AS nth, count(*) OVER (PARTITION BY split) AS n_train
  FROM x JOIN dr USING (run_id) WHERE NOT is_test),
sh AS (SELECT unnest([""" + ", ".join(f"CAST('{s!r}' AS DOUBLE)" for s in SIZES) + """]) AS share),
pt AS (SELECT tr.*, share FROM tr JOIN sh ON nth < floor(share*n_train)),
ce AS (SELECT split, share, 1e0 AS alpha, """ + _MOMENTS + " FROM pt GROUP BY split, share)" + _ridge("ce", "split, share", "co") \
    + ", st AS (SELECT * FROM pt JOIN co USING (split, share))" + _errors("st", "split, share", "et") \
    + ", sv AS (SELECT * FROM x JOIN dr USING (run_id) JOIN co USING (split) WHERE is_test)" + _errors("sv", "split, share", "ev")


@query("learning_curve", with_v(_CURVE + """ SELECT round(share, 9) AS share, round(avg(et.n_rows/2)/(SELECT avg(c) FROM (SELECT count(*) AS c FROM x GROUP BY run_id)), 8) AS n_runs,
  round(avg(et.r2), 7) AS train_mean, round(stddev_pop(et.r2), 7) AS train_std, round(avg(ev.r2), 4) AS cv_mean, round(stddev_pop(ev.r2), 4) AS cv_std
  FROM et JOIN ev USING (split, share) GROUP BY share"""))
def learning_curve(spark, sf):
    out = sel.learning_curve(REGISTRY["ridge"], {"alpha": 1.0}, training(spark, sf), FEATURES)
    return rounded(out, 7, share=9, n_runs=8, cv_mean=4, cv_std=4)


_LIMIT = 0.02
_AGAIN = _ROWS + (BINS + SPLIT).replace("FROM v GROUP BY", "FROM s GROUP BY") + """, hv AS (SELECT x.*, p <= quota AS is_test FROM x JOIN o USING (run_id) JOIN qt USING (load_n_bin, temp_c_bin)),
c1 AS (SELECT 'first' AS model, 1e0 AS alpha, """ + _MOMENTS + " FROM hv WHERE NOT is_test)" + _ridge("c1", "model", "f1") + f""",
e1 AS (SELECT hv.*, abs(greatest({_pred(0)} + (SELECT avg(cof) FROM s), 1e-3) - cof) AS abs_err FROM hv, f1),
k1 AS (SELECT *, count(CASE WHEN abs_err <= {_LIMIT} THEN 1 END) OVER (PARTITION BY run_id) AS ok, row_number() OVER (PARTITION BY run_id ORDER BY abs_err, seq) AS place FROM e1),
kept AS (SELECT * EXCLUDE (ok, place, abs_err) FROM k1 WHERE abs_err <= {_LIMIT} OR (ok = 0 AND place = 1)),
c2 AS (SELECT 'again' AS model, 1e0 AS alpha, """ + _MOMENTS + " FROM kept)" + _ridge("c2", "model", "f2") + """,
bo AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2), sc AS (SELECT 'kept' AS split, kept.*, bo.* FROM kept, bo UNION ALL SELECT 'test', hv.*, bo.* FROM hv, bo WHERE is_test)""" \
    + _errors("sc", "model, split", "er")


@query("retrain_clean", with_v(_AGAIN + """ SELECT model, split, n_rows, round(r2, 7) AS r2, round(rmse, 8) AS rmse, round(mae, 8) AS mae FROM er"""))
def retrain_clean(spark, sf):
    """Ridge on the training runs; rows with large residuals go; ridge on what is left of all runs."""
    train, test = halves(spark, sf)
    first = fit_model(REGISTRY["ridge"], {"alpha": 1.0}, train, FEATURES)
    again, kept = sel.retrain(REGISTRY["ridge"], {"alpha": 1.0}, first, train.unionByName(test), FEATURES, _LIMIT)
    out = sel.model_scores({"first": first.unclamped(), "again": again.unclamped()}, {"kept": kept, "test": test})
    return rounded(out.filter("target = 'all'").select("model", "split", "n_rows", "r2", "rmse", "mae"), 8, r2=7)
