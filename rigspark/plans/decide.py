"""Decisions over scored setpoints: fronts, optima, stability, next experiments."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.physics import add_features
from ..functions.rows import near_match
from ..models.registry import long_predictions
from ..models.stages import RangeScaler
from ..operators.neighbors import nearest_distance
from ..operators.relational import arg_row, novel
from ..operators.stats import minmax_score
from ..operators.timeseries import run_in_time, template_curve
from ..params import DOE_PICKS, RANGE_EPS, SETPOINT, SPARSITY_WEIGHT, STEADY_AT_SECONDS, TARGETS, UNCERTAINTY_WEIGHT
from ..scale import as_list, attach, quantiles
from ..session import cut
from .scenarios import neighbours, tail_times

SLICES = 256
SLICE_ROWS = 1_000_000
FAR = 1e9  # between groups that must not be neighbours; points lie within a few units


def pareto_front(df: DataFrame, x: str = "cof", y: str = "fai", by: str | Iterable[str] = (), slices: int = SLICES,
                 slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows no other row beats in (x, y), both minimised; exact duplicates all stay.

    Rows are sliced along x at approximate quantiles. The least y of all
    slices to the left rules most rows out at once; slicing is repeated on what
    is left until no slice is large. Only then does each slice run an ordered
    minimum, over its distinct x values.
    """
    by = as_list(by)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = [i / slices for i in range(1, slices)]
    for _ in range(8):
        cuts = d.agg(F.percentile_approx(x, at, 10_000)).first()[0] or []
        splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
        d = Bucketizer(splits=splits, inputCol=x, outputCol="_slice").transform(d.drop("_slice"))
        per = d.groupBy(*by, "_slice").agg(F.min(y).alias("_best"), F.count(F.lit(1)).alias("_n"))
        before = F.min("_best").over(W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
        per = cut(per.withColumn("_before", before).drop("_best"))
        largest = per.agg(F.max("_n")).first()[0] or 0
        d = attach(d, per.drop("_n"), [*by, "_slice"])
        d = d.filter(F.col("_before").isNull() | (F.col(y) < F.col("_before"))).drop("_before")
        if largest <= slice_rows:
            break
        d = cut(d)
    least = d.groupBy(*by, "_slice", x).agg(F.min(y).alias("_y"))
    w = W.partitionBy(*by, "_slice").orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    front = least.withColumn("_prev", F.min("_y").over(w)).filter(F.col("_prev").isNull() | (F.col("_y") < F.col("_prev")))
    # a front is short: met on both values, a crowded x brings no more rows than the front has
    return attach(d, front.select(*by, "_slice", x, F.col("_y").alias(y)), [*by, "_slice", x, y]).select(*df.columns)


def knee_point(front: DataFrame, x: str = "cof", y: str = "fai", tie: str = "point_id", by: str | Iterable[str] = (),
               eps: float = RANGE_EPS) -> DataFrame:
    """The front row farthest from the chord between the front's ends; the first row of a front of two or less.

    A front falls monotonically, so its ends are its extremes and one
    aggregate locates the chord.
    """
    by = as_list(by)
    ends = front.groupBy(*by).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y1"), F.max(y).alias("_y0"),
                                  F.count(F.lit(1)).alias("_n"))
    d = attach(front, ends, by) if by else front.crossJoin(F.broadcast(ends))
    sx, sy = F.col("_x1") - F.col("_x0"), F.col("_y0") - F.col("_y1")
    nx, ny = (F.col(x) - F.col("_x0")) / (sx + F.lit(eps)), (F.col(y) - F.col("_y1")) / (sy + F.lit(eps))
    dx, dy, top = sx / (sx + F.lit(eps)), -(sy / (sy + F.lit(eps))), sy / (sy + F.lit(eps))
    norm = F.sqrt(dx * dx + dy * dy)
    dist = F.when((F.col("_n") > 2) & (norm > 0), F.abs(dx * (ny - top) - dy * nx) / F.nullif(norm, F.lit(0e0))).otherwise(F.lit(0e0))
    d = d.withColumn("knee_distance", dist)
    rest = [*[c for c in front.columns if c not in by], "knee_distance"]
    best = d.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(-F.col("knee_distance"), F.col(x), F.col(tie))).alias("_r"))
    return best.select(*by, "_r.*")


def annotated_front(front: DataFrame, grid: DataFrame, on: str = "point_id") -> DataFrame:
    return front.join(grid, on)


def scalar_optimum(scored: DataFrame, by: str | Iterable[str] = "ester", targets: Iterable[str] = TARGETS, tie: str = "point_id") -> DataFrame:
    """Per group the row with the least sum of range-scaled targets, first in grid order."""
    return arg_row(minmax_score(scored, targets, by), "score", tie, "min", by)


def tail_value(model: Model, points: DataFrame, start: int = 6900, stop: int = 7200, step: int = 10, key: str | Iterable[str] = "point_id",
               prepare=add_features, targets: Iterable[str] = TARGETS) -> DataFrame:
    """Mean prediction over the end of a test at each point."""
    scored = model.transform(prepare(tail_times(points, start, stop, step)))
    return scored.groupBy(*as_list(key)).agg(*[F.avg(f"pred_{t}").alias(f"tail_{t}") for t in targets])


def optimum_curve(model: Model, points: DataFrame, template: DataFrame, template_run: str, key: str = "point_id", prepare=add_features,
                  base_state: int = 0) -> tuple[DataFrame, DataFrame]:
    """Predicted signal of each point on the template's time axis beside the base state's, and its run-in time."""
    both = points.withColumn("kind", F.lit("optimum")).unionByName(
        points.withColumn("ester", F.lit(base_state).cast(points.schema["ester"].dataType)).withColumn("kind", F.lit("base")))
    curve = model.transform(prepare(template_curve(template, template_run, both.drop("time_s"))))
    curve = curve.select(key, "kind", "step", "time_s", *SETPOINT, F.col("pred_cof").alias("cof"), F.col("pred_fai").alias("fai"))
    run_in = run_in_time(curve.filter("kind = 'optimum'"), "cof", tail=100, run=key, order="step")
    return curve, run_in


def stability(model: Model, points: DataFrame, reference: str = "tail_cof", rel: float = 0.1, limit: float = 0.05, key: str = "point_id",
              prepare=add_features) -> DataFrame:
    """Largest relative change of the first target over the eight neighbours of every point."""
    scored = model.transform(prepare(neighbours(points, rel)))
    dev = F.abs(F.col("pred_cof") - F.col(reference)) / F.col(reference)
    out = scored.groupBy(key).agg(F.max(dev).alias("max_deviation"))
    return out.withColumn("status", F.when(F.col("max_deviation") < limit, "Stable").otherwise("Unstable"))


def disagreement(preds: DataFrame, key: str | Iterable[str] = "point_id", by: str | Iterable[str] = (), target: str = "target",
                 eps: float = RANGE_EPS) -> DataFrame:
    """Spread between models per point, range-scaled per target and averaged over targets."""
    key, by = as_list(key), as_list(by)
    spread = preds.groupBy(*by, *key, target).agg(F.stddev_pop("pred").alias("spread"))
    span = spread.groupBy(*by, target).agg(F.min("spread").alias("_lo"), F.max("spread").alias("_hi"))
    d = attach(spread, span, [*by, target])
    scaled = (F.col("spread") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(eps))
    return d.groupBy(*by, *key).agg(F.avg(scaled).alias("uncertainty"))


def scaled_setpoints(grid: DataFrame, other: DataFrame, cols: Sequence[str] = SETPOINT) -> tuple[DataFrame, DataFrame]:
    """Both tables on the grid's range, in columns ``_s_<name>``."""
    scaler = RangeScaler(inputCols=list(cols), outputCols=[f"_s_{c}" for c in cols]).fit(grid)
    return scaler.transform(grid), scaler.transform(other)


def _state_places(points: DataFrame, other: DataFrame, cols: Sequence[str], by: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables on the range that ``points`` have in their own group of ``by`` (a column of a few values); groups lie FAR apart."""
    cols = [c for c in cols if c != by]
    ranges = points.groupBy(by).agg(*[f(c).cast("double").alias(f"{e}_{c}") for c in cols for e, f in (("a", F.min), ("b", F.max))]).orderBy(by).collect()

    def placed(d: DataFrame) -> DataFrame:
        own = F.col(by)

        def pick(value) -> Column:
            out = F.lit(None).cast("double")
            for i, r in enumerate(ranges):
                out = F.when(own == F.lit(r[by]), value(i, r)).otherwise(out)
            return out
        scaled = {f"_s_{c}": pick(lambda i, r, c=c: (F.col(c) - F.lit(r[f"a_{c}"])) / F.lit((r[f"b_{c}"] - r[f"a_{c}"]) or 1.0)) for c in cols}
        return d.withColumns(scaled | {"_s_group": pick(lambda i, r: F.lit(i * FAR))}).filter("_s_group IS NOT NULL")
    return placed(points), placed(other), [*(f"_s_{c}" for c in cols), "_s_group"]


def sparsity(points: DataFrame, measured: DataFrame, cols: Sequence[str] = SETPOINT, eps: float = RANGE_EPS, by: str | None = None) -> DataFrame:
    """Distance of each point to its nearest measured setpoint in grid-scaled space, and that distance range-scaled.

    With ``by`` each group of points is scaled for itself and meets the measured rows of its own group only; points of a group that was
    never measured have no distance and are left out.
    """
    if by:
        g, m, places = _state_places(points, measured, cols, by)
        d = cut(nearest_distance(g, m, places).filter(F.col("distance") < FAR / 2))
        span = d.groupBy(by).agg(F.min("distance").alias("_lo"), F.max("distance").alias("_hi"))
        d = attach(d, span, by)
    else:
        g, m = scaled_setpoints(points, measured, cols)
        d = cut(nearest_distance(g, m, [f"_s_{c}" for c in cols]))
        span = d.agg(F.min("distance").alias("_lo"), F.max("distance").alias("_hi"))
        d = d.crossJoin(F.broadcast(span))
    d = d.withColumn("sparsity", (F.col("distance") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(eps)))
    return d.select(*points.columns, "distance", "sparsity")


def doe_sequential(candidates: DataFrame, measured: DataFrame, n: int = DOE_PICKS, w_u: float = UNCERTAINTY_WEIGHT, w_s: float = SPARSITY_WEIGHT,
                   cols: Sequence[str] = SETPOINT, key: str = "point_id", scale_on: DataFrame | None = None, eps: float = RANGE_EPS,
                   by: str | None = None, carry: Sequence[str] = (), distance: str | None = None) -> DataFrame:
    """Greedy picks of uncertain and remote points; each pick counts as measured for the next.

    With ``by`` (a column of a few values, as the state) every group has picks of its own, measured against its own rows on its own ranges, and all
    groups go through a round together. Groups without measured rows have no picks. ``carry`` names further columns of the picks.
    ``distance`` names a column of distances to the measured rows on the ranges of ``scale_on``, where they are known (see ``sparsity``).

    Distances to the measured set are found once. A pick can only shorten
    them, so later rounds take the minimum with the distance to the pick; the
    range of distances is taken anew over the points still in the pool. The pool is stored once, rounds are expressions over it.
    """
    frame = scale_on if scale_on is not None else candidates
    spark = candidates.sparkSession
    if by:
        frame_of = {r[by]: r for r in frame.groupBy(by).agg(*[f(c).cast("double").alias(f"{e}_{c}") for c in cols for e, f in (("a", F.min), ("b", F.max))]).collect()}
    else:
        frame_of = {0: frame.agg(*[f(c).cast("double").alias(f"{e}_{c}") for c in cols for e, f in (("a", F.min), ("b", F.max))]).first()}
    group = F.col(by) if by else F.lit(0)

    def place(c: str) -> Column:
        out = F.lit(None).cast("double")
        for g, r in frame_of.items():
            low, high = r[f"a_{c}"] or 0.0, r[f"b_{c}"] or 0.0
            out = F.when(group == F.lit(g), (F.col(c) - F.lit(low)) / F.lit((high - low) or 1.0)).otherwise(out)
        return out

    places = [f"_s_{c}" for c in cols]
    pool = candidates.withColumns({f"_s_{c}": place(c) for c in cols} | {"_g": group})
    if distance is not None:
        pool = pool.withColumn("_d", F.col(distance))
    elif by:
        pool = pool.join(sparsity(frame, measured, cols, eps, by).select(key, F.col("distance").alias("_d")), key)
    else:
        pool = nearest_distance(pool, measured.withColumns({f"_s_{c}": place(c) for c in cols}), places, "_d")
    pool = cut(pool.drop("distance") if distance is None and "distance" in candidates.columns else pool)
    fields = (f"{by} {candidates.schema[by].dataType.simpleString()}, " if by and by not in cols else "") \
        + f"place int, {key} {candidates.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in cols) \
        + ", uncertainty double, " + "".join(f"{c} double, " for c in carry) + "distance double, norm_distance double, score double"
    picks = []
    for turn in range(1, n + 1):
        spans = {r["_g"]: r for r in pool.groupBy("_g").agg(F.min("_d").alias("lo"), F.max("_d").alias("hi")).collect()}
        if not spans:
            break
        tops = []
        for g, span in spans.items():
            remote = (F.col("_d") - F.lit(span["lo"])) / F.lit(span["hi"] - span["lo"] + eps)
            scored = pool.filter(F.col("_g") == F.lit(g)).withColumn("norm_distance", remote)
            scored = scored.withColumn("score", F.lit(w_u) * F.col("uncertainty") + F.lit(w_s) * F.col("norm_distance"))
            tops.append(scored.orderBy(F.desc("score"), key).limit(1))
        nearer, gone = F.col("_d"), F.lit(False)
        for best in reduce(lambda a, b: a.unionByName(b), tops).collect():
            g = best["_g"]
            picks.append(((best[by],) if by and by not in cols else ()) + (turn, best[key], *[float(best[c]) for c in cols], float(best["uncertainty"]),
                         *[float(best[c]) for c in carry], float(best["_d"]), float(best["norm_distance"]), float(best["score"])))
            to_pick = F.sqrt(sum(((F.col(s) - F.lit(best[s])) ** 2 for s in places), F.lit(0e0)))
            nearer = F.when(F.col("_g") == F.lit(g), F.least("_d", to_pick)).otherwise(nearer)
            gone = gone | ((F.col("_g") == F.lit(g)) & (F.col(key) == F.lit(best[key])))
        pool = pool.filter(~gone).withColumn("_d", nearer)
    return spark.createDataFrame(picks, fields)


def safe_point(cands: DataFrame, q: float = 0.25, pred: str = "pred", by: str | Iterable[str] = (), key: str = "point_id") -> DataFrame:
    """Among points both near to measurements and agreed upon, the one with the least prediction."""
    by = as_list(by)
    cut_at = quantiles(cands, ["distance", "uncertainty"], [q], by)
    d = attach(cands, cut_at, by) if by else cands.crossJoin(F.broadcast(cut_at))
    d = d.filter((F.col("distance") < F.col("distance_q")[0]) & (F.col("uncertainty") < F.col("uncertainty_q")[0])).select(*cands.columns)
    return arg_row(d, pred, key, "min", by)


def doe_curves(model: Model, picks: DataFrame, template: DataFrame, template_run: str, key: str | Iterable[str] = "point_id", prepare=add_features) -> DataFrame:
    curve = model.transform(prepare(template_curve(template, template_run, picks.select(*as_list(key), *SETPOINT))))
    return curve.select(*as_list(key), "step", "time_s", F.col("pred_cof").alias("cof"))


def design_candidates(preds: DataFrame, grid: DataFrame, measured: DataFrame, state: str = "ester") -> DataFrame:
    """Grid points with what a design weighs, each state for itself: ``distance`` to the measured rows, ``uncertainty`` between models, its
    spread per target (``uncertainty_<target>``), and the mean prediction of the first target.

    ``preds`` are long predictions at the grid points with ``point_id`` and the state.
    """
    own = disagreement(preds, "point_id", state)
    spread = preds.groupBy("point_id").agg(*[F.stddev_pop(F.when(F.col("target") == t, F.col("pred"))).alias(f"uncertainty_{t}") for t in TARGETS],
                                           F.avg(F.when(F.col("target") == TARGETS[0], F.col("pred"))).alias("pred"))
    return sparsity(grid, measured, by=state).join(own.drop(state), "point_id").join(spread, "point_id")


def suggest_experiments(models: Mapping[str, Model], grid: DataFrame, measured: DataFrame, n: int = DOE_PICKS, prepare=add_features,
                        state: str = "ester") -> tuple[DataFrame, DataFrame]:
    """Next experiments and the safe validation point of each state; both states go through the rounds together."""
    preds = long_predictions(models, prepare(grid.withColumn("time_s", F.lit(STEADY_AT_SECONDS))), ["point_id", state])
    cands = cut(design_candidates(preds, grid, measured, state))
    picks = doe_sequential(novel(cands, measured), measured, n, scale_on=grid, by=state, carry=[f"uncertainty_{t}" for t in TARGETS], distance="distance")
    return picks, safe_point(cands, by=state)


def validate_at(models: Mapping[str, Model], df: DataFrame, setpoint: Mapping[str, float], template_run: str, prepare=add_features,
                at: float = STEADY_AT_SECONDS, skip: Iterable[str] = ("knn", "ridge")) -> tuple[DataFrame, DataFrame]:
    """Measured curve of the first run at a setpoint, predicted curves on the template axis, and predictions at one time.

    Curves are long: ``model`` is "measured" for the run itself.
    """
    from .scenarios import as_points

    models = {k: m for k, m in models.items() if k not in set(skip)}
    run = near_match(df, setpoint).agg(F.min("run_id")).first()[0]
    actual = df.filter(F.col("run_id") == run).select(F.lit("measured").alias("model"), "time_s", *TARGETS)
    point = as_points(df.sparkSession, {k: (int(v) if k == "ester" else float(v)) for k, v in setpoint.items()})
    curve = long_predictions(models, prepare(template_curve(df, template_run, point)), ["step", "time_s"])
    wide = curve.groupBy("model", "step", "time_s").pivot("target", list(TARGETS)).agg(F.first("pred")).drop("step")
    one = long_predictions(models, prepare(point.withColumn("time_s", F.lit(float(at)))), ["time_s"])
    return actual.unionByName(wide.select("model", "time_s", *TARGETS)), one.groupBy("model").pivot("target", list(TARGETS)).agg(F.first("pred"))


