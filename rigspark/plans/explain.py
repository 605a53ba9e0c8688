"""What drives a model's predictions: partial dependence and Shapley attributions."""

from __future__ import annotations

import random
from collections.abc import Iterable, Sequence

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..params import BACKGROUND_ROWS, SEED, TARGETS
from ..scale import as_list, quantiles, counted
from ..session import cut
from .scenarios import linspace


def _axis(df: DataFrame, feature: str, n: int, lo: float, hi: float) -> Column:
    """Grid of one feature: its values if they are few, else even steps between two quantiles."""
    few = df.select(F.col(feature).cast("double").alias("v")).filter("v IS NOT NULL").distinct().limit(n).collect()
    if len(few) < n:
        return F.array(*[F.lit(v) for v in sorted(r["v"] for r in few)])
    a, b = quantiles(df, feature, (lo, hi)).first()[0]
    return linspace(a, b, n)


def partial_dependence(model: Model, df: DataFrame, features: str | Iterable[str], n: int = 20, lo: float = 0.05, hi: float = 0.95,
                       target: str = TARGETS[0]) -> DataFrame:
    """Mean prediction while one or two features take grid values and all other columns stay as measured.

    The grid is exploded onto the rows and aggregated map-side, so only the
    grid's cells are shuffled.
    """
    features = as_list(features)
    d = df
    for f in features:
        axis = _axis(df, f, n, lo, hi)
        d = d.drop(f).withColumn(f, F.explode(axis))
    return model.transform(d).groupBy(*features).agg(F.avg(f"pred_{target}").alias("mean_pred"), F.count(F.lit(1)).alias("n_rows"))


def sample_rows(df: DataFrame, n: int, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """A repeatable sample: the rows whose hashed key comes first."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def _coalitions(orders: Sequence[Sequence[int]], p: int) -> dict[int, list[int]]:
    """Sets of features (bit masks) that the orders pass through, with the signed weight that a set's value has for every feature.

    A set counts for the feature that completed it and against the next one; orders that share a set share its value.
    """
    weights: dict[int, list[int]] = {}
    for order in orders:
        mask = 0
        for j in order:
            weights.setdefault(mask, [0] * p)[j] -= 1
            mask |= 1 << j
            weights.setdefault(mask, [0] * p)[j] += 1
    return weights


def shapley(model: Model, df: DataFrame, features: Sequence[str], background: DataFrame, permutations: int = 8, sample: int | None = None,
            seed: int = SEED, key: str = "row_id", value: Column | None = None, prepare=None, closed: bool | None = None) -> DataFrame:
    """Additive attributions by sampled feature orders, for any model.

    An order turns a background row into the row one feature at a time. The
    inputs on the way depend on the set of features switched so far only, so every
    (row, background row, set) is scored once for all orders that pass
    through it, and its value goes to the features with the set's signed weights. The full set is
    the row itself, scored once. The empty one is the background row: where the prediction depends on ``features`` alone
    (``closed``; told from the model's own features if not given) it is scored once for all rows.
    The attributions of a row add up to f(row) minus the mean of f(background).
    All rows are attributed unless ``sample`` asks for a number of them.
    """
    features = list(features)
    p = len(features)
    rng = random.Random(seed)
    orders = []
    while len(orders) < permutations:
        o = rng.sample(range(p), p)
        orders += [o, o[::-1]]
    weights = _coalitions(orders[:permutations], p)
    if closed is None:
        closed = prepare is None and set(getattr(model, "features", [None])) <= set(features)
    rows = (df if sample is None else sample_rows(df, sample, key, seed)).select(key, *[c for c in df.columns if c != key])
    bg, short = counted(background.select(*features), BACKGROUND_ROWS)
    if not short:
        raise ValueError(f"every row meets every background row: give a background of at most {BACKGROUND_ROWS} rows")
    n_bg = bg.count()
    v = value if value is not None else F.col(f"pred_{TARGETS[0]}")
    full = (1 << p) - 1
    between = [m for m in sorted(weights) if any(weights[m]) and m != full and (m or not closed)]
    masks = [full, *between]
    empty = 0.0
    if closed:
        empty = model.transform(bg).agg(F.sum(v)).first()[0] or 0.0

    # one background row, the first, brings the full set along; it stands for all of them
    numbered = bg.select(*[F.col(f).alias(f"_b_{f}") for f in features]).withColumn(
        "_first", F.row_number().over(W.orderBy(*[f"_b_{f}" for f in features])) == 1)  # at most BACKGROUND_ROWS rows
    some, every = (F.array(*[F.lit(i) for i in numbers]) for numbers in (range(1, len(masks)), range(len(masks))))
    d = rows.crossJoin(F.broadcast(numbered)).withColumn("_set", F.explode(F.when(F.col("_first"), every).otherwise(some)))
    holds = [F.get(F.array(*[F.lit(bool(m >> j & 1)) for m in masks]), F.col("_set")) for j in range(p)]
    d = d.withColumns({f: F.when(holds[j], F.col(f)).otherwise(F.col(f"_b_{f}")) for j, f in enumerate(features)})
    d = model.transform(prepare(d) if prepare else d)
    each = [F.get(F.array(*[F.lit(float(weights[m][j] * (n_bg if m == full else 1))) for m in masks]), F.col("_set")) for j in range(p)]
    sums = d.groupBy(key).agg(*[F.sum(w * v).alias(f"_w{j}") for j, w in enumerate(each)])
    share = F.lit(float(permutations * n_bg))
    phi = [F.struct(F.lit(f).alias("feature"), ((F.col(f"_w{j}") + F.lit(float(weights[0][j] * empty if closed else 0.0))) / share).alias("phi"))
           for j, f in enumerate(features)]
    return sums.select(key, F.explode(F.array(*phi)).alias("_p")).select(key, "_p.*")


def shapley_summary(attr: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature."""
    return attr.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"), F.count(F.lit(1)).alias("n_rows"))


def shapley_pairs(attr: DataFrame, df: DataFrame, features: Iterable[str], colour: str = "ester", key: str = "row_id") -> DataFrame:
    """(value, attribution, colour) triples of the chosen features."""
    features = list(features)
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col(colour).alias("colour")) for f in features]
    values = df.select(key, F.explode(F.array(*rows)).alias("_v")).select(key, "_v.*")
    return attr.filter(F.col("feature").isin(features)).join(values, [key, "feature"])


def decision_paths(attr: DataFrame, base: float, rows: int | None = 20, key: str = "row_id") -> DataFrame:
    """Running sums from the base value, least important feature first, of the first ``rows`` rows; of all rows without a number."""
    rank = shapley_summary(attr).select("feature", "importance")  # a row per feature
    d = attr
    if rows is not None:
        d = d.join(F.broadcast(attr.select(key).distinct().orderBy(key).limit(rows)), key, "left_semi")
    d = d.join(F.broadcast(rank), "feature")
    w = W.partitionBy(key).orderBy("importance", "feature").rowsBetween(W.unboundedPreceding, 0)
    return d.select(key, "feature", "importance", "phi", (F.lit(float(base)) + F.sum("phi").over(w)).alias("path"))


def order_by_output(attr: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows by total attribution, highest first."""
    return attr.groupBy(key).agg(F.sum("phi").alias("output")).orderBy(F.desc("output"), key)
