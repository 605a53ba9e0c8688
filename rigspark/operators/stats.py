"""Aggregates over runs, setpoints and scored rows.

All of them combine map-side before their shuffle, so a hot run or setpoint
costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.physics import round_half_even, snap
from ..params import ERROR_LIMIT, HIGH_COF, RANGE_EPS, SETPOINT
from ..scale import as_list, attach, quantiles


def sample_weights(df: DataFrame, exact: Iterable[str] = ("conc", "ester"), rounded: Iterable[str] = ("load_n", "temp_c"),
                   out: str = "weight") -> DataFrame:
    """Square root of the inverse setpoint frequency, scaled to mean 1.

    Both totals follow from the table of setpoint counts: sum of weights is
    the sum of sqrt(count), so the rows are read once and joined once.
    """
    exact, rounded = as_list(exact), as_list(rounded)
    keys = [*exact, *[f"_{c}" for c in rounded]]
    d = df.withColumns({f"_{c}": F.rint(c) for c in rounded})
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    scale = counts.agg((F.sum("_cnt") / F.sum(F.sqrt("_cnt"))).alias("_scale"))
    weights = counts.crossJoin(F.broadcast(scale)).select(*keys, (F.sqrt(F.lit(1e0) / F.col("_cnt")) * F.col("_scale")).alias(out))
    return attach(d, weights, keys).select(*df.columns, out)


def run_setpoints(df: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    return df.groupBy(run).agg(*[F.avg(c).alias(c) for c in SETPOINT if c != "ester"],
                               F.min_by("ester", order).alias("ester"))


def setpoint_distribution(df: DataFrame, step: float = 5.0, run: str = "run_id") -> DataFrame:
    """Runs per rounded setpoint, most frequent first."""
    s = run_setpoints(df, run).select(
        snap("temp_c", step).cast("int").alias("temp_c"), snap("load_n", step).cast("int").alias("load_n"),
        round_half_even("conc", 2).alias("conc"), "ester")
    return (s.groupBy("temp_c", "load_n", "conc", "ester").agg(F.count(F.lit(1)).alias("n_runs"))
            .orderBy(F.desc("n_runs"), "temp_c", "load_n", "conc", "ester"))


def high_counts(df: DataFrame, col: str = "cof", limit: float = HIGH_COF, run: str = "run_id") -> DataFrame:
    """Samples above the limit per run; the row without a run is the total."""
    counts = df.filter(F.col(col) > limit).groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    return counts.rollup(run).agg(F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")).alias("n_rows"))


_DESCRIBE = ("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe(df: DataFrame, cols: Iterable[str], approx: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles, one row per column."""
    cols = as_list(cols)
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}|count"), F.avg(c).alias(f"{c}|mean"), F.stddev_samp(c).alias(f"{c}|std"),
                 F.min(c).alias(f"{c}|min"), F.max(c).alias(f"{c}|max")]
    one = df.agg(*aggs).crossJoin(F.broadcast(quantiles(df, cols, (0.25, 0.5, 0.75), approx=approx)))
    rows = [F.struct(
        F.lit(c).alias("column"), *[F.col(f"`{c}|{s}`").cast("double").alias(s) for s in ("count", "mean", "std", "min")],
        *[F.col(f"`{c}_q`")[i].cast("double").alias(s) for i, s in enumerate(("q25", "q50", "q75"))],
        F.col(f"`{c}|max`").cast("double").alias("max")) for c in cols]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.column", *[f"r.{s}" for s in _DESCRIBE])


def correlation(df: DataFrame, targets: Iterable[str], inputs: Iterable[str]) -> DataFrame:
    """Pearson coefficients, long: one pass, one row per (target, input)."""
    pairs = [(t, i) for t in targets for i in inputs]
    one = df.agg(*[F.corr(t, i).alias(f"c{n}") for n, (t, i) in enumerate(pairs)])
    rows = [F.struct(F.lit(t).alias("target"), F.lit(i).alias("input"), F.col(f"c{n}").alias("r"))
            for n, (t, i) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def histogram(df: DataFrame, col: str, bins: int = 15) -> DataFrame:
    """Equal-width bins over the value range; the last bin is closed, empty bins are listed."""
    span = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    span = span.select(F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                       F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    span = F.broadcast(span)
    place = F.floor((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    counts = (df.select(col).filter(F.col(col).isNotNull()).crossJoin(span)
              .groupBy(F.least(F.lit(bins - 1), place).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_rows")))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    frame = (span.select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
             .select("bin", (F.col("_lo") + F.col("bin") * width).alias("lo"),
                     (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi")))
    return frame.join(F.broadcast(counts), "bin", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("bigint")))


def box_stats(df: DataFrame, col: str, by: str | Iterable[str] = (), reach: float = 1.5) -> DataFrame:
    """Quartiles and whiskers: the outermost values within ``reach`` quartile ranges of the box."""
    by = as_list(by)
    q = quantiles(df, col, (0.25, 0.5, 0.75), by).select(
        *by, *[F.col(f"{col}_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    d = df.select(*by, col)
    d = attach(d, q, by) if by else d.crossJoin(F.broadcast(q))
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col(col) >= F.col("q1") - F.lit(reach) * iqr) & (F.col(col) <= F.col("q3") + F.lit(reach) * iqr)
    return d.groupBy(*by).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(col))).alias("whisker_lo"), F.max(F.when(inside, F.col(col))).alias("whisker_hi"),
        F.count(F.when(~inside, 1)).alias("n_outliers"))


def flag_effect(steady: DataFrame, axes: Sequence[str] = ("load_n", "temp_c"), flag: str = "ester",
                value: str = "cof") -> DataFrame:
    """Mean and sample deviation of a steady value by (rounded axis, flag), all axes in one pass."""
    d = steady.select(*[F.rint(a).alias(a) for a in axes], flag, value)
    sets = [[F.col(a), F.col(flag)] for a in axes]
    out = d.groupingSets(sets, *axes, flag).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n_runs"))
    return out


def error_by_run(scored: DataFrame, limit: float = ERROR_LIMIT, run: str = "run_id") -> DataFrame:
    return (scored.filter(F.abs("residual") > limit).groupBy(run)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.avg("time_s").alias("avg_time"), F.avg("load_n").alias("avg_load"),
                 F.avg("temp_c").alias("avg_temp"))
            .orderBy(F.desc("n_rows"), run))


def range_rmse(scored: DataFrame, limit: float = HIGH_COF, y: str = "y", pred: str = "pred") -> DataFrame:
    e = F.col(pred) - F.col(y)
    return scored.groupBy((F.col(y) > limit).alias("is_high")).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n_rows"))


def target_metrics(scored: DataFrame, by: Iterable[str] = ("model", "split"), target: str = "target") -> DataFrame:
    """R2, RMSE and MAE per target; the total sum of squares comes from the streaming variance."""
    e = F.col("pred") - F.col("y")
    d = scored.groupBy(*by, target).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(e * e).alias("_sse"), F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"), (F.var_pop("y") * F.count("y")).alias("_sst"))
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).when(F.col("_sse") == 0, 1e0).otherwise(0e0)
    return d.select(*by, target, "n_rows", r2.alias("r2"), F.sqrt("mse").alias("rmse"), "mae", "mse")


def regression_metrics(scored: DataFrame, by: Iterable[str] = ("model", "split"), target: str = "target") -> DataFrame:
    """Overall scores: mean R2 over targets, root of the mean MSE, mean MAE; target "all" beside each target."""
    by = as_list(by)
    per = target_metrics(scored, by, target)
    total = per.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.avg("r2").alias("r2"),
                                 F.sqrt(F.avg("mse")).alias("rmse"), F.avg("mae").alias("mae"))
    return per.drop("mse").unionByName(total.withColumn(target, F.lit("all")))


def minmax_score(df: DataFrame, targets: Iterable[str] = ("cof", "fai"), by: str | Iterable[str] = (),
                 eps: float = RANGE_EPS, out: str = "score") -> DataFrame:
    """Sum of range-scaled targets; ranges per group of ``by`` (models, states)."""
    targets, by = as_list(targets), as_list(by)
    aggs = [f(c).alias(f"_{n}_{c}") for c in targets for n, f in (("lo", F.min), ("hi", F.max))]
    span = df.groupBy(*by).agg(*aggs)
    d = attach(df, span, by) if by else df.crossJoin(F.broadcast(span))
    score = None
    for c in targets:
        s = (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + F.lit(eps))
        score = s if score is None else score + s
    return d.withColumn(out, score).select(*df.columns, out)


def metric_cube(scored: DataFrame, dims: Iterable[str] = ("model", "split", "target")) -> DataFrame:
    """Scores at every level of the dimensions; the rows are summed once, the cube is built on the sums."""
    e = F.col("pred") - F.col("y")
    sums = scored.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"), F.sum(e * e).alias("_sq"), F.sum(F.abs(e)).alias("_abs"))
    return sums.cube(*dims).agg(F.sum("_n").alias("n_rows"), F.sqrt(F.sum("_sq") / F.sum("_n")).alias("rmse"),
                                (F.sum("_abs") / F.sum("_n")).alias("mae"))


def regime_share(df: DataFrame, lam: str, run: str = "run_id") -> DataFrame:
    """Share of a run's samples in each lubrication regime."""
    from ..functions.physics import regime

    names = ("boundary", "mixed", "hydrodynamic")
    counts = df.withColumn("_regime", regime(lam)).groupBy(run).pivot("_regime", list(names)).agg(F.count(F.lit(1)))
    n = sum((F.coalesce(F.col(c), F.lit(0)) for c in names), F.lit(0))
    return counts.select(run, *[(F.coalesce(F.col(c), F.lit(0)) / n).alias(c) for c in names])
