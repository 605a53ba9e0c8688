"""Joins, orderings and set operations on keyed tables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..scale import as_list, attach, counted, ordered_positions
from ..session import cut

GRID_POINTS = 1 << 20  # points of a grid made by one task
FEW_LEVELS = 1024  # levels of an axis that an expression may hold


def attach_stats(df: DataFrame, stats: DataFrame, on: str | Iterable[str] = "run_id") -> DataFrame:
    return attach(df, stats, on)


def attach_count(df: DataFrame, keys: Iterable[str], out: str = "n_group") -> DataFrame:
    """Group size on every row, by counting and joining back instead of a window over the group."""
    keys = as_list(keys)
    return attach(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)), keys)


def runs_subset(df: DataFrame, runs: DataFrame, run: str = "run_id", how: str = "left_semi") -> DataFrame:
    """Rows of the chosen runs; the list is broadcast only if a count shows it is short."""
    chosen, small = counted(runs.select(run).distinct())
    return df.join(F.broadcast(chosen) if small else chosen, run, how)


def setpoint_keys() -> dict[str, Column]:
    """Key under which a setpoint counts as measured: concentration in hundredths, whole load and temperature."""
    return {
        "_kc": F.rint(F.col("conc") * 100).cast("int"),
        "_kl": F.col("load_n").cast("int"),
        "_kt": F.col("temp_c").cast("int"),
        "_ke": F.col("ester").cast("int"),
    }


def novel(grid: DataFrame, measured: DataFrame, keys: Mapping[str, Column] | None = None) -> DataFrame:
    """Grid points whose key no measured row has."""
    keys = dict(keys or setpoint_keys())
    have, small = counted(measured.select(*[c.alias(k) for k, c in keys.items()]).distinct())
    return grid.withColumns(keys).join(F.broadcast(have) if small else have, list(keys), "left_anti").drop(*keys)


def setpoint_grid(spark: SparkSession, axes: Mapping[str, DataFrame | tuple]) -> DataFrame:
    """Cartesian product of axes, first axis slowest, with ``point_id`` in that order.

    An axis is (first, step, levels), or a table of one column that holds its levels: each distinct one counts once, in ascending order.
    A point's number is read as a mixed-radix number with one digit per axis. Numbers are dealt over all tasks by ``range``, a regular axis
    is computed from its digit, a few levels are looked up in an array and a long table of levels is joined by the digit, so no task makes
    more points than any other.
    """
    levels = {}
    for name, axis in axes.items():
        if isinstance(axis, tuple):
            levels[name] = (int(axis[2]), axis)
        else:
            one = axis.toDF(name).dropna().distinct()
            few = [r[0] for r in one.orderBy(name).limit(FEW_LEVELS + 1).collect()]
            if len(few) <= FEW_LEVELS:
                levels[name] = (len(few), few)
            else:
                placed = cut(ordered_positions(one, [F.col(name)], pos="_digit").select("_digit", name))
                levels[name] = (placed.count(), placed)
    total = math.prod(n for n, _ in levels.values())
    if total >= 2 ** 63:
        raise OverflowError(f"a grid of {total} points")
    d, stride = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // GRID_POINTS))).withColumnRenamed("id", "point_id"), total
    for name, (n, axis) in levels.items():
        stride = stride // n if n else 0
        digit = F.expr(f"(point_id div {stride or 1}L) % {n or 1}L")
        if isinstance(axis, tuple):
            d = d.withColumn(name, F.lit(float(axis[0])) + digit * F.lit(float(axis[1])))
        elif isinstance(axis, list):
            d = d.withColumn(name, F.get(F.array(*[F.lit(x) for x in axis]), digit.cast("int")) if axis else F.lit(None))
        else:
            d = attach(d.withColumn("_digit", digit), axis, "_digit").drop("_digit")
    return d.select("point_id", *levels)


def align(a: DataFrame, b: DataFrame, on: str | Iterable[str]) -> DataFrame:
    """Side-by-side tables by explicit key."""
    return a.join(b, as_list(on), "full_outer")


def compare_states(scored: DataFrame, on: Iterable[str], state: str = "ester", values: Iterable[str] = ("cof", "fai")) -> DataFrame:
    """Values of state 0 and 1 at the same point, and the advantage of state 1."""
    values = as_list(values)
    aggs = []
    for v in values:
        for s in (0, 1):
            aggs.append(F.avg(F.when(F.col(state) == s, F.col(v))).alias(f"{v}_{s}"))
    d = scored.groupBy(*as_list(on)).agg(*aggs)
    return d.withColumns({f"{v}_gain": F.col(f"{v}_0") - F.col(f"{v}_1") for v in values})


def pick_models(metrics: DataFrame, names: Iterable[str], model: str = "model") -> DataFrame:
    return metrics.filter(F.col(model).isin(list(names)))


def top_models(metrics: DataFrame, k: int = 3, require: Iterable[str] = ("ridge", "mlp"), score: str = "r2_cv",
               model: str = "model") -> DataFrame:
    """The k best models; if none of the smooth families is among them, the best smooth one takes the last place.

    One row per model: a table of a handful of rows.
    """
    w = W.orderBy(F.desc(score), model)
    ranked = metrics.withColumn("place", F.row_number().over(w)).withColumn("_smooth", F.col(model).isin(list(require)))
    ranked = ranked.withColumn("_has", F.max(F.when(F.col("place") <= k, F.col("_smooth"))).over(W.partitionBy()))
    best_smooth = F.min(F.when(F.col("_smooth"), F.col("place"))).over(W.partitionBy())
    ranked = ranked.withColumn("_best", best_smooth)
    swap = ~F.col("_has") & F.col("_best").isNotNull()
    keep = F.when(swap, (F.col("place") < k) | (F.col("place") == F.col("_best"))).otherwise(F.col("place") <= k)
    place = F.when(swap & (F.col("place") == F.col("_best")), F.lit(k)).otherwise(F.col("place"))
    return ranked.filter(keep).withColumn("place", place).drop("_smooth", "_has", "_best")


def arg_row(df: DataFrame, score: str, tie: str, how: str = "min", by: str | Iterable[str] = ()) -> DataFrame:
    """The row with the least (greatest) score, first by ``tie``; one row per group. Rows without a score come last.

    With groups, a hash aggregate finds the best scores, and only the rows that have them are compared by ``tie``.
    """
    by = as_list(by)
    rest = [c for c in df.columns if c not in by]
    if by:
        best = df.groupBy(*by).agg((F.min if how == "min" else F.max)(score).alias("_best"))
        df = attach(df, best, by).filter(F.col(score).eqNullSafe(F.col("_best"))).drop("_best")
    sign = F.col(score) if how == "min" else -F.col(score)
    first = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(sign.isNull(), sign, F.col(tie))).alias("_r"))
    return first.select(*by, "_r.*")


def sorted_report(df: DataFrame, by: str, tie: Iterable[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(by), *as_list(tie))


def keep_least_error(scored: DataFrame, run: str = "run_id", err: str = "abs_err", order: str = "seq") -> DataFrame:
    """Per run, its row of least error."""
    return arg_row(scored, err, order, "min", run)


def top_features(attr: DataFrame, k: int = 3, score: str = "importance", name: str = "feature") -> DataFrame:
    return attr.orderBy(F.desc(score), name).limit(k)


def stack(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def exclude(pool: DataFrame, chosen: DataFrame, on: str | Iterable[str]) -> DataFrame:
    return pool.join(chosen, as_list(on), "left_anti")


def split_mask(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the mask holds, and all others (null counts as not held)."""
    mask = F.coalesce(cond, F.lit(False))
    return df.filter(mask), df.filter(~mask)
