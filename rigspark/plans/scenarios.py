"""Hypothetical rows to score. Generators are narrow explodes over given setpoints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.physics import hertz_stress
from ..params import GRID_AXES, STEADY_AT_SECONDS


def linspace(lo: float | Column, hi: float | Column, n: int) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    step = (hi - lo) / F.lit(float(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + i * step)


def as_points(spark: SparkSession, fixed: Mapping[str, float]) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in fixed.items()])


def sweep(points: DataFrame, var: str, lo: float, hi: float, n: int = 20, at: float = STEADY_AT_SECONDS) -> DataFrame:
    """Each given setpoint with one variable replaced by ``n`` even steps, for both states."""
    keep = [c for c in points.columns if c not in (var, "ester", "step", "time_s")]
    return (points.select(*keep, F.posexplode(linspace(lo, hi, n)).alias("step", var))
            .withColumn("ester", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("time_s", F.lit(float(at))))


def hertz_sweep(points: DataFrame, lo: float = 10.0, hi: float = 200.0, n: int = 20, at: float = STEADY_AT_SECONDS) -> DataFrame:
    return sweep(points, "load_n", lo, hi, n, at).withColumn("hertz_mpa", hertz_stress("load_n"))


def surface(points: DataFrame, v1: str, r1: tuple, v2: str, r2: tuple, n: int = 50, at: float = STEADY_AT_SECONDS) -> DataFrame:
    """An n x n grid of two variables around each given setpoint."""
    keep = [c for c in points.columns if c not in (v1, v2, "time_s")]
    return (points.select(*keep, F.posexplode(linspace(*r1, n)).alias("i", v1))
            .select("*", F.posexplode(linspace(*r2, n)).alias("j", v2)).withColumn("time_s", F.lit(float(at))))


def neighbours(points: DataFrame, rel: float = 0.1, at: float = STEADY_AT_SECONDS) -> DataFrame:
    """The eight setpoints around each point: load and temperature at -rel, 0, +rel, without the centre."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    around = F.array(*[F.struct((F.col("load_n") * F.lit(1 + a * rel)).alias("l"), (F.col("temp_c") * F.lit(1 + b * rel)).alias("t"))
                       for a, b in steps])
    keep = [c for c in points.columns if c not in ("load_n", "temp_c", "time_s")]
    return points.select(*keep, F.posexplode(around).alias("neighbour", "_n")).select(
        *keep, "neighbour", F.col("_n.l").alias("load_n"), F.col("_n.t").alias("temp_c"), F.lit(float(at)).alias("time_s"))


def tail_times(points: DataFrame, start: int = 6900, stop: int = 7200, step: int = 10) -> DataFrame:
    keep = [c for c in points.columns if c != "time_s"]
    times = F.sequence(F.lit(start), F.lit(stop), F.lit(step)).cast("array<double>")
    return points.select(*keep, F.explode(times).alias("time_s"))


def campaign_grid(spark: SparkSession, at: float = 7200.0, states: tuple[int, ...] = (0, 1), axes=GRID_AXES) -> DataFrame:
    """The setpoint grid of both states; ``point_id`` counts concentration-major inside a state."""
    from ..operators.relational import setpoint_grid

    order = {"ester": spark.createDataFrame([(int(s),) for s in states], "ester int"), **axes}
    return setpoint_grid(spark, order).withColumn("time_s", F.lit(float(at)))
