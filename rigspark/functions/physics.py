"""Contact mechanics and signal formulas as Column -> Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..params import BALL_RADIUS_MM, LOWER_BOUND, POISSON_RATIO, YOUNG_MODULUS_MPA


def col(x: Column | str | float) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def log_time(t: Column | str) -> Column:
    return F.log(col(t))


def time_squared(t: Column | str) -> Column:
    return col(t) * col(t)


def contact_radius(load, e_star, radius) -> Column:
    return F.cbrt(F.lit(3e0) * col(load) * col(radius) / (F.lit(4e0) * col(e_star)))


def peak_pressure(load, e_star, radius) -> Column:
    a = contact_radius(load, e_star, radius)
    return F.lit(3e0) * col(load) / (F.lit(2e0 * math.pi) * a * a)


def hertz_stress(load, e=YOUNG_MODULUS_MPA, nu=POISSON_RATIO, radius=BALL_RADIUS_MM) -> Column:
    """Peak pressure of a ball on a flat, both of the same material."""
    return peak_pressure(load, float(e) / (2.0 * (1.0 - float(nu) ** 2)), radius)


def two_body_modulus(e1, nu1, e2, nu2) -> Column:
    part1 = (F.lit(1e0) - col(nu1) * col(nu1)) / col(e1)
    part2 = (F.lit(1e0) - col(nu2) * col(nu2)) / col(e2)
    return F.lit(1e0) / (part1 + part2)


def hertz_two_body(load, e1, nu1, e2, nu2, radius=BALL_RADIUS_MM) -> Column:
    """Peak pressure for two bodies of different materials."""
    return peak_pressure(load, two_body_modulus(e1, nu1, e2, nu2), radius)


def hertz_profile(contacts: DataFrame, n: int = 100, extent: float = 1.5,
                  load: str = "load_n", e_star: float = YOUNG_MODULUS_MPA / (2 * (1 - POISSON_RATIO ** 2)),
                  radius: float = BALL_RADIUS_MM) -> DataFrame:
    """Pressure field on an n x n grid over -extent*a .. extent*a per contact."""
    ticks = F.sequence(F.lit(0), F.lit(n - 1))
    d = (contacts.withColumn("a_mm", contact_radius(load, e_star, radius))
         .withColumn("p_max", peak_pressure(load, e_star, radius))
         .withColumn("ix", F.explode(ticks)).withColumn("iy", F.explode(ticks)))
    step = F.lit(2 * extent) * F.col("a_mm") / F.lit(float(n - 1))
    d = d.withColumn("x_mm", -F.lit(extent) * F.col("a_mm") + F.col("ix") * step)
    d = d.withColumn("y_mm", -F.lit(extent) * F.col("a_mm") + F.col("iy") * step)
    inside = F.lit(1e0) - (F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm")) / (F.col("a_mm") * F.col("a_mm"))
    return d.withColumn("pressure", F.when(inside >= 0, F.col("p_max") * F.sqrt(inside)).otherwise(F.lit(0e0)))


def stribeck_cof(lam, boundary=0.8, mixed=2.6, mu0=0.12, mu_min=0.025, slope=0.025) -> Column:
    """Friction over the film-thickness ratio: plateau, cosine descent, linear rise."""
    x = col(lam)
    blend = F.lit(0.5) * (F.lit(1e0) + F.cos(F.lit(math.pi) * (x - F.lit(boundary)) / F.lit(mixed - boundary)))
    return (F.when(x <= boundary, F.lit(mu0))
            .when(x <= mixed, F.lit(mu_min) + F.lit(mu0 - mu_min) * blend)
            .otherwise(F.lit(mu_min) + F.lit(slope) * (x - F.lit(mixed))))


def regime(lam, boundary=0.8, mixed=2.6) -> Column:
    x = col(lam)
    return F.when(x <= boundary, "boundary").when(x <= mixed, "mixed").when(x > mixed, "hydrodynamic")


def clamp(pred, lower: float = LOWER_BOUND) -> Column:
    return F.greatest(col(pred), F.lit(lower))


def snap(x, step: float) -> Column:
    """Nearest multiple of ``step``, ties to even."""
    return F.rint(col(x) / F.lit(float(step))) * F.lit(float(step))


def round_half_even(x, digits: int) -> Column:
    return F.rint(col(x) * F.lit(10.0 ** digits)) / F.lit(10.0 ** digits)


def add_features(df: DataFrame) -> DataFrame:
    """Derived inputs of a measured or hypothetical row."""
    return (df.withColumn("log_time", log_time("time_s"))
            .withColumn("time_squared", time_squared("time_s"))
            .withColumn("hertz_mpa", hertz_stress("load_n")))
