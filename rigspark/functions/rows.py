"""Row filters and small projections; all narrow, none shuffles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..params import RATIO_EPS, RATIO_PAIRS, SEED, WARM_UP_SECONDS
from ..schema import LABELS, NONZERO, NOT_NULL


def valid_rows(df: DataFrame, not_null: Iterable[str] = NOT_NULL, nonzero: Iterable[str] = NONZERO,
               min_time: float = WARM_UP_SECONDS, time: str = "time_s") -> DataFrame:
    cond = F.col(time) > min_time
    for c in not_null:
        cond = cond & F.col(c).isNotNull()
    for c in nonzero:
        cond = cond & (F.col(c) != 0)
    return df.filter(cond)


def positive(df: DataFrame, cols: Iterable[str] = ("time_s", "cof", "fai")) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(c) > 0)
    return df.filter(cond)


def default_flag(df: DataFrame, col: str = "ester", value: int = 0) -> DataFrame:
    if col not in df.columns:
        return df.withColumn(col, F.lit(value).cast("int"))
    return df.withColumn(col, F.coalesce(F.col(col).try_cast("double").try_cast("int"), F.lit(value)))


def ratios(df: DataFrame, pairs: Iterable[tuple[str, str]] = RATIO_PAIRS, eps: float = RATIO_EPS) -> DataFrame:
    return df.withColumns({f"{a}_div_{b}": F.col(a) / (F.col(b) + F.lit(eps)) for a, b in pairs})


def near_match(df: DataFrame, targets: Mapping[str, float], atol: float = 1e-3, rtol: float = 1e-5) -> DataFrame:
    """Rows at a given setpoint: load and temperature by rounding, the rest by tolerance."""
    cond = F.lit(True)
    for name, value in targets.items():
        if name in ("load_n", "temp_c"):
            cond = cond & (F.rint(name) == F.lit(float(value)))
        elif name == "ester":
            cond = cond & (F.col(name) == F.lit(int(value)))
        else:
            cond = cond & (F.abs(F.col(name) - F.lit(float(value))) <= F.lit(atol + rtol * abs(float(value))))
    return df.filter(cond)


def friendly_names(df: DataFrame, mapping: Mapping[str, str] = LABELS) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def unit_noise(key: Column | str, seed: int, salt: str) -> Column:
    """Repeatable uniform in [0, 1): a hash of the row key, not of its place."""
    key = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}#{salt}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def jitter(df: DataFrame, amplitudes: Mapping[str, float], seed: int = SEED, key: str = "run_id",
           floor: Iterable[str] = ("conc",)) -> DataFrame:
    out = {}
    for name, amp in amplitudes.items():
        moved = F.col(name) + (unit_noise(key, seed, name) * 2 - 1) * F.lit(float(amp))
        out[f"{name}_plot"] = F.greatest(moved, F.lit(0e0)) if name in set(floor) else moved
    return df.withColumns(out)
