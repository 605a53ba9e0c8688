"""Registry of named queries, and the shared inputs they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.rows import positive, valid_rows
from ..schema import measurements

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the equivalent SQL where there is one."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return measurements(table(spark, sf, "events"))


def valid(spark: SparkSession, sf: str) -> DataFrame:
    """Measured rows that pass the row filters; most statistics start here."""
    return positive(valid_rows(measurements(table(spark, sf, "events"), decode_once=True)))


def rnd(c: Column | str, digits: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 9, **special: int) -> DataFrame:
    """Round every double column at the very end; ``special`` overrides the digits of a column."""
    return df.select(*[
        F.round(F.col(f.name), special.get(f.name, digits)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields])


# The events adapter in SQL: the same rows as schema.measurements.
M = """m AS (
  SELECT concat(event_type, '_', CAST(m AS VARCHAR)) AS run_id, seq,
         CAST(us - 1704067200000000 AS DOUBLE) / 360e6 AS time_s,
         20e0 + 25*m + (k % 7 - 3)*1e-1 AS load_n,
         40e0 + 20*e + (k % 5 - 2)*1e-1 AS temp_c,
         5e-2*((3*e + m) % 13) AS conc,
         (e + m) % 2 AS ester,
         2e-2 + value/1000e0 AS cof,
         5e-1 + 4e-3*value + k/100e0 AS fai
  FROM (SELECT event_id AS seq, epoch_us(ts) AS us, event_type, CAST(user_id % 8 AS INT) AS m, value,
               CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS e,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
        FROM events) b)"""
V = M + """, v AS (SELECT * FROM m WHERE conc IS NOT NULL AND cof IS NOT NULL AND fai IS NOT NULL
  AND load_n <> 0 AND temp_c <> 0 AND time_s > 35 AND cof > 0 AND fai > 0)"""


def with_m(sql: str) -> str:
    return f"WITH {M} {sql}"


def with_v(sql: str) -> str:
    return f"WITH {V} {sql}"
