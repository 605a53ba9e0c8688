"""Ordered work inside runs: resampling, smoothing, steady state, run-in time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F, types as T

from ..params import (CHUNK_ROWS, DOWNSAMPLE_ROWS, END_OF_TEST_SECONDS, ROLLING_ROWS, RUN_IN_ROWS, SETPOINT,
                      STEADY_SECONDS, TARGETS)
from ..scale import as_list, attach, counted, spine_all, trailing, with_positions, with_run_stats
from ..session import cut


def _numeric(df: DataFrame, skip: Iterable[str]) -> list[str]:
    skip = set(skip)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def downsample(df: DataFrame, n: int = DOWNSAMPLE_ROWS, run: str = "run_id", seq: str = "seq",
               rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean of every numeric column per block of ``n`` consecutive rows of a run.

    Blocks count the rows given, so filters belong before this step. The short
    last block is kept. ``seq`` of the result is the dense block number.
    """
    cols = _numeric(df, [run, seq])
    d = with_positions(df.select(run, seq, *cols), run, seq, "_pos", "_total", rows)
    d = d.withColumn("_bucket", F.floor(F.col("_pos") / n).cast("bigint"))
    out = d.groupBy(run, "_bucket").agg(*[F.avg(c).alias(c) for c in cols])
    return out.withColumnRenamed("_bucket", seq)


def rolling_mean(df: DataFrame, col: str, n: int = ROLLING_ROWS, strict: bool = True, run: str | list[str] = "run_id",
                 order: str | list[str] = "seq", out: str | None = None, dense: bool = False,
                 rows: int = CHUNK_ROWS) -> DataFrame:
    """Trailing mean over ``n`` rows. Strict: rows without a full window are dropped.

    ``dense`` says that ``order`` already is a gapless 0-based position.
    """
    keys = as_list(run)
    d, pos = df, "_pos"
    if dense:
        pos = as_list(order)[0]
    else:
        d = with_positions(df, keys, order, "_pos", "_total", rows)
    d = trailing(d, {"_mean": F.avg(col), "_seen": F.count(col)}, n - 1, keys, pos, rows)
    if strict:
        d = d.filter(F.col("_seen") == n)
    target = out or col
    cols = [F.col("_mean").alias(target) if c == target else F.col(c) for c in df.columns]
    if target not in df.columns:
        cols.append(F.col("_mean").alias(target))
    return d.select(*cols)


def last_window(df: DataFrame, span: float = STEADY_SECONDS, run: str = "run_id", time: str = "time_s",
                order: str = "seq", rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows in the last ``span`` seconds of each run; chunks that end earlier are not joined at all."""
    d = with_run_stats(
        df, run, parts={"_last": F.max(time)}, whole={"_end": F.max("_last").over(spine_all(run))},
        order=order, rows=rows, keep=F.col("_last") >= F.col("_end") - F.lit(span))
    return d.filter(F.col(time) >= F.col("_end") - F.lit(span)).drop("_end")


def steady_state(df: DataFrame, span: float = STEADY_SECONDS, run: str = "run_id", order: str = "seq",
                 means: Iterable[str] = ("cof", "fai", "conc", "load_n", "temp_c"), rows: int = CHUNK_ROWS) -> DataFrame:
    """Per run: means over its last ``span`` seconds, and the flag of the first such row."""
    d = last_window(df, span, run, order=order, rows=rows)
    aggs = [F.avg(c).alias(c) for c in means if c in df.columns]
    if "ester" in df.columns:
        aggs.append(F.min_by("ester", order).alias("ester"))
    return d.groupBy(run).agg(*aggs, F.count(F.lit(1)).alias("n_rows"))


def summary_rows(df: DataFrame, span: float = STEADY_SECONDS, at: float = END_OF_TEST_SECONDS,
                 run: str = "run_id", seq: str = "seq", rows: int = CHUNK_ROWS) -> DataFrame:
    """One synthetic end-of-test row per run: its last row, targets averaged over the last ``span`` seconds.

    ``seq`` is that of the last row measured up to ``at``, so ordering by
    (seq, is_summary) is ordering by time also for runs that went on longer.
    """
    d = last_window(df, span, run, order=seq, rows=rows)
    keep = [c for c in df.columns if c not in (run, seq, "time_s", *TARGETS, "is_summary")]
    out = d.groupBy(run).agg(
        F.max(seq).alias("_last"), *[F.max_by(c, seq).alias(c) for c in keep], *[F.avg(c).alias(c) for c in TARGETS])
    early = df.filter(F.col("time_s") <= at).groupBy(run).agg(F.max(seq).alias("_upto"))
    out = out.join(early, run, "left").withColumn(seq, F.coalesce(F.col("_upto"), F.lit(-1).cast("bigint")))
    out = out.withColumn("time_s", F.lit(float(at))).withColumn("is_summary", F.lit(True))
    return out.select(*[c for c in df.columns if c != "is_summary"], "is_summary")


def with_summary(df: DataFrame, span: float = STEADY_SECONDS, at: float = END_OF_TEST_SECONDS,
                 run: str = "run_id", seq: str = "seq", rows: int = CHUNK_ROWS) -> DataFrame:
    return df.withColumn("is_summary", F.lit(False)).unionByName(summary_rows(df, span, at, run, seq, rows))


def tail_n(df: DataFrame, k: int = 50, frac: float = 0.1, run: str | list[str] = "run_id",
           order: str | list[str] = "seq", rows: int = CHUNK_ROWS) -> DataFrame:
    """The last max(k, frac * size) rows of each run."""
    d = with_positions(df, run, order, "_pos", "_total", rows)
    n = F.greatest(F.lit(k), F.floor(F.lit(frac) * F.col("_total")))
    return d.filter(F.col("_pos") >= F.col("_total") - n).drop("_pos", "_total")


def run_in_time(df: DataFrame, col: str = "cof", n: int = RUN_IN_ROWS, tail: int = 50, frac: float = 0.1,
                sigmas: float = 3.0, rel: float = 0.05, run: str | list[str] = "run_id", time: str = "time_s",
                order: str | list[str] = "seq", rows: int = CHUNK_ROWS) -> DataFrame:
    """Time of the last smoothed sample outside the run's final band, 0 if none.

    The band is the mean of the smoothed tail, plus or minus the larger of
    ``sigmas`` population deviations and ``rel`` of that mean.
    """
    keys, order = as_list(run), as_list(order)
    d = df.select(*keys, *[c for c in dict.fromkeys([*order, time, col]) if c not in keys])
    d = with_positions(d, keys, order, "_pos", "_total", rows)
    d = trailing(d, {"_s": F.avg(col)}, n - 1, keys, "_pos", rows)
    d = cut(d.select(*keys, time, F.col("_s").alias("_smooth"), "_pos", "_total"))
    in_tail = F.col("_pos") >= F.col("_total") - F.greatest(F.lit(tail), F.floor(F.lit(frac) * F.col("_total")))
    t = F.when(in_tail, F.col("_smooth"))
    bands = d.groupBy(*keys).agg(F.avg(t).alias("_mean"), F.stddev_pop(t).alias("_sd"))
    band = F.greatest(F.lit(sigmas) * F.col("_sd"), F.lit(rel) * F.col("_mean"))
    d = attach(d.select(*keys, time, "_smooth", "_pos"), bands.withColumn("_band", band), keys)
    out_at = F.when(F.abs(F.col("_smooth") - F.col("_mean")) > F.col("_band"), F.col(time))
    return d.groupBy(*keys).agg(
        F.coalesce(F.max(out_at), F.lit(0e0)).alias("run_in_s"), F.max("_mean").alias("final_mean"),
        F.max("_band").alias("tolerance"))


def first_row(df: DataFrame, cols: Iterable[str] = SETPOINT, run: str | list[str] = "run_id",
              order: str = "seq") -> DataFrame:
    """Values of each run's first row. ``order`` is one primitive column, so the buffers stay in a hash aggregate."""
    return df.groupBy(*as_list(run)).agg(*[F.min_by(c, order).alias(c) for c in cols])


def template_curve(df: DataFrame, run_id: str, setpoints: DataFrame, run: str = "run_id") -> DataFrame:
    """The time axis of one template run, crossed with hypothetical setpoints.

    The setpoints, mostly a few optima or suggestions, are broadcast if a count allows it. A long list is dealt over
    blocks, and each block of setpoints meets its own copy of the axis.
    """
    setpoints, short = counted(setpoints)
    axis = (df.filter(F.col(run) == run_id).filter("time_s > 0 AND temp_c <> 0 AND load_n <> 0")
            .select("time_s", F.col("seq").alias("step")))
    if short:
        return axis.crossJoin(F.broadcast(setpoints))
    blocks = int(setpoints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    axis = axis.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = setpoints.withColumn("_block", F.pmod(F.xxhash64(*setpoints.columns), F.lit(blocks)).cast("int"))
    return axis.join(dealt, "_block").drop("_block")

