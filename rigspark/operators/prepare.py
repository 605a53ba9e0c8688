"""Outliers, bins, splits, folds and collinearity: from clean rows to training rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..params import CHUNK_ROWS, ERROR_LIMIT, FOLDS, PROTECTED, SEED, TEST_SHARE, VIF_THRESHOLD
from ..scale import as_list, attach, ordered_positions, quantiles, spine_all, with_positions, with_run_stats


def quantile_outliers(df: DataFrame, group: str = "run_id", cols: Iterable[str] = ("cof",), lo: float = 0.01,
                      hi: float = 0.99, approx: int | None = None, rows: int | None = None) -> DataFrame:
    """Rows whose listed columns all lie within their group's [lo, hi] quantiles."""
    cols = as_list(cols)
    extra = {} if rows is None else {"rows": rows}
    bounds = quantiles(df, cols, (lo, hi), group, approx=approx, **extra)
    d = attach(df, bounds, group)
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(c) >= F.col(f"{c}_q")[0]) & (F.col(c) <= F.col(f"{c}_q")[1])
    return d.filter(cond).select(*df.columns)


def residual_filter(scored: DataFrame, limit: float = ERROR_LIMIT, run: str = "run_id", order: str = "seq",
                    err: str = "abs_err", rows: int = CHUNK_ROWS, keep_mask: bool = False) -> DataFrame:
    """Drop rows of large error, but leave a run that would vanish its least-error row.

    With ``keep_mask`` all rows stay and ``retained`` says which ones count.
    """
    # a summary row shares its place with the last measured row and comes after it
    place = F.col(order) * 2 + (F.col("is_summary").cast("int") if "is_summary" in scored.columns else F.lit(0))
    d = with_run_stats(
        scored.withColumn("_place", place), run,
        parts={"_low": F.min(err)}, whole={"_least": F.min("_low").over(spine_all(run))}, order=order, rows=rows)
    d = with_run_stats(
        d, run, parts={"_at": F.min(F.when(F.col(err) == F.col("_least"), F.col("_place")))},
        whole={"_first": F.min("_at").over(spine_all(run))}, order=order, rows=rows)
    retained = (F.col(err) <= limit) | ((F.col("_least") > limit) & (F.col("_place") == F.col("_first")))
    d = d.withColumn("retained", retained).drop("_place", "_least", "_first")
    return d if keep_mask else d.filter("retained").drop("retained")


def quantile_bins(df: DataFrame, cols: Iterable[str], q: int = 3, key: str = "run_id") -> DataFrame:
    """Equal-frequency bins, right-closed; repeated edges merge. A constant column is binned by rank of the key."""
    cols = as_list(cols)
    edges = quantiles(df, cols, [i / q for i in range(q + 1)])
    found = edges.first()
    out = df
    for c in cols:
        u = sorted(set(found[f"{c}_q"] or []))
        if len(u) > 1:
            bin_no = sum(((F.col(c) > F.lit(e)).cast("int") for e in u[1:-1]), F.lit(0))
            out = out.withColumn(f"{c}_bin", F.when(F.col(c).isNotNull(), bin_no))
        else:
            out = _rank_bins(out, f"{c}_bin", q, key)
    return out


def _rank_bins(df: DataFrame, out: str, q: int, key: str) -> DataFrame:
    """Bins of equal size in key order. The sorted rows are written first, so their partition numbers stay put."""
    d = ordered_positions(df, [F.col(key)], pos="_pos", total="_total")
    bin_no = sum(((F.col("_pos") > F.lit(i / q) * (F.col("_total") - 1)).cast("int") for i in range(1, q)), F.lit(0))
    return d.withColumn(out, bin_no).drop("_pos", "_total")


def _drawn(df: DataFrame, keys: list[str], run: str, seed: Column) -> DataFrame:
    """Position of each run in a repeatable shuffle: md5 order, its leading digits as evenly filled chunks."""
    d = df.withColumn("_h", F.md5(F.concat(F.col(run), seed)))
    lead = F.conv(F.substring("_h", 1, 4), 16, 10).cast("bigint")
    return with_positions(d, keys, ["_h", run], "_pos", "_size", chunk=lead).drop("_h")


def stratified_run_split(runs: DataFrame, by: Iterable[str], test: float = TEST_SHARE, seed: int = SEED,
                         run: str = "run_id") -> DataFrame:
    """Mark ``test`` of the runs, spread over the strata by largest remainder."""
    by = as_list(by)
    d = _drawn(runs, by, run, F.lit(f"#{seed}"))
    strata = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    everything = W.partitionBy()  # one row per stratum
    strata = strata.withColumn("_want", F.ceil(F.lit(test) * F.sum("_n").over(everything)))
    share = F.col("_want") * F.col("_n") / F.sum("_n").over(everything)
    strata = strata.withColumn("_base", F.floor(share)).withColumn("_rem", share - F.floor(share))
    place = F.row_number().over(W.orderBy(F.desc("_rem"), *by))
    left = F.col("_want") - F.sum("_base").over(everything)
    strata = strata.withColumn("_quota", F.col("_base") + (place <= left).cast("int"))
    d = attach(d, strata.select(*by, "_quota"), by)
    return d.withColumn("is_test", F.col("_pos") < F.col("_quota")).drop("_pos", "_size", "_quota")


def group_shuffle_split(runs: DataFrame, n: int = 5, test: float = TEST_SHARE, seed: int = SEED,
                        run: str = "run_id") -> DataFrame:
    """``n`` independent random holdouts of runs, long: one row per (split, run)."""
    d = runs.select(run).distinct().withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    d = _drawn(d, ["split"], run, F.concat(F.lit(f"#{seed}#"), F.col("split").cast("string")))
    return d.select("split", run, (F.col("_pos") < F.ceil(F.lit(test) * F.col("_size"))).alias("is_test"))


def group_kfold(df: DataFrame, k: int = FOLDS, group: str = "run_id") -> DataFrame:
    """Fold number per run: runs by size, largest first, dealt out to and fro, so folds differ by at most the largest run."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    d = ordered_positions(sizes, [F.desc("n_rows"), F.col(group)], pos="_pos")
    turn, place = F.floor(F.col("_pos") / F.lit(k)), F.col("_pos") % k
    return d.select(group, F.when(turn % 2 == 0, place).otherwise(F.lit(k - 1) - place).cast("int").alias("fold"), "n_rows")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """p x p Pearson matrix. Columns are centred and scaled first, which keeps the moments accurate."""
    cols = list(cols)
    m = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    live = [i for i in range(len(cols)) if (m[f"s{i}"] or 0.0) > 1e-12 * max(1.0, abs(m[f"m{i}"] or 0.0))]
    z = df.select(*[((F.col(cols[i]) - F.lit(float(m[f"m{i}"]))) / F.lit(float(m[f"s{i}"]))).alias(f"z{i}") for i in live])
    out = np.full((len(cols), len(cols)), np.nan)
    if live:
        v = VectorAssembler(inputCols=z.columns, outputCol="v", handleInvalid="skip").transform(z).select("v")
        out[np.ix_(live, live)] = Correlation.corr(v, "v").first()[0].toArray()
    return out


def vif_from_correlation(r: np.ndarray) -> np.ndarray:
    """1 / (1 - R2) of each column against the others; constant or fully explained columns are infinite."""
    p = r.shape[0]
    dead = np.isnan(np.diag(r))
    out = np.full(p, np.inf)
    for j in range(p):
        others = [i for i in range(p) if i != j and not dead[i]]
        if dead[j]:
            continue
        if not others:
            out[j] = 1.0
            continue
        rj = r[others, j]
        r2 = float(rj @ np.linalg.pinv(r[np.ix_(others, others)], rcond=1e-10, hermitian=True) @ rj)
        out[j] = 1.0 / (1.0 - r2) if 1.0 - r2 > 1e-10 else np.inf
    return out


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cols = list(cols)
    values = vif_from_correlation(correlation_matrix(df, cols))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, values)], "feature string, vif double")


def vif_keep(r: np.ndarray, cols: Sequence[str], threshold: float = VIF_THRESHOLD,
             protected: Iterable[str] = PROTECTED) -> list[str]:
    """Drop the worst unprotected column until none exceeds the threshold; p x p work on one matrix."""
    cols, protected = list(cols), set(protected)
    keep = list(range(len(cols)))
    while len(keep) > 1:
        v = vif_from_correlation(r[np.ix_(keep, keep)])
        bad = [(-v[n], n) for n, i in enumerate(keep) if v[n] > threshold and cols[i] not in protected]
        if not bad:
            break
        keep.pop(min(bad)[1])
    return [cols[i] for i in keep]
