"""Validation of linear models from mergeable moments.

A ridge fit needs its rows only as sums: counts, sums and products of inputs and targets. The sums of disjoint row sets add up, so one
aggregate over all (fold, split, prefix) cells holds every fit that a validation wants. A fold is trained on the total minus its own sums, a
prefix on the sum of the cells up to it; all penalties are solved from one small eigenproblem, and R2 and RMSE on any cell are a
quadratic form of its sums. Nothing is refitted and no row is read twice.

Sums are taken around the means of the whole table, which keeps differences of sums accurate.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.prepare import group_shuffle_split
from ..params import FOLDS, SEED, TARGETS
from ..scale import as_list, attach, ordered_positions, with_positions
from ..session import cut


@dataclass(frozen=True)
class Moments:
    """Products of (1, inputs, targets) summed over rows; inputs and targets are shifted."""

    sums: np.ndarray
    inputs: int

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.sums + other.sums, self.inputs)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.sums - other.sums, self.inputs)

    @property
    def n(self) -> int:
        return int(round(self.sums[0, 0]))

    def ridge(self, alphas: Sequence[float]) -> np.ndarray:
        """Coefficients (alpha, 1 + inputs, target), intercept first, of ridge fits on inputs scaled to unit deviation."""
        p, n = self.inputs, self.sums[0, 0]
        mean = self.sums[0, 1:] / n
        cov = self.sums[1:, 1:] / n - np.outer(mean, mean)
        scale = np.sqrt(np.clip(np.diag(cov)[:p], 0, None))
        scale[scale == 0] = 1.0
        values, axes = np.linalg.eigh(cov[:p, :p] / np.outer(scale, scale) * n)
        seen = axes.T @ (cov[:p, p:] / scale[:, None] * n)
        slopes = np.stack([axes @ (seen / np.maximum(values + a, 1e-300)[:, None]) for a in alphas]) / scale[None, :, None]
        level = mean[p:][None, :] - np.einsum("i,ait->at", mean[:p], slopes)
        return np.concatenate([level[:, None, :], slopes], 1)

    def errors(self, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """R2 and mean squared error per target of a (1 + inputs, target) fit on these rows."""
        p, n = self.inputs, self.sums[0, 0]
        r2, mse = [], []
        for t in range(coefficients.shape[1]):
            v = np.zeros(len(self.sums))
            v[:p + 1], v[p + 1 + t] = -coefficients[:, t], 1.0
            sse = max(0.0, float(v @ self.sums @ v))
            sst = float(self.sums[p + 1 + t, p + 1 + t] - self.sums[0, p + 1 + t] ** 2 / n)
            r2.append(1 - sse / sst if sst > 0 else float(sse == 0))
            mse.append(sse / n)
        return np.array(r2), np.array(mse)


def gather(df: DataFrame, inputs: Sequence[str], targets: Iterable[str] = TARGETS, by: str | Iterable[str] = ()) -> tuple[dict[tuple, Moments], np.ndarray]:
    """Moments of every group of ``by`` in one aggregate, and the shift of inputs and targets. Rows with a null cell do not count.

    The result is as large as the number of groups: folds, splits, prefixes, never data.
    """
    by, cols = as_list(by), [*inputs, *targets]
    df = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    shift = np.array([means[c] or 0.0 for c in cols])
    z: list[Column] = [F.lit(1e0), *[F.col(c) - F.lit(float(s)) for c, s in zip(cols, shift)]]
    q = len(z)
    pairs = [(i, j) for i in range(q) for j in range(i, q)]
    rows = df.groupBy(*by).agg(*[F.sum(z[i] * z[j]).alias(f"s_{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        m = np.zeros((q, q))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s_{i}_{j}"] or 0.0
        out[tuple(r[c] for c in by)] = Moments(m, len(inputs))
    return out, shift


def total(parts: Iterable[Moments]) -> Moments:
    parts = list(parts)
    return Moments(sum(p.sums for p in parts), parts[0].inputs)


def unshifted(coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Coefficients for the columns as they are."""
    p = coefficients.shape[-2] - 1
    out = coefficients.copy()
    out[..., 0, :] += shift[p:] - np.einsum("i,...it->...t", shift[:p], coefficients[..., 1:, :])
    return out


def fold_scores(df: DataFrame, inputs: Sequence[str], alphas: Sequence[float], targets: Iterable[str] = TARGETS) -> list[tuple[int, int, float, float]]:
    """(alpha number, fold, R2, RMSE) of every penalty on every ``fold``, each fitted on the other folds."""
    folds, _ = gather(df, inputs, targets, "fold")
    whole, out = total(folds.values()), []
    for (fold,), own in sorted(folds.items()):
        for k, c in enumerate((whole - own).ridge(alphas)):
            r2, mse = own.errors(c)
            out.append((k, fold, float(r2.mean()), float(np.sqrt(mse.mean()))))
    return out


def fold_predictions(df: DataFrame, inputs: Sequence[str], alpha: float, name: str = "ridge", keys: Sequence[str] = ("row_id", "fold"),
                     targets: Iterable[str] = TARGETS) -> DataFrame:
    """Out-of-fold predictions of all folds in one narrow pass, long, as ``cross_predictions`` gives them."""
    folds, shift = gather(df, inputs, targets, "fold")
    whole = total(folds.values())
    fits = {fold: unshifted((whole - own).ridge([alpha])[0], shift) for (fold,), own in folds.items()}
    rows = []
    for k, t in enumerate(targets):
        weights = [F.create_map(*[F.lit(x) for fold, c in sorted(fits.items()) for x in (fold, float(c[i, k]))])[F.col("fold")] for i in range(len(inputs) + 1)]
        pred = sum((w * F.col(c) for w, c in zip(weights[1:], inputs)), weights[0])
        rows.append(F.struct(F.lit(name).alias("model"), F.lit(t).alias("target"), pred.alias("pred"), F.col(t).alias("y")))
    return df.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def prefix_scores(df: DataFrame, inputs: Sequence[str], alpha: float, sizes: Sequence[float], splits: int = FOLDS, test: float = 0.1,
                  seed: int = SEED, targets: Iterable[str] = TARGETS) -> list[tuple[int, float, int, float, float]]:
    """(split, share, rows, training R2, validation R2) for growing prefixes of the training rows in (run, seq) order.

    Every row is met once per split: its cell is the first prefix that holds it, or the split's held-out rows.
    """
    sizes = sorted(float(s) for s in sizes)
    df = df.select("run_id", "seq", *inputs, *targets)  # the table may have a split of its own
    draws = cut(group_shuffle_split(df, splits, test, seed))
    counts = cut(df.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n")))
    both = counts.join(draws, "run_id").withColumn("_n", F.when(F.col("is_test"), 0).otherwise(F.col("_n")))
    starts = ordered_positions(both, [F.col("split"), F.col("run_id")], "_n", "_start")
    spans = cut(starts.groupBy("split").agg(F.min("_start").alias("_first"), F.sum("_n").alias("_train")))  # a row per split
    starts = starts.join(F.broadcast(spans), "split").select("split", "run_id", "is_test", (F.col("_start") - F.col("_first")).alias("_start"), "_train")
    placed = with_positions(df, "run_id", "seq", "_pos", "_run_rows")
    d = attach(placed, starts, "run_id")
    at = F.col("_start") + F.col("_pos")
    cell = sum(((at >= F.floor(F.lit(s) * F.col("_train"))).cast("int") for s in sizes), F.lit(0))
    cells, _ = gather(d.withColumn("_cell", F.when(F.col("is_test"), -1).otherwise(cell)), inputs, targets, ["split", "_cell"])
    out = []
    for split in range(splits):
        held = cells.get((split, -1))
        for k, share in enumerate(sizes):
            parts = [cells[split, j] for j in range(k + 1) if (split, j) in cells]
            if parts and held is not None:
                mine = total(parts)
                c = mine.ridge([alpha])[0]
                out.append((split, share, mine.n, float(mine.errors(c)[0].mean()), float(held.errors(c)[0].mean())))
    return out


def alphas_of(draws: Sequence[Mapping]) -> list[float]:
    return [float(p.get("alpha", 1.0)) for p in draws]
