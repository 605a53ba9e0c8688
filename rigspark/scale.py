"""Building blocks that keep run-ordered work bounded when one run is huge.

A window over ``PARTITION BY run`` puts a whole run into one task, and one run
may hold a third of an archive. The operators therefore never window over a
run. They split it into chunks by its position key:

* ``chunk = floor(seq / CHUNK_ROWS)``. ``seq`` is unique inside a run, so one
  (run, chunk) group holds at most CHUNK_ROWS rows whatever the data. It is a
  pure function of the row, so a retried task sees the same chunks.
* the *spine* is one small row per (run, chunk), built with partial
  aggregation. Whatever a row needs to know about its run (offset, size, last
  time, tolerance ...) is computed on the spine and joined back on
  (run, chunk), a key that cannot be hot.
* a *halo* copies the last rows of a block into the next one, so that frames
  which look back a fixed number of rows stay exact at block borders.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .params import BROADCAST_ROWS, CHUNK_ROWS, QUANTILE_ROWS
from .session import cut

CHUNK = "_chunk"


def as_list(x: str | Iterable[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def chunked(df: DataFrame, order: str = "seq", rows: int = CHUNK_ROWS) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(order) / F.lit(rows)).cast("bigint"))


def with_run_stats(
    df: DataFrame, keys: str | Iterable[str], parts: dict[str, Column], whole: dict[str, Column],
    order: str = "seq", rows: int = CHUNK_ROWS, keep: Column | None = None, keep_chunk: bool = False,
) -> DataFrame:
    """Attach run-level values to every row without a hot join key.

    ``parts`` are aggregates per (run, chunk); ``whole`` are window expressions
    over the spine of one run (use ``spine_all`` / ``spine_before``). ``keep``
    drops whole chunks on the spine before the join reads them.
    """
    keys = as_list(keys)
    rows_df = df if CHUNK in df.columns else chunked(df, order, rows)
    spine = rows_df.groupBy(*keys, CHUNK).agg(*[c.alias(n) for n, c in parts.items()])
    spine = spine.select(*keys, CHUNK, *parts, *[c.alias(n) for n, c in whole.items()])
    if keep is not None:
        spine = spine.filter(keep)
    spine = spine.drop(*parts)
    out = rows_df.join(spine, [*keys, CHUNK])
    return out if keep_chunk else out.drop(CHUNK)


def spine_all(keys: str | Iterable[str]) -> W:
    return W.partitionBy(*as_list(keys))


def spine_before(keys: str | Iterable[str]) -> W:
    return W.partitionBy(*as_list(keys)).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)


def with_positions(
    df: DataFrame, keys: str | Iterable[str] = "run_id", order: str | Sequence[str] = "seq",
    pos: str = "pos", total: str = "n_rows", rows: int = CHUNK_ROWS, chunk: Column | None = None,
) -> DataFrame:
    """Dense 0-based position of each row in its run, and the run's row count.

    ``chunk`` may replace the default chunk by any expression that never
    decreases along ``order``.
    """
    keys, order = as_list(keys), as_list(order)
    d = df.withColumn(CHUNK, chunk) if chunk is not None else chunked(df, order[0], rows)
    local = F.row_number().over(W.partitionBy(*keys, CHUNK).orderBy(*order)) - 1
    d = with_run_stats(
        d.withColumn("_local", local), keys,
        parts={"_rows": F.count(F.lit(1))},
        whole={"_offset": F.coalesce(F.sum("_rows").over(spine_before(keys)), F.lit(0)),
               total: F.sum("_rows").over(spine_all(keys))},
        keep_chunk=True,
    )
    return d.withColumn(pos, F.col("_local") + F.col("_offset")).drop("_local", "_offset", CHUNK)


def trailing(
    df: DataFrame, exprs: dict[str, Column], back: int, keys: str | Iterable[str] = "run_id",
    pos: str = "pos", rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Evaluate aggregates over each row and the ``back`` rows before it.

    ``pos`` must be dense. Each block of ``rows`` positions is one window
    partition; rows that later blocks look back to are copied there first.
    """
    keys = as_list(keys)
    block = F.floor(F.col(pos) / F.lit(rows)).cast("bigint")
    last = F.floor((F.col(pos) + F.lit(back)) / F.lit(rows)).cast("bigint")
    d = df.withColumn("_own", block).withColumn("_block", F.explode(F.sequence(F.col("_own"), last)))
    w = W.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(-back, 0)
    d = d.select("*", *[e.over(w).alias(n) for n, e in exprs.items()])
    return d.filter(F.col("_own") == F.col("_block")).drop("_own", "_block")


def ordered_positions(df: DataFrame, order: Sequence[Column], value: str | None = None, pos: str = "pos",
                      total: str = "total") -> DataFrame:
    """Position (or running sum of ``value`` before the row) along a global order.

    The rows are range-sorted and written first, so that their partition
    numbers are stable; each partition is then one chunk of the numbering.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.select("*", F.spark_partition_id().cast("bigint").alias(CHUNK), F.monotonically_increasing_id().alias("_id")))
    amount = F.lit(1).cast("bigint") if value is None else F.col(value)
    local = F.sum(amount).over(W.partitionBy(CHUNK).orderBy("_id").rowsBetween(W.unboundedPreceding, 0)) - amount
    spine = placed.groupBy(CHUNK).agg(F.sum(amount).alias("_sum"))
    w = W.partitionBy()  # one row per partition of the input
    spine = spine.select(CHUNK, (F.sum("_sum").over(w.orderBy(CHUNK)) - F.col("_sum")).alias("_before"), F.sum("_sum").over(w).alias(total))
    out = placed.withColumn("_local", local).join(F.broadcast(spine), CHUNK).withColumn(pos, F.col("_local") + F.col("_before"))
    return out.drop(CHUNK, "_id", "_local", "_before")


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Count at most ``rows + 1`` rows: the size check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def counted(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` as a stored table, and whether it is short enough to broadcast. Its plan runs once."""
    stored = cut(df)
    return stored, fits(stored, rows)


def _short(stored: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint if a count allows it."""
    return F.broadcast(stored) if fits(stored) else stored


def attach(
    df: DataFrame, stats: DataFrame, on: str | Iterable[str], how: str = "inner",
    rows: int = BROADCAST_ROWS, salts: int = 32, salt_by: str | None = None,
) -> DataFrame:
    """Join per-key values back to rows whose keys may be hot.

    Null keys are keys like any other. The stats side is counted first. Within ``rows`` it is broadcast and the
    big side is not shuffled at all. Beyond, the rows of a key are spread over
    ``salts`` partitions and the stats are copied to each of them.
    """
    on = as_list(on)
    stats, small = counted(stats, rows)
    own = {k: f"_at_{k}" for k in on}
    stats = stats.withColumnsRenamed(own)
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()]
    out = [*on, *[c for c in df.columns if c not in on], *[c for c in stats.columns if c not in own.values()]]
    if small:
        return df.join(F.broadcast(stats), same, how).select(*out)
    salt_of = F.xxhash64(*([salt_by] if salt_by else [c for c in df.columns]))
    left = df.withColumn("_salt", F.pmod(salt_of, F.lit(salts)).cast("int"))
    right = stats.withColumn("_at_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*same, F.col("_salt") == F.col("_at_salt")], how).select(*out)


# --- exact quantiles -------------------------------------------------------

_SLICES = 4096


def quantiles(
    df: DataFrame, cols: str | Iterable[str], qs: Sequence[float], by: str | Iterable[str] = (),
    rows: int = QUANTILE_ROWS, approx: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles, one array column ``<col>_q`` per input column.

    ``percentile`` keeps every distinct value of a group in one buffer, so it
    is used only where a count shows that no group exceeds ``rows``. Larger
    groups are narrowed by counting values in equal slices of a value range,
    again and again, until the slice that holds the wanted rank is small.
    ``approx`` switches to sketches of that accuracy.
    """
    cols, by = as_list(cols), as_list(by)
    wanted = F.array(*[F.lit(float(q)) for q in qs])
    if approx is not None:
        return df.groupBy(*by).agg(*[F.percentile_approx(c, wanted, approx).alias(f"{c}_q") for c in cols])
    sizes = cut(df.groupBy(*by).count()) if by else df.select(F.count(F.lit(1)).alias("count"))
    largest = sizes.agg(F.max("count")).first()[0] or 0
    if largest <= rows:
        return df.groupBy(*by).agg(*[F.percentile(c, wanted).alias(f"{c}_q") for c in cols])
    if not by:
        return _sliced_quantiles(df.withColumn("_all", F.lit(0)), cols, qs, ["_all"], rows).drop("_all")
    hot = _short(cut(sizes.filter(F.col("count") > rows).select(*by)))
    cold = (df.join(hot, by, "left_anti").groupBy(*by)
            .agg(*[F.percentile(c, wanted).alias(f"{c}_q") for c in cols]))
    return cold.unionByName(_sliced_quantiles(df.join(hot, by, "left_semi"), cols, qs, by, rows))


def _sliced_quantiles(df: DataFrame, cols: list[str], qs: Sequence[float], by: list[str], rows: int) -> DataFrame:
    """Exact quantiles of huge groups; the state holds a few rows per group."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.select(*by, F.expr(f"stack({len(cols)}, {pairs}) AS (_col, _v)")).filter("_v IS NOT NULL")
    key = [*by, "_col"]
    # state: the value range [lo, hi] that holds rank `_rank`, and the rows below it
    state = long.groupBy(*key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_n"))
    state = state.withColumn("_q", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])))
    at = F.col("_q.q") * (F.col("_n") - 1)
    state = state.select(*key, "_lo", "_hi", F.col("_q.i").alias("_i"), (at - F.floor(at)).alias("_frac"),
                         F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("_rank"),
                         F.col("_n").alias("_inside"), F.lit(0).cast("bigint").alias("_below"))
    state = cut(state)
    slice_of = F.when(F.col("_hi") <= F.col("_lo"), 0).otherwise(
        F.least(F.lit(_SLICES - 1), F.floor((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0e0)) * _SLICES)))
    ids, span = [*key, "_i", "_rank"], [*key, "_lo", "_hi"]
    is_open = (F.col("_inside") > rows) & (F.col("_lo") < F.col("_hi"))
    for _ in range(16):
        wide = state.filter(is_open)
        if wide.isEmpty():
            break
        # ranges shared by several ranks are counted once
        hit = long.join(_short(cut(wide.select(*span).distinct())), key).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        hist = (hit.withColumn("_s", slice_of).groupBy(*span, "_s")
                .agg(F.count("_v").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b")))
        w = W.partitionBy(*span).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
        hist = hist.withColumn("_left", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        found = wide.join(hist, span).withColumn("_below", F.col("_below") + F.col("_left"))
        found = found.filter((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_c")))
        narrowed = found.select(*key, F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), "_i", "_frac", "_rank",
                                F.col("_c").alias("_inside"), "_below")
        state = cut(state.filter(~is_open).unionByName(narrowed))
    # one value left, or few enough rows to rank; equal values are counted, not listed
    near = long.join(_short(state), key).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    values = near.groupBy(*ids, "_frac", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*ids).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    values = values.withColumn("_start", F.col("_below") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
    ranked = values.filter((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_c")))
    per_q = ranked.groupBy(*key, "_i").agg(
        F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.max("_frac").alias("_frac"))
    value = F.col("_a") + F.col("_frac") * (F.col("_b") - F.col("_a"))
    per_q = per_q.select(*key, F.struct(F.col("_i"), value.alias("v")).alias("_iv"))
    wide = per_q.groupBy(*by).agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_col") == c, F.col("_iv")))), lambda s: s["v"]).alias(f"{c}_q")
        for c in cols])
    return wide
