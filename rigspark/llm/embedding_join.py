"""Near duplicates among embeddings by an epsilon grid order join.

Unit vectors with a cosine of ``t`` or more lie within ``sqrt(2 - 2t)``, epsilon, of each other. The vectors of a label are sorted by the cells
(of side epsilon) that they fall into on the leading principal directions, and the sorted sequence is cut into blocks with a bounding box on
those directions. Pairs of intervals of the sequence are then joined recursively, from the whole sequence down to pairs of blocks, and a pair
whose boxes are further apart than epsilon is dropped. Inside a task the recursion goes on from blocks to short stretches, whose vectors are
compared in double precision. Two stretches that lie wholly within epsilon of each other are linked as a whole, without their pairs.

The directions only order and prune: any orthonormal ones give the same links. Equal vectors are one class and are compared once. A pair of
blocks returns, for each vector, how many vectors it links with there and one of the vectors it hangs together with, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .base import bounded_batches, given_id, query, sort_id, store, table
from .components import components

AXES = 8  # leading principal directions of the grid
SPAN = 256  # directions are sought among so many coordinates
LENGTHS = 16  # vector lengths that get directions of their own; others are ordered by their first coordinates
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 2048
LEAF = 128  # vectors compared at a time
FAN = 4  # bits: each interval has 16 parts
SLACK = 1e-9  # more than rounding adds to a distance


def _units(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of vectors without nulls, by length: the length, their places in the batch, and the vectors divided by their norms."""
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, unit(values[ends[at][:, None] + np.arange(size)])


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that no square is too large or too small
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal directions (coordinates x AXES) of the most frequent vector lengths, from the moments of all ``_vector``."""
    lengths = [r._size for r in vectors.groupBy(F.size("_vector").alias("_size")).count().orderBy(F.desc("count"), "_size").limit(LENGTHS).collect()]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for size, _, x in _units(b.column(0)):
                if size in lengths:
                    x = np.hstack([np.ones((len(x), 1)), x[:, :SPAN]])
                    sums[size] = sums.get(size, 0) + x.T @ x
        for size, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))],
                                             ["_size", "_i", "_row"])

    parts = vectors.select("_vector").mapInArrow(moments, "_size int, _i int, _row array<double>").select("_size", "_i", F.posexplode("_row").alias("_j", "_x"))
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("_size", "_i", "_j").agg(F.sum("_x").alias("_x")).collect():  # at most LENGTHS * (SPAN + 1)^2 numbers
        side = min(r._size, SPAN) + 1
        out.setdefault(r._size, np.zeros((side, side)))[r._i, r._j] = r._x
    for size, m in out.items():
        mean = m[0, 1:] / m[0, 0]
        _, axes = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        out[size] = axes[:, ::-1][:, :AXES].copy()
    return out


def project(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Places on AXES orthonormal directions; short vectors have zeros beyond their last coordinate."""
    own = axes.get(x.shape[1])
    p = x[:, :len(own)] @ own if own is not None else x[:, :AXES]
    return np.hstack([p, np.zeros((len(p), AXES - p.shape[1]))])


def _pack(columns: list[np.ndarray], vectors: np.ndarray) -> bytes:
    return np.stack(columns).astype(np.int64).tobytes() + vectors.tobytes()


def _unpack(raw: bytes, n: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """``_h1, _h2, _id, _copies`` as rows, and the unit vectors."""
    return np.frombuffer(raw, np.int64, 4 * n).reshape(4, n), unit(np.frombuffer(raw, kind, offset=32 * n).reshape(n, -1))


def _blocks(classes: DataFrame, axes, label: str, side: float, kind: str) -> DataFrame:
    """Blocks of the sequence of every label: place, boxes and packed vectors."""
    cells = [f"_c{j}" for j in range(AXES)]

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, cell = np.zeros(b.num_rows, np.int32), np.zeros((b.num_rows, AXES), np.int32)
            for size, at, x in _units(b.column(5)):
                sizes[at], cell[at] = size, np.floor(project(x, axes.value) / side)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes), *(pa.array(cell[:, j].copy()) for j in range(AXES))], [*b.schema.names, "_size", *cells])

    given = f"_label {label}, _h1 bigint, _h2 bigint, _id bigint, _copies bigint, _vector array<{'float' if kind == 'f4' else 'double'}>"
    rows = classes.select("_label", "_h1", "_h2", "_id", "_copies", "_vector").mapInArrow(grid, f"{given}, _size int, {', '.join(c + ' int' for c in cells)}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no, held, group = TaskContext.get().partitionId(), 0, [], None

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal no
            t = pa.Table.from_batches(parts).combine_chunks()
            size = t["_size"][0].as_py()
            x = t["_vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, size)
            p = project(unit(x), axes.value)
            raw = _pack([t[c].to_numpy() for c in ("_h1", "_h2", "_id", "_copies")], x)
            no += 1
            return pa.RecordBatch.from_arrays(
                [t["_label"].combine_chunks().slice(0, 1), *(pa.array([v], pa.int32()) for v in (size, task, no - 1, len(x))), pa.array([raw], pa.binary()),
                 *(pa.array([v]) for v in [*p.min(0).tolist(), *p.max(0).tolist()])],
                ["_label", "_size", "_task", "_no", "_n", "_raw", *(f"_lo{j}" for j in range(AXES)), *(f"_hi{j}" for j in range(AXES))])

        for b in batches:
            start = 0
            while start < b.num_rows:
                mine = (b.column(0)[start].as_py(), b.column(6)[start].as_py())
                most = max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * mine[1])))
                if held and (mine != group or sum(h.num_rows for h in held) >= most):
                    yield block(held)
                    held = []
                group = mine
                end = min(b.num_rows, start + most - sum(h.num_rows for h in held))
                # rows of another label or length end the block
                labels, sizes = b.column(0).slice(start, end - start), b.column(6).slice(start, end - start)
                same = [x == mine for x in zip(labels.to_pylist(), sizes.to_pylist())]
                end = start + (same.index(False) if False in same else len(same))
                held.append(b.slice(start, end - start))
                start = end
        if held:
            yield block(held)

    order = ["_label", "_size", *cells, "_h1"]
    boxes = ", ".join(f"{e}{j} double" for e in ("_lo", "_hi") for j in range(AXES))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, f"_label {label}, _size int, _task int, _no int, _n int, _raw binary, {boxes}")


def _block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (``_a`` <= ``_b``) of places of blocks of one label whose boxes lie within epsilon: whole sequences, then parts of what is left."""
    lows, highs = [f"_lo{j}" for j in range(AXES)], [f"_hi{j}" for j in range(AXES)]
    top = int(blocks.agg(F.max("_at")).first()[0]).bit_length()
    shifts = list(range((top + FAN - 1) // FAN * FAN, -1, -FAN))

    def nodes(shift: int, p: str) -> DataFrame:
        boxes = blocks.groupBy("_label", "_size", F.shiftright("_at", shift).alias("_node")).agg(*[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])
        return boxes.select(F.col("_label").alias(f"{p}_label"), F.col("_size").alias(f"{p}_size"), F.col("_node").alias(f"{p}_node"), *[F.col(c).alias(p + c) for c in lows + highs])

    pairs = None
    for shift in shifts:
        x, y = nodes(shift, "x"), nodes(shift, "y")
        if pairs is None:
            near = x.join(y, (F.col("x_label") == F.col("y_label")) & (F.col("x_size") == F.col("y_size")) & (F.col("x_node") == F.col("y_node")))
        else:
            near = pairs.join(x, (F.col("_label") == F.col("x_label")) & (F.col("_size") == F.col("x_size")) & (F.col("_a") == F.shiftright("x_node", FAN)))
            near = near.join(y, (F.col("_label") == F.col("y_label")) & (F.col("_size") == F.col("y_size")) & (F.col("_b") == F.shiftright("y_node", FAN)))
        gap = F.lit(0.0)
        for lo, hi in zip(lows, highs):
            g = F.greatest(F.lit(0.0), F.col("y" + lo) - F.col("x" + hi), F.col("x" + lo) - F.col("y" + hi))
            gap = gap + g * g
        near = near.filter((F.col("x_node") <= F.col("y_node")) & (gap <= F.lit((epsilon + SLACK) ** 2)))
        pairs = store(near.select(F.col("x_label").alias("_label"), F.col("x_size").alias("_size"), F.col("x_node").alias("_a"), F.col("y_node").alias("_b")))
    return pairs.select("_a", "_b")


def meet(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, copies: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Joins the vectors ``x`` with ``y`` (or ``x`` with itself): how many vectors each links with, and a number of its linked group.

    ``px`` and ``py`` are places on the grid directions, ``copies`` how often each vector of both occurs.
    """
    off, epsilon = (0 if same else len(x)), math.sqrt(max(0.0, 2 - 2 * least))
    counts, group = np.zeros(len(copies), np.int64), np.arange(len(copies))

    def join(members: np.ndarray) -> None:
        g = np.unique(group[members])
        if len(g) > 1:
            group[np.isin(group, g)] = g[0]

    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        self_ = same and (a, b) == (c, d)
        lo, hi, lo2, hi2 = px[a:b].min(0), px[a:b].max(0), py[c:d].min(0), py[c:d].max(0)
        gap = np.maximum(0, np.maximum(lo2 - hi, lo - hi2))
        if not self_ and gap @ gap > (epsilon + SLACK) ** 2:
            continue
        wide = np.maximum(hi, hi2) - np.minimum(lo, lo2)
        if wide @ wide <= epsilon * epsilon:  # may be all within epsilon: the balls around the middles tell
            m, m2 = x[a:b].mean(0), y[c:d].mean(0)
            r, r2 = np.sqrt(((x[a:b] - m) ** 2).sum(1).max()), np.sqrt(((y[c:d] - m2) ** 2).sum(1).max())
            if np.sqrt(((m - m2) ** 2).sum()) + r + r2 <= epsilon - SLACK:
                if self_:
                    counts[a:b] += copies[a:b].sum() - copies[a:b]
                else:
                    counts[a:b] += copies[off + c:off + d].sum()
                    counts[off + c:off + d] += copies[a:b].sum()
                join(np.concatenate([np.arange(a, b), np.arange(off + c, off + d)]))
                continue
        if max(b - a, d - c) <= LEAF:
            hit = x[a:b] @ y[c:d].T >= least
            if self_:
                hit = np.triu(hit, 1)
            if hit.any():
                counts[a:b] += hit @ copies[off + c:off + d]
                counts[off + c:off + d] += copies[a:b] @ hit
                for i in np.flatnonzero(hit.any(1)):
                    others = off + c + np.flatnonzero(hit[i])
                    if (group[others] != group[a + i]).any():
                        join(np.append(others, a + i))
        elif self_:
            m = (a + b) // 2
            stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            stack += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
        else:
            stack += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]
    return counts, group


def _links(blocks: DataFrame, pairs: DataFrame, axes, kind: str, least: float) -> DataFrame:
    """Per pair of blocks and vector with links there: ``_h1``, ``_h2``, ``_links``, its ``_id`` and the least id it hangs together with."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, at2, n, raw, n2, raw2 in zip(*(c.to_pylist() for c in b.columns)):
                same = at == at2
                keys, x = _unpack(raw, n, kind)
                keys2, y = (keys[:, :0], x) if same else _unpack(raw2, n2, kind)
                keys = np.hstack([keys, keys2])
                px = project(x, axes.value)
                counts, group = meet(x, y, px, px if same else project(y, axes.value), keys[3], same, least)
                on = np.flatnonzero(counts)
                if len(on):
                    first = np.full(len(group), np.iinfo(np.int64).max)
                    np.minimum.at(first, group, keys[2])
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (keys[0, on], keys[1, on], counts[on], keys[2, on], first[group[on]])],
                                                     ["_h1", "_h2", "_links", "_id", "_root"])

    one = blocks.select(F.col("_at").alias("_a"), F.col("_n").alias("_na"), F.col("_raw").alias("_ra"))
    two = blocks.select(F.col("_at").alias("_b"), F.col("_n").alias("_nb"), F.col("_raw").alias("_rb"))
    both = pairs.join(one, "_a").join(two, "_b").select("_a", "_b", "_na", "_ra", "_nb", "_rb")
    return both.mapInArrow(compare, "_h1 bigint, _h2 bigint, _links bigint, _id bigint, _root bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """One row per input row: the id, ``n_links`` (other vectors of its label with a cosine of ``least`` or more), ``component_id`` (smallest id
    that links reach) and ``kept``, whether it is that one.

    * A null label links with nothing, nor do vectors that are null, empty, zero or hold a null or non-finite component, nor those of unlike length.
    * Equal vectors of a label link. Repeated rows count as vectors of their own; rows that share an id are one node of the components.
    * Rows without an id are told apart by their vectors, sort last and have a null id and, if they are its smallest, component.
    * An empty table stays empty. Extra columns are left out.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, mb=8)
    kind = "f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "f8"
    label = vectors.schema[label_col].dataType.simpleString()
    x = F.col(vector_col) if kind == "f4" else F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(sort_id(F.col(id_col), F.col(vector_col).cast("string")).alias("_id"), F.col(label_col).alias("_label"), x.alias("_vector"),
                          F.coalesce(F.col(label_col).isNotNull() & finite, F.lit(False)).alias("_good"))
    rows = store(rows.withColumns({"_row": F.monotonically_increasing_id(), "_h1": F.when(F.col("_good"), F.xxhash64("_label", "_vector")),
                                   "_h2": F.when(F.col("_good"), F.xxhash64(F.lit(17), "_label", "_vector"))}))
    good = rows.filter("_good")
    groups = store(good.groupBy("_h1", "_h2").agg(F.min("_row").alias("_row"), F.min("_id").alias("_class"), F.count(F.lit(1)).alias("_copies")))
    classes = good.drop("_id").join(groups.withColumnRenamed("_class", "_id"), ["_h1", "_h2", "_row"])
    axes = spark.sparkContext.broadcast(directions(good))
    epsilon = math.sqrt(max(0.0, 2 - 2 * least))
    blocks = store(_blocks(classes, axes, label, epsilon or 1e-6, kind))
    links = None
    most = blocks.agg(F.max("_no"), F.max("_task")).first()
    if most[0] is not None:
        blocks = blocks.withColumn("_at", F.shiftleft(F.col("_task").cast("bigint"), int(most[0]).bit_length()) + F.col("_no"))
        links = store(_links(blocks, _block_pairs(blocks, epsilon), axes, kind, least))
    else:
        links = spark.createDataFrame([], "_h1 bigint, _h2 bigint, _links bigint, _id bigint, _root bigint")

    # rows of one id in several classes tie the classes together
    spread = good.select("_id", "_h1", "_h2").distinct().groupBy("_id").count().filter("count > 1").select("_id")
    ties = good.join(spread, "_id", "left_semi").join(groups.drop("_row"), ["_h1", "_h2"]).select(F.col("_id").alias("a"), F.col("_class").alias("b"))
    edges = links.select(F.col("_id").alias("a"), F.col("_root").alias("b")).unionAll(ties).filter("a <> b")
    nodes = store(components(edges)).withColumnRenamed("node", "_class")
    counts = links.groupBy("_h1", "_h2").agg(F.sum("_links").alias("_links"))
    known = groups.join(counts, ["_h1", "_h2"], "left").join(nodes, "_class", "left")
    known = known.select("_h1", "_h2", (F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))).alias("_n"), F.coalesce("component", "_class").alias("_component"))
    out = rows.select("_id", "_h1", "_h2").join(known, ["_h1", "_h2"], "left").withColumn("_component", F.coalesce("_component", "_id"))
    return out.select(given_id(F.col("_id")).alias(id_col), F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_links"),
                      given_id(F.col("_component")).alias("component_id"), (F.col("_id") == F.col("_component")).alias("kept"))


@query("op11_embedding_near_dedup", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
h AS (SELECT * FROM g WHERE norm > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (WITH RECURSIVE reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, l.b FROM reach JOIN l ON reach.other = l.a)
      SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, r.component_id, r.component_id = e.vec_id AS kept
FROM embeddings e JOIN r USING (vec_id) LEFT JOIN n USING (vec_id)""")
def op11_embedding_near_dedup(spark, sf):
    return near_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"))
