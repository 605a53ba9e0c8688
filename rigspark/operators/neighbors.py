"""Exact nearest neighbours without comparing every pair.

References are dealt into cells of about the root of their number. Up to four dimensions the cells are boxes: a grid over the data, and a finer
grid inside every crowded box, again and again. Wider vectors go to the nearest of as many pivots, found over a first level of few pivots.
What the driver knows of a cell (its size, its box or its distances from the pivot) gives each query an upper bound on its k-th distance
and each cell a lower bound on what it can offer, so a query only visits cells that can still hold a neighbour: rings of boxes around
it, or balls that reach it. A cell that stays crowded (many equal vectors) is split into blocks by hash and a crowded query list likewise,
so a task never holds more than one block of each, whatever the skew.

Wide vectors without structure reach most balls. Where a look at a few queries shows that, blocks of queries meet blocks of references
instead, every pair of blocks in a task: distances come from one matrix product, and those that its rounding leaves in doubt are taken again
dimension by dimension. Inside a cell of few dimensions a query only meets references whose widest coordinate is near its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..scale import attach
from ..session import cut

#: Cells the driver keeps numbers of; beyond, crowded cells are split by hash.
MOST_CELLS = 1 << 14
BLOCK_ROWS = 20_000
MOST_LEVELS = 24
LEAST_CELL = 512
GRID_DIMENSIONS = 4
#: Queries looked at, and the share of the references they reach, from which on blocks meet all blocks. They steer cost, not results.
LOOK, MOST_REACHED = 256, 0.25
#: Least dimensions for matrix products; vectors a block holds (16 MB), and blocks a side that keep a small cluster busy.
PRODUCT_DIMENSIONS, BLOCK_BYTES, LEAST_BLOCKS = 16, 16 << 20, 8
#: Queries that share a window of references.
WINDOW_QUERIES = 128


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed dimension by dimension."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(out)


def _blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, (1 << 22) // max(1, width))
    for i in range(0, n, step):
        yield slice(i, i + step)


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), dtype=float)


def _reach(upper: np.ndarray) -> np.ndarray:
    """A bound with room for rounding."""
    return upper * (1 + 1e-9) + 1e-12


def _ranked(row: np.ndarray, at: np.ndarray, dist: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The m least distances of each row, ties by position."""
    order = np.lexsort((at, dist, row))
    row, at, dist = row[order], at[order], dist[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < m
    return row[keep], at[keep], dist[keep]


def _by_pairs(x: np.ndarray, y: np.ndarray, m: int) -> Iterator[tuple]:
    for s in _blocks(len(x), len(y)):
        d = _dist(x[s], y)
        row, at = np.nonzero(d <= np.partition(d, m - 1, axis=1)[:, m - 1, None])
        row, at, dist = _ranked(row, at, d[row, at], m)
        yield s.start + row, at, dist


def _by_windows(x: np.ndarray, y: np.ndarray, m: int) -> Iterator[tuple]:
    """Along the widest coordinate: a few references around the queries bound the m-th distance, and so how far along any other may lie."""
    j = int(np.ptp(y, axis=0).argmax())
    along, places = np.argsort(x[:, j], kind="stable"), np.argsort(y[:, j], kind="stable")
    ordered = y[places]
    line = ordered[:, j]
    for i in range(0, len(x), WINDOW_QUERIES):
        mine = along[i:i + WINDOW_QUERIES]
        q = x[mine]
        low, high = q[0, j], q[-1, j]
        a, b = max(0, int(np.searchsorted(line, low)) - 2 * m), min(len(line), int(np.searchsorted(line, high, "right")) + 2 * m)
        bound = np.concatenate([np.partition(_dist(q[s], ordered[a:b]), m - 1, axis=1)[:, m - 1] for s in _blocks(len(q), b - a)]) if b - a >= m else np.array([np.inf])
        far = _reach(bound.max())
        a, b = int(np.searchsorted(line, low - far)), int(np.searchsorted(line, high + far, "right"))
        for s in _blocks(len(q), b - a):
            d = _dist(q[s], ordered[a:b])
            row, at = np.nonzero(d <= np.partition(d, m - 1, axis=1)[:, m - 1, None])
            row, at, dist = _ranked(row, places[a + at], d[row, at], m)
            yield mine[s.start + row], at, dist


def _by_products(x: np.ndarray, y: np.ndarray, m: int) -> Iterator[tuple]:
    """From |y|^2 - 2xy, which ranks the references of a query up to rounding; what may be among the m least is measured exactly."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    slack = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (xx + yy.max())
    side = len(y) // 32
    for s in _blocks(len(x), len(y)):
        g = x[s] @ (-2 * y.T)
        g += yy
        # the m-th least of minima over disjoint sets of references is no less than the m-th least of all
        least = g[:, :32 * side].reshape(len(g), 32, side).min(1) if side >= 4 * m else g
        row, at = np.nonzero(g <= (np.partition(least, m - 1, axis=1)[:, m - 1] + slack[s])[:, None])
        a, b, total = x[s][row], y[at], np.zeros(len(row))
        for j in range(x.shape[1]):
            total += (a[:, j] - b[:, j]) ** 2
        row, at, dist = _ranked(row, at, np.sqrt(total), m)
        yield s.start + row, at, dist


def _nearest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x`` with the positions and distances of their k nearest rows of ``y``, ties by position."""
    m = min(k, len(y))
    most = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    if not most < 1e150:  # squares overflow, or a component is not a number
        found = _by_pairs(x, y, m)
    elif x.shape[1] >= PRODUCT_DIMENSIONS:
        found = _by_products(x, y, m)
    else:
        found = _by_windows(x, y, m)
    parts = list(found)
    return tuple(np.concatenate([p[j] for p in parts]) for j in range(3))


class Boxes:
    """Cells of up to four dimensions: a grid, and grids inside its crowded boxes."""

    def __init__(self, refs: DataFrame, dims: int, n: int, k: int):
        self.levels: list[tuple] = []  # per level: parents, their corners and widths, slices a side, first id
        most = max(LEAST_CELL, int(4 * n ** 0.5))
        boxes, ids = self._stats(refs, F.lit(0).cast("bigint"), dims), 1
        done: list[tuple] = []
        while True:
            crowded = [b for b in boxes if b[1] > most and any(h > l for l, h in zip(b[2], b[3]))] if self.levels else boxes
            if not crowded or ids >= MOST_CELLS or len(self.levels) == MOST_LEVELS:
                break
            split = {b[0] for b in crowded}
            done += [b for b in boxes if b[0] not in split]
            side = max(2, min(16, int(np.ceil((2 * max(b[1] for b in crowded) / most) ** (1 / dims)))))
            while len(crowded) * side ** dims > 4 * MOST_CELLS and side > 2:
                side -= 1
            crowded.sort()
            low = np.array([b[2] for b in crowded])
            self.levels.append((np.array([b[0] for b in crowded]), low, np.array([b[3] for b in crowded]) - low, side, ids))
            ids += len(crowded) * side ** dims
            # only rows of the boxes split last are counted again
            last = refs.withColumn("_cell", self.assigner()("vec")).filter(F.col("_cell") >= self.levels[-1][4])
            boxes = self._stats(last, F.col("_cell"), dims)
        done += boxes
        self.ids = np.array([b[0] for b in done], np.int64)
        self.sizes = np.array([b[1] for b in done], np.int64)
        self.low, self.high = np.array([b[2] for b in done]), np.array([b[3] for b in done])
        self.k = k

    @staticmethod
    def _stats(refs: DataFrame, cell, dims: int) -> list[tuple]:
        rows = refs.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("n"), *[f(F.col("vec")[j]).alias(f"{e}{j}") for j in range(dims) for e, f in (("a", F.min), ("b", F.max))])
        return [(r["_cell"], r["n"], [r[f"a{j}"] for j in range(dims)], [r[f"b{j}"] for j in range(dims)]) for r in rows.collect()]

    def assigner(self):
        levels = list(self.levels)

        @F.pandas_udf("bigint")
        def cell_of(v: pd.Series) -> pd.Series:
            x, cell = _matrix(v), np.zeros(len(v), np.int64)
            for parents, low, width, side, base in levels:
                at = np.minimum(np.searchsorted(parents, cell), len(parents) - 1)
                on = np.flatnonzero(parents[at] == cell)
                a = at[on]
                share = np.divide(x[on] - low[a], width[a], out=np.zeros((len(on), x.shape[1])), where=width[a] > 0)
                step = np.clip((share * side).astype(np.int64), 0, side - 1)
                code = a.astype(np.int64)
                for j in range(x.shape[1]):
                    code = code * side + step[:, j]
                cell[on] = base + code
            return pd.Series(cell)
        return cell_of

    def visitor(self):
        ids, sizes, low, high, k = self.ids, self.sizes, self.low, self.high, self.k

        @F.pandas_udf("array<bigint>")
        def cells_to_visit(v: pd.Series) -> pd.Series:
            x, out = _matrix(v), []
            full = sizes >= k
            for s in _blocks(len(x), len(ids)):
                near, far = np.zeros((len(x[s]), len(ids))), np.zeros((len(x[s]), len(ids)))
                for j in range(x.shape[1]):
                    a, b = low[None, :, j] - x[s, j, None], x[s, j, None] - high[None, :, j]
                    near += np.maximum(0, np.maximum(a, b)) ** 2
                    far += np.maximum(np.abs(a), np.abs(b)) ** 2
                upper = far[:, full].min(1) if full.any() else np.full(len(near), np.inf)
                if k > 1:  # several cells together may hold k nearer ones
                    order = np.argpartition(far, min(k, len(ids)) - 1, axis=1)[:, :k]
                    order = np.take_along_axis(order, np.take_along_axis(far, order, 1).argsort(1), 1)
                    enough = np.cumsum(sizes[order], 1) >= k
                    some = enough.any(1)
                    upper[some] = np.minimum(upper[some], np.take_along_axis(far, order, 1)[some, enough.argmax(1)[some]])
                out.extend(ids[row] for row in near <= _reach(upper)[:, None])
            return pd.Series(out)
        return cells_to_visit


class Balls:
    """Cells of wide vectors: those nearest to a pivot, and pivots nearest to one of fewer pivots above them."""

    def __init__(self, refs: DataFrame, n: int, k: int):
        count = max(2, min(MOST_CELLS, int(n ** 0.5)))
        rows = refs.select("vec", F.xxhash64("rid").alias("h")).orderBy("h").limit(count).collect()
        pivots = np.unique(np.array([r["vec"] for r in rows], dtype=float), axis=0)
        # unique sorts; the tops must not be neighbours
        tops = pivots[np.linspace(0, len(pivots) - 1, max(1, int(len(pivots) ** 0.5))).astype(int)]
        group = np.concatenate([_dist(pivots[s], tops).argmin(1) for s in _blocks(len(pivots), len(tops))])
        order = np.argsort(group, kind="stable")
        self.pivots, group = pivots[order], group[order]
        used = np.unique(group)
        self.tops = tops[used]
        self.spans = [(int(np.searchsorted(group, g)), int(np.searchsorted(group, g, "right"))) for g in used]
        self.k = k
        placed = cut(refs.select("rid", "vec").withColumn("_p", self._placer()("vec")).select("rid", "_p.cell", "_p.d"))
        stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        p = len(self.pivots)
        self.ids, self.sizes = np.arange(p, dtype=np.int64), np.zeros(p, np.int64)
        self.lo, self.hi, self.near = np.full(p, np.inf), np.full(p, -np.inf), np.full((p, k), np.inf)
        for r in stats.collect():
            self.sizes[r["cell"]], self.lo[r["cell"]], self.hi[r["cell"]] = r["n"], r["lo"], r["hi"]
        rank = F.row_number().over(W.partitionBy("cell").orderBy("d"))
        for r in placed.select("cell", "d", rank.alias("r")).filter(F.col("r") <= k).collect():
            self.near[r["cell"], r["r"] - 1] = r["d"]

    def _placer(self):
        pivots, tops, spans = self.pivots, self.tops, self.spans

        @F.pandas_udf("struct<cell bigint, d double>")
        def place(v: pd.Series) -> pd.DataFrame:
            x = _matrix(v)
            cell, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
            top = np.concatenate([_dist(x[s], tops).argmin(1) for s in _blocks(len(x), len(tops))]) if len(x) else np.zeros(0, int)
            for g in np.unique(top):
                a, b = spans[g]
                at = np.flatnonzero(top == g)
                for s in _blocks(len(at), b - a):
                    d = _dist(x[at[s]], pivots[a:b])
                    near = d.argmin(1)
                    cell[at[s]], dist[at[s]] = a + near, d[np.arange(len(near)), near]
            return pd.DataFrame({"cell": cell, "d": dist})
        return place

    def assigner(self):
        place = self._placer()
        return lambda vec: place(vec)["cell"]

    def reached(self, queries: DataFrame) -> float:
        """The mean share of the references in the cells that a few queries visit."""
        looked = queries.orderBy(F.xxhash64("vec")).limit(LOOK).select(self.visitor()("vec").alias("cells")).collect()
        return float(np.mean([self.sizes[r["cells"]].sum() for r in looked]) / self.sizes.sum()) if looked else 0.0

    def visitor(self):
        pivots, tops, spans, sizes, lo, hi, near, k = self.pivots, self.tops, self.spans, self.sizes, self.lo, self.hi, self.near, self.k
        reach = np.array([max((np.sqrt(((pivots[a:b] - t) ** 2).sum(1)) + hi[a:b]).max(), 0.0) for t, (a, b) in zip(tops, spans)])

        @F.pandas_udf("array<bigint>")
        def cells_to_visit(v: pd.Series) -> pd.Series:
            x, out = _matrix(v), []
            for s in _blocks(len(x), len(pivots) * k):
                q = x[s]
                above = _dist(q, tops)
                first = above.argmin(1)
                bounds = np.full((len(q), k), np.inf)  # k least upper bounds met so far
                dist = np.full((len(q), len(pivots)), np.nan)

                def look(rows: np.ndarray, g: int) -> None:
                    a, b = spans[g]
                    d = _dist(q[rows], pivots[a:b])
                    dist[rows, a:b] = d
                    met = np.concatenate([bounds[rows], (d[:, :, None] + near[None, a:b, :]).reshape(len(d), -1)], 1)
                    bounds[rows] = np.partition(met, k - 1, axis=1)[:, :k]
                for g in range(len(tops)):  # the nearest group first: it gives a bound to begin with
                    rows = np.flatnonzero(first == g)
                    if len(rows):
                        look(rows, g)
                for g in range(len(tops)):
                    rows = np.flatnonzero((first != g) & (above[:, g] - reach[g] <= _reach(bounds.max(1))))
                    if len(rows):
                        look(rows, g)
                upper = _reach(bounds.max(1))
                with np.errstate(invalid="ignore"):
                    lower = np.maximum(0.0, np.maximum(dist - hi, lo - dist))
                    visit = (sizes > 0) & (lower <= upper[:, None])
                out.extend(np.flatnonzero(row).astype(np.int64) for row in visit)
            return pd.Series(out)
        return cells_to_visit


def _best(queries: DataFrame, q: DataFrame, r: DataFrame, by: list[str], k: int, payload: list[str]) -> DataFrame:
    """The k nearest references of every query over all groups in which it meets some; what a group hands on names queries by number."""
    def nearest(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or rs.empty:
            return pd.DataFrame({c: [] for c in ["qid", "rid", "dist", *payload]})
        rs = rs.sort_values("rid", kind="stable")  # ties in order of rid
        qi, ri, dist = _nearest(_matrix(qs["vec"]), _matrix(rs["vec"]), k)
        found = {"qid": qs["qid"].to_numpy()[qi], "rid": rs["rid"].to_numpy()[ri], "dist": dist}
        found.update({c: rs[c].to_numpy()[ri] for c in payload})
        return pd.DataFrame(found)

    kinds = {"qid": "bigint", "rid": r.schema["rid"].dataType.simpleString(), "dist": "double", **{c: r.schema[c].dataType.simpleString() for c in payload}}
    found = q.groupBy(*by).cogroup(r.groupBy(*by)).applyInPandas(nearest, ", ".join(f"{c} {t}" for c, t in kinds.items()))
    rank = F.row_number().over(W.partitionBy("qid").orderBy("dist", "rid"))
    best = found.withColumn("place", rank).filter(F.col("place") <= k)
    return best.join(queries, "qid").select("vec", "rid", "dist", *payload, "place")


def _block_join(queries: DataFrame, refs: DataFrame, k: int, payload: list[str], n: int, dims: int, block_rows: int) -> DataFrame:
    """Every block of queries against every block of references; what a pair of blocks hands on names queries by number, not by vector."""
    most = max(1, min(block_rows, BLOCK_BYTES // (8 * dims)))
    qbs, rbs = (max(-(-c // most), min(LEAST_BLOCKS, -(-c // LEAST_CELL))) for c in (queries.count(), n))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(qbs)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rbs - 1))))
    r = refs.withColumn("rb", F.pmod(F.xxhash64("rid"), F.lit(rbs)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qbs - 1))))
    return _best(queries, q, r, ["rb", "qb"], k, payload)


def knn_join(queries: DataFrame, refs: DataFrame, k: int, payload: Iterable[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest references of every distinct query vector, ties by ``rid``.

    ``queries(vec)`` and ``refs(rid, vec, payload...)`` hold array<double>
    vectors of one length; the result is ``(vec, rid, dist, payload...)``. Without references it is empty.
    """
    payload = list(payload)
    # from here on a query is named by a number: only the tasks that measure distances see its vector again
    queries = cut(queries.select("vec").distinct().withColumn("qid", F.monotonically_increasing_id()))
    refs = cut(refs.select("rid", "vec", *payload))
    fields = ", ".join(["vec array<double>", f"rid {refs.schema['rid'].dataType.simpleString()}", "dist double"]
                       + [f"{c} {refs.schema[c].dataType.simpleString()}" for c in payload])
    known = refs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not known["n"]:
        return queries.sparkSession.createDataFrame([], fields)
    cells = Boxes(refs, known["d"], known["n"], k) if known["d"] <= GRID_DIMENSIONS else Balls(refs, known["n"], k)
    if isinstance(cells, Balls) and cells.reached(queries) > MOST_REACHED:
        return _block_join(queries, refs, k, payload, known["n"], known["d"], block_rows)
    visits = cut(queries.withColumn("cell", F.explode(cells.visitor()("vec"))))
    crowd = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    # at most MOST_CELLS rows, once split: blocks of references and of queries by cell
    sizes = queries.sparkSession.createDataFrame([(int(c), int(-(-int(s) // block_rows) or 1)) for c, s in zip(cells.ids, cells.sizes)], "cell bigint, _rbs int")
    plan = sizes.join(crowd, "cell").select("cell", "_rbs", F.ceil(F.col("_n") / F.lit(block_rows)).cast("int").alias("_qbs"))
    plan = F.broadcast(cut(plan))
    q = visits.join(plan, "cell").withColumn("qb", F.pmod(F.xxhash64("vec"), F.col("_qbs")).cast("int"))
    q = q.withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("_rbs") - 1))).select("cell", "rb", "qb", "qid", "vec")
    r = refs.withColumn("cell", cells.assigner()(F.col("vec"))).join(plan, "cell").withColumn("rb", F.pmod(F.xxhash64("rid"), F.col("_rbs")).cast("int"))
    r = r.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("_qbs") - 1))).select("cell", "rb", "qb", "rid", "vec", *payload)

    return _best(queries, q, r, ["cell", "rb", "qb"], k, payload)



def nearest_distance(points: DataFrame, refs: DataFrame, cols: Iterable[str], out: str = "distance", **limits) -> DataFrame:
    """Distance of each point to its nearest reference over ``cols`` (already scaled)."""
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    known = refs.select(vec.alias("vec")).distinct().withColumn("rid", F.xxhash64("vec"))
    pts = points.withColumn("_vec", vec)
    found = knn_join(pts.select(F.col("_vec").alias("vec")), known, 1, **limits)
    found = found.select(F.col("vec").alias("_vec"), F.col("dist").alias(out))
    return attach(pts, found, "_vec").drop("_vec")
