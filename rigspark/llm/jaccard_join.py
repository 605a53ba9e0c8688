"""Exact Jaccard self-join of shingle sets by universe partition and pigeonhole, and the components of its links.

Sets with Jaccard similarity p/q or more differ in at most H = (x + y)(q - p)/(q + p) tokens. Tokens are hashed into segments; the number
of segments depends on the size band of the set, and a set that may be similar to sets of the band below is indexed there too. A segment
may be *exact* (both subsets equal; weight 1) or *near* (they differ by one token at most; weight 2). Differences over H cannot fall into
segments of total weight W > H without leaving some segment good, and in fact the good ones weigh W - H or more. So every set may leave
out exact segments of total weight W - H - 1, as long as all sets leave them out by one common order: the last good segment of a pair
is then indexed by both. Empty subsets go first, then subsets that a sample showed to be frequent, then small ones: what is left out
is what would cost most. Near segments index their subset and its one-deletion neighbourhood. How many segments of a band are near, and
how many there are, is chosen by the expected cost for the sizes and the number of sets in the band.

Sets of equal signature are candidates. Equal sets are one class from the start. In a run of equal signatures every class is compared
with the first one, links are verified on the whole sets, and components are formed; then classes of one run in different components are
compared with each other, so that no link is lost. Parity sketches (a bit per group of tokens) bound the difference of two sets from
below, and only pairs that they cannot rule out have their sets compared. Runs are sorted and streamed, frequent signatures salted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import bounded_batches, by_id, given_id, query, sort_id, store, table, tasks_for
from .components import components
from .shingles import mix, shingle_sets, shingle_table

#: Ids that may be broadcast (8 MB); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
BAND_RATIO = 4
#: Share of the documents looked at for frequent signatures, least count there, and most signatures kept. They steer cost, not results.
SAMPLE, SAMPLE_LEAST, FREQUENT = 32, 4, 50_000
SALTS = 64
#: Members of a run compared in one task, members that meet one copy of their first class.
BLOCK, STAR = 2048, 8192
#: Members of a (run, block pair) from which they are compared as arrays, and words of sketches held as one array.
MANY, TILE = 32, 1 << 20
#: Whole sets, and shingles signed, that a task is worth.
SETS_EACH, SHINGLES_EACH = 1 << 11, 1 << 19
#: Least signatures a class carries, by which a pair that meets in several runs is compared in the first of them.
HEADS = 16


@dataclass(frozen=True)
class Similarity:
    """Link if q * intersection >= p * union."""

    p: int = 75
    q: int = 100

    def most_difference(self, x: int, y: int) -> int:
        return (x + y) * (self.q - self.p) // (self.q + self.p)

    def largest_partner(self, x: int) -> int:
        return x * self.q // self.p

    def smallest_partner(self, x: int) -> int:
        return -(-x * self.p // self.q)

    def linked(self, x: int, y: int, both: int) -> bool:
        return x > 0 and y > 0 and self.q * both >= self.p * (x + y - both)


def band_of(x: int) -> int:
    k, top = 0, BAND_RATIO - 1
    while x > top:
        k, top = k + 1, top * BAND_RATIO + BAND_RATIO - 1
    return k


def band_top(k: int) -> int:
    return BAND_RATIO ** (k + 1) - 1


@dataclass(frozen=True)
class Allocation:
    """Segments of a band, and how many of them are near."""

    segments: int
    near: int

    @property
    def weight(self) -> int:
        return self.segments + self.near


def allocate(k: int, sets: int, sim: Similarity) -> Allocation:
    """The cheapest allocation for a band of so many sets: rows written, and expected meetings of empty subsets."""
    top = band_top(k)
    need = sim.most_difference(top, sim.largest_partner(top)) + 1
    x = max(1, top // 2)
    differ = sim.most_difference(x, sim.largest_partner(x))
    best = None
    for near in sorted({0, need // 4, need // 2}):
        for slack in (0, need // 4, need // 2, need):
            a = Allocation(max(need - near + slack, near, 1), near)
            if a.weight < need:
                continue
            mean = x / a.segments
            empty = math.exp(-mean)
            rows = max(0, differ + 1 - 2 * near) + near * (1 + mean)
            loose = max(0.0, (a.segments - near) * empty - (a.weight - differ - 1)) + near * empty * (1 + mean)
            cost = rows + loose * (1 + sets * 0.01)
            if best is None or cost < best[0]:
                best = (cost, a)
    return best[1]


_SEGMENT, _BAND, _SUBSET = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_HALF = np.uint64(32)
#: Bits of a signature that a small table tells infrequent ones by, before the sorted list is searched.
_TABLE_BITS = 20


class Frequent:
    """Frequent signatures: a bit table that rules out most others, and the sorted list."""

    def __init__(self, signatures: np.ndarray):
        self.sorted = np.unique(signatures)
        self.table = np.zeros(1 << _TABLE_BITS if len(self.sorted) else 0, bool)
        self.table[(self.sorted >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def has(self, sig: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.zeros(len(sig), bool)
        out = self.table[(sig >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.sorted, sig[maybe]), len(self.sorted) - 1)
        out[maybe] = self.sorted[at] == sig[maybe]
        return out


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    return np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _named(subset: np.ndarray, segment: np.ndarray, salt: np.uint64) -> np.ndarray:
    return mix(subset * _SUBSET + _SEGMENT * (segment.astype(np.uint64) + np.uint64(1)) + salt)


def signatures(tokens: np.ndarray, counts: np.ndarray, k: int, a: Allocation, most: np.ndarray, frequent: Frequent,
               everything: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets in band ``k`` for partners that differ by at most ``most`` tokens, and the number of the set each belongs to.

    ``tokens`` holds the sorted sets one after the other, none of them empty. Segments are ranges of tokens, so a subset is a run of its set.
    """
    with np.errstate(over="ignore"):
        salt, n = _BAND * np.uint64(k + 1), len(counts)
        owner = np.repeat(np.arange(n), counts)
        key = owner * a.segments + (((tokens >> _HALF) * np.uint64(a.segments)) >> _HALF).astype(np.int64)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        size, total = np.diff(starts, append=len(key)), np.add.reduceat(tokens, starts)
        of, which = np.divmod(key[starts], a.segments)
        sig = _named(total, which, salt)
        exact = which >= a.near
        filled = np.bincount(of[exact], minlength=n)
        empty = a.segments - a.near - filled
        spare = np.maximum(0, a.weight - most - 1) if not everything else empty
        keep = exact.copy()
        ends = np.cumsum(filled)
        cost = sig[exact] >> np.uint64(7) | np.maximum(63 - size[exact], 0).astype(np.uint64) << np.uint64(57)
        cost[frequent.has(sig[exact])] |= np.uint64(1 << 63)
        inside = np.ones(len(cost), bool)
        # a set leaves out its costliest subsets; two of equal cost at the border both stay
        for i in np.flatnonzero(spare > empty).tolist():
            end = int(ends[i])
            begin, stay = end - int(filled[i]), int(filled[i] - (spare[i] - empty[i]))
            inside[begin:end] = cost[begin:end] <= np.partition(cost[begin:end], stay - 1)[stay - 1] if stay > 0 else False
        keep[exact] = inside
        out, owners = [sig[keep]], [of[keep]]
        there = which[exact]
        for i in np.flatnonzero(spare < empty).tolist():  # empty subsets are the last resort
            missing = np.setdiff1d(np.arange(a.near, a.segments), there[int(ends[i] - filled[i]):int(ends[i])], assume_unique=True)
            names = np.sort(_named(np.zeros(len(missing), np.uint64), missing, salt))[: int(empty[i] - spare[i])]
            out.append(names)
            owners.append(np.full(len(names), i))
        if a.near:
            out.append(sig[~exact])
            owners.append(of[~exact])
            near = np.flatnonzero(np.repeat(~exact, size))
            out.append(_named(np.repeat(total, size)[near] - tokens[near], np.repeat(which, size)[near], salt))
            owners.append(owner[near])
            hollow = np.ones((n, a.near), bool)
            hollow[of[~exact], which[~exact]] = False
            row, segment = np.nonzero(hollow)
            out.append(_named(np.zeros(len(row), np.uint64), segment, salt))
            owners.append(row)
        return np.concatenate(out), np.concatenate(owners)


#: Tokens, and cells of sets by near segments, that are worked on at a time.
_TOKENS, _CELLS = 1 << 16, 1 << 20


def table_signatures(tokens: np.ndarray, counts: np.ndarray, plan: dict[int, Allocation], sim: Similarity, frequent: Frequent,
                     everything: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All signatures of many sets, with the number of their set: in its own band, and in the band below if it has partners there."""
    begins = np.cumsum(counts) - counts
    band = np.array([band_of(x) for x in counts.tolist()], np.int64)
    for k in range(int(band.max(initial=0)) + 1):
        own = (band == k) & (counts > 0)
        below = (band == k + 1) & (counts * sim.p <= band_top(k) * sim.q)
        if k not in plan:
            continue
        for sets, at_most in ((own, lambda x: sim.largest_partner(x)), (below, lambda x: band_top(k))):
            sets = np.flatnonzero(sets)
            step = max(1, _CELLS // max(1, plan[k].near))
            for part in _parts(sets, counts, step):
                x = counts[part]
                sig, of = signatures(tokens[_ranges(begins[part], x)], x, k, plan[k], sim.most_difference(x, at_most(x)), frequent, everything)
                yield sig, part[of]


def _parts(sets: np.ndarray, counts: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Stretches of the sets with few tokens and at most ``most`` sets."""
    ends = np.cumsum(counts[sets])
    i = 0
    while i < len(sets):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _TOKENS, "right"))
        j = min(max(j, i + 1), i + most)
        yield sets[i:j]
        i = j


def set_signatures(tokens: np.ndarray, plan: dict[int, Allocation], sim: Similarity, frequent: np.ndarray, everything: bool = False) -> np.ndarray:
    """All signatures of one set."""
    found = [sig for sig, _ in table_signatures(tokens, np.array([len(tokens)]), plan, sim, Frequent(frequent), everything)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


# --- parity sketches ---------------------------------------------------------

def sketches(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit per group of tokens: the parity of the group. One bit a token or more, a power of two, 64 at least. The bytes of all sets, and their ends."""
    bits = 1 << np.maximum(6, np.frexp(np.maximum(counts - 1, 0).astype(float))[1].astype(np.int64))
    ends = np.cumsum(bits)
    at = (tokens >> np.uint64(12)).astype(np.int64) & np.repeat(bits - 1, counts)
    at += np.repeat(ends - bits, counts)
    parity = np.bincount(at, minlength=int(bits.sum())) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little"), ends // 8


def sketch(tokens: np.ndarray) -> bytes:
    """The sketch of one set."""
    return sketches(tokens, np.array([len(tokens)]))[0].tobytes()


def _fold(s: np.ndarray, size: int) -> np.ndarray:
    while s.shape[-1] > size:
        half = s.shape[-1] // 2
        s = s[..., :half] ^ s[..., half:]
    return s


def may_link(x: int, y: int, a: bytes, b: bytes, sim: Similarity) -> bool:
    """False only if the sizes or the sketches prove that two sets differ too much."""
    if not sim.smallest_partner(x) <= y <= sim.largest_partner(x):
        return False
    size = min(len(a), len(b)) // 8
    differ = _fold(np.frombuffer(a, np.uint64), size) ^ _fold(np.frombuffer(b, np.uint64), size)
    return int(np.bitwise_count(differ).sum()) <= sim.most_difference(x, y)


# --- the join ----------------------------------------------------------------

def _semi(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Join the documents with a table by ``_id``: broadcast if it is counted to be short, else shuffled."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "_id", how)


def _arrays(*columns) -> list[pa.Array]:
    return [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def scan_sets(docs: DataFrame) -> DataFrame:
    """Of every row (``_id``, ``_text``): size, 128-bit digest and sketch of its set."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, counts = shingle_table(b.column(1).cast(pa.binary()).to_pylist())
            d1, d2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
            some = counts > 0
            if some.any():
                begins = (np.cumsum(counts) - counts)[some]
                d1[some], d2[some] = np.add.reduceat(tokens, begins), np.add.reduceat(mix(tokens ^ _BAND), begins)
            drawn, ends = sketches(tokens, counts)
            drawn = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(drawn)])
            yield pa.RecordBatch.from_arrays(_arrays(b.column(0), counts.astype(np.int64), _as_long(d1), _as_long(d2), drawn.cast(pa.binary())),
                                             ["_id", "_n", "_d1", "_d2", "_sketch"])
    return docs.mapInArrow(scan, "_id bigint, _n bigint, _d1 bigint, _d2 bigint, _sketch binary")


def _emit_signatures(docs: DataFrame, plan, sim: Similarity, frequent, everything: bool = False) -> DataFrame:
    """Rows (``_key``, ``_id``, ``_sig``): the key is the signature, and ``_sig`` null. A frequent signature is dealt over SALTS keys and given beside them."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Frequent(frequent.value if frequent is not None else np.zeros(0, np.uint64))
        for b in batches:
            ids = b.column(0).to_numpy()
            for sig, of in table_signatures(*shingle_table(b.column(1).cast(pa.binary()).to_pylist()), plan, sim, common, everything):
                owner, often = ids[of], common.has(sig)
                key = sig.copy()
                with np.errstate(over="ignore"):
                    key[often] = mix(sig[often] + _SEGMENT * (1 + owner[often] % SALTS).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(_as_long(key)), pa.array(owner), pa.array(_as_long(sig), mask=~often)], ["_key", "_id", "_sig"])
    return docs.mapInArrow(emit, "_key bigint, _id bigint, _sig bigint")


def _runs(rows: DataFrame, tasks: int) -> DataFrame:
    """Members of runs of equal ``_key``: ``_sig``, ``_id``, and the id that leads their run. A lone member stays only if it is salted.

    The rows are sorted by Spark, by one number, and streamed: a task holds one batch and the last row before it. Should two signatures
    share a key, they are parted again by ``_sig`` where runs of one signature meet, and pairs are verified anyway.
    """
    names = ["_sig", "_id", "_first"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = held = None  # (key, leading id) of the open run; its only row, if it was not passed on yet
        for b in batches:
            if not b.num_rows:
                continue
            key, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            salted = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            sig = np.where(salted, b.column(2).fill_null(0).to_numpy(), key)
            new = np.concatenate([[run is None or run[0] != key[0]], key[1:] != key[:-1]])
            heads = np.concatenate([[run[1] if run else 0], ids[new]])[np.cumsum(new)]
            take = ~new | np.concatenate([~new[1:], [False]]) | salted
            if held is not None and not new[0]:
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*held, held[1])], names)
            run = (key[-1], heads[-1])
            held = (sig[-1], ids[-1]) if not take[-1] else None
            yield pa.RecordBatch.from_arrays(_arrays(sig[take], ids[take], heads[take]), names)
    return rows.repartition("_key").coalesce(tasks).sortWithinPartitions("_key").mapInArrow(stream, "_sig bigint, _id bigint, _first bigint")


def _verified(docs: DataFrame, pairs: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (``a``, ``b``) whose sets are similar, compared on the whole sets.

    ``a`` is sent once for every STAR of its pairs, each ``b`` once a pair; a task streams them and holds one ``a``.
    """
    n = pairs.count()
    counts = store(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_pairs")), tasks=tasks_for(n))
    copies = F.floor((F.col("_pairs") - 1) / F.lit(STAR)) + 1
    centres = counts.select(F.col("a").alias("_id"), F.col("a").alias("_to"), F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)).alias("_salt"), F.lit(0).alias("_role"))
    members = pairs.join(counts, "a").select(F.col("b").alias("_id"), F.col("a").alias("_to"), F.pmod(F.xxhash64("b"), copies).alias("_salt"), F.lit(1).alias("_role"))
    wanted = store(centres.unionAll(members))
    ids = store(wanted.select("_id").distinct(), tasks=tasks_for(2 * n))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shingle_sets(b.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in found], pa.binary())], ["_id", "_set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, []
        for b in batches:
            left, right = [], []
            for to, salt, role, node, raw in zip(*(b.column(i).to_pylist() for i in range(5))):
                s = np.frombuffer(raw, np.uint64)
                if (to, salt) != at:
                    at, centre = (to, salt), []
                if not role:
                    centre.append(s)
                elif any(sim.linked(len(c), len(s), len(np.intersect1d(c, s, assume_unique=True))) for c in centre):
                    left.append(to)
                    right.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    texts = _semi(docs, ids, "left_semi").mapInArrow(sets, "_id bigint, _set binary")
    small = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    sent = texts.join(F.broadcast(wanted) if small else wanted, "_id")
    sent = sent.select("_to", "_salt", "_role", "_id", "_set").repartition("_to", "_salt")
    sent = sent.coalesce(tasks_for(2 * n, SETS_EACH)).sortWithinPartitions("_to", "_salt", "_role")
    return store(sent.mapInArrow(compare, "a bigint, b bigint"))


def _sketched(pairs: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs that sizes and sketches cannot rule out."""
    left = sets.select(F.col("_id").alias("a"), F.col("_n").alias("_an"), F.col("_sketch").alias("_as"))
    right = sets.select(F.col("_id").alias("b"), F.col("_n").alias("_bn"), F.col("_sketch").alias("_bs"))

    @F.arrow_udf("boolean")
    def may(an: pa.Array, a: pa.Array, bn: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([may_link(*x, sim) for x in zip(an.to_pylist(), bn.to_pylist(), a.to_pylist(), b.to_pylist())], pa.bool_())

    met = pairs.join(left, "a").join(right, "b").filter(f"_an * {sim.p} <= _bn * {sim.q} AND _bn * {sim.p} <= _an * {sim.q}")
    return store(met.filter(may("_an", "_as", "_bn", "_bs")).select("a", "b").distinct(), tasks=tasks_for(pairs.count()))


def _tile(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches of ``words`` words or more as the rows of one array, the longer ones folded."""
    return np.array([_fold(np.frombuffer(s, np.uint64), words) for s in sketches]).reshape(-1, words)


def met_as_arrays(group: list, one_block: bool, sim: Similarity) -> Iterator[tuple[int, int]]:
    """The pairs of a large (run, block pair), sorted by size: a set meets many others at a time. Sketches do not get shorter with the size."""
    own, ids, of, n = (np.array([r[c] for r in group], np.int64) for c in (3, 4, 5, 6))
    heads = [frozenset(r[8]) for r in group]
    ends = np.searchsorted(n, [sim.largest_partner(int(x)) for x in n], "right")
    words = np.array([len(r[7]) // 8 for r in group])
    lo = 0
    while lo < len(group):
        step = max(1, TILE // int(words[lo]))
        hi = min(lo + step, int(np.searchsorted(words, words[lo], "right")))
        left = _tile([r[7] for r in group[lo:hi]], words[lo])
        for at in range(lo, int(ends[hi - 1]), step):
            stop = min(at + step, int(ends[hi - 1]))
            right = left if (at, stop) == (lo, hi) else _tile([r[7] for r in group[at:stop]], words[lo])
            for x in range(lo, hi):
                y = np.arange(max(at, x + 1), min(stop, int(ends[x])))
                y = y[(of[y] != of[x]) & (one_block | (own[y] != own[x]))]
                differ = np.bitwise_count(right[y - at] ^ left[x - lo]).sum(axis=1, dtype=np.int64)
                for k in y[differ <= sim.most_difference(n[x], n[y])].tolist():
                    if heads[x].isdisjoint(heads[k]):
                        yield (int(min(ids[x], ids[k])), int(max(ids[x], ids[k])))
        lo = hi


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs of one run in different components that sketches cannot rule out.

    A run longer than BLOCK is cut into blocks; two blocks meet in a task of their own, so no task holds a whole run.
    """
    n = members.count()
    rows = members.select("_sig", "_id").distinct().join(labels, F.col("_id") == F.col("node"), "left")
    rows = rows.select("_sig", "_id", F.coalesce("component", "_id").alias("_of"))
    rows = store(rows, tasks=tasks_for(n))
    runs = store(rows.groupBy("_sig").agg(F.count(F.lit(1)).alias("_rows"), F.min("_of").alias("_low"), F.max("_of").alias("_high")).filter("_low <> _high"), tasks=tasks_for(n))
    rows = store(rows.join(runs.select("_sig", "_rows"), "_sig"), tasks=tasks_for(n))
    n = rows.count()
    # two classes meet in the least signature they share: a class carries its HEADS least ones, and a run leaves a pair to an earlier one
    heads = rows.groupBy("_id").agg(F.slice(F.array_sort(F.collect_set("_sig")), 1, HEADS).alias("_heads"))
    carried = store(sets.select("_id", "_n", "_sketch").join(heads, "_id"), tasks=tasks_for(n))
    blocks = F.floor((F.col("_rows") - 1) / F.lit(BLOCK)) + 1
    rows = rows.join(carried, "_id").withColumn("_own", F.pmod(F.xxhash64("_id"), blocks))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    earlier = F.filter("_heads", lambda h: h < F.col("_sig"))
    rows = rows.select("_sig", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "_id", "_of", "_n",
                       "_sketch", earlier.alias("_heads"))

    def met(group: list) -> Iterator[tuple[int, int]]:
        """Pairs of a (run, block pair); sorted by size, a set meets only those that are not too large for it."""
        one_block = group[0][1] == group[0][2]
        if len(group) >= MANY:
            yield from met_as_arrays(sorted(group, key=lambda r: r[6]), one_block, sim)
            return
        group = [(*r[3:8], frozenset(r[8])) for r in sorted(group, key=lambda r: r[6])]
        for x, (own, a, of, n, s, heads) in enumerate(group):
            most = sim.largest_partner(n)
            for own2, b, of2, n2, s2, heads2 in group[x + 1:]:
                if n2 > most:
                    break
                if of != of2 and (one_block or own != own2) and heads.isdisjoint(heads2) and may_link(n, n2, s, s2, sim):
                    yield (min(a, b), max(a, b))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        for b in batches:
            out = set()
            for row in zip(*(b.column(i).to_pylist() for i in range(9))):
                if group and row[:3] != group[0][:3]:
                    out.update(met(group))
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])
        if group:
            out = set(met(group))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    keys = ["_sig", "_i", "_j"]
    return store(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a bigint, b bigint").distinct(), tasks=tasks_for(n))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sim: Similarity = Similarity()) -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``class_id`` (smallest id with the same set).

    * Null texts and texts without words have the empty set and no links; fewer than five words are one shingle.
    * Rows that share an id count as one document: what is linked to one of them is linked to all. Rows without an id sort last.
    * Repeated rows get equal rows. An empty table stays empty. Texts are read whole.
    * Shingles are compared as 64-bit hashes, equal sets as 128-bit digests.
    """
    out = _components_of(docs, id_col, text_col, sim)
    return out.select(given_id(F.col("_id")).alias(id_col), F.col("_n").alias("n_shingles"), given_id(F.col("_component")).alias("component_id"),
                      given_id(F.coalesce("_class", "_id")).alias("class_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sim: Similarity = Similarity()) -> DataFrame:
    """One document of each component stays, the one with the smallest id, with all its columns. Texts without words all stay."""
    gone = store(_components_of(docs, id_col, text_col, sim).filter("_id <> _component").select("_id").distinct())
    return by_id(docs, gone, "left_anti", id_col, text_col)


def _components_of(docs: DataFrame, id_col: str, text_col: str, sim: Similarity) -> DataFrame:
    """Of every row ``_id``, ``_n``, ``_class`` and ``_component``, in numbers of ``sort_id``."""
    spark = docs.sparkSession
    bounded_batches(spark, mb=4)
    rows = docs.select(sort_id(F.col(id_col), F.col(text_col)).alias("_id"), F.col(text_col).alias("_text"))
    scanned = store(scan_sets(rows))
    tasks = tasks_for(scanned.count())
    classes = store(scanned.filter("_n > 0").groupBy("_d1", "_d2", "_n").agg(F.min("_id").alias("_class"), F.count(F.lit(1)).alias("_copies")), tasks=tasks)
    owners = scanned.join(classes, ["_d1", "_d2", "_n"])
    sets = store(owners.filter("_id = _class").select("_id", "_n", "_sketch").distinct(), tasks=tasks)
    same = owners.select(F.col("_id").alias("a"), F.col("_class").alias("b"))

    # only the first document of each class goes on
    others = store(scanned.select("_id").join(sets.select("_id"), "_id", "left_anti").distinct(), tasks=tasks)
    firsts = _semi(rows, others, "left_anti")

    in_band = F.floor(F.log(F.col("_n").cast("double")) / math.log(BAND_RATIO) + 1e-9).cast("int")
    bands = sets.groupBy(in_band.alias("_band")).agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("shingles")).collect()
    filled = {r._band: r.n for r in bands}
    plan = {k: allocate(k, filled.get(k, 0), sim) for k in range(max(filled, default=0) + 1)}
    sample = firsts.filter(F.pmod(F.xxhash64("_id"), F.lit(SAMPLE)) == 0)
    often = (_emit_signatures(sample, plan, sim, None, everything=True).groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") >= SAMPLE_LEAST).orderBy(F.desc("n"), "_key").limit(FREQUENT).collect())
    frequent = spark.sparkContext.broadcast(np.array(sorted(r._key for r in often), np.int64).view(np.uint64))

    runs = store(_runs(_emit_signatures(firsts, plan, sim, frequent), tasks_for(sum(r.shingles for r in bands), SHINGLES_EACH)))
    members = tasks_for(runs.count())
    common = spark.createDataFrame([(int(x),) for x in frequent.value.view(np.int64)], "_sig bigint")
    # a frequent signature has a first member in every salt group; they meet the first of all
    firsts_of = store(runs.join(F.broadcast(common), "_sig", "left_semi").select("_sig", "_first").distinct(), tasks=members)
    least = firsts_of.groupBy("_sig").agg(F.min("_first").alias("_least"))
    star = runs.select(F.col("_first").alias("a"), F.col("_id").alias("b"))
    star = star.unionAll(firsts_of.join(least, "_sig").select(F.col("_least").alias("a"), F.col("_first").alias("b")))
    star = store(star.filter("a <> b").distinct(), tasks=members)
    links = _verified(rows, _sketched(star, sets, sim), sim)

    labels = store(components(links))
    rest = _across(runs, labels, sets, sim)
    more = _verified(rows, rest, sim)
    several = same.distinct().groupBy("a").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")  # an id with several texts
    found = store(components(links.unionAll(more).unionAll(same.join(several, "a", "left_semi").filter("a <> b"))))

    out = scanned.join(classes, ["_d1", "_d2", "_n"], "left").join(found, F.col("_class") == F.col("node"), "left")
    return out.select("_id", "_n", "_class", F.least(F.coalesce("component", "_class", "_id"), F.col("_id")).alias("_component"))


@query("op8_ngram_jaccard_join")
def op8_ngram_jaccard_join(spark, sf):
    return similar_groups(table(spark, sf, "documents").select("doc_id", "text")).drop("class_id")
