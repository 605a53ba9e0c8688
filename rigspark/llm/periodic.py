"""Periodic runs of words, found by recompression.

The words of a slice of documents become one row of numbers, a number of its own between documents. Rounds of recompression turn it into a
run-length grammar: a block round replaces every stretch of one symbol by (symbol, length); a pair round splits the symbols into a left
and a right half and replaces every left-right pair. Equal stretches are parsed alike but for a symbol at either end of each round, so the
longest common extension of two positions is found by climbing the rounds while symbols agree and going down again where they differ.

A run of period q and length 2q or more holds two neighbours of the grid 0, q, 2q, ... . Every neighbouring pair of equal words on the
grid of every q is a candidate (n/1 + n/2 + ... of them at most); its extensions to both sides give the run exactly. All steps work
on whole arrays of positions.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import bounded_batches, query, table

SLICE_WORDS = 1 << 19  # words of one grammar; a longer text has one of its own
CANDIDATES = 1 << 18  # pairs extended at a time
TOP = 16  # the grammar ends at so many symbols
SCHEMA = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string")


class Grammar:
    """Rounds of recompression over a row of numbers in which the first and last symbol occur once."""

    def __init__(self, row: np.ndarray):
        self.rows = [row.astype(np.int64)]
        #: per round: positions above, starts below, and the right half of the symbols (pair round) or the ends of stretches (block round)
        self.up: list[np.ndarray] = []
        self.down: list[np.ndarray] = []
        self.right: list[np.ndarray | None] = []
        self.names = int(row.max()) + 1 if len(row) else 0
        while len(self.rows[-1]) > TOP:
            self._blocks()
            self._pairs()

    def _add(self, keep: np.ndarray, right: np.ndarray | None) -> np.ndarray:
        self.up.append((np.cumsum(keep) - 1).astype(np.int32))
        starts = np.flatnonzero(keep)
        self.down.append(np.append(starts, len(keep)).astype(np.int32))
        self.right.append(right)
        return starts

    def _blocks(self) -> None:
        row = self.rows[-1]
        keep = np.concatenate([[True], row[1:] != row[:-1]])
        if keep.all():
            return
        starts = self._add(keep, None)
        lengths = np.diff(self.down[-1])
        out, long = row[starts], np.flatnonzero(lengths > 1)
        self._name(out, long, out[long], lengths[long])

    def _pairs(self) -> None:
        row = self.rows[-1]
        with np.errstate(over="ignore"):
            mixed = (row.astype(np.uint64) + np.uint64(2 * len(self.up) + 1)) * np.uint64(0x9E3779B97F4A7C15)
            right = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63) == 1
        first = np.flatnonzero(~right[:-1] & right[1:])
        keep = np.ones(len(row), bool)
        keep[first + 1] = False
        starts = self._add(keep, right)
        out = row[starts]
        self._name(out, self.up[-1][first], row[first], row[first + 1])

    def _name(self, out: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Equal pairs (a, b) get one new number each."""
        found, number = np.unique((a << 32) | b, return_inverse=True)
        out[at] = self.names + number
        self.names += len(found)
        self.rows.append(out)

    def extend(self, p: np.ndarray, q: np.ndarray, back: bool = False) -> np.ndarray:
        """How far the row agrees from ``p`` and from ``q`` on, or before them; ``p`` and ``q`` differ."""
        ps, qs = p.astype(np.int64), q.astype(np.int64)
        live, stopped, side = np.arange(len(ps)), [], -1 if back else 0

        def equal(k: int, which: np.ndarray) -> np.ndarray:
            return self.rows[k][ps[which] + side] == self.rows[k][qs[which] + side]

        def rest(k: int, at: np.ndarray) -> np.ndarray:
            """Symbols from ``at`` to the border of its stretch."""
            above = self.up[k][at + side]
            return at - self.down[k][above] if back else self.down[k][above + 1] - at

        def move(which: np.ndarray, by) -> None:
            ps[which] += -by if back else by
            qs[which] += -by if back else by

        for k in range(len(self.up)):
            same = equal(k, live)
            stop, live = live[~same], live[same]
            if self.right[k] is None:  # up to the border of the stretch, if both have equally far to go
                a, b = rest(k, ps[live]), rest(k, qs[live])
                move(live, np.minimum(a, b))
                stop, live = np.concatenate([stop, live[a != b]]), live[a == b]
            else:  # a symbol that may be the far half of a pair is passed by itself
                half = self.right[k][ps[live] + side]
                move(live[~half if back else half], 1)
            stopped.append(stop)
            if not len(live):
                break
            if back:
                ps[live], qs[live] = self.up[k][ps[live] - 1] + 1, self.up[k][qs[live] - 1] + 1
            else:
                ps[live], qs[live] = self.up[k][ps[live]], self.up[k][qs[live]]
        else:
            on = live
            while len(on := on[equal(len(self.up), on)]):
                move(on, 1)
        for k in range(len(stopped) - 1, -1, -1):  # those still under way are below round k + 1
            if len(live):
                ps[live], qs[live] = self.down[k][ps[live]], self.down[k][qs[live]]
                same = live[equal(k, live)]
                if self.right[k] is None:
                    move(same, np.minimum(rest(k, ps[same]), rest(k, qs[same])))
                else:
                    move(same, 1)
            live = np.concatenate([live, stopped[k]])
        return np.abs(ps - p)


def runs_of(row: np.ndarray, owner: np.ndarray, longest: int, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, in order of start and period.

    ``owner`` numbers the documents (borders are -1 and have symbols of their own), ``longest`` is the length of the longest one.
    """
    grammar, found, waiting, size = None, [], [], 0

    def flush() -> None:
        nonlocal grammar, waiting, size
        if waiting:
            grammar = grammar or Grammar(row)
            p = np.concatenate([x for x, _ in waiting])
            q = np.concatenate([np.full(len(x), w, np.int64) for x, w in waiting])
            before = grammar.extend(p, p + q, back=True)
            after = grammar.extend(p, p + q)
            ok = (before + after >= q) & (before + after + q >= least)
            found.append(np.unique(np.stack([(p - before)[ok], (p + q + after)[ok], q[ok]], 1), axis=0))
        waiting, size = [], 0

    for q in range(1, longest // 2 + 1):
        p = np.flatnonzero(row[:-q:q] == row[q::q]) * q
        p = p[owner[p] == owner[p + q]]
        if len(p):
            waiting.append((p, q))
            size += len(p)
            if size >= CANDIDATES:
                flush()
    flush()
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    table_ = np.unique(np.concatenate(found), axis=0)
    # a stretch that has several periods counts with the smallest
    first = np.concatenate([[True], (table_[1:, :2] != table_[:-1, :2]).any(1)]) if len(table_) else np.zeros(0, bool)
    table_ = table_[first]
    table_ = table_[np.lexsort((table_[:, 2], table_[:, 0]))]
    return table_[:, 0], table_[:, 1], table_[:, 2]


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """The word numbers of a document of ``n`` words: every tenth document, by the hash of its id, repeats a stretch to its end."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    at = np.arange(n)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def _slices(ids: list[int | None], texts: list[bytes | None], plant: bool) -> Iterator[tuple[list[int | None], list[list[bytes]]]]:
    some, words, size = [], [], 0
    for i, text in zip(ids, texts):
        mine = text.split() if text else []
        if plant and mine:
            at = planted(i, len(mine))
            mine = [mine[k] for k in at.tolist()]
        if words and size + len(mine) > SLICE_WORDS:
            yield some, words
            some, words, size = [], [], 0
        some.append(i)
        words.append(mine)
        size += len(mine)
    if words:
        yield some, words


def _judge(words: list[list[bytes]]) -> tuple[list[tuple], list[bytes]]:
    """Of each document: number of runs, the longest run, hash of the runs; and the text without repetitions."""
    counts = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(counts + 1) - counts  # a border before each document, and one at the end
    numbers: dict[bytes, int] = {}
    name = numbers.setdefault
    row = np.empty(int(counts.sum()) + len(words) + 1, np.int64)
    owner = np.full(len(row), -1, np.int64)
    for k, (w, f) in enumerate(zip(words, first.tolist())):
        row[f:f + len(w)] = [name(x, len(numbers)) for x in w]
        owner[f:f + len(w)] = k
    row[owner < 0] = len(numbers) + np.arange(len(words) + 1)
    start, end, period = runs_of(row, owner, int(counts.max(initial=0)))

    drop = np.zeros(len(row) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, end, -1)
    dropped = np.cumsum(drop)[:-1] > 0
    whose = owner[start]
    low, high = np.searchsorted(whose, np.arange(len(words))), np.searchsorted(whose, np.arange(len(words)), "right")
    base = first[whose] if len(whose) else start
    start, length = start - base, end - start
    out, texts = [], []
    for k, (w, f) in enumerate(zip(words, first.tolist())):
        mine = slice(low[k], high[k])
        rows = list(zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist()))
        best = min(rows, key=lambda r: (-r[1], r[0], r[2])) if rows else None
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in rows)
        gone = dropped[f:f + len(w)]
        texts.append(b" ".join(w) if not gone.any() else b" ".join(x for x, g in zip(w, gone.tolist()) if not g))
        out.append((len(rows), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest()))
    return out, texts


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, texts: bool = False) -> DataFrame:
    """One row per input row: the id (as a long), ``n_runs``, the longest run (``start``, ``length``, ``period``, ``exponent_milli``),
    ``runs_sha256`` and ``collapsed_sha256`` (of the words that no run repeats, joined by a space); with ``texts`` also ``collapsed``.

    A run is a stretch of words, maximal for its smallest period, of at least twelve words and two periods. Words are split at white space.

    * Null, empty or blank text: no words, no runs, the hashes of nothing. Without runs the four numbers of the longest one are null.
    * Of equally long runs the first counts, then the one of the smaller period. Repeated rows get equal rows; a null id stays null.
    * Texts are taken whole, however long. An empty table stays empty. ``plant`` repeats a stretch of every tenth document first.
    """
    bounded_batches(docs.sparkSession)
    schema = SCHEMA + (", collapsed string" if texts else "")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, words in _slices(b.column(0).to_pylist(), b.column(1).to_pylist(), plant):
                found, kept = _judge(words)
                columns = [pa.array(ids, pa.int64()), *(pa.array([f[k] for f in found], pa.int64()) for k in range(5)),
                           pa.array([f[5] for f in found], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
                if texts:
                    columns.append(pa.array([t.decode("utf-8", "replace") for t in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(scan, schema)
    return out.withColumnRenamed("doc_id", id_col)


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf):
    return periodic_runs(table(spark, sf, "documents").select("doc_id", "text"), plant=True)
