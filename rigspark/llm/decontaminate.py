"""Benchmark decontamination: a broadcast hash set of benchmark windows, scanned over the words of every document.

A window is ``n`` consecutive words of an item (all its words if it has fewer). Benchmark words get numbers; a document becomes a row of
word numbers, a rolling hash of every window is looked up among the sorted window hashes, and each hit is verified word by word.

The benchmark is read in blocks of bounded size and each block is broadcast on its own, so a benchmark of any size works: a document is
contaminated if any block says so. Long items are cut into pieces that overlap by ``n - 1`` words and lose no window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import bounded_batches, query, store, table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # after bytes.lower(), which changes A-Z only
PIECE_WORDS = 4096
MATCHES = 65_536  # windows verified at a time
SCAN = "struct<n_words:bigint,hits:array<int>,items:array<string>>"


def words_of(raw: bytes | None) -> list[bytes]:
    return WORD.findall(raw.lower()) if raw else []


@dataclass
class Block:
    """Windows of a part of the benchmark: word numbers (0 is any other word), the numbers of all its words in a row, the items and where
    they begin, and per window length the sorted window hashes with the windows' places in the row: some 16 bytes a word."""

    numbers: dict[bytes, int]
    row: np.ndarray
    names: list[str | None]
    begins: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def build(items: list[tuple[str | None, list[bytes]]], n: int) -> Block:
        numbers: dict[bytes, int] = {}
        row = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for _, words in items for w in words), np.uint32)
        sizes = np.array([len(words) for _, words in items], np.int64)
        begins = np.cumsum(sizes) - sizes
        windows = {}
        for size in np.unique(np.minimum(sizes, n)).tolist():
            if size:
                long = np.flatnonzero(sizes >= n if size == n else sizes == size)
                each = sizes[long] - size + 1
                places = np.repeat(begins[long] - np.cumsum(each) + each, each) + np.arange(each.sum())
                hashes = _hash([row[places + k] for k in range(size)])
                order = np.argsort(hashes, kind="stable")
                windows[size] = (hashes[order], places[order])
        return Block(numbers, row, [name for name, _ in items], begins, windows)

    def scan(self, texts: list[bytes | None]) -> tuple[list[int], list[list[int]], list[list[str]]]:
        """Per text: its words, the numbers of the words that lie in a hit, and the items hit."""
        words = [words_of(t) for t in texts]
        counts = [len(w) for w in words]
        ends = np.cumsum(counts, dtype=np.int64)
        ids = np.fromiter(map(self.numbers.get, chain.from_iterable(words), repeat(0)), np.uint32, int(ends[-1]) if counts else 0)
        hits: list[list[int]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        marked = np.zeros(len(ids) + 1, np.int64)
        for size, (hashes, places) in self.windows.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)  # windows of benchmark words only
            if not len(starts):
                continue
            h = _hash([ids[starts + k] for k in range(size)])
            low = np.searchsorted(hashes, h)
            on = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == h)
            starts, low, h = starts[on], low[on], h[on]
            doc = np.searchsorted(ends, starts, side="right")
            inside = starts + size <= ends[doc]
            starts, low, h, doc = starts[inside], low[inside], h[inside], doc[inside]
            for at in range(0, len(starts), MATCHES):  # a window may stand in many items
                a, d = starts[at:at + MATCHES], doc[at:at + MATCHES]
                each = np.searchsorted(hashes, h[at:at + MATCHES], side="right") - low[at:at + MATCHES]
                which = np.repeat(np.arange(len(a)), each)
                place = places[np.repeat(low[at:at + MATCHES] - np.cumsum(each) + each, each) + np.arange(each.sum())]
                same = np.ones(len(which), bool)
                for k in range(size):
                    same &= ids[a[which] + k] == self.row[place + k]
                which, place = which[same], place[same]
                found = np.unique(a[which])
                np.add.at(marked, found, 1)
                np.add.at(marked, found + size, -1)
                item = np.searchsorted(self.begins, place, side="right") - 1
                for x, i in np.unique(np.stack([d[which], item], 1), axis=0).tolist() if len(which) else ():
                    if self.names[i] is not None:
                        items[x].add(self.names[i])
        at = np.flatnonzero(np.cumsum(marked[:-1]) > 0)
        for i, d in zip(at.tolist(), np.searchsorted(ends, at, side="right").tolist()):
            hits[d].append(i - (int(ends[d]) - counts[d]))
        return counts, hits, [sorted(x) for x in items]


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out + c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def blocks_of(bench: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text", block_mb: float = 16) -> tuple[int, Iterator]:
    """How many broadcast blocks of about ``block_mb`` of text the benchmark needs, and the blocks, each made when it is asked for.

    Null or wordless items have no window. Equal ids are one item. An item without an id still marks words, and is named nowhere.
    """
    spark = bench.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                step = PIECE_WORDS - n + 1
                for i in range(0, max(len(words) - n + 1, 1), step) if words else ():
                    rows.append((item, i, b" ".join(words[i:i + PIECE_WORDS])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.binary())], ["item", "at", "words"])

    cut = store(bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
                .mapInArrow(pieces, "item string, at bigint, words binary"))
    size = cut.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_blocks = max(1, -(-size // int(block_mb * (1 << 20))))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("item", "at"), F.lit(n_blocks)))

    def blocks() -> Iterator:
        for k in range(n_blocks):
            rows = cut.filter(F.col("block") == k).select("item", "words").collect()  # bounded by block_mb
            # plain values, which workers read without this package
            yield spark.sparkContext.broadcast(vars(Block.build([(r.item, bytes(r.words).split(b" ")) for r in rows], n)))
    return n_blocks, blocks()


def _scanner(block):
    @F.arrow_udf(SCAN)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            counts, hits, items = Block(**block.value).scan(t.cast(pa.binary()).to_pylist())
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                                              pa.array(items, pa.list_(pa.string()))], ["n_words", "hits", "items"])
    return scan


def scan_benchmark(docs: DataFrame, bench: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   block_mb: float = 16) -> DataFrame:
    """One row per document: the id, ``n_words``, ``hits`` (numbers of the words inside a hit), ``items`` (ids as strings, sorted).

    * Null text has no words. Repeated rows are scanned one by one; null ids stay. An empty benchmark hits nothing.
    * Long texts are scanned whole; a task holds one batch of bounded size, or one long text.
    """
    bounded_batches(docs.sparkSession)
    n_blocks, blocks = blocks_of(bench, n, block_mb=block_mb)
    if n_blocks == 1:
        out = docs.select(F.col(id_col).alias("_id"), _scanner(next(blocks))(F.col(text_col)).alias("_scan"))
        return out.select(F.col("_id").alias(id_col), "_scan.n_words", "_scan.hits", "_scan.items")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_given"))
    return _all_hits(rows, blocks).select(F.col("_id").alias(id_col), "n_words", F.array_sort("_hits").alias("hits"), F.array_sort("_items").alias("items"))


def _all_hits(rows: DataFrame, blocks: Iterator) -> DataFrame:
    """Rows with the hits and items of all blocks (``n_words``, ``_hits``, ``_items``): one stored pass a block, one block alive at a time."""
    d = rows.withColumns({"n_words": F.lit(0).cast("bigint"), "_hits": F.array().cast("array<int>"), "_items": F.array().cast("array<string>")})
    for block in blocks:
        scanned = d.withColumn("_scan", _scanner(block)("_given"))
        d = store(scanned.withColumns({"n_words": F.col("_scan.n_words"), "_hits": F.array_union("_hits", "_scan.hits"),
                                       "_items": F.array_union("_items", "_scan.items")}).drop("_scan"))
        block.destroy()
    return d


def _without(raw: bytes, hits: list[int]) -> bytes:
    """Cut each run of hit words out, from its first byte to its last."""
    inside, out, last = set(hits), [], 0
    spans: list[list[int]] = []
    for i, m in enumerate(WORD.finditer(raw.lower())):
        if i in inside:
            if spans and i - 1 in inside:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
    for a, b in spans:
        out.append(raw[last:a])
        last = b
    return b"".join([*out, raw[last:]])


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "document", n: int = 10, text_col: str = "text", block_mb: float = 16) -> DataFrame:
    """Remove contaminated documents (``remove="document"``) or the hit words and what lies between them (``"span"``). All columns stay.

    Null texts, repeated rows and extra columns pass through unchanged. Hits are looked for in the whole given text by all blocks, then cut
    at once, so ``block_mb`` does not change the result.
    """
    if remove not in ("document", "span"):
        raise ValueError(f"remove must be 'document' or 'span', not {remove!r}")
    bounded_batches(docs.sparkSession)
    n_blocks, blocks = blocks_of(bench, n, block_mb=block_mb)
    if n_blocks == 1:
        if remove == "document":
            return docs.filter(F.size(_scanner(next(blocks))(docs[text_col])["hits"]) == 0)
        return docs.withColumn(text_col, _cutter()(docs[text_col], _scanner(next(blocks))(docs[text_col])["hits"]))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text_col].alias("_given"))
    found = _all_hits(rows, blocks)
    if remove == "document":
        found = found.filter(F.size("_hits") == 0)
        return found.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
    text = _cutter()("_given", "_hits")
    return found.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def _cutter():
    @F.arrow_udf("string")
    def cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([_without(r, h) if h else r for r, h in zip(texts.cast(pa.binary()).to_pylist(), hits.to_pylist())], pa.binary()).cast(pa.string())
    return cut


@query("op2_benchmark_decontamination", r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
sizes AS (SELECT DISTINCT n FROM bl),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, i, item_id FROM dwin JOIN win USING (n, k)),
nh AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)""")
def op2_benchmark_decontamination(spark, sf):
    found = scan_benchmark(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
