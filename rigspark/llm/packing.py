"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity`` tokens. Pieces are dealt evenly over partitions; each packs its pieces by best-fit
decreasing and knows from dual feasible functions how few bins its lengths can need. A partition that meets its bound is certified: its
bins settle, but for the few emptiest ones, which have the room of one sequence together. A partition with a gap hands over all its bins with room. While the bins in all exceed the bound of
the whole table, the bins handed over are dealt over further partitions, whole bins each, which pack their pieces again and keep the result
only if it needs fewer bins; that ends when a turn gains nothing. Partitions and histograms (one count per length) are of bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import bounded_batches, query, store, table

CAPACITY = 2048
SEPARATOR = 0
#: Pieces a partition packs at once, and how many times that an exchange packs: bins are saved in larger company.
PARTITION_PIECES, EXCHANGE = 16_384, 4
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# --- tokens ------------------------------------------------------------------

class Encoder:
    """Token ids in the vocabulary of a byte-level BPE file of ``tokenizers``.

    The merges of such a file are the order of its ids, so ``tiktoken`` gives the same ids from the same file, about four times as fast.
    With ``added`` the file's added tokens are read inside a text, as ``tokenizers`` does by default; without, their letters are encoded
    like any others, as it does with ``encode_special_tokens``.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        # byte-level vocabularies write printable bytes as themselves and the others from U+0100 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        if added and any(t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"an added token of {path} takes in what is around it; tiktoken has no such tokens")
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(letter[c] for c in w): i for w, i in vocabulary.items() if w not in special}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special if added else {})
        self.allowed = set(special) if added else set()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return np.array(self.encoding.encode(text or "", allowed_special=self.allowed, disallowed_special=()), "<u4").tobytes()


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Cut each document's ids, the separator at the end, into pieces: the first takes the remainder, the others are full."""
    bounded_batches(docs.sparkSession, mb=8)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, encoder = np.uint32(SEPARATOR).tobytes(), Encoder(vocabulary, added=True)
        for b in batches:
            ids, pieces, starts, lengths, crcs = [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                view = memoryview(encoder.encode(text) + end)
                total, start, piece = len(view) // 4, 0, 0
                while start < total:
                    length = (total - start) % capacity or capacity
                    ids.append(doc), pieces.append(piece), starts.append(start), lengths.append(length)
                    crcs.append(zlib.crc32(view[start * 4:(start + length) * 4]))
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                                              pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


# --- bins --------------------------------------------------------------------

def bin_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins that items of these lengths can need: the best of two families of dual feasible functions.

    A dual feasible function never gives the items of one bin more than 1 in all, so the sum over all items, rounded up, is a bound.
    """
    if not len(lengths):
        return 0
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((lengths * counts).sum()) // capacity)
    for k in range(1, 65):  # rounding: (k+1) x / C kept where it is whole, else rounded down over k
        scaled = (k + 1) * lengths
        value = np.where(scaled % capacity == 0, k * lengths, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    dense = np.bincount(lengths, weights=counts, minlength=capacity + 1).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(dense * np.arange(capacity + 1))])
    items = np.concatenate([[0], np.cumsum(dense)])
    for small in range(1, capacity // 2 + 1):  # threshold: below it nothing, above C - it a whole bin
        whole = int(items[-1] - items[capacity - small + 1])
        middle = int(tokens[capacity - small + 1] - tokens[small])
        best = max(best, whole - (-middle // capacity))
    return best


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Pack items given in decreasing order: bin of each, offset of each, and the room left in each bin."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, left, bins, offsets = 0, [], [], []
    for n in lengths:
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins.append(b)
        offsets.append(capacity - room)
        left[b] = room - n
        if left[b]:
            rooms[left[b]].append(b)
            open_rooms |= 1 << left[b]
    return bins, offsets, left


def _repack(table_: pa.Table, turn: int, capacity: int) -> pa.Table:
    """Pack one partition's pieces; ``open`` marks those of the bins it hands over: all with room, or, if its bound certifies it, only so
    many of the emptiest ones as have the room of one sequence together (less can't save a sequence elsewhere)."""
    length = table_.column("length").to_numpy()
    order = np.lexsort((table_.column("_row").to_numpy(), -length))
    table_ = table_.take(pa.array(order))
    length = length[order]
    bins, offsets, left = best_fit_decreasing(length.tolist(), capacity)
    part = table_.column("_part")[0].as_py()
    sequence = (np.int64(turn) << 56) + (np.int64(part) << 24) + np.array(bins, np.int64)
    offset, room = np.array(offsets, np.int64), np.array(left)[bins]
    if turn:
        old = table_.column("sequence_id").to_numpy()
        if len(np.unique(old)) <= len(left):  # no bin gained: as it was
            sequence, offset = old, table_.column("offset").to_numpy()
            used = {s: length[old == s].sum() for s in np.unique(old)}
            room = capacity - np.array([used[s] for s in old])
    names, first = np.unique(sequence, return_index=True)
    opened = room > 0
    if len(names) == bin_bound(*np.unique(length, return_counts=True), capacity):
        emptiest = np.argsort(-room[first], kind="stable")
        some = np.searchsorted(np.cumsum(room[first][emptiest]), capacity) + 1
        opened &= np.isin(sequence, names[emptiest[:some]])
    for name, values in (("sequence_id", sequence), ("offset", offset), ("open", opened)):
        table_ = table_.set_column(table_.schema.get_field_index(name), name, pa.array(values))
    return table_


def _packer(turn: int, capacity: int):
    def work(part: pa.Table) -> pa.Table:
        return _repack(part, turn, capacity)
    return work


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Place every piece (columns of PIECES) in a sequence: adds ``sequence_id`` and ``offset``.

    * Repeated pieces are placed one by one, ties go by their stored order. A null id is carried along. An empty table stays empty.
    * Offsets are gapless from 0 in every sequence; no sequence exceeds ``capacity``.
    """
    rows = store(pieces.withColumn("_row", F.monotonically_increasing_id()))
    total = rows.count()
    by_length = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"))  # at most ``capacity`` rows
    histogram = np.array([(r.length, r.n) for r in by_length.collect()], np.int64).reshape(-1, 2)
    bound = bin_bound(histogram[:, 0], histogram[:, 1], capacity)
    schema = f"{PIECES}, _row bigint, _part bigint, sequence_id bigint, offset bigint, open boolean"
    state = (rows.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(max(1, -(-total // partition_pieces))))).withColumn("sequence_id", F.lit(0).cast("bigint"))
             .withColumn("offset", F.lit(0).cast("bigint")).withColumn("open", F.lit(True)))
    done, settled_bins, before, turn = None, 0, None, 0
    while True:
        placed = store(state.groupBy("_part").applyInArrow(_packer(turn, capacity), schema))
        # every bin has one piece at offset 0
        found = {r.open: (r.pieces, r.bins) for r in placed.groupBy("open").agg(F.count(F.lit(1)).alias("pieces"), F.sum((F.col("offset") == 0).cast("int")).alias("bins")).collect()}
        open_pieces, open_bins = found.get(True, (0, 0))
        bins = settled_bins + open_bins + found.get(False, (0, 0))[1]
        if bins <= bound or bins == before or open_bins < 2:
            done = placed if done is None else done.unionAll(placed)
            break
        settled = placed.filter(~F.col("open"))
        done = settled if done is None else done.unionAll(settled)
        settled_bins, before, turn = bins - open_bins, bins, turn + 1
        parts = max(1, -(-open_pieces // (EXCHANGE * partition_pieces)))
        state = placed.filter("open").withColumn("_part", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(parts)))
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack. Null text counts as empty and holds the separator alone; long texts are encoded whole."""
    out = pack(token_pieces(docs, vocabulary, id_col, text_col, capacity), capacity)
    return out.withColumnRenamed("doc_id", id_col)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf):
    import public_tokenizers

    return pack_documents(table(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
