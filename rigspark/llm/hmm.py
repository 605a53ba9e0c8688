"""Language-model scores by a hidden Markov model.

Latent states emit word classes, and a class emits its words: P(word | state) = P(class | state) * P(word | class). The ``own_words`` most
frequent training words are classes of their own; every other word, seen or not, belongs to the class of its last letters, where it has the
share (c + 1) / (tokens + words + 1) by its count, and any unseen word the share of the one unknown word of its class. So the model is a
distribution over texts of training words and one unknown word a class. Its tables for the states are of fixed
size, and the counts of all words stay a distributed table: texts meet it by a join, except for the most frequent words, a bounded list.

Training is Baum-Welch: in every round every partition runs the scaled forward-backward recursion over all its training texts, expected
counts are summed over all partitions, and the driver holds the K x classes parameters only. Recursions go over whole texts, whatever
their length: a very long one is gone through in stretches that hand on their state, so memory holds one stretch.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import bounded_batches, held_out, query, store, table

FLUSH_WORDS = 300_000
#: Tokens of one vectorised recursion, or of a stretch of a longer text; and time steps from one scaling to the next.
CHUNK_TOKENS, SCALE_STEPS = 1_000_000, 8


@dataclass(frozen=True)
class Settings:
    states: int = 8
    own_words: int = 4096
    ending_classes: int = 2048
    #: At most so many of the most frequent words have their counts broadcast (about 6 MB); the others are joined.
    frequent_words: int = 131_072
    #: Baum-Welch rounds. Each reads all training texts.
    rounds: int = 8
    seed: int = 6


def tokens_of(raw: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case: exactly what bytes.lower and bytes.split do."""
    return raw.lower().split() if raw else []


def count_words(texts: DataFrame) -> DataFrame:
    """``word``, ``c`` over a column of texts; a task hands on its counts whenever it holds FLUSH_WORDS of them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for b in batches:
            for raw in b.column(0).cast(pa.binary()).to_pylist():
                counts.update(tokens_of(raw))
                if len(counts) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    return texts.mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Training totals, the frequent words, and the classes."""

    tokens: int  # N, ends included
    words: int  # V, the end included
    ends: int
    own: dict[bytes, int]
    frequent: dict[bytes, int]
    endings: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.own) + self.endings + 1

    def class_of(self, word: bytes) -> int:
        k = self.own.get(word)
        return k if k is not None else len(self.own) + zlib.crc32(word[-3:]) % self.endings


def learn_vocabulary(counts: DataFrame, ends: int, s: Settings) -> Vocabulary:
    # a histogram of counts in sixteenths of a power of two shows how low a count may be without naming too many words
    step = F.floor(F.log2("c") * 16).cast("int")
    least, last, total = None, None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if total + r.n > s.frequent_words:
            last = r.step
            break
        total += r.n
        least = r.step
    named = counts.filter(step >= least).collect() if least is not None else []
    if last is not None and total < s.frequent_words:  # the step that goes beyond the limit fills it up, ties in order of words
        named += counts.filter(step == last).orderBy(F.desc("c"), "word").limit(s.frequent_words - total).collect()
    frequent = dict(sorted(((bytes(r.word), r.c) for r in named), key=lambda x: (-x[1], x[0])))
    own = {w: k for k, w in enumerate(list(frequent)[: s.own_words])}
    v = Vocabulary(0, 0, ends, own, frequent, s.ending_classes, np.zeros(0), np.zeros(0))
    shared = counts.sparkSession.sparkContext.broadcast((own, s.ending_classes))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, endings = shared.value
        me = Vocabulary(0, 0, 0, own, {}, endings, np.zeros(0), np.zeros(0))
        n, w = np.zeros(me.classes, np.int64), np.zeros(me.classes, np.int64)
        for b in batches:
            k = np.array([me.class_of(x) for x in b.column(0).to_pylist()], np.int64)
            np.add.at(n, k, b.column(1).to_numpy())
            np.add.at(w, k, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(w)], ["k", "n", "w"])

    rows = counts.mapInArrow(sums, "k bigint, n bigint, w bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    v.class_tokens, v.class_words = np.zeros(v.classes), np.zeros(v.classes)
    for r in rows.collect():
        v.class_tokens[r.k], v.class_words[r.k] = r.n, r.w
    v.class_tokens[-1], v.class_words[-1] = ends, 1 if ends else 0
    v.tokens, v.words = int(v.class_tokens.sum()), int(v.class_words.sum())
    return v


ENCODED = ("_id bigint, _held boolean, _classes binary, _tokens bigint, _known bigint, _sum double, _inner double, _outer double, "
           "_rare array<struct<word:binary,n:int>>")


def encode(docs: DataFrame, vocabulary) -> DataFrame:
    """Per text (``_id``, ``_held``, ``_given``) its class sequence, the sums its frequent words give, and its other words with their counts.

    ``vocabulary`` is a broadcast of the fields of a ``Vocabulary``: plain values, which workers read without this package.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(**vocabulary.value)
        share = np.log10(v.class_tokens + v.class_words + 1).tolist()  # below a word's count in its class
        known_words = {w: (v.class_of(w), math.log10(c + 1)) for w, c in v.frequent.items()}
        first_ending, end = len(v.own), v.classes - 1
        for b in batches:
            classes, n_tokens, n_known, sums, inners, outers = [], [], [], [], [], []
            rare_words, rare_counts, rare_ends = [], [], [0]
            for raw in b.column(2).cast(pa.binary()).to_pylist():
                words = tokens_of(raw)
                class_of, known, total, inner, outer = {}, int(v.ends > 0), math.log10(v.ends + 1), 0.0, 0.0
                for w, n in Counter(words).items():
                    found = known_words.get(w)
                    if found is None:
                        rare_words.append(w)
                        rare_counts.append(n)
                        k = v.class_of(w)
                        outer += n * share[k]
                    else:
                        k, log = found
                        known += n
                        total += n * log
                        if k >= first_ending:
                            outer += n * share[k]
                            inner += n * log
                    class_of[w] = k
                rare_ends.append(len(rare_words))
                sequence = array("H", map(class_of.__getitem__, words))
                sequence.append(end)
                for column, x in zip((classes, n_tokens, n_known, sums, inners, outers), (sequence.tobytes(), len(sequence), known, total, inner, outer)):
                    column.append(x)
            rare = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int32())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(classes, pa.binary()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                 *(pa.array(x, pa.float64()) for x in (sums, inners, outers)), pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), rare)],
                ["_id", "_held", "_classes", "_tokens", "_known", "_sum", "_inner", "_outer", "_rare"])
    return docs.mapInArrow(code, ENCODED)


# --- the model ---------------------------------------------------------------

@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # classes x K

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.start, self.move, self.emit

    @staticmethod
    def seeded(v: Vocabulary, s: Settings) -> Model:
        """Every state begins near the shares of the classes; random factors tell them apart, and states tend to stay."""
        rng = np.random.Generator(np.random.Philox(key=s.seed))
        emit = Model.shares(v)[:, None] * rng.gamma(2.0, 0.5, (v.classes, s.states))
        move = np.full((s.states, s.states), 0.1 / max(s.states - 1, 1))
        np.fill_diagonal(move, 0.9 if s.states > 1 else 1.0)
        return Model(np.full(s.states, 1 / s.states), move, emit / emit.sum(0))

    @staticmethod
    def shares(v: Vocabulary) -> np.ndarray:
        return (v.class_tokens + 0.5) / (v.class_tokens + 0.5).sum()

    @staticmethod
    def from_counts(start, move, emit, v: Vocabulary) -> Model:
        """Expected counts with a little of the overall shares mixed in, so that nothing is impossible."""
        start, move = start + 1.0, move + 1.0
        emit = emit + 5.0 * Model.shares(v)[:, None] + 1e-6 * emit.sum(0)[None, :] * Model.shares(v)[:, None]
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _chunks(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of sequences of similar length, longest first: CHUNK_TOKENS tokens at most, or one sequence."""
    order, chunk, tokens = sorted(range(len(sequences)), key=lambda i: -len(sequences[i])), [], 0
    for i in order:
        if chunk and tokens + len(sequences[i]) > CHUNK_TOKENS:
            yield chunk
            chunk, tokens = [], 0
        chunk.append(i)
        tokens += len(sequences[i])
    if chunk:
        yield chunk


@dataclass
class _Packed:
    """Sequences, longest first, time by time: at time ``t`` the classes of the first ``alive[t]`` stand from ``first[t]`` on."""

    codes: np.ndarray
    alive: list[int]
    first: list[int]
    last: np.ndarray  # where each sequence has its last class
    stretches: list[tuple[int, int]]

    @staticmethod
    def of(sequences: list[np.ndarray]) -> _Packed:
        lengths = np.array([len(x) for x in sequences])
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        first = np.concatenate([[0], np.cumsum(alive)])
        codes = np.empty(first[-1], np.uint16 if first[-1] > CHUNK_TOKENS else np.intp)
        for i, x in enumerate(sequences):
            codes[first[: len(x)] + i] = x
        steps = len(alive) if first[-1] <= CHUNK_TOKENS else max(1, CHUNK_TOKENS // len(sequences))
        return _Packed(codes, alive.tolist(), first.tolist(), first[lengths - 1] + np.arange(len(sequences)),
                       [(t, min(t + steps, len(alive))) for t in range(0, len(alive), steps)])

    def slice(self, stretch: tuple[int, int]) -> np.ndarray:
        return self.codes[self.first[stretch[0]]:self.first[stretch[1]]]


class _Space:
    """Arrays of states by place that one chunk after another uses: fresh memory costs more than the sums."""

    def __init__(self, states: int, arrays: int):
        self.states, self.flat = states, [np.empty(0) for _ in range(arrays)]

    def array(self, i: int, places: int) -> np.ndarray:
        if len(self.flat[i]) < self.states * places:
            self.flat[i] = np.empty(self.states * places)
        return self.flat[i][: self.states * places].reshape(self.states, places)


def _forward(m: Model, p: _Packed, stretch: tuple[int, int], emitted: np.ndarray, out: np.ndarray, alpha: np.ndarray | None):
    """The recursion through a stretch, from ``alpha`` before it, into ``out`` (states by place); the last alpha and the scales by time."""
    move, start, base, scales = np.ascontiguousarray(m.move.T), m.start[:, None], p.first[stretch[0]], {}
    for t in range(*stretch):
        at, n = p.first[t] - base, p.alive[t]
        now = out[:, at:at + n]
        np.multiply(emitted[:, at:at + n], start if alpha is None else move @ alpha[:, :n], out=now)
        if t % SCALE_STEPS == SCALE_STEPS - 1:
            scales[t] = now.sum(0)
            now /= scales[t]
        alpha = now
    return alpha.copy(), scales


def likelihoods(m: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 P of each class sequence by the scaled forward recursion; memory for the states does not grow with the length."""
    out, emit, space = np.zeros(len(sequences)), np.ascontiguousarray(m.emit.T), _Space(len(m.start), 1)
    for chunk in _chunks(sequences):
        p, alpha, total = _Packed.of([sequences[i] for i in chunk]), None, np.zeros(len(chunk))
        for stretch in p.stretches:
            codes = p.slice(stretch)
            emitted = emit.take(codes, axis=1, out=space.array(0, len(codes)), mode="clip")
            alpha, scales = _forward(m, p, stretch, emitted, emitted, alpha)
            for c in scales.values():
                total[:len(c)] += np.log10(c)
            from_, to = p.first[stretch[0]], p.first[stretch[1]]
            ends = np.flatnonzero((p.last >= from_) & (p.last < to))
            total[ends] += np.log10(emitted[:, p.last[ends] - from_].sum(0))
        out[chunk] = total
    return out


def expected_counts(m: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions by the scaled forward-backward recursion over whole sequences; and log10 P of them all.

    States enter by their ratios only, so the emissions of a class are divided by their largest, and what is left stays near one.
    """
    states, classes = len(m.start), len(m.emit)
    start, move, emit, total = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes)), 0.0
    largest = m.emit.max(1)
    logs, emit_of, space = np.log10(largest), np.ascontiguousarray((m.emit / largest[:, None]).T), _Space(states, 2)
    for chunk in _chunks(sequences):
        p = _Packed.of([sequences[i] for i in chunk])
        total += float(logs.take(p.codes).sum())
        entries = [None]  # alpha before each stretch
        for stretch in p.stretches[:-1]:
            codes = p.slice(stretch)
            emitted = emit_of.take(codes, axis=1, out=space.array(0, len(codes)), mode="clip")
            entries.append(_forward(m, p, stretch, emitted, emitted, entries[-1])[0])
        beta, ahead, later = np.ones((states, len(chunk))), None, 0
        for stretch, entry in zip(reversed(p.stretches), reversed(entries)):
            codes, base = p.slice(stretch), p.first[stretch[0]]
            emitted = emit_of.take(codes, axis=1, out=space.array(0, len(codes)), mode="clip")
            alphas = space.array(1, len(codes))
            _, scales = _forward(m, p, stretch, emitted, alphas, entry)
            total += sum(float(np.log10(c).sum()) for c in scales.values())
            for t in range(stretch[1] - 1, stretch[0] - 1, -1):
                at, n = p.first[t] - base, p.alive[t]
                alpha, ends = alphas[:, at:at + n], n - later
                if later:
                    move += alpha[:, :later] @ ahead.T
                    np.matmul(m.move, ahead, out=beta[:, :later])
                if ends:  # here sequences end: the states of their last class add up to one
                    last = alpha[:, later:].sum(0)
                    total += float(np.log10(last).sum())
                    beta[:, later:n] = 1 / last
                alpha *= beta[:, :n]  # now the probability of each state
                ahead, later = emitted[:, at:at + n], n
                ahead *= beta[:, :n]
                if t in scales:
                    ahead /= scales[t]
            ahead = ahead.copy()  # the next stretch takes its place
            for k in range(states):
                emit[k] += np.bincount(codes, weights=alphas[k], minlength=classes)
        start += alphas[:, :p.alive[0]].sum(1)
    return start, move * m.move, np.ascontiguousarray(emit.T), total


def baum_welch(encoded: DataFrame, v: Vocabulary, s: Settings, history: list[float] | None = None) -> Model:
    """Rounds of expected counts over the stored class sequences of all training texts.

    ``history`` gets log10 P of the class sequences under the model that each round began with.
    """
    spark = encoded.sparkSession
    model = Model.seeded(v, s)
    train = encoded.filter(~F.col("_held")).select("_classes")
    k = s.states
    for _ in range(s.rounds):
        shared = spark.sparkContext.broadcast(model.parts())

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, total = Model(*shared.value), None
            for b in batches:
                sequences = [np.frombuffer(x, np.uint16) for x in b.column(0).to_pylist()]
                found = np.concatenate([np.ravel(x) for x in expected_counts(m, sequences)]) if sequences else None
                total = found if total is None else total if found is None else total + found
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

        sums = train.mapInArrow(expect, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
        if sums:
            total = np.zeros(k + k * k + v.classes * k + 1)
            total[[x.at for x in sums]] = [x.n for x in sums]
            if history is not None:
                history.append(float(total[-1]))
            model = Model.from_counts(total[:k], total[k:k + k * k].reshape(k, k), total[k + k * k:-1].reshape(v.classes, k), v)
        shared.destroy()
    return model


def hmm_scores(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Learn from the rows where ``held`` is false and score every row.

    Returns the id, ``held_out``, ``n_tokens`` (words and one end), ``n_known``, ``train_tokens``, ``base_score`` (add-one unigram) and
    ``score``, both log10 probabilities of the whole text.

    * Null and empty texts are an end alone. Repeated rows are scored, and counted in training, one by one. Null ids stay.
    * No training rows: every word is unknown, the base score is 0, classes are equally likely. An empty table stays empty.
    * Every round reads all training texts; neither training nor scoring cuts a text.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark, mb=8)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), held.alias("_held"), F.col(text_col).alias("_given"))
    counts = store(count_words(rows.filter(~F.col("_held")).select("_given")))
    ends = rows.filter(~F.col("_held")).count()
    v = learn_vocabulary(counts, ends, settings)
    encoded = encode(rows, spark.sparkContext.broadcast(vars(v))).withColumn("_row", F.monotonically_increasing_id())
    encoded = store(encoded.sortWithinPartitions(F.desc("_tokens")))  # texts of like length are gone through together
    model = baum_welch(encoded, v, settings)

    # words outside the broadcast list meet their counts by a join; a text names each of them once
    rare = encoded.select("_row", F.explode("_rare").alias("_word")).select("_row", F.col("_word.word").alias("word"), F.col("_word.n").alias("n"))
    rare = rare.join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("_more"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("_also"))

    shared = spark.sparkContext.broadcast(model.parts())

    @F.arrow_udf("double")
    def sequence_score(classes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in classes:
            yield pa.array(likelihoods(Model(*shared.value), [np.frombuffer(x, np.uint16) for x in c.to_pylist()]), pa.float64())

    scored = encoded.select("_row", "_id", "_held", "_tokens", "_known", "_sum", "_inner", "_outer", sequence_score("_classes").alias("_sequence"))
    scored = scored.join(rare, "_row", "left")
    more, scale = F.coalesce("_more", F.lit(0.0)), float(np.log10(v.tokens + v.words + 1))
    return scored.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), F.col("_tokens").alias("n_tokens"),
                         (F.col("_known") + F.coalesce("_also", F.lit(0))).cast("bigint").alias("n_known"),
                         F.lit(v.tokens).cast("bigint").alias("train_tokens"),
                         (F.col("_sum") + more - F.col("_tokens") * scale).alias("base_score"),
                         (F.col("_sequence") + F.col("_inner") + more - F.col("_outer")).alias("score"))


@query("op6_lm_scoring")
def op6_lm_scoring(spark, sf):
    return hmm_scores(table(spark, sf, "documents").select("doc_id", "text"), held_out("doc_id", 7, 2))
