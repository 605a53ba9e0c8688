"""Hidden Markov scores and packing against plain versions."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rigspark.llm import hmm, packing
from rigspark.llm.base import held_out

from .tables import TEXTS, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


def small_model(states=3, classes=5, seed=1):
    rng = np.random.default_rng(seed)
    unit = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(unit(rng.random(states), 0), unit(rng.random((states, states)), 1), unit(rng.random((classes, states)), 0))


def test_recursions_equal_all_paths():
    m, rng = small_model(), np.random.default_rng(2)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 2, 5, 4, 5)]
    start, move, emit, scores = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for s in sequences:
        paths = {p: m.start[p[0]] * math.prod(m.move[a, b] for a, b in zip(p, p[1:])) * math.prod(m.emit[c, k] for c, k in zip(s, p))
                 for p in itertools.product(range(3), repeat=len(s))}
        total = sum(paths.values())
        scores.append(math.log10(total))
        for p, w in paths.items():
            start[p[0]] += w / total
            for a, b in zip(p, p[1:]):
                move[a, b] += w / total
            for c, k in zip(s, p):
                emit[c, k] += w / total
    assert np.allclose(hmm.likelihoods(m, sequences), scores)
    for got, want in zip(hmm.expected_counts(m, sequences), (start, move, emit)):
        assert np.allclose(got, want)


def test_stretches_hand_on_their_state(monkeypatch):
    sequences = [np.random.default_rng(n).integers(0, 5, n).astype(np.uint16) for n in (1, 9, 64, 65, 700)]
    whole = hmm.expected_counts(small_model(), sequences), hmm.likelihoods(small_model(), sequences)
    monkeypatch.setattr(hmm, "CHUNK_TOKENS", 32)
    assert all(np.allclose(x, y) for x, y in zip(whole[0], hmm.expected_counts(small_model(), sequences)))
    assert np.allclose(whole[1], hmm.likelihoods(small_model(), sequences))


def test_training_runs_through_a_long_text_once(spark):
    sequence = np.random.default_rng(3).integers(0, 5, 70_000).astype(np.uint16)
    counts = np.bincount(sequence, minlength=5).astype(float)
    v = hmm.Vocabulary(70_000, 5, 1, {}, {}, 4, counts, np.ones(5))
    settings = hmm.Settings(states=3, rounds=1)
    table = spark.createDataFrame([(False, bytearray(sequence.tobytes()), 0)], "_held boolean, _classes binary, _row bigint")
    got = hmm.baum_welch(table, v, settings)
    want = hmm.Model.from_counts(*hmm.expected_counts(hmm.Model.seeded(v, settings), [sequence])[:3], v)
    assert np.allclose(got.start, want.start) and np.allclose(got.move, want.move) and np.allclose(got.emit, want.emit)


def test_scores_do_not_depend_on_the_layout(spark, data):
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    settings = hmm.Settings(states=3, rounds=3)
    a, b = ({r.doc_id: r.score for r in hmm.hmm_scores(t, held_out("doc_id", 7, 2), settings=settings).collect()} for t in (texts.coalesce(1), texts.repartition(7)))
    assert a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-7)


def test_long_sequences_stay_finite():
    s = np.random.default_rng(1).integers(0, 5, 300_000).astype(np.uint16)
    assert np.isfinite(hmm.likelihoods(small_model(), [s, s[:7]])).all()


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_scores_on_awkward_rows(spark, frequent):
    table = docs(spark)
    got = hmm.hmm_scores(table, held_out("doc_id", 7, 2), settings=hmm.Settings(states=2, own_words=2, ending_classes=5, frequent_words=frequent, rounds=2)).collect()
    rows = [(i, (t or "").encode().lower().split() + [b" "], zlib.crc32(str("" if i is None else i).encode()) % 7 == 2) for i, t in TEXTS]
    c = Counter(w for _, words, held in rows if not held for w in words)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for i, w, held in rows)
    assert Counter((*tuple(r)[:5], round(r.base_score, 4)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_words_of_a_class_share_all_of_it(spark):
    """The model is a distribution: the probabilities of all one-word texts over a closed class, and of the unseen rest, add up."""
    table = spark.createDataFrame([(k, "ab cb db ab") for k in range(1, 9)], "doc_id bigint, text string")
    settings = hmm.Settings(states=2, own_words=1, ending_classes=1, frequent_words=10, rounds=2)
    asked = spark.createDataFrame([(100, "ab"), (101, "cb"), (102, "db"), (103, "zz"), (104, "")], "doc_id bigint, text string")
    got = {r.doc_id: 10 ** r.score for r in hmm.hmm_scores(table.unionAll(asked), F.col("doc_id") >= 100, settings=settings).collect() if r.doc_id >= 100}
    v = hmm.learn_vocabulary(hmm.count_words(table.select("text")), 8, settings)
    model_mass = 0.0  # of words of the ending class: counts + 1 each, and 1 for all unseen
    for word, c in Counter("ab cb db ab".split() * 8).items():
        if word.encode() not in v.own:
            model_mass += got[{"ab": 100, "cb": 101, "db": 102}[word]]
    ratio = got[103] / model_mass
    others = [c for w, c in Counter("ab cb db ab".split() * 8).items() if w.encode() not in v.own]
    assert math.isclose(ratio, 1 / sum(c + 1 for c in others), rel_tol=1e-9)


def test_no_training_rows_and_empty(spark):
    got = hmm.hmm_scores(docs(spark), F.lit(True)).collect()
    assert len(got) == len(TEXTS) and all(r.train_tokens == r.n_known == 0 and r.base_score == 0 for r in got)
    assert hmm.hmm_scores(docs(spark, []), held_out("doc_id", 7, 2)).count() == 0


def test_model_beats_the_base_on_held_out(spark, data):
    r = hmm.op6_lm_scoring(spark, data).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def test_ids_equal_the_tokenizer(spark, data):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += [t or "" for _, t in TEXTS] + ["  two  spaces\n end ", "x 　y\x1cz", "it's o'k  's", "<|endoftext|> x", "日本 語 ok"]
    encoder = packing.Encoder(PATH)
    assert [encoder.encode(t) for t in texts] == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_inside_a_text(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["<|endoftext|> x", "a<|endoftext|>", "a  <|endoftext|>  b<|endoftext|><|endoftext|>\n c", "<|endoftext|", "plain  text \n"] + [t or "" for _, t in TEXTS]
    encoder = packing.Encoder(PATH, added=True)
    assert [encoder.encode(t) for t in texts] == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = packing.pack_documents(docs(spark, list(enumerate(texts[:5]))), PATH).collect()
    want = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in enumerate(texts[:5])}
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_packing(spark):
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.pack_documents(docs(spark), PATH, capacity=64).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        start, piece = 0, 0
        while start < len(ids):
            length = (len(ids) - start) % 64 or 64
            want[(i, piece, start, length, zlib.crc32(ids[start:start + length].tobytes()))] += 1
            start, piece = start + length, piece + 1
    assert Counter(tuple(r)[:5] for r in got) == want
    check_packed(got, 64)
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0


def test_exchange_never_loses_and_meets_the_bound(spark):
    lengths = np.random.default_rng(4).integers(1, 60, 3000)
    rows = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES)
    got = packing.pack(rows, 100, 60).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter(enumerate(lengths.tolist()))
    values, counts = np.unique(lengths, return_counts=True)
    assert packing.bin_bound(values, counts, 100) <= check_packed(got, 100) <= 1.01 * packing.bin_bound(values, counts, 100) + 1


def test_bounds_and_best_fit():
    assert packing.bin_bound(np.array([51]), np.array([7]), 100) == 7
    assert packing.bin_bound(np.array([34]), np.array([9]), 100) == 5
    assert packing.bin_bound(np.array([60, 41]), np.array([3, 3]), 100) == 5
    assert packing.best_fit_decreasing([60, 50, 50, 40], 100) == ([0, 1, 1, 0], [0, 0, 50, 60], [0, 0])
