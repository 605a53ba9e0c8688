"""Task code on workers that cannot import this package; and stages and settings at their borders."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rigspark.llm import decontaminate as de, hmm, language, packing

from .tables import docs
from .test_texts import hits_by_hand

REPO = Path(__file__).resolve().parents[2]
CODE = """
import sys
sys.path.insert(0, {repo!r})
from rigspark.session import local_session
from rigspark import llm
spark = local_session(2, 2, "2g")
def absent(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("rigspark") is None, "the package is there"
        yield b
spark.range(4).mapInArrow(absent, "id bigint").count()
for name in {names!r}:
    n = llm.queries()[name](spark, {data!r}).count()
    print(name, n, flush=True)
"""
NAMES = [n for n in ("op2_benchmark_decontamination", "op6_lm_scoring", "op7_language_id", "op8_ngram_jaccard_join", "op9_best_fit_packing",
                     "op11_embedding_near_dedup", "op12_conversation_structure_repair", "op13_periodic_runs")]


def test_workers_need_no_copy_of_the_package(data, tmp_path):
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO), names=NAMES, data=data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == NAMES


def test_language_stage_keeps_texts_when_nothing_is_learned(spark):
    table = docs(spark)
    kept = corpus_pipeline.identify_language(spark, table.withColumn("lang", F.lit(None).cast("string")), "")
    lettered = [r for r in table.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert kept.columns == table.columns and kept.count() == len(lettered)
    assert corpus_pipeline.identify_language(spark, table.limit(0), "").count() == 0


def test_language_stage_rejects_noise_only(spark):
    english = "the house and the garden with the old tree and a long road to the town by the river "
    rows = [(k, english * 3, "en") for k in range(1, 40)] + [(90, "\u0436\u0448\u0449\u044a\u044d\u044e " * 60, None), (91, english, None), (92, "\u0436\u0448", None), (93, "12 " * 200, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    gone = {r[0] for r in rows} - {r.doc_id for r in corpus_pipeline.identify_language(spark, table, "").collect()}
    assert gone == {90, 93}


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([("i1", "shared line of text own line one short and more words here to be found")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs(spark), docs(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == table.columns and out.count() <= table.count()


def test_long_texts_without_spaces_have_no_false_word_ends():
    text = "".join(chr(97 + k * k % 23) for k in range(1000))
    whole, _ = language.bundle([text], language.Letters(64))
    parts, _ = language.bundle([text], language.Letters(64), most=100)
    assert (whole == parts).all()


@pytest.mark.parametrize("block_mb", [16, 0.00002])
def test_spans_do_not_depend_on_blocks(spark, block_mb):
    bench = spark.createDataFrame([("a", "one two three four"), ("b", "three four five six"), ("c", "zero seven"), (None, "nine ten")], "item_id string, text string")
    texts = ["zero one two three four five six seven", "x one two three four y", "zero seven nine ten", None, "zero one two three four seven"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = de.decontaminate(table, bench, remove="span", n=4, block_mb=block_mb).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["zero  seven", "x  y", "", None, "zero  seven"]


def test_blocks_hold_little_more_than_their_text():
    items = [(f"i{k}", [b"w%d" % (k * 7 % 5000 + j) for j in range(60)]) for k in range(3000)]
    block = de.Block.build(items, 10)
    kept = block.row.nbytes + block.begins.nbytes + sum(h.nbytes + p.nbytes for h, p in block.windows.values())
    assert kept <= 24 * len(block.row)
    text = b" ".join(items[17][1][5:30])
    counts, hits, found = block.scan([text])
    assert counts == [25] and hits == [list(range(25))] and "i17" in found[0]


def test_the_limit_of_frequent_words_is_filled(spark):
    words = [(f"w{k:03d}".encode(), 5) for k in range(60)] + [(b"top", 9)]
    counts = spark.createDataFrame([(bytearray(w), c) for w, c in words], "word binary, c bigint")
    for limit in (1, 20, 50, 100):
        v = hmm.learn_vocabulary(counts, 3, hmm.Settings(own_words=20, frequent_words=limit))
        assert list(v.frequent) == [w for w, _ in sorted(words, key=lambda x: (-x[1], x[0]))][:limit]
        assert len(v.own) == min(20, limit)


def test_partitions_are_certified_or_exchange(spark):
    lengths = np.random.default_rng(4).integers(1, 101, 3000).tolist()
    rows = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(lengths)], packing.PIECES)
    bound = packing.bin_bound(*np.unique(np.array(lengths), return_counts=True), 100)
    for partition in (500, 1000, 5000):
        got = packing.pack(rows, 100, partition).collect()
        assert len(got) == 3000
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by.values():
            places.sort()
            assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= 100
        assert len(by) <= bound * 1.02 + 1
