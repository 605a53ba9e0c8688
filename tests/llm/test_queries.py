"""Registered queries: equal to their SQL on whole tables, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from rigspark import llm
from rigspark.llm.base import store
from tests.oracle import compare, duck

QUERIES, ORACLES = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, name):
    assert compare(spark, duck(data), QUERIES[name], ORACLES[name], data) is None


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_equals_plain_version(spark, data):
    """Each stage against a plain computation on its own input."""
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from .test_groups import components_by_hand
    from .test_texts import hits_by_hand

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, [r.asDict() for r in docs.collect()]
    bench = pq.read_table(f"{data}/benchmark.parquet").to_pylist()
    plain = {
        "language id": lambda rows: [r for r in rows if any(c.isalpha() for c in r["text"] or "")],
        "exact dedup": lambda rows: list({"".join((r["text"] or "").split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None}): r
                                          for r in sorted(rows, key=lambda r: (len(r["text"] or ""), -r["doc_id"]))}.values()),
        "near dedup": lambda rows: (lambda c: [r for r in rows if c[r["doc_id"]][1] == r["doc_id"]])(components_by_hand([(r["doc_id"], r["text"]) for r in rows])),
        "decontamination": lambda rows: [r for r in rows if not hits_by_hand(r["text"], bench)[0]],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, kept = store(stage(spark, docs, data)), plain[name](kept)
        assert docs.columns == columns
        assert sorted(r.doc_id for r in docs.collect()) == sorted(r["doc_id"] for r in kept), name
    packed = corpus_pipeline.run(spark, data).groupBy("doc_id").sum("length").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r[0]: r[1] for r in packed} == {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept}
