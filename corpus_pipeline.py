"""From raw documents to packed training sequences: the stages of a text pipeline, each on all rows the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rigspark.llm.base import held_out, store, table
from rigspark.llm.decontaminate import decontaminate
from rigspark.llm.exact_dedup import exact_dedup
from rigspark.llm.jaccard_join import near_dedup
from rigspark.llm.language import language_of, train_languages
from rigspark.llm.packing import pack_documents


#: A text of so many characters whose cosine with every learned language is below this is in none of them; shorter ones tell too little.
LEAST_COSINE, ENOUGH_CHARS = 0.05, 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject null texts, texts without a letter, and texts of ENOUGH_CHARS that are like no learned language (noise, other languages).

    Where no row has a language to learn from, nothing can be unlike it: texts with a letter stay.
    """
    learned = train_languages(docs.filter(~held_out("doc_id", 3, 1)))
    judged = language_of(learned)(docs["text"])
    keep = judged["lettered"]
    if learned:
        keep = keep & ((judged["score"] >= LEAST_COSINE) | (F.char_length(docs["text"]) < ENOUGH_CHARS))
    return docs.filter(keep)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest original stays."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar shingle sets connect, the one with the smallest id stays."""
    return near_dedup(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove documents that hold a window of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language id", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Language identification and packing have no SQL equivalent; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
